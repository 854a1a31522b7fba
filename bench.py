"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

ranking, subquery and text operators. Each is run once to warm up, then three times; the median
counts. Rows scanned per second are given for the shapes that the baseline states a rate for.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tessera import queries as catalogue

HEADLINE = (
    "index_point_lookup", "filter_compare_literal", "filter_compare_columns", "inner_join", "hash_join_hint", "merge_join_hint",
    "multiway_join", "join_aggregate", "agg_group_by", "having", "window_row_number", "scalar_subquery", "semi_join_exists",
    "anti_join_not_exists", "contains_word", "json_extract_text", "top_k", "recursive_cte", "interval_join",
)
#: Single-row INSERT statements timed on a fresh table: in auto-commit, and in one transaction.
INSERTS = (5, 100)
RUNS = 3


def insert_rates(spark: SparkSession) -> dict[str, float]:
    session = catalogue._stored(spark, "")
    catalogue._must(session, "CREATE TABLE bench (id INT, x DOUBLE, name VARCHAR)", "INSERT INTO bench VALUES (0, 0.5, 'warm')")
    out = {}
    for n, name in zip(INSERTS, ("inserts_per_sec", "inserts_per_sec_in_transaction"), strict=True):
        sqls = [f"INSERT INTO bench VALUES ({i}, {i}.5, 'row')" for i in range(n)]
        began = time.perf_counter()
        catalogue._must(session, *sqls) if n == INSERTS[0] else catalogue._must(session, "BEGIN", *sqls, "COMMIT")
        out[name] = round(n / (time.perf_counter() - began), 1)
    return out


def indexed_lookup(spark: SparkSession, sf_dir: str) -> tuple[float, int]:
    """An equality lookup on a stored table that VACUUM has laid out by its index."""
    session = catalogue._stored(spark, sf_dir, "orders")
    catalogue._must(session, "CREATE INDEX by_key ON orders (o_orderkey) USING BTREE", "VACUUM orders")
    took = []
    for _ in range(RUNS + 1):
        began = time.perf_counter()
        found = session.sql("SELECT * FROM orders WHERE o_orderkey = 100").collect()
        took.append(time.perf_counter() - began)
    return round(statistics.median(took[1:]), 4), len(found)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = catalogue.queries()
    seconds: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in HEADLINE:
        took = []
        for run in range(RUNS + 1):
            began = time.perf_counter()
            df = found[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            if run:
                took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took), 4)
        rows[name] = df.count()
    rates = insert_rates(spark)
    seconds["indexed_lookup"], rows["indexed_lookup"] = indexed_lookup(spark, sf_dir)
    lineitem = catalogue.table(spark, sf_dir, "lineitem").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1],
        "rows_out": rows, "cpus": int(cpus), "runs": RUNS,
        "scan_rows_per_sec": round(lineitem / seconds["filter_compare_columns"]), "group_by_rows_per_sec": round(lineitem / seconds["agg_group_by"]), **rates,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
