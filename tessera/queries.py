"""The catalogue: one query per operator with its DuckDB equivalent.

Queries marked ``dialect`` go through the SQL front end, those marked ``stored`` through a session
over versioned tables; the others call the operator library.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import predicates as P
from .operators import relational as R
from .plans.dialect import check_with, lower, with_default_names
from .plans.lexer import tokenize
from .session import MAX_RECURSION, Session
from .sources import files

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return files.read(spark, f"{sf_dir}/{name}.parquet")


def _query(name: str, oracle: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _QUERIES[name] = fn
        _ORACLE[name] = oracle
        return fn

    return add


def _named(tokens, names: tuple[str, ...]) -> set[str]:
    return {t.text for t in tokens} & set(names)


def dialect(spark: SparkSession, sf_dir: str, sql: str, args: tuple = ()) -> DataFrame:
    """Lower a dialect query over the Parquet tables and hand it to Spark."""
    tokens = tokenize(sql)
    check_with(tokens)
    own = spark.newSession()
    own.conf.set("spark.sql.ansi.enabled", "false")
    own.conf.set("spark.sql.cteRecursionLevelLimit", str(MAX_RECURSION))
    files.register(own, sf_dir, tuple(_named(tokens, TABLES)))
    return own.sql(lower(with_default_names(tokens), args))


def _dialect(name: str, sql: str, oracle: str | None = None) -> None:
    _query(name, oracle or sql)(lambda spark, sf_dir: dialect(spark, sf_dir, sql))


def _folder(spark: SparkSession) -> str:
    """A new folder that the whole cluster shares; a folder of this machine only where it is the cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or '/tmp/checkpoints').rstrip('/')}/tessera/{uuid.uuid4().hex}"


def _stored(spark: SparkSession, sf_dir: str, *names: str) -> Session:
    """A session over a fresh store, with tables loaded from Parquet."""
    session = Session(spark, _folder(spark))
    for name in names:
        session.load(name, table(spark, sf_dir, name))
    return session


def _must(session: Session, *sqls: str) -> Session:
    for sql in sqls:
        result = session.execute(sql)
        if not result.ok:
            raise RuntimeError(f"{sql}: {result.message}")
    return session


# --- scans and filters -------------------------------------------------------------------------


@_query("seq_scan", "SELECT * FROM nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.scan(table(spark, d, "nation"))


@_query("limited_scan", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.top_k(R.scan(table(spark, d, "orders"), ["o_orderkey", "o_custkey"]), 25, F.asc("o_orderkey"))


@_query("project_columns", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.scan(table(spark, d, "customer"), ["c_custkey", "c_name", "c_mktsegment"])


@_query(
    "filter_compare_literal",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000.0 AND o_totalprice <= 200000.0
       AND o_custkey >= 10 AND o_custkey < 1000 AND o_orderstatus != 'P' AND o_orderpriority = '1-URGENT'""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    c = P.compare
    where = c("o_totalprice", ">", 100000.0) & c("o_totalprice", "<=", 200000.0) & c("o_custkey", ">=", 10) & c("o_custkey", "<", 1000)
    return R.scan(table(spark, d, "orders"), ["o_orderkey", "o_totalprice"], where & c("o_orderstatus", "!=", "P") & c("o_orderpriority", "=", "1-URGENT"))


@_query("filter_compare_columns", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey < l_suppkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.scan(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], P.compare("l_partkey", "<", F.col("l_suppkey")))


@_query(
    "filter_and_or_not",
    "SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal > 5000.0) AND NOT (c_nationkey = 3 OR c_nationkey = 7)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    c = P.compare
    where = (c("c_mktsegment", "=", "BUILDING") | c("c_acctbal", ">", 5000.0)) & ~(c("c_nationkey", "=", 3) | c("c_nationkey", "=", 7))
    return R.scan(table(spark, d, "customer"), ["c_custkey"], where)


@_query("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1_' OR p_type LIKE 'E%'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.scan(table(spark, d, "part"), ["p_partkey", "p_name"], P.like("p_name", "%1_") | P.like("p_type", "E%"))


@_query("filter_in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.scan(table(spark, d, "customer"), ["c_custkey", "c_mktsegment"], F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))


@_query("filter_not_in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.scan(table(spark, d, "customer"), ["c_custkey", "c_mktsegment"], ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))


@_query("index_point_lookup", "SELECT * FROM orders WHERE o_orderkey = 100")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.point_lookup(table(spark, d, "orders"), "o_orderkey", 100)


@_query("index_range_scan", "SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 300")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.range_scan(table(spark, d, "orders"), "o_orderkey", 100, 300)


@_query("index_only_scan", "SELECT o_orderkey FROM orders WHERE o_orderkey = 100")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.point_lookup(table(spark, d, "orders"), "o_orderkey", 100).select("o_orderkey")


@_query("bitmap_combine", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND (o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH')")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = P.compare
    where = c("o_orderstatus", "=", "F") & (c("o_orderpriority", "=", "1-URGENT") | c("o_orderpriority", "=", "2-HIGH"))
    return R.scan(table(spark, d, "orders"), ["o_orderkey"], where)


# --- the dialect's own predicates --------------------------------------------------------------

_dialect(
    "contains_word", "SELECT doc_id, lang FROM documents WHERE text CONTAINS 'the'",
    "SELECT doc_id, lang FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^a-z0-9]+'), 'the')",
)
_dialect(
    "json_extract_text", "SELECT event_id, user_id FROM events WHERE props ->> 'k' = '42'",
    "SELECT event_id, user_id FROM events WHERE (props ->> 'k') = '42'",
)


@_query(
    "array_contains",
    "SELECT l_orderkey FROM (SELECT l_orderkey, list(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey) WHERE list_contains(flags, 'R')",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    flags = R.aggregate(table(spark, d, "lineitem"), ["l_orderkey"], {"flags": F.collect_set("l_returnflag")})  # three flags at most
    return R.scan(flags, ["l_orderkey"], P.array_has("flags", "R"))


@_query(
    "range_overlaps",
    """SELECT l_orderkey, s, e FROM (SELECT l_orderkey, min(l_partkey) AS s, max(l_partkey) AS e FROM lineitem GROUP BY l_orderkey)
       WHERE s <= 20 AND e >= 5""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    spans = R.aggregate(table(spark, d, "lineitem"), ["l_orderkey"], {"s": F.min("l_partkey"), "e": F.max("l_partkey")})
    return R.scan(spans, ["l_orderkey", "s", "e"], P.overlaps("s", "e", 5, 20))


_dialect(
    "dialect_overlaps", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_suppkey, l_partkey) OVERLAPS (3, 9)",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey <= 9 AND l_partkey >= 3",
)


@_query(
    "interval_join",
    "SELECT p_partkey, c_custkey FROM part JOIN customer ON p_partkey <= c_custkey + c_nationkey AND p_partkey + p_size >= c_custkey",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Whole tables and whole intervals: [p_partkey, p_partkey + p_size] and [c_custkey, c_custkey + c_nationkey]."""
    part = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") + F.col("p_size")).alias("p_to"))
    customer = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") + F.col("c_nationkey")).alias("c_to"))
    return R.interval_join(part, customer, ("p_partkey", "p_to"), ("c_custkey", "c_to"), 64).select("p_partkey", "c_custkey")


# --- joins and subqueries ----------------------------------------------------------------------

_JOIN = "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey"


def _customer_orders(spark: SparkSession, d: str, strategy: str | None) -> DataFrame:
    joined = R.equi_join(table(spark, d, "customer"), table(spark, d, "orders"), [("c_custkey", "o_custkey")], strategy=strategy)
    return joined.select("c_custkey", "o_orderkey", "o_totalprice")


for _name, _strategy in (("inner_join", None), ("hash_join_hint", "hash"), ("merge_join_hint", "merge")):
    _query(_name, _JOIN)(lambda spark, d, s=_strategy: _customer_orders(spark, d, s))


@_query(
    "multiway_join",
    """SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    steps = ((table(spark, d, "nation"), "c_nationkey", "n_nationkey"), (table(spark, d, "region"), "n_regionkey", "r_regionkey"))
    return R.multiway_join(table(spark, d, "customer"), *steps).select("c_custkey", "n_name", "r_name")


_dialect("semi_join_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
_dialect("anti_join_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")


@_query("semi_join_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = P.compare("o_orderstatus", "=", "F")
    return R.semi_join(table(spark, d, "customer"), table(spark, d, "orders").where(found), [("c_custkey", "o_custkey")]).select("c_custkey")


@_query("anti_join_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def _(spark: SparkSession, d: str) -> DataFrame:
    dear = P.compare("o_totalprice", ">", 250000.0)
    return R.anti_join(table(spark, d, "customer"), table(spark, d, "orders").where(dear), [("c_custkey", "o_custkey")]).select("c_custkey")


_dialect("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)")

# --- aggregation -------------------------------------------------------------------------------


@_query(
    "agg_group_by",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS price,
       round(avg(l_discount), 6) AS disc FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    measures = {
        "n": F.count(F.lit(1)), "qty": F.round(F.sum("l_quantity"), 2), "price": F.round(F.sum("l_extendedprice"), 2), "disc": F.round(F.avg("l_discount"), 6),
    }
    return R.aggregate(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], measures)


@_query("agg_global", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.aggregate(table(spark, d, "orders"), [], {"n": F.count(F.lit(1)), "total": F.round(F.sum("o_totalprice"), 2), "mean": F.round(F.avg("o_totalprice"), 4)})


@_query("agg_count_column", "SELECT event_type, count(*) AS n, count(nullif(user_id % 5, 0)) AS some FROM events GROUP BY event_type")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.aggregate(table(spark, d, "events"), ["event_type"], {"n": F.count(F.lit(1)), "some": F.count(F.nullif(F.col("user_id") % 5, F.lit(0)))})


@_query("agg_min_max", "SELECT p_brand, min(p_retailprice) AS low, max(p_retailprice) AS high, min(p_name) AS first_name, max(p_type) AS last_type FROM part GROUP BY p_brand")
def _(spark: SparkSession, d: str) -> DataFrame:
    measures = {"low": F.min("p_retailprice"), "high": F.max("p_retailprice"), "first_name": F.min("p_name"), "last_type": F.max("p_type")}
    return R.aggregate(table(spark, d, "part"), ["p_brand"], measures)


@_query("group_by_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.aggregate(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {})


@_query("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.aggregate(table(spark, d, "orders"), ["o_custkey"], {"n": F.count(F.lit(1))}, F.col("n") > 12)


_dialect(
    "dialect_having", "SELECT o_orderpriority, COUNT(*), MAX(o_totalprice) AS top FROM orders GROUP BY o_orderpriority HAVING AVG(o_totalprice) > 2.5",
    """SELECT o_orderpriority, count(*) AS "COUNT(*)", max(o_totalprice) AS top FROM orders GROUP BY o_orderpriority HAVING avg(o_totalprice) > 2.5""",
)


@_query(
    "join_aggregate",
    """SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    steps = ((table(spark, d, "customer"), "o_custkey", "c_custkey"), (table(spark, d, "nation"), "c_nationkey", "n_nationkey"))
    return R.aggregate(R.multiway_join(table(spark, d, "orders"), *steps), ["n_name"], {"n": F.count(F.lit(1)), "revenue": F.round(F.sum("o_totalprice"), 2)})


# --- windows -----------------------------------------------------------------------------------

for _kind, _order in (("row_number", "o_totalprice DESC, o_orderkey"), ("rank", "o_orderpriority"), ("dense_rank", "o_orderpriority")):
    _keys = [("o_totalprice", True), ("o_orderkey", False)] if _kind == "row_number" else [("o_orderpriority", False)]
    _query(f"window_{_kind}", f"SELECT o_orderkey, o_custkey, {_kind}() OVER (PARTITION BY o_custkey ORDER BY {_order}) AS place FROM orders")(
        lambda spark, d, kind=_kind, keys=_keys: R.ranking(table(spark, d, "orders"), kind, ["o_custkey"], keys, "place").select("o_orderkey", "o_custkey", "place")
    )

_dialect(
    "window_no_partition", "SELECT n_nationkey, n_name, ROW_NUMBER() OVER (ORDER BY n_name DESC) FROM nation",
    'SELECT n_nationkey, n_name, CAST(row_number() OVER (ORDER BY n_name DESC) AS INTEGER) AS "ROW_NUMBER" FROM nation',
)

# --- order, limit, sets ------------------------------------------------------------------------


@_query("order_by", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(R.order_key("c_acctbal", True), R.order_key("c_custkey"))


@_query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), F.asc("o_orderkey"))


_dialect("limit", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 5")


@_query("union_all", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def _(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    region = table(spark, d, "region").select("r_regionkey", "r_name")
    return R.union_all(nation, region, region)


_dialect("cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000) SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey")
_dialect(
    "recursive_cte",
    """WITH RECURSIVE walk AS (SELECT n_nationkey AS k, 0 AS depth FROM nation WHERE n_nationkey = 0
       UNION ALL SELECT walk.k * 2 + 1, walk.depth + 1 FROM walk WHERE walk.depth < 12)
       SELECT n_name, depth FROM walk JOIN nation ON n_nationkey = k""",
    """WITH RECURSIVE walk AS (SELECT n_nationkey AS k, 0 AS depth FROM nation WHERE n_nationkey = 0
       UNION ALL SELECT CAST(walk.k * 2 + 1 AS INTEGER), CAST(walk.depth + 1 AS INTEGER) FROM walk WHERE walk.depth < 12)
       SELECT n_name, depth FROM walk JOIN nation ON n_nationkey = k""",
)

# --- stored tables: views, functions, DML, statistics --------------------------------------------


@_query("view", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0.0 GROUP BY c_mktsegment")
def _(spark: SparkSession, d: str) -> DataFrame:
    session = _must(_stored(spark, d, "customer"), "CREATE VIEW solvent AS SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0.0")
    return session.sql("SELECT c_mktsegment, COUNT(*) AS n FROM solvent GROUP BY c_mktsegment")


@_query("sql_function", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    session = _stored(spark, d, "customer", "orders")
    _must(session, "CREATE FUNCTION order_count(cust BIGINT) RETURNS BIGINT AS $$ SELECT COUNT(*) FROM orders WHERE o_custkey = cust $$ LANGUAGE SQL")
    return session.sql("SELECT c_custkey, order_count(c_custkey) AS n FROM customer")


@_query("native_function", "SELECT n_nationkey, CAST(n_nationkey + n_regionkey AS INTEGER) AS s, CAST(n_nationkey * n_nationkey AS INTEGER) AS q FROM nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    session = _must(
        _stored(spark, d, "nation"), "CREATE EXTENSION ints AS 'tessera.functions.samples'",
        "CREATE FUNCTION add_ints(a INT, b INT) RETURNS INT AS ints, 'add_ints' LANGUAGE PYTHON",
        "CREATE FUNCTION square(a INT) RETURNS INT AS ints, 'square' LANGUAGE PYTHON",
    )
    return session.sql("SELECT n_nationkey, add_ints(n_nationkey, n_regionkey) AS s, square(n_nationkey) AS q FROM nation")


@_query("insert_defaults", "SELECT n_nationkey AS id, n_name AS name, 'pending' AS status FROM nation UNION ALL SELECT 100, 'ATLANTIS', 'pending'")
def _(spark: SparkSession, d: str) -> DataFrame:
    session = _must(
        _stored(spark, d, "nation"), "CREATE TABLE place (id INT, name VARCHAR(25), status VARCHAR DEFAULT 'pending')",
        "INSERT INTO place (id, name) SELECT n_nationkey, n_name FROM nation", "INSERT INTO place (id, name) VALUES (100, 'ATLANTIS')",
    )
    return session.sql("SELECT id, name, status FROM place")


@_query("update_where", "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    session = _must(_stored(spark, d, "customer"), "UPDATE customer SET c_mktsegment = 'MOVED' WHERE c_nationkey = 3")
    return session.sql("SELECT c_custkey, c_mktsegment FROM customer")


@_query("delete_where", "SELECT o_orderkey FROM orders WHERE NOT (o_totalprice > 150000.0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 1))")
def _(spark: SparkSession, d: str) -> DataFrame:
    session = _must(
        _stored(spark, d, "orders", "customer"),
        "DELETE FROM orders WHERE o_totalprice > 150000.0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 1)",
    )
    return session.sql("SELECT o_orderkey FROM orders")


@_query("savepoint_rollback", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    session = _must(
        _stored(spark, d, "region"), "BEGIN", "DELETE FROM region WHERE r_regionkey = 0", "SAVEPOINT one",
        "DELETE FROM region WHERE r_regionkey > 0", "ROLLBACK TO SAVEPOINT one", "COMMIT",
    )
    return session.sql("SELECT r_regionkey, r_name FROM region")


@_query("trigger_audit", "SELECT r_regionkey AS k, r_name AS name FROM region WHERE r_regionkey < 3")
def _(spark: SparkSession, d: str) -> DataFrame:
    session = _must(
        _stored(spark, d, "region"), "CREATE TABLE audit (k INT, name VARCHAR)",
        "CREATE PROCEDURE note(r_regionkey INT, r_name VARCHAR) AS $$ INSERT INTO audit VALUES (r_regionkey, r_name) $$ LANGUAGE SQL",
        "CREATE TRIGGER watch AFTER DELETE ON region FOR EACH ROW EXECUTE PROCEDURE note()", "DELETE FROM region WHERE r_regionkey < 3",
    )
    return session.sql("SELECT k, name FROM audit")


@_query("procedure_call", "SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'RENAMED' ELSE r_name END AS r_name FROM region")
def _(spark: SparkSession, d: str) -> DataFrame:
    session = _must(
        _stored(spark, d, "region"),
        "CREATE PROCEDURE rename(target INT, new_name VARCHAR) AS $$ UPDATE region SET r_name = new_name WHERE r_regionkey = target $$ LANGUAGE SQL",
        "CALL rename(2, 'RENAMED')",
    )
    return session.sql("SELECT r_regionkey, r_name FROM region")


@_query("sequence_values", "SELECT 100 AS a, 105 AS b, 105 AS c")
def _(spark: SparkSession, d: str) -> DataFrame:
    session = _must(
        _stored(spark, d), "CREATE SEQUENCE s START WITH 100 INCREMENT BY 5", "CREATE TABLE t (a INT, b INT, c INT)",
        "INSERT INTO t VALUES (nextval('s'), nextval('s'), currval('s'))",
    )
    return session.sql("SELECT a, b, c FROM t")


@_query("parameter_binding", "SELECT c_custkey FROM customer WHERE c_acctbal > -500.5 AND c_mktsegment = 'BUILDING'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d, "customer").sql("SELECT c_custkey FROM customer WHERE c_acctbal > $1 AND c_mktsegment = $2", [-500.5, "BUILDING"])


@_query("show_tables", "SELECT 'nation' AS table_name UNION ALL SELECT 'region'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d, "nation", "region").sql("SHOW TABLES")


@_query("vacuum", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 50")
def _(spark: SparkSession, d: str) -> DataFrame:
    session = _must(_stored(spark, d, "orders"), "DELETE FROM orders WHERE o_orderkey <= 50", "CREATE INDEX by_key ON orders (o_orderkey) USING BTREE", "VACUUM orders")
    return session.sql("SELECT o_orderkey, o_custkey FROM orders")


@_query("analyze_stats", "SELECT CAST(count(*) AS BIGINT) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    session = _must(_stored(spark, d, "orders"), "ANALYZE orders")
    stats = session.store.latest()[1]["stats"]["orders"]
    price = stats["columns"]["o_totalprice"]
    return spark.createDataFrame([(stats["rows"], float(price["min"]), float(price["max"]))], "n bigint, low double, high double")


@_query("values_source", "SELECT * FROM (VALUES (1, 'a', CAST(1.5 AS DOUBLE)), (2, NULL, CAST(2.5 AS DOUBLE))) AS t (id, name, x)")
def _(spark: SparkSession, d: str) -> DataFrame:
    session = _must(_stored(spark, d), "CREATE TABLE t (id INT, name VARCHAR, x DOUBLE)", "INSERT INTO t VALUES (1, 'a', 1.5), (2, NULL, 2.5)")
    return session.sql("SELECT id, name, x FROM t")


@_query("serial_ids", "SELECT r_name AS name, CAST(row_number() OVER (ORDER BY r_regionkey) AS INTEGER) AS id FROM region")
def _(spark: SparkSession, d: str) -> DataFrame:
    session = _must(_stored(spark, d), "CREATE TABLE t (id SERIAL, name VARCHAR)")
    for row in table(spark, d, "region").orderBy("r_regionkey").collect():  # five regions
        if not session.execute("INSERT INTO t (name) VALUES ($1)", [row.r_name]).ok:
            raise RuntimeError("insert failed")
    return session.sql("SELECT name, id FROM t")


@_query("snapshot_read", "SELECT n_nationkey, n_name FROM nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A transaction keeps reading the version it began with while another session deletes rows."""
    reader = _must(_stored(spark, d, "nation"), "BEGIN")
    _must(Session(spark, reader.store.root), "DELETE FROM nation WHERE n_nationkey > 5")
    return reader.sql("SELECT n_nationkey, n_name FROM nation")


@_query("rolled_back_transaction", "SELECT r_regionkey FROM region")
def _(spark: SparkSession, d: str) -> DataFrame:
    session = _must(_stored(spark, d, "region"), "BEGIN", "DELETE FROM region WHERE r_regionkey > 1", "ROLLBACK")
    return session.sql("SELECT r_regionkey FROM region")


@_query("show_stats", "SELECT * FROM (VALUES ('tables', '2'), ('views', '1'), ('indexes', '1'), ('sequences', '0'), ('functions', '0'), ('procedures', '0'), ('triggers', '0')) AS t (metric, value)")
def _(spark: SparkSession, d: str) -> DataFrame:
    session = _must(_stored(spark, d, "nation", "region"), "CREATE VIEW v AS SELECT n_name FROM nation", "CREATE INDEX i ON nation (n_nationkey) USING HASH")
    return session.sql("SHOW STATS")


@_query("view_join_aggregate", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def _(spark: SparkSession, d: str) -> DataFrame:
    session = _must(_stored(spark, d, "nation", "region"), "CREATE VIEW n2 AS SELECT n_name, n_regionkey FROM nation")
    return session.sql("SELECT r_name, COUNT(*) AS n FROM n2 JOIN region ON n2.n_regionkey = region.r_regionkey GROUP BY r_name")


@_query("change_log_replication", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey <> 6")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Three transactions put the nations by key modulo 3; the second rolls back, the third never ends; a fourth deletes one."""
    from .streaming.replication import Replica

    replica = Replica(spark, _folder(spark))
    puts = table(spark, d, "nation").select(
        (F.col("n_nationkey") % 3).cast("bigint").alias("txn"), F.col("n_nationkey").cast("bigint").alias("seq"), F.lit("put").alias("op"),
        F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"),
    )
    schema = "txn bigint, seq bigint, op string, key string, value string"
    replica.apply(puts.union(spark.createDataFrame([(0, 100, "commit", None, None)], schema)), 0)
    later = [(1, 101, "rollback", None, None), (9, 102, "delete", "6", None), (9, 103, "commit", None, None)]
    replica.apply(spark.createDataFrame(later, schema), 1)
    return replica.rows()


# --- what the statements above leave out ---------------------------------------------------------


def _outcome(spark: SparkSession, session: Session, *sqls: str) -> DataFrame:
    """(step, ok) of statements, some of which must fail."""
    return spark.createDataFrame([(i, session.execute(sql).ok) for i, sql in enumerate(sqls)], "step int, ok boolean")


def _steps(*oks: bool) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS step, {str(ok).lower()} AS ok" for i, ok in enumerate(oks))


@_query("window_partition_by_two", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber DESC) AS place FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    out = R.ranking(table(spark, d, "lineitem"), "row_number", ["l_orderkey", "l_returnflag"], [("l_linenumber", True)], "place")
    return out.select("l_orderkey", "l_linenumber", "place")


_dialect(
    "window_filter_limit", "SELECT o_orderkey, RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) AS place FROM orders WHERE o_custkey < 50 ORDER BY o_orderkey LIMIT 20",
    "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) AS place FROM orders WHERE o_custkey < 50 ORDER BY o_orderkey LIMIT 20",
)


@_query("join_key_types", "SELECT n_nationkey, r_name FROM nation JOIN region ON CAST(n_regionkey AS DOUBLE) = r_regionkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    """An integer key meets a double one."""
    nation = table(spark, d, "nation").withColumn("as_double", F.col("n_regionkey").cast("double"))
    return R.equi_join(nation, table(spark, d, "region"), [("as_double", "r_regionkey")]).select("n_nationkey", "r_name")


@_query("array_literal_contains", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
def _(spark: SparkSession, d: str) -> DataFrame:
    session = _must(
        _stored(spark, d, "nation"), "CREATE TABLE tagged (region INT, tags VARCHAR[])",
        "INSERT INTO tagged VALUES (0, ARRAY['cold']), (1, ARRAY['warm', 'wet']), (3, ARRAY['warm']), (4, NULL)",
    )
    return session.sql("SELECT n_nationkey, n_name FROM nation JOIN tagged ON n_regionkey = region WHERE tags @> 'warm'")


@_query("json_on_insert", _steps(True, True, False, True))
def _(spark: SparkSession, d: str) -> DataFrame:
    session = _must(_stored(spark, d), "CREATE TABLE t (id INT, data JSON)")
    values = ("'{\"a\": [1, null]}'", "NULL", "'{invalid json}'", "'7'")
    return _outcome(spark, session, *[f"INSERT INTO t VALUES ({i}, {v})" for i, v in enumerate(values)])


@_query("current_defaults", "SELECT r_regionkey AS id, true AS dated, true AS stamped FROM region")
def _(spark: SparkSession, d: str) -> DataFrame:
    session = _must(
        _stored(spark, d, "region"), "CREATE TABLE t (id INT, day DATE DEFAULT CURRENT_DATE, at TIMESTAMP DEFAULT CURRENT_TIMESTAMP)",
        "INSERT INTO t (id) SELECT r_regionkey FROM region",
    )
    return session.sql("SELECT id, day IS NOT NULL AS dated, at IS NOT NULL AS stamped FROM t")


@_query("poisoned_transaction", _steps(True, True, False, False, False, True, True))
def _(spark: SparkSession, d: str) -> DataFrame:
    session = _stored(spark, d, "region")
    return _outcome(
        spark, session, "BEGIN", "DELETE FROM region WHERE r_regionkey = 0", "SELECT * FROM nowhere", "DELETE FROM region WHERE r_regionkey = 1",
        "SELECT r_name FROM region", "ROLLBACK", "SELECT r_name FROM region",
    )


@_query("write_conflict", "SELECT r_regionkey, true AS lost FROM region WHERE r_regionkey <> 4")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Two transactions write one table; the first to commit wins."""
    one = _must(_stored(spark, d, "region"), "BEGIN", "DELETE FROM region WHERE r_regionkey = 3")
    two = _must(Session(spark, one.store.root), "DELETE FROM region WHERE r_regionkey = 4")
    lost = not one.execute("COMMIT").ok
    return two.sql("SELECT r_regionkey FROM region").withColumn("lost", F.lit(lost))


@_query("drop_statements", _steps(*[True] * 12, False, False, False, False))
def _(spark: SparkSession, d: str) -> DataFrame:
    session = _stored(spark, d, "region")
    return _outcome(
        spark, session, "CREATE VIEW v AS SELECT r_name FROM region", "CREATE SEQUENCE s", "CREATE FUNCTION f(a INT) RETURNS INT AS $$ SELECT a + 1 $$ LANGUAGE SQL",
        "CREATE PROCEDURE p(r_regionkey INT) AS $$ SELECT 1 $$ LANGUAGE SQL", "CREATE TRIGGER g AFTER DELETE ON region FOR EACH ROW EXECUTE PROCEDURE p()",
        "CREATE INDEX i ON region (r_regionkey) USING BTREE", "DROP INDEX i", "DROP TRIGGER g ON region", "DROP PROCEDURE p", "DROP FUNCTION f", "DROP SEQUENCE s", "DROP VIEW v",
        "SELECT * FROM v", "DROP VIEW v", "CALL p(1)", "DROP SEQUENCE s",
    )


@_query("refused_calls", _steps(True, True, False, False, False))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Wrong arity, a missing function, and transaction control in a body."""
    session = _stored(spark, d, "region")
    return _outcome(
        spark, session, "CREATE FUNCTION f(a INT) RETURNS INT AS $$ SELECT a + 1 $$ LANGUAGE SQL", "CREATE PROCEDURE p(a INT) AS $$ COMMIT $$ LANGUAGE SQL",
        "SELECT f(1, 2) AS x FROM region", "SELECT nothing_here(1) AS x FROM region", "CALL p(1)",
    )


@_query("recursive_cte_checks", _steps(False, False))
def _(spark: SparkSession, d: str) -> DataFrame:
    """RECURSIVE without UNION ALL, and UNION ALL without RECURSIVE."""
    return _outcome(
        spark, _stored(spark, d, "region"), "WITH RECURSIVE r AS (SELECT r_regionkey FROM region) SELECT * FROM r",
        "WITH r AS (SELECT r_regionkey FROM region UNION ALL SELECT r_regionkey FROM region) SELECT * FROM r",
    )


@_query("explain", "SELECT true AS planned, true AS pushed")
def _(spark: SparkSession, d: str) -> DataFrame:
    plan = _stored(spark, d, "region").sql("EXPLAIN SELECT r_name FROM region WHERE r_regionkey = 2").first()[0]
    return spark.createDataFrame([("Physical Plan" in plan, "PushedFilters: [IsNotNull(r_regionkey), EqualTo(r_regionkey,2)]" in plan)], "planned boolean, pushed boolean")


@_query("trigger_bulk_insert", "SELECT n_nationkey AS k FROM nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    """INSERT ... SELECT into a table with a row trigger."""
    session = _must(
        _stored(spark, d, "nation"), "CREATE TABLE t (k INT, name VARCHAR)", "CREATE TABLE audit (k INT)",
        "CREATE PROCEDURE note(k INT) AS $$ INSERT INTO audit VALUES (k) $$ LANGUAGE SQL", "CREATE TRIGGER w BEFORE INSERT ON t FOR EACH ROW EXECUTE PROCEDURE note()",
        "INSERT INTO t SELECT n_nationkey, n_name FROM nation",
    )
    return session.sql("SELECT k FROM audit")


@_query("slow_query_log", "SELECT 'SELECT r_name FROM region' AS query")
def _(spark: SparkSession, d: str) -> DataFrame:
    session = Session(spark, _stored(spark, d, "region").store.root, slow_ms=0)
    session.sql("SELECT r_name FROM region")
    return spark.createDataFrame([(q,) for q, _ in session.slow_log], "query string")


@_query("indexed_lookup", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 37")
def _(spark: SparkSession, d: str) -> DataFrame:
    """VACUUM lays the table out by its index, so the statistics of files and row groups skip the rest."""
    session = _must(_stored(spark, d, "orders"), "CREATE INDEX by_customer ON orders (o_custkey) USING BRIN", "VACUUM orders")
    return session.sql("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 37")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, join, group, order and limit over orders and customers, through the dialect."""
    return dialect(
        spark, sf_dir,
        """SELECT c_mktsegment, COUNT(*) AS n, SUM(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey
           WHERE o_totalprice > 1000.0 GROUP BY c_mktsegment ORDER BY total DESC LIMIT 5""",
    )


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
