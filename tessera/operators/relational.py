"""Relational operators: DataFrame in, DataFrame out, nothing run until an action.

Physical choices are Catalyst's. Hints exist where the reference lets a strategy be chosen, and the
interval join is written as an equality join on buckets because Spark would otherwise compare all
pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# --- scans -------------------------------------------------------------------------------------


def scan(df: DataFrame, columns: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """Filter and column list reach the Parquet reader as PushedFilters and ReadSchema."""
    out = df.where(where) if where is not None else df
    return out.select(*columns) if columns else out


def point_lookup(df: DataFrame, column: str, value: object) -> DataFrame:
    """Equality lookup: row groups are skipped by their statistics or bloom filter."""
    return df.where(F.col(column) == F.lit(value))


def range_scan(df: DataFrame, column: str, low: object, high: object) -> DataFrame:
    """Both ends belong to the range."""
    return df.where(F.col(column).between(F.lit(low), F.lit(high)))


# --- joins -------------------------------------------------------------------------------------

#: Spark's hints for the join strategies that can be asked for.
STRATEGIES = {"hash": "shuffle_hash", "merge": "merge", "broadcast": "broadcast"}


def equi_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str = "inner", strategy: str | None = None) -> DataFrame:
    """Join on pairs of columns; null keys never match. Without a strategy, sizes at run time decide."""
    side = right.hint(STRATEGIES[strategy]) if strategy else right
    return left.join(side, reduce(lambda a, b: a & b, (left[x] == right[y] for x, y in on)), how)


def multiway_join(first: DataFrame, *steps: tuple[DataFrame, str, str]) -> DataFrame:
    """Left-deep joins in the given order: (table, column so far, column of the table)."""
    return reduce(lambda out, s: out.join(s[0], out[s[1]] == s[0][s[2]]), steps, first)


def semi_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows with a match (IN, EXISTS)."""
    return equi_join(left, right, on, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows without a match (NOT EXISTS); a null key has none."""
    return equi_join(left, right, on, "left_anti")


#: How much wider the buckets of each level of the interval join are.
LEVEL_STEP = 8


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: int) -> DataFrame:
    """Pairs of rows whose whole-number intervals share a point, ends included.

    Each interval is filed under the one or two buckets that it touches at its own level, where buckets
    are at least as wide as it is long (the lowest has ``width``), and at the levels above. A pair
    meets at the higher of its two levels, so a long interval makes few rows; it is kept in the first
    bucket that both touch, so no distinct follows. Rows with a null end match nothing. The longest
    interval, which gives the number of levels, is looked up at once.
    """
    (a, b), (c, d) = left_span, right_span
    longest = [df.agg(F.max(F.col(high) - F.col(low))).first()[0] or 0 for df, low, high in ((left, a, b), (right, c, d))]
    widths = [width]
    while widths[-1] < max(longest):
        widths.append(widths[-1] * LEVEL_STEP)

    def filed(df: DataFrame, low: str, high: str, side: str) -> DataFrame:
        size = F.col(high) - F.col(low)
        own = F.coalesce(*[F.when(size <= w, k) for k, w in enumerate(widths)])
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(w).cast("bigint").alias("width")) for k, w in enumerate(widths)]))
        rows = df.where(F.col(low) <= F.col(high)).withColumns({f"_own_{side}": own, f"_at_{side}": each}).where(F.col(f"_at_{side}.level") >= F.col(f"_own_{side}"))
        buckets = F.sequence(F.floor(F.col(low) / F.col(f"_at_{side}.width")), F.floor(F.col(high) / F.col(f"_at_{side}.width")))
        return rows.withColumn(f"_bucket_{side}", F.explode(buckets))

    one, two = filed(left, a, b, "left"), filed(right, c, d, "right")
    level, cell = F.col("_at_left.level"), F.col("_bucket_left")
    shared = (level == F.col("_at_right.level")) & (cell == F.col("_bucket_right")) & (level == F.greatest("_own_left", "_own_right"))
    first = F.floor(F.greatest(one[a], two[c]) / F.col("_at_left.width"))
    met = one.join(two, shared & (one[a] <= two[d]) & (one[b] >= two[c]) & (cell == first))
    return met.drop(*[f"_{x}_{side}" for x in ("own", "at", "bucket") for side in ("left", "right")])


# --- aggregation -------------------------------------------------------------------------------


def aggregate(df: DataFrame, by: Sequence[str], measures: dict[str, Column], having: Column | None = None) -> DataFrame:
    """Grouped aggregation, or one row without ``by``; partial aggregates precede the shuffle."""
    named = [c.alias(n) for n, c in measures.items()]
    if not named:
        return df.select(*by).distinct()
    out = df.groupBy(*by).agg(*named) if by else df.agg(*named)
    return out.where(having) if having is not None else out


# --- windows -----------------------------------------------------------------------------------


def order_key(column: str, descending: bool = False) -> Column:
    """Nulls come last when ascending and first when descending."""
    return F.col(column).desc_nulls_first() if descending else F.col(column).asc_nulls_last()


def ranking(df: DataFrame, kind: str, partition_by: Sequence[str], order_by: Sequence[tuple[str, bool]], name: str | None = None) -> DataFrame:
    """Adds row_number, rank or dense_rank as a bigint."""
    window = Window.partitionBy(*partition_by).orderBy(*[order_key(c, d) for c, d in order_by])
    return df.withColumn(name or kind.upper(), getattr(F, kind)().over(window).cast("bigint"))


# --- order and sets ----------------------------------------------------------------------------


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """TakeOrderedAndProject: each task keeps k rows, no full sort."""
    return df.orderBy(*order).limit(k)


def union_all(*frames: DataFrame) -> DataFrame:
    """Columns by position, repeats kept."""
    return reduce(DataFrame.union, frames)
