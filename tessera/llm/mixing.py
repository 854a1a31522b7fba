"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source's target is cut into blocks of equal numbers of words. Blocks go to sources, and within
a source to its shards, by the highest quotients size / (2 * seats + 1), so quotas are integers
that add up. A shard is a slice of the source by the seeded digest of doc_id. Inside a shard the
documents lie in the order of that digest, which is the seeded shuffle, and its blocks are numbered
along it; whole epochs come before a partial one, which takes the quota's first blocks of the shuffle. Only the last document of a shard's quota is taken in part.

One row per source (weights are set per source) reaches the driver; everything per document or
shard stays distributed.

Defined results: null text has size 0 and is taken 0 times. A null doc_id is digested as empty
text; ties go by size, then by a hash of the text. Repeated rows are separate documents. Where all sizes are 0, so are the targets. An empty
table gives an empty result. Other columns are ignored (``mixture`` keeps them all).
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, materialize

#: Weights of the sources in code-point order, repeating (fixed by the contract of the query).
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK_WORDS = 16
#: Hex digits of the digest that name a shard: 256 shards per source, 16 times as many for each
#: further factor of 16 beyond this many words.
SHARD_DIGITS = 2
SHARD_WORDS = 1 << 32
SEED = "mix-1"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def apportion(votes: list[float], seats: int) -> list[int]:
    """Sainte-Laguë: each seat goes to the highest votes / (2 * seats so far + 1), ties to the first."""
    total = sum(votes)
    if seats <= 0 or total <= 0:
        return [0] * len(votes)
    # Seats that rounding at a slightly too large divisor gives are surely won; the rest go one by one.
    divisor = total / seats
    out = [int(v / divisor + 0.5) for v in votes]
    while sum(out) > seats:
        divisor *= 1 + (sum(out) - seats + 0.5) / seats
        out = [int(v / divisor + 0.5) for v in votes]
    queue = [(-v / (2 * n + 1), i) for i, (v, n) in enumerate(zip(votes, out, strict=True)) if v > 0]
    heapq.heapify(queue)
    for _ in range(seats - sum(out)):
        _, i = queue[0]
        out[i] += 1
        heapq.heapreplace(queue, (-votes[i] / (2 * out[i] + 1), i))
    return out


def source_targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> list[tuple]:
    """(source, size, target): weighted shares of ``share`` times all words, at most cap times a source's size.

    What a cap cuts off is shared again by weight until no target is above its cap.
    """
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = share * sum(sizes.values())
    free, capped = set(names), 0
    while True:
        rate = (total - capped) / sum(weight[s] for s in free) if free else 0.0
        over = {s for s in free if weight[s] * rate > cap * sizes[s]}
        if not over:
            break
        free -= over
        capped += sum(cap * sizes[s] for s in over)
    return [(s, sizes[s], float(weight[s] * rate) if s in free else float(cap * sizes[s])) for s in names]


def shard_digits_for(words: int) -> int:
    digits = SHARD_DIGITS
    while words > SHARD_WORDS << 4 * (digits - SHARD_DIGITS):
        digits += 1
    return digits


def _plan(docs: DataFrame, seed: str, block: int, shard_digits: int | None, rows: bool = False) -> DataFrame:
    spark = docs.sparkSession
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = docs.select(
        F.col("doc_id"), F.col("source"), *([F.struct("*").alias("_row")] if rows else []),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint").alias("_size"),
        digest.alias("_digest"), F.xxhash64("text").alias("_tie"),
    )
    sized = materialize(sized)
    totals = {r[0]: r[1] for r in sized.groupBy("source").agg(F.sum("_size")).collect()}
    targets = source_targets(totals)
    blocks = apportion([t for _, _, t in targets], round(sum(t for _, _, t in targets) / block))
    table = spark.createDataFrame(
        [(i, s, size, t, b) for i, ((s, size, t), b) in enumerate(zip(targets, blocks, strict=True))],
        "_sid int, _source string, source_size bigint, target double, _blocks bigint",
    )
    digits = shard_digits or shard_digits_for(sum(totals.values()))
    sized = sized.withColumn("_shard", F.substring("_digest", 1, digits)).join(table, F.col("source").eqNullSafe(F.col("_source")))

    def shares(shards: pd.DataFrame) -> pd.DataFrame:
        shards = shards.sort_values("_shard")
        quota = apportion([float(x) for x in shards["_words"]], int(shards["_blocks"].iloc[0]))
        return shards.assign(_quota=[min(CAP * int(w), block * q) for w, q in zip(shards["_words"], quota, strict=True)])

    quotas = (
        sized.groupBy("_sid", "_shard").agg(F.sum("_size").alias("_words"), F.first("_blocks").alias("_blocks"))
        .groupBy("_sid").applyInPandas(shares, "_sid int, _shard string, _words bigint, _blocks bigint, _quota bigint")
        .drop("_blocks")
    )
    before = Window.partitionBy("_sid", "_shard").orderBy("_digest", "_size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    partial = F.greatest(F.lit(0), F.least(F.col("_size"), F.expr("_quota % _words") - F.col("_before")))
    taken = F.when(F.col("_words") > 0, F.expr("_quota div _words") * F.col("_size") + partial).otherwise(0)
    return placed.join(quotas, ["_sid", "_shard"]).withColumn("_taken", taken.cast("bigint"))


def mix(docs: DataFrame, seed: str = SEED, block: int = BLOCK_WORDS, shard_digits: int | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row; taken: words the mix takes, repeats counted."""
    plan = _plan(docs, seed, block, shard_digits)
    return plan.select("doc_id", F.col("_size").alias("size"), "source_size", "target", F.col("_taken").alias("taken"))


def mixture(docs: DataFrame, seed: str = SEED, block: int = BLOCK_WORDS, shard_digits: int | None = None) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a document taken twice is two rows, one taken in part
    is cut after its share of words, one not taken is absent."""
    names = docs.columns
    plan = _plan(docs, seed, block, shard_digits, rows=True)
    taken = plan.where("_taken > 0").withColumns({"_whole": F.expr("_taken div _size").cast("int"), "_rest": F.expr("_taken % _size")})
    whole = taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_whole")))).select("_row.*")
    at = names.index("text")

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = []
        for text, words in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
            texts.append(text[: next(islice(_WORD.finditer(text), words - 1, None)).end()])
        arrays = list(batch.columns[: len(names)])
        arrays[at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(arrays, names)

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    part = arrow_map(taken.where("_rest > 0").select("_row.*", "_rest"), cut, columns)
    if "n_chars" in names:
        part = part.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return whole.union(part.select(*names))
