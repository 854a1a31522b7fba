"""Pattern packing by non-negative least squares.

Piece lengths are counted in a histogram (its size is the sequence length, whatever the corpus).
Patterns of up to three true lengths that fill a sequence exactly are enumerated, their repeat
counts fitted to the histogram by non-negative least squares and rounded to what it can supply;
what is left is fitted again until no pattern is taken. The rest is packed best-fit decreasing,
into new sequences; where best-fit alone needs fewer sequences, it is the plan. Only the plan,
whose size is bounded by the histogram, exists on the driver; pieces are matched to places by their
rank among the pieces of one length, dealt over as many salts as the length needs.

Defined results: null text is empty text (the end id alone). Rows that repeat a doc_id are packed
row by row. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, discard, materialize
from .tokens import encoder

SEQUENCE = 2048
#: Steps of one fit.
STEPS = 100
#: Pieces of one (length, salt) group on average, in which they are ranked: at most 8 MB of ids. Only
#: the number of each group's pieces meets per length.
GROUP_ROWS = 1_000
#: Equal sequences: their number, and the (length, pieces) of each.
Group = tuple[int, tuple[tuple[int, int], ...]]


def patterns(classes: int, present: np.ndarray) -> np.ndarray:
    """(p, 3) multisets of up to three present lengths that sum to ``classes``; 0 pads."""
    out = [(classes, 0, 0)] if present[classes] else []
    for a in range(1, classes):
        if not present[a]:
            continue
        if a >= classes - a and present[classes - a]:
            out.append((a, classes - a, 0))
        rest = classes - a
        b = np.arange((rest + 1) // 2, min(a, rest - 1) + 1)
        c = rest - b
        ok = (c >= 1) & (c <= b) & present[b] & present[c]
        out.extend((a, int(x), int(y)) for x, y in zip(b[ok], c[ok], strict=True))
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def fit(shapes: np.ndarray, counts: np.ndarray, rounds: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|^2, by accelerated projected gradients."""
    size, total = len(counts), max(1, counts.sum())
    target = counts / total
    used = shapes > 0

    def apply(x: np.ndarray) -> np.ndarray:
        return np.bincount(shapes.ravel(), np.repeat(x, 3), size) * (np.arange(size) > 0)

    def transpose(y: np.ndarray) -> np.ndarray:
        return (y[shapes] * used).sum(axis=1)

    probe = np.ones(len(shapes))
    for _ in range(30):
        probe = transpose(apply(probe))
        probe /= np.linalg.norm(probe)
    step = 1 / np.linalg.norm(transpose(apply(probe)))
    x = y = np.zeros(len(shapes))
    t = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0, y - step * transpose(apply(y) - target))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x * total


@dataclass
class PackingPlan:
    """Runs of ranks: among pieces of length ``cls`` the ranks from ``low`` fill sequences from ``sequence``,
    ``each`` pieces per sequence, from slot ``slot``."""

    cls: np.ndarray
    low: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    slot: np.ndarray
    sequences: int


def plan_packing(counts: np.ndarray) -> PackingPlan:
    """counts[n]: pieces of length n (1 to len(counts) - 1, the last a full sequence)."""
    sequence = len(counts) - 1
    full = [(int(counts[sequence]), ((sequence, 1),))]
    rest = counts.astype(np.int64).copy()
    rest[sequence] = 0
    left = rest.copy()
    filled = _by_patterns(left, sequence)
    plans = [_best_fit(left, sequence, filled), _best_fit(rest, sequence, [])]
    best = min(plans, key=lambda groups: sum(n for n, _ in groups))
    return _runs([g for g in full + best if g[0] > 0], counts)


def _by_patterns(left: np.ndarray, sequence: int) -> list[Group]:
    """Sequences after fitted patterns, whose pieces are taken from ``left``.

    Repeat counts are rounded along their running sum, the largest first, so that many small ones
    together are not lost; the fit is repeated on what is left.
    """
    out: list[Group] = []
    while len(shapes := patterns(sequence, left > 0)):
        repeats = fit(shapes, left)
        order = np.argsort(-repeats, kind="stable")
        wanted = np.diff(np.floor(np.cumsum(repeats[order]) + 0.5), prepend=0).astype(np.int64)
        taken = 0
        for i, want in zip(order[wanted > 0].tolist(), wanted[wanted > 0].tolist(), strict=True):
            lengths, sizes = np.unique(shapes[i][shapes[i] > 0], return_counts=True)
            n = int(min(want, (left[lengths] // sizes).min()))
            if n > 0:
                left[lengths] -= n * sizes
                out.append((n, tuple(zip(lengths.tolist(), sizes.tolist(), strict=True))))
                taken += n
        if not taken:
            break
    return out


def _best_fit(left: np.ndarray, sequence: int, filled: list[Group]) -> list[Group]:
    """Best-fit decreasing on counts, into what ``filled`` leaves too: equal sequences are handled as one group."""
    open_at: dict[int, list[Group]] = {}
    spaces: list[int] = []

    def put(space: int, group: Group) -> None:
        if space not in open_at:
            open_at[space] = []
            insort(spaces, space)
        open_at[space].append(group)

    for group in filled:
        put(sequence - sum(size * each for size, each in group[1]), group)
    for size in range(sequence - 1, 0, -1):
        n = int(left[size])
        while n > 0:
            at = bisect_left(spaces, size)
            if at == len(spaces):
                each = sequence // size
                if n >= each:
                    put(sequence - each * size, (n // each, ((size, each),)))
                if n % each:
                    put(sequence - n % each * size, (1, ((size, n % each),)))
                break
            space = spaces[at]
            count, parts = open_at[space].pop()
            if not open_at[space]:
                del open_at[space]
                spaces.pop(at)
            each = min(space // size, n)
            fills = min(count, n // each)
            if fills < count:
                put(space, (count - fills, parts))
            put(space - each * size, (fills, (*parts, (size, each))))
            n -= fills * each
    return [g for found in open_at.values() for g in found]


def _runs(groups: list[Group], counts: np.ndarray) -> PackingPlan:
    taken = np.zeros(len(counts), dtype=np.int64)
    rows, sequence = [], 0
    for n, parts in groups:
        slot = 0
        for size, each in parts:
            rows.append((size, taken[size], sequence, each, slot))
            taken[size] += n * each
            slot += each
        sequence += n
    if (taken != counts).any():
        raise AssertionError("the plan does not place every piece")
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return PackingPlan(*table.T, sequence)


def token_pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's ids with the end id."""

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        doc, piece, length, crc, data = [], [], [], [], []
        ids = batch.column(0).to_pylist()
        for at, raw in enumerate(encode.many(batch.column(1).to_pylist())):
            raw += end
            for k, low in enumerate(range(0, len(raw), 4 * sequence)):
                part = raw[low : low + 4 * sequence]
                doc.append(ids[at])
                piece.append(k)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                data.append(part if with_ids else None)
        arrays = [
            pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array([sequence * k for k in piece], pa.int64()),
            pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(data, pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
    return arrow_map(rows, cut, schema) if with_ids else arrow_map(rows, cut, schema).drop("ids")


def pack(pieces: DataFrame, sequence: int = SEQUENCE, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` of at most ``sequence``.

    Sequences hold whole pieces, gapless from offset 0, and at most ``sequence`` tokens.
    """
    spark = pieces.sparkSession
    placed = pieces.withColumn("_cls", F.col("length").cast("int"))
    counts = np.zeros(sequence + 1, dtype=np.int64)
    for cls, n in placed.groupBy("_cls").agg(F.count("*")).collect():  # one row per length
        counts[cls] = n
    plan = plan_packing(counts)
    salts = F.expr(f"array({', '.join(str(max(1, -(-int(n) // GROUP_ROWS))) for n in counts)})")
    # Rows that are equal in the order and every column may swap places; no others can.
    ties = F.xxhash64(*[F.col(f"`{c}`") for c in pieces.columns])
    salted = placed.withColumn("_salt", F.pmod(F.xxhash64(*order, F.col("ids_crc32") if "ids_crc32" in pieces.columns else F.lit(0)), salts[F.col("_cls")]).cast("int"))
    before = Window.partitionBy("_cls").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        salted.groupBy("_cls", "_salt").agg(F.count("*").alias("_n"))
        .select("_cls", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    rank = F.row_number().over(Window.partitionBy("_cls", "_salt").orderBy(*order, ties)) - 1
    ranked = salted.withColumn("_rank", rank).join(bases, ["_cls", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    shared = spark.sparkContext.broadcast(plan)  # bounded by the histogram

    def place(cls: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = shared.value
        run = np.searchsorted((p.cls << 44) + p.low, (cls << 44) + rank, side="right") - 1
        within = rank - p.low[run]
        return p.sequence[run] + within // p.each[run], p.slot[run] + within % p.each[run]

    names = pieces.columns

    def assign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cls, rank = (batch.column(len(names) + i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
        sequence_id, slot = place(cls, rank)
        columns = [*batch.columns[: len(names)], pa.array(sequence_id), pa.array(slot)]
        yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "_slot"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    assigned = arrow_map(ranked.select(*names, "_cls", "_rank"), assign, f"{columns}, sequence_id bigint, _slot bigint")
    earlier = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return assigned.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("bigint")).drop("_slot")


def pack_documents(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialize(token_pieces(docs, tokenizer, sequence)), sequence)


def packed_sequences(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """The training sequences themselves: sequence_id, n_tokens, ids (little-endian uint32), offsets.

    ``offsets`` are where documents start in the sequence, for attention masks that keep them apart.
    """
    placed = pack(materialize(token_pieces(docs, tokenizer, sequence, with_ids=True)), sequence)
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids", "length", "doc_id")))  # at most `sequence` pieces
    return placed.groupBy("sequence_id").agg(rows.alias("rows")).select(
        "sequence_id",
        F.expr("aggregate(rows, 0L, (n, r) -> n + r.length)").alias("n_tokens"),
        F.expr("aggregate(rows, X'', (b, r) -> concat(b, r.ids))").alias("ids"),
        F.expr("transform(rows, r -> r.offset)").alias("offsets"),
        F.expr("transform(rows, r -> r.doc_id)").alias("doc_ids"),
    )
