"""Approximate nearest neighbours by cross-polytope hashing.

A hash rotates a unit vector by three rounds of random signs and the fast Hadamard transform and
takes the nearest signed axis. A table's hash is several of these together, the last one over as
many coordinates as give the table about a quarter as many cells as there are vectors, so cells
stay small however many rows there are. A query probes, in every table, the cells with the
largest sums of its signed coordinates; the share of cells it probes falls as rows are added.

Vectors are filed under (table, first axis), packed into blocks of bounded size; a query goes to
the first axes among its probes and there meets only the vectors of the cells it probes: no pair
becomes a row, no block is compared as a whole, and only each query's best leave a task. Scores are
exact inner products in double precision. A query that finds fewer than it asks for while there are
more searches every cell.

Where norms differ, the largest inner product is not the smallest angle: vectors then get one more
coordinate that makes all norms equal (and queries a 0 there), for hashing only.

Defined results: vectors null, zero, holding null or non-finite components, or of another length
than the most common one take no part; neither do rows without vec_id. Rows that repeat a vec_id
count once, with their best score, and never neighbour themselves. An empty table gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, materialize, sliced

TABLES = 24
#: Probed share of all cells, over all tables together: SHARE / rows ** FALL, at most the whole.
#: Measured on unit vectors without any structure, the hardest kind: recall 0.92 or more.
SHARE, FALL = 3.6, 0.35
#: Cells of a table: about a quarter of the rows, at least this many.
LEAST_CELLS = 1 << 14
#: Vectors and queries of a block.
VECTOR_BLOCK = 4096
QUERY_BLOCK = 2048
#: Candidate pairs that a task scores at a time, and keeps before it cuts them to each query's best.
PAIRS = 1 << 16
HELD = 1 << 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows (their length a power of two), without scaling."""
    x, n, h = x.copy(), x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


@lru_cache(maxsize=256)
def _rotation(width: int, number: int) -> np.ndarray:
    """The pseudo-rotation as a matrix, for widths at which one product is the faster way."""
    return _rotated(np.eye(width), number)


def _rotated(x: np.ndarray, number: int) -> np.ndarray:
    width = x.shape[1]
    signs = np.random.Generator(np.random.PCG64([7, number])).integers(0, 2, (3, width)) * 2 - 1
    for row in signs:
        x = hadamard(x * row) / np.sqrt(width)
    return x


@dataclass(frozen=True)
class CrossPolytope:
    """``tables`` hash tables over vectors of ``size`` components; lift: add the norm coordinate."""

    size: int
    tables: int
    lift: bool
    largest: float
    rows: int = 0

    @property
    def width(self) -> int:
        return 1 << (self.size + self.lift - 1).bit_length()

    @property
    def dims(self) -> list[int]:
        """Coordinates of each hash of a table; a hash of d coordinates has 2 d values."""
        want = max(LEAST_CELLS, 1 << max(0, self.rows // 4).bit_length())
        out = [self.width]
        while (cells := self._cells(out)) * 2 <= want:
            out.append(min(self.width, want // cells // 2))
        return out

    @staticmethod
    def _cells(dims: list[int]) -> int:
        return int(np.prod([2 * d for d in dims], dtype=np.int64))

    @property
    def axes(self) -> int:
        return 2 * self.width

    @property
    def rest(self) -> int:
        """Cells of a table below one first axis."""
        return self._cells(self.dims) // self.axes

    @property
    def cells(self) -> int:
        return self._cells(self.dims)

    def _coordinates(self, vectors: np.ndarray, table: int, query: bool) -> Iterator[np.ndarray]:
        x = np.zeros((len(vectors), self.width))
        x[:, : self.size] = vectors
        if self.lift and not query:
            x[:, self.size] = np.sqrt(np.maximum(0, self.largest**2 - (vectors.astype(np.float64) ** 2).sum(axis=1)))
        for i, d in enumerate(self.dims):
            number = 16 * table + i
            y = x @ _rotation(self.width, number) if self.width <= 256 else _rotated(x, number)
            yield y[:, :d]

    def rotate(self, vectors: np.ndarray, table: int, query: bool) -> np.ndarray:
        return next(self._coordinates(vectors, table, query))

    def cell(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """Each vector's cell: the first axis is its highest digit."""
        cell = np.zeros(len(vectors), dtype=np.int64)
        for y in self._coordinates(vectors, table, False):
            axis = np.abs(y).argmax(axis=1)
            cell = cell * 2 * y.shape[1] + 2 * axis + (y[np.arange(len(y)), axis] < 0)
        return cell

    def probes(self, vectors: np.ndarray, table: int, n: int) -> np.ndarray:
        """(m, n) cells with the largest sums of each query's signed coordinates.

        The best n sums over several hashes extend the best n over the hashes before.
        """
        cell, total = np.zeros((len(vectors), 1), dtype=np.int64), np.zeros((len(vectors), 1))
        for y in self._coordinates(vectors, table, True):
            signed = np.stack([y, -y], axis=2).reshape(len(y), 2 * y.shape[1])
            m = min(n, signed.shape[1])
            top = np.argpartition(-signed, m - 1, axis=1)[:, :m] if m < signed.shape[1] else np.tile(np.arange(m), (len(y), 1))
            grown = (total[:, :, None] + np.take_along_axis(signed, top, axis=1)[:, None, :]).reshape(len(y), -1)
            cells = (cell[:, :, None] * signed.shape[1] + top[:, None, :]).reshape(len(y), -1)
            if n < grown.shape[1]:
                keep = np.argpartition(-grown, n - 1, axis=1)[:, :n]
                grown, cells = np.take_along_axis(grown, keep, axis=1), np.take_along_axis(cells, keep, axis=1)
            cell, total = cells, grown
        return cell


def _sound(column: str) -> Column:
    v = F.col(column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _cut(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best by score, ties to the smaller id; one entry per id."""
    order = np.lexsort((-scores, ids, query))
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.ones(len(ids), dtype=bool)
    first[1:] = (ids[1:] != ids[:-1]) | (query[1:] != query[:-1])
    query, ids, scores = query[first], ids[first], scores[first]
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return query[place < k], ids[place < k], scores[place < k]


def _expand(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    n = ends - starts
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())


class _Packer:
    """Rows of one batch grouped by a key, as packed binaries."""

    def __init__(self, key: np.ndarray, *columns: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[order], return_index=True)
        self.ends = np.append(first[1:], len(key))
        self.firsts, self.columns = first, [np.ascontiguousarray(c[order]) for c in columns]

    def packed(self, column: int) -> pa.Array:
        c = self.columns[column]
        return pa.array([c[a:b].tobytes() for a, b in zip(self.firsts, self.ends, strict=True)], pa.binary())


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, probes: float | None = None, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query row among all other rows.

    probes: share of each table's cells that a query probes; by the number of rows if not given.
    """
    spark = vectors.sparkSession
    kind = np.dtype("<f8" if "double" in vectors.schema[vector_column].dataType.simpleString() else "<f4")
    rows = vectors.where(F.col(id_column).isNotNull() & _sound(vector_column)).select(
        F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.sqrt(F.aggregate(vector_column, F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("norm"),
    )
    shape = rows.groupBy(F.size("v").alias("size")).agg(
        F.count("*").alias("n"), F.min("norm").alias("low"), F.max("norm").alias("high"), F.sum(F.col("asks").cast("int")).alias("asks")
    ).orderBy(F.desc("n"), "size").first()
    if shape is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    size, n_rows = shape["size"], shape["n"]
    index = CrossPolytope(size, tables, bool(shape.high > shape.low * 1.001), shape.high, n_rows)
    rows = rows.where(F.size("v") == size).select("id", "v", "asks")

    def with_blocks(df: DataFrame, sized: DataFrame, most: int, name: str) -> DataFrame:
        """Adds the number of blocks of each row's axis; there are few axes, whatever the data."""
        n = sized.groupBy("axis").agg(F.ceil(F.sum("n") / most).cast("int").alias(name))
        return df.join(F.broadcast(n), "axis")  # one row per table and axis of the index

    def file(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x, ids = _matrix(batch.column(1), size).astype(kind), batch.column(0).to_numpy(zero_copy_only=False)
        for t in range(tables):
            axis, inner = np.divmod(index.cell(x, t), index.rest)
            packer = _Packer(t * index.axes + axis, ids, inner.astype("<i4"), x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(packer.keys.astype(np.int32)), *(packer.packed(i) for i in range(3)), pa.array(packer.ends - packer.firsts)], ["axis", "ids", "inner", "x", "n"]
            )

    filed = materialize(arrow_map(rows.select("id", "v"), file, "axis int, ids binary, inner binary, x binary, n bigint", rows=VECTOR_BLOCK))
    packs = F.collect_list(F.struct("ids", "inner", "x"))
    packed = materialize(
        with_blocks(filed, filed, VECTOR_BLOCK, "blocks").withColumn("block", F.pmod(F.xxhash64("ids"), F.col("blocks")).cast("int")).groupBy("axis", "block").agg(packs.alias("vectors"))
    )

    def search(queries: DataFrame, probes: int, in_tables: int) -> DataFrame:
        def probe(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            x, ids = _matrix(batch.column(1), size).astype(kind), batch.column(0).to_numpy(zero_copy_only=False)
            for t in range(in_tables):
                cells = index.probes(x, t, probes)
                axis, inner = np.divmod(cells.ravel(), index.rest)
                who = np.repeat(np.arange(len(x)), cells.shape[1])
                # One entry per query and axis, with the cells it probes below that axis.
                order = np.lexsort((inner, who, axis))
                axis, inner, who = axis[order], inner[order], who[order]
                first = np.flatnonzero(np.append(True, (axis[1:] != axis[:-1]) | (who[1:] != who[:-1])))
                packer = _Packer(axis[first], ids[who[first]], np.diff(np.append(first, len(axis))).astype("<i4"), x[who[first]])
                below = _Packer(axis, inner.astype("<i4"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((t * index.axes + packer.keys).astype(np.int32)), *(packer.packed(i) for i in range(3)), below.packed(0), pa.array(packer.ends - packer.firsts)],
                    ["axis", "ids", "n_cells", "x", "cells", "n"],
                )

        asked = materialize(arrow_map(queries.select("id", "v"), probe, "axis int, ids binary, n_cells binary, x binary, cells binary, n bigint", rows=QUERY_BLOCK // 4))
        parts = with_blocks(asked, asked, QUERY_BLOCK, "parts").withColumn("part", F.pmod(F.xxhash64("ids"), F.col("parts")).cast("int"))
        parts = parts.groupBy("axis", "part").agg(F.collect_list(F.struct("ids", "n_cells", "x", "cells")).alias("queries"))
        # Every part of an axis's queries meets every block of its vectors, dealt by axis and block.
        parts = with_blocks(parts, filed, VECTOR_BLOCK, "blocks").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        found = materialize(parts.join(packed, ["axis", "block"]).select("queries", "vectors").mapInArrow(compare, "query_id bigint, ids array<bigint>, scores array<double>, compared bigint"))
        merged = found.groupBy("query_id").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("scores")).alias("scores"))

        def top(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            each = np.diff(batch.column(1).offsets.to_numpy())
            q = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), each)
            q, i, s = _cut(q, *(batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (1, 2)), k)
            place = np.arange(len(q)) - np.searchsorted(q, q) + 1
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(place.astype(np.int32)), pa.array(i), pa.array(s)], ["query_id", "rank", "vec_id", "score"])

        out = materialize(arrow_map(merged, top, "query_id bigint, rank int, vec_id bigint, score double"))
        discard(asked, found)
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n_held = compared = 0

        def together(column: pa.ListScalar, field: str, dtype) -> np.ndarray:
            return np.frombuffer(b"".join(column.values.field(field).to_pylist()), dtype=dtype)

        def flush() -> pa.RecordBatch:
            nonlocal held, n_held, compared
            q, i, s = _cut(*(np.concatenate(x) for x in zip(*held, strict=True)), k) if held else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            ids, first = np.unique(q, return_index=True)
            offsets = pa.array(np.append(first, len(q)).astype(np.int32))
            total, held, n_held, compared = compared, [], 0, 0
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (i, s)]
            return pa.RecordBatch.from_arrays([pa.array(ids), *lists, pa.array([total] + [0] * (len(ids) - 1) if len(ids) else [], pa.int64())], ["query_id", "ids", "scores", "compared"])

        for batch in sliced(batches, 8):  # a row is two blocks
            for queries, block in zip(batch.column(0), batch.column(1), strict=True):
                v_ids, inner, v = together(block, "ids", "<i8"), together(block, "inner", "<i4"), together(block, "x", kind).reshape(-1, size)
                order = np.argsort(inner, kind="stable")
                v_ids, inner, v = v_ids[order], inner[order], v[order].astype(np.float64)
                q_ids, n_cells = together(queries, "ids", "<i8"), together(queries, "n_cells", "<i4")
                q, cells = together(queries, "x", kind).reshape(-1, size).astype(np.float64), together(queries, "cells", "<i4")
                low, high = np.searchsorted(inner, cells, "left"), np.searchsorted(inner, cells, "right")
                who = np.repeat(np.arange(len(q_ids)), n_cells)
                filled = high > low
                low, high, who = low[filled], high[filled], who[filled]
                upto = np.cumsum(high - low)
                at = 0
                while at < len(low):
                    end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
                    row, pair = _expand(low[at:end], high[at:end]), np.repeat(who[at:end], high[at:end] - low[at:end])
                    other = v_ids[row] != q_ids[pair]
                    row, pair = row[other], pair[other]
                    scores = (v[row] * q[pair]).sum(axis=1)  # unlike a matrix product's, the last bits depend on the pair alone
                    compared += len(row)
                    found = _cut(q_ids[pair], v_ids[row], scores, k)
                    held.append(found)
                    n_held += len(found[0])
                    at = end
                    if n_held > HELD:
                        merged = _cut(*(np.concatenate(x) for x in zip(*held, strict=True)), k)
                        held, n_held = [merged], len(merged[0])
                        if n_held > HELD // 2:
                            yield flush()
        yield flush()

    asks = rows.where("asks")
    whole = index.cells
    per_table = whole * (SHARE / n_rows**FALL / tables if probes is None else probes)
    wanted = int(min(whole, max(1, np.ceil(per_table))))
    found = search(asks, wanted, tables if wanted < whole else 1)
    full = found.groupBy("query_id").agg(F.count("*").alias("found")).where(F.col("found") >= min(k, n_rows - 1)).select("query_id")
    short = materialize(asks.join(full, F.col("id") == F.col("query_id"), "left_anti").select("id", "v"))
    if not short.isEmpty():
        wide = search(short, whole, 1)
        found = materialize(found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(wide))
    discard(filed, packed, short)
    return found
