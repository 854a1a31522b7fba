"""Shared plumbing: durable intermediates, bounded key bitmaps, hashing, prefix sums."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Used only where the session names no spark.checkpoint.dir and one machine is the whole cluster, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder of the cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or LOCAL_CHECKPOINTS).rstrip('/')}/tessera/{uuid.uuid4().hex}"


def materialize(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back.

    Cuts lineage so that a lost executor costs a re-read, never a recomputation, and lets several
    jobs use one result.
    """
    spark = df.sparkSession
    path = folder or work_folder(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if "/tessera/" in folder:
                path.getFileSystem(conf).delete(path, True)


def stored_bytes(table: DataFrame) -> int:
    """Bytes of the files that a table is read from."""
    jvm, conf, total = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration(), 0
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        total += path.getFileSystem(conf).getContentSummary(path).getLength()
    return total


# --- hashing -----------------------------------------------------------------------------------

_FOLDED = np.arange(256)
_FOLDED[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Texts are hashed in pieces of about this many bytes, cut at white space.
_PIECE = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _random(n: int, stream: int) -> np.ndarray:
    """The first n numbers of a fixed stream of random 64-bit integers."""
    return mix64(mix64(np.arange(n, dtype=np.uint64) + np.uint64(stream << 40)) + np.uint64(0x9E3779B97F4A7C15))


_VALUES = _random(256, 1)
_FOLDED_VALUES = _VALUES[_FOLDED]
_weights = [_random(1 << 12, 2)]


def _weight(n: int) -> np.ndarray:
    """Random weights of the places 0 to n - 1 of a range."""
    if n > len(_weights[0]):
        _weights[0] = _random(1 << n.bit_length(), 2)
    return _weights[0]


class RangeHashes:
    """Hashes of byte ranges that begin where one of ``anchors`` (ascending) does.

    A range's hash is the sum of its bytes' random values, each times the random weight of its place
    in the range, so equal content gives equal hashes wherever it lies. The weights are independent,
    not powers of one base: no family of texts cancels out, as the powers' sums modulo 2 ** 64 do.
    """

    def __init__(self, data: np.ndarray, anchors: np.ndarray, fold_case: bool = False) -> None:
        self.total = np.zeros(len(data) + 1, dtype=np.uint64)
        if len(anchors):
            runs, first = np.diff(anchors, append=len(data)), int(anchors[0])
            place = np.arange(first, len(data)) - np.repeat(anchors, runs)
            values = (_FOLDED_VALUES if fold_case else _VALUES)[data[first:]]
            np.cumsum(values * _weight(int(runs.max()))[place], out=self.total[first + 1 :])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = self.total[ends] - self.total[starts]
        return mix64(raw ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(text: str, fold_case: bool = True) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    raw = text.encode("utf-8", "surrogatepass")
    out = []
    at = 0
    while at < len(raw):
        end = min(len(raw), at + _PIECE)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        data = np.frombuffer(raw, dtype=np.uint8, count=end - at, offset=at)
        inside = np.empty(len(data) + 2, dtype=np.int8)
        inside[0] = inside[-1] = 0
        inside[1:-1] = ~_SPACE[data]
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        out.append(RangeHashes(data, starts, fold_case)(starts, ends))
        at = end
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    out = np.sort(hashes)
    new = np.empty(len(out), dtype=bool)
    new[:1] = True
    np.not_equal(out[1:], out[:-1], out=new[1:])
    return out[new]


def word_shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter sequence counts as one shingle."""
    words = word_hashes(text) if text else np.empty(0, dtype=np.uint64)
    if not len(words):
        return words
    n = min(width, len(words))
    total = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        total = mix64(total * np.uint64(0x9FB21C651E98DF25) + words[k : len(words) - n + 1 + k])
    return distinct(total)


_PLACES = _random(64, 3) | np.uint64(1)


def char_shingles(points: np.ndarray, width: int) -> np.ndarray:
    """Hashes, with repeats, of the windows of ``width`` code points (at most 64) of one or more lines."""
    n = max(0, len(points) - width + 1)
    wide = points.astype(np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total += wide[k : k + n] * _PLACES[k]
    return mix64(total)


def code_points(line: bytes) -> np.ndarray:
    """Code points of UTF-8 bytes."""
    if line.isascii():
        return np.frombuffer(line, dtype=np.uint8)
    return np.frombuffer(line.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype="<u4")


def set_digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits, as two signed longs, that identify a set of hashes."""
    one = mix64(hashes ^ np.uint64(0x51ED270B0A1F39C1)).sum(dtype=np.uint64)
    two = mix64(hashes ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64)
    both = np.array([one, two], dtype=np.uint64).view(np.int64)
    return int(both[0]), int(both[1])


#: Rows handed to Python at a time.
BATCH_ROWS = 500

# --- arrow helpers -----------------------------------------------------------------------------


def list_array(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    values = np.concatenate(rows) if rows else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow for functions of one small batch.

    Spark bounds the bytes of what it hands over (spark.sql.execution.arrow.maxBytesPerBatch); here that
    is sliced to ``rows``, without copies and without settings of the session.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows):
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


# --- bounded bitmaps ---------------------------------------------------------------------------

#: Bits per key and most bits of a bitmap that pre-filters rows, which bounds what is broadcast (8 MB).
BITS_PER_KEY = 16
BITMAP_MOST = 1 << 26


def bitmap_slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(keys.view(np.uint64)) % np.uint64(bits)).astype(np.int64)


def key_bitmap(keys: DataFrame, column: str):
    """A broadcast bitmap in which every key of a bigint column is marked; None where it could not filter.

    Its size follows the number of keys up to ``BITMAP_MOST`` bits. A filter only: rows that pass by
    chance are removed by the exact join that follows, and beyond the largest size that join does all
    the work. At most ``BITMAP_MOST / 64`` words reach the driver.
    """
    spark = keys.sparkSession
    n = keys.count()
    bits = 1 << max(16, (BITS_PER_KEY * n).bit_length())
    if bits > BITMAP_MOST:
        bits = BITMAP_MOST
        if 2 * n > bits:
            return None

    def slots(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        slot = np.unique(bitmap_slots(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits))
        words, first = np.unique(slot >> 6, return_index=True)
        masks = np.left_shift(np.uint64(1), (slot & 63).astype(np.uint64))
        merged = np.bitwise_or.reduceat(masks, first) if len(slot) else masks
        yield pa.RecordBatch.from_pydict({"word": words, "mask": merged.view(np.int64)})

    table = (
        arrow_map(keys.select(column).where(F.col(column).isNotNull()), slots, "word bigint, mask bigint", rows=10_000)
        .groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    )
    bitmap = np.zeros(bits // 64, dtype=np.uint64)
    bitmap[table.column("word").to_numpy()] = table.column("mask").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(bitmap)


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = bitmap_slots(keys, len(bitmap) * 64)
    return (bitmap[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1


# --- prefix sums -------------------------------------------------------------------------------


def running_starts(df: DataFrame, order: list[str], **sums: str) -> DataFrame:
    """Adds, as each name, the sum of its column over all rows that come before in ``order`` (ties: any order).

    Rows are dealt by range; totals per range (as many as there are partitions) are summed in a
    single small window, and the running sums inside a range are a streaming window.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(*[F.sum(v).alias(f"_total_{k}") for k, v in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_range", *[F.coalesce(F.sum(f"_total_{k}").over(before), F.lit(0)).alias(f"_base_{k}") for k in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.repartitionByRange(parts, "_range").withColumns({f"_in_{k}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in sums.items()})
    return placed.join(F.broadcast(bases), "_range").select(  # one row per partition
        *df.columns, *[(F.col(f"_base_{k}") + F.col(f"_in_{k}")).cast("bigint").alias(k) for k in sums]
    )


# --- connected components ----------------------------------------------------------------------


#: Links that one task joins by itself; with more, rounds over the cluster do the same.
LOCAL_LINKS = 1_000_000


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, comp) of one task's links: roots are hooked to smaller roots until nothing changes."""
    parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate([x for pair in zip(*parts, strict=True) for x in pair]), return_inverse=True)
    one, two = at[: len(at) // 2], at[len(at) // 2 :]
    root = np.arange(len(nodes))
    while len(one):
        low = np.minimum(root[one], root[two])
        np.minimum.at(root, root[one], low)
        np.minimum.at(root, root[two], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        apart = root[one] != root[two]
        one, two = one[apart], two[apart]
    for low in range(0, len(nodes), 10_000):
        yield pa.RecordBatch.from_pydict({"node": nodes[low : low + 10_000], "comp": nodes[root[low : low + 10_000]]})


def components(links: DataFrame, a: str = "a", b: str = "b", local: int = LOCAL_LINKS) -> DataFrame:
    """(node, comp) for every node of an undirected link table of bigints; comp: smallest node.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): each halves distances, so
    the number of rounds is logarithmic; each round is written to the shared folder. At most
    ``local`` links are joined in one executor task instead; the result is the same.
    """
    edges = materialize(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    if edges.count() <= local:
        out = materialize(edges.select("u", "v").coalesce(1).mapInArrow(_joined_up, "node bigint, comp bigint"))
        discard(edges)
        return out
    mark = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        step = (
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        done = materialize(step)
        now = done.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = done
        if tuple(now) == mark:
            break
        mark = tuple(now)
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    out = materialize(pairs.union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()))
    discard(edges)
    return out


#: Parts of a key's rows in ``join_salted``.
SALTS = 32


def join_salted(rows: DataFrame, keyed: DataFrame, key: str, spread: str) -> DataFrame:
    """Inner join of many rows a key with one row a key; a key's rows are dealt to SALTS tasks by ``spread``."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def null_safe(column: str, other: str) -> Column:
    return F.col(column).eqNullSafe(F.col(other))
