"""Content-addressed store of token ids.

Format, below one folder (all tables are zstd Parquet, so any Spark file system can hold them):

* ``chunks``    hash binary(16), n int, ids binary — each distinct chunk once; ids are
  little-endian unsigned integers of ``id_bytes`` bytes
* ``frequent``  hash — the chunks that more than one in HOT_SHARE recipe rows name; readers deal
  them to salts
* ``recipes``   uid, doc_id, at, n, hash — a document is its chunks in the order of ``at``
* ``documents`` uid, doc_id, rank, start, n_tokens, root — in ascending doc_id order; ``start``
  counts the ids of all documents before; root is the digest of the recipe's hashes in order
* ``manifest``  level, node, root — a Merkle tree over the document roots in rank order, 1,024
  children per node, up to one node
* ``format``    id_bytes, end_id, window, minimum, maximum, mask_bits

A rolling hash over a window of ids places the cuts, so equal passages give equal chunks wherever
they start. Reading back recomputes every chunk's hash, every document's root and the tree, and
derives each document's crc32 by combining the crc32 of its chunks, so chunk bytes never travel to
their documents.

Defined results: null text is empty text (the end id alone). Rows that repeat a doc_id are separate
documents with one doc_id; null doc_ids come first. An empty table gives empty tables. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, discard, materialize, mix64, running_starts, sliced, work_folder
from .tokens import encoder

WINDOW = 16
MINIMUM, MAXIMUM, MASK_BITS = 64, 4096, 9
FAN = 1024
#: A chunk that more than one in so many recipe rows name is joined in this many salted parts.
HOT_SHARE, SALTS = 1000, 32
#: Ids of a document that ``read_ids`` puts in one row, give or take a chunk.
PART = 1 << 20
#: Chunk hashes that one task remembers to leave out repeats before the shuffle.
SEEN = 200_000


_GEAR = mix64(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x9E37))


def _marks(ids: np.ndarray, mask_bits: int) -> np.ndarray:
    """Places (after an id) where the hash of the last WINDOW ids ends in ``mask_bits`` zero bits."""
    h = _GEAR[ids] if len(ids) and ids.max() < len(_GEAR) else mix64(ids.astype(np.uint64) + np.uint64(0x9E37))
    factor, reach = 0x9E3779B97F4A7C15, 1
    while reach < WINDOW:
        sums = h.copy()
        sums[reach:] += h[:-reach] * np.uint64(pow(factor, reach, 2**64)) if reach < len(h) else 0
        h, reach = sums, 2 * reach
    return np.flatnonzero(h * np.uint64(0xD6E8FEB86659FD93) < np.uint64(1 << (64 - mask_bits))) + 1


def cut_points(ids: np.ndarray, bounds: list[int] | None = None, minimum: int = MINIMUM, maximum: int = MAXIMUM, mask_bits: int = MASK_BITS) -> list[int]:
    """Ends of the content-defined chunks of the documents that end at ``bounds`` (default: one).

    Documents are hashed together: a window that reaches into the document before ends nearer to
    the start than the least chunk, where no cut is made.
    """
    bounds = [len(ids)] if bounds is None else bounds
    marks = _marks(ids, mask_bits)
    split = np.searchsorted(marks, bounds).tolist()
    ends, last, at = [], 0, 0
    for bound, upto in zip(bounds, split, strict=True):
        for mark in marks[at:upto].tolist():
            while mark - last > maximum:
                last += maximum
                ends.append(last)
            if mark - last >= minimum and mark < bound:
                ends.append(mark)
                last = mark
        while bound - last > maximum:
            last += maximum
            ends.append(last)
        ends.append(bound)
        last, at = bound, upto
    return ends


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode documents and write the store."""
    spark = docs.sparkSession
    wide = encoder(tokenizer).vocabulary > 1 << 16
    kind = "<u4" if wide else "<u2"

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        uid, seen = TaskContext.get().partitionId() << 40, set()
        for batch in sliced(batches):
            rows: list[tuple] = []
            raw = [r + end for r in encode.many(batch.column(1).to_pylist())]
            bounds = np.cumsum([len(r) // 4 for r in raw]).tolist()
            ids = np.frombuffer(b"".join(raw), dtype="<u4")
            stored, width = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
            cuts = iter(cut_points(ids, bounds))
            low = 0
            for doc_id, bound in zip(batch.column(0).to_pylist(), bounds, strict=True):
                first, hashes = low, []
                while low < bound:
                    high = next(cuts)
                    data = stored[low * width : high * width]
                    hashes.append(_digest(data))
                    fresh = hashes[-1] not in seen
                    if fresh and len(seen) < SEEN:
                        seen.add(hashes[-1])
                    last = high == bound
                    rows.append((uid, doc_id, low - first, high - low, hashes[-1], data if fresh else None,
                                 bound - first if last else None, _digest(b"".join(hashes)) if last else None))
                    low = high
                uid += 1
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
            names = ["uid", "doc_id", "at", "n", "hash", "ids", "n_tokens", "root"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    staged = materialize(rows.mapInArrow(
        chunk, "uid bigint, doc_id bigint, at bigint, n int, hash binary, ids binary, n_tokens bigint, root binary"
    ))
    write = lambda df, name: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")
    write(staged.where("ids is not null").groupBy("hash").agg(F.first("n").alias("n"), F.first("ids").alias("ids")), "chunks")
    often = staged.groupBy("hash").agg(F.count("*").alias("uses")).where(F.col("uses") * HOT_SHARE > staged.count())
    write(often.select("hash").coalesce(1), "frequent")
    heads = staged.where("root is not null").select("uid", "doc_id", "n_tokens", "root", F.lit(1).alias("one"))
    ranked = running_starts(heads, ["doc_id", "uid"], start="n_tokens", rank="one")
    write(ranked.select("uid", "doc_id", "rank", "start", "n_tokens", "root"), "documents")
    recipes = staged.select("uid", "doc_id", "at", "n", "hash")
    write(recipes.repartitionByRange("doc_id", "uid", "at").sortWithinPartitions("doc_id", "uid", "at"), "recipes")
    write(_tree(spark.read.parquet(f"{folder}/documents")), "manifest")
    write(spark.createDataFrame(
        [(4 if wide else 2, end_id, WINDOW, MINIMUM, MAXIMUM, MASK_BITS)],
        "id_bytes int, end_id int, window int, minimum int, maximum int, mask_bits int",
    ).coalesce(1), "format")
    discard(staged)


def _tree(documents: DataFrame) -> DataFrame:
    """Merkle levels over the document roots: (level, node, root) up to one node."""
    level = documents.select(F.col("rank").alias("node"), "root")
    out, at, n = None, 0, documents.count()
    while at == 0 or n > 1:
        level = (
            level.groupBy(F.floor(F.col("node") / FAN).alias("parent"))
            .agg(F.array_sort(F.collect_list(F.struct("node", "root"))).alias("children"))  # FAN at most
            .select(F.col("parent").alias("node"), F.unhex(F.sha2(F.concat_ws("", F.transform("children", lambda c: F.hex(c.root))).cast("binary"), 256)).alias("root"))
        )
        at, n = at + 1, -(-n // FAN)
        level = materialize(level)
        step = level.select(F.lit(at).alias("level"), "node", "root")
        out = step if out is None else out.union(step)
    return out


# --- crc32 of a concatenation ------------------------------------------------------------------


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials over GF(2) modulo the crc32 polynomial, bit-reflected."""
    out = np.zeros(np.broadcast(a, b).shape, dtype=np.uint64)
    b = np.broadcast_to(b, out.shape).copy()
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(bit)) & np.uint64(1) == 1, b, np.uint64(0))
        b = np.where(b & np.uint64(1) == 1, (b >> np.uint64(1)) ^ np.uint64(0xEDB88320), b >> np.uint64(1))
    return out


def _squares() -> list[np.ndarray]:
    x8 = np.array([1 << (31 - 8)], dtype=np.uint64)
    out = [x8]
    for _ in range(47):
        out.append(_times(out[-1], out[-1]))
    return out


_SHIFTS = _squares()


def shift_crc(crc: np.ndarray, following: np.ndarray) -> np.ndarray:
    """What a part's crc32 contributes to the whole's when ``following`` bytes come after it."""
    crc, rest, k = crc.astype(np.uint64), following.astype(np.int64).copy(), 0
    while (rest > 0).any():
        odd = rest & 1 == 1
        crc[odd] = _times(crc[odd], _SHIFTS[k])
        rest >>= 1
        k += 1
    return crc


def _with_chunks(spark: SparkSession, folder: str, recipes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Recipe rows with their chunk's columns; a chunk that many documents share is dealt to salts."""
    # At most HOT_SHARE chunks can have more than that share of the uses.
    hot = F.broadcast(spark.read.parquet(f"{folder}/frequent").select("hash", F.lit(SALTS).alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    salted = recipes.join(hot, "hash", "left").withColumn("salt", F.pmod(F.xxhash64("uid", "at"), salts).cast("int")).drop("salts")
    spread = chunks.join(hot, "hash", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return salted.join(spread, ["hash", "salt"]).drop("salt")


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_chunks) per document, verified from the files.

    Fails if a chunk does not have the hash it is stored under, is missing, or if a document's
    root or the Merkle tree differs.
    """
    form = spark.read.parquet(f"{folder}/format").first()
    kind = f"<u{form.id_bytes}"

    def check(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        crc = []
        for h, n, ids in zip(*batch.columns, strict=True):
            data = ids.as_py()
            if _digest(data) != h.as_py() or len(data) != n.as_py() * form.id_bytes:
                raise ValueError("a chunk differs from the hash it is stored under")
            crc.append(zlib.crc32(np.frombuffer(data, dtype=kind).astype("<u4")))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64())], ["hash", "crc"])

    checked = arrow_map(spark.read.parquet(f"{folder}/chunks").select("hash", "n", "ids"), check, "hash binary, crc bigint")
    documents = spark.read.parquet(f"{folder}/documents")
    tree = spark.read.parquet(f"{folder}/manifest")
    ours = _tree(documents)
    if ours.exceptAll(tree).union(tree.exceptAll(ours)).limit(1).count():
        raise ValueError("the Merkle tree differs from the documents' roots")
    recipes = spark.read.parquet(f"{folder}/recipes").select("uid", "at", "n", "hash")
    parts = _with_chunks(spark, folder, recipes, checked).join(documents.select("uid", "n_tokens"), "uid").select(
        "uid", "at", "n", "hash", "crc", (4 * (F.col("n_tokens") - F.col("at") - F.col("n"))).alias("following")
    )

    def shifted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        crc, following = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
        value = pa.array(shift_crc(crc, following).astype(np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], value], ["uid", "at", "n", "hash", "value"])

    # A recipe is read by offset, so its hashes are put in order before the root is recomputed.
    whole = arrow_map(parts, shifted, "uid bigint, at bigint, n int, hash binary, value bigint").groupBy("uid").agg(
        F.bit_xor("value").alias("crc"), F.sum("n").alias("found"), F.count("*").alias("n_chunks"),
        F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("recipe"),
    )

    def roots(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        root = [_digest(b"".join(x["hash"] for x in recipe)) for recipe in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(root, pa.binary())], ["uid", "crc", "found", "n_chunks", "rebuilt"])

    rebuilt = arrow_map(whole, roots, "uid bigint, crc bigint, found bigint, n_chunks bigint, rebuilt binary")
    sound = F.expr("rebuilt <=> root and found <=> n_tokens")
    return documents.join(rebuilt, "uid", "left").select(
        "doc_id", "start", "n_tokens",
        F.when(sound, F.col("crc")).otherwise(F.raise_error(F.lit("a document differs from its recipe")).cast("bigint")).alias("ids_crc32"),
        "n_chunks",
    )


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids): ids as little-endian bytes of ``id_bytes`` each, ``start`` counted over all documents.

    A document is one row, or one row for each PART of its ids where it has more.
    """
    chunks = spark.read.parquet(f"{folder}/chunks").select("hash", "ids")
    recipes = _with_chunks(spark, folder, spark.read.parquet(f"{folder}/recipes").select("uid", "at", "hash"), chunks)
    whole = recipes.groupBy("uid", F.floor(F.col("at") / PART).alias("part")).agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    return spark.read.parquet(f"{folder}/documents").join(whole, "uid").select(
        "doc_id", (F.col("start") + F.col("parts")[0]["at"]).alias("start"), F.expr("aggregate(parts, X'', (b, p) -> concat(b, p.ids))").alias("ids")
    )


def store_round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write the store and report what the files hold."""
    spark = docs.sparkSession
    folder = folder or work_folder(spark)
    write_store(docs, folder, tokenizer)
    return read_store(spark, folder)
