"""Fuzzy line deduplication by MinHash.

Equal lines fold into one node first (128-bit digest, partially aggregated). Signatures of character
shingles are banded for high recall; candidates are confirmed by exact Jaccard on the full shingle
sets; distributed union-find makes components; of each component one line stays, the one with the
smallest (doc_id, line number).

Lines are the text's parts between line feeds, trimmed of white space for comparison only. Shingles
are of ``width`` code points in any script; a line of at most ``width`` matches equal lines only.
Lines without a word are never removed.

Defined results: null text stays null and empty text empty. Rows equal in doc_id and text are one
document, every row of which keeps the same lines; rows that repeat a doc_id with other text are
documents of their own. A null doc_id sorts last among keepers. Other columns pass unchanged,
whatever their names (n_chars, where present, counts the new text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import char_shingles, code_points, discard, in_bitmap, join_salted, key_bitmap, materialize, sliced
from .linking import Banding, link, packed_bands

NUM, DEN = 80, 100
WIDTH = 8
#: 14 bands of 3: at every similarity from 0.8 on, a pair is lost less often than with 16 bands of 4.
HASHES = 42
BAND_MISS = 1e-3
POSTERIOR_MISS = 1e-6
#: Lines whose signature one task has made and that it leaves out when they come again.
SEEN = 200_000
_BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"


#: Lines are hashed together up to about this many bytes, which a processor's cache holds.
PIECE = 1 << 15


def _hashed(lines: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Shingle hashes, with repeats, of some lines after each other, and where each line's start and end.

    A line of at most ``width`` code points has none; what lies between two lines belongs to neither.
    """
    low = size = 0
    for high, line in enumerate(lines, 1):
        size += len(line)
        if size > PIECE or high == len(lines):
            some = lines[low:high]
            counts = np.array([len(x) if x.isascii() else len(x.decode("utf-8", "surrogatepass")) for x in some])
            every = char_shingles(code_points(b"".join(some)), width)
            starts = np.cumsum(counts) - counts
            yield every, starts, np.where(counts > width, starts + counts - width + 1, starts)
            low, size = high, 0


def _signed(lines: list[bytes], width: int, sign: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which lines have shingles, and the signatures of those."""
    has, signatures = [np.empty(0, dtype=bool)], []
    for every, starts, ends in _hashed(lines, width):
        some = ends > starts
        has.append(some)
        signatures.append(sign(every, starts[some], ends[some]))
    return np.concatenate(has), signatures


def _shingled(lines: list[bytes], width: int) -> list[np.ndarray]:
    """Shingle hashes, with repeats, of each line."""
    return [every[a:b] for every, starts, ends in _hashed(lines, width) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _lines(text: str | None) -> Iterator[tuple[int, bytes]]:
    """(line number, trimmed bytes) of the lines that hold a word."""
    if text:
        for i, raw in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
            if line := raw.strip(_BLANK):
                yield i, line


def _digest(line: bytes) -> bytes:
    return hashlib.blake2b(line, digest_size=16).digest()


def _longs(digests: list[bytes]) -> np.ndarray:
    """(n, 2) signed longs."""
    return np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"),
        F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit(""))).alias("doc_key"),
    )


def _staged_lines(rows: DataFrame, plan: Banding, width: int) -> DataFrame:
    """(doc_id, doc_key, line, d1, d2, bands) of every line; bands only where a task first meets it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign, seen = plan.range_signer(), set()
        for batch in sliced(batches):
            doc, key, line_no, digests, at, new = [], [], [], [], [], []
            for doc_id, text, doc_key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i, line in _lines(text):
                    d = _digest(line)
                    if d not in seen and len(line) > width:
                        at.append(len(doc))
                        new.append(line)
                        if len(seen) < SEEN:
                            seen.add(d)
                    doc.append(doc_id)
                    key.append(doc_key)
                    line_no.append(i)
                    digests.append(d)
            has, signatures = _signed(new, width, sign)
            signed = np.zeros(len(doc), dtype=bool)
            signed[np.array(at, dtype=np.int64)[has]] = True
            bands = packed_bands(plan, signed, np.concatenate([np.empty((0, plan.hashes), dtype=np.uint32), *signatures]))
            d1, d2 = _longs(digests).T
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(line_no, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), bands],
                ["doc_id", "doc_key", "line", "d1", "d2", "bands"],
            )

    return rows.mapInArrow(run, "doc_id bigint, doc_key bigint, line int, d1 bigint, d2 bigint, bands binary")


def removed_lines(docs: DataFrame, num: int = NUM, den: int = DEN, width: int = WIDTH, hashes: int = HASHES) -> DataFrame:
    """(doc_id, doc_key, line, component) of the lines to remove; component: digest of its smallest node."""
    plan = Banding.for_threshold(num, den, hashes, BAND_MISS)
    rows = _keyed(docs)
    staged = materialize(_staged_lines(rows, plan, width))
    nodes = staged.where("octet_length(bands) > 0").select(F.col("d1").alias("node"), "bands")

    def fetch(involved: DataFrame):
        wanted = key_bitmap(involved, "node")

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in sliced(batches):
                node, full = [], []
                lines = [line for text in batch.column(0).to_pylist() for _, line in _lines(text) if len(line) > width]
                digests = _longs([_digest(line) for line in lines])[:, 0]
                hit = np.ones(len(lines), dtype=bool) if wanted is None else in_bitmap(wanted.value, digests)
                for at in np.flatnonzero(hit).tolist():
                    d = int(digests[at])
                    if d not in seen:
                        if len(seen) < SEEN:
                            seen.add(d)
                        node.append(d)
                        full.append(lines[at])
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.nulls(len(node), pa.binary()), pa.array(full, pa.binary())], ["node", "sig", "set"])

        return rows.select("text").mapInArrow(sets, "node bigint, sig binary, set binary"), wanted

    # Lines travel as they are, an eighth of their shingles' size, and are cut where they are compared.
    linked = link(nodes, fetch, plan, POSTERIOR_MISS, screened=False, unpack=lambda lines: _shingled(lines, width))
    keeper = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line", "doc_key"))
    groups = materialize(staged.groupBy("d1", "d2").agg(keeper.alias("first"), F.count("*").alias("n")))
    classes = groups.join(linked, F.col("d1") == F.col("node"), "left").select("d1", "d2", "first", "n", F.col("comp"))
    fuzzy = classes.where("comp is not null")
    best = fuzzy.groupBy("comp").agg(F.min("first").alias("best"))
    fuzzy = join_salted(fuzzy, best, "comp", "d1").select("d1", "d2", "best", F.col("comp").alias("component"))
    exact = classes.where("comp is null and n > 1").select("d1", "d2", F.col("first").alias("best"), F.col("d1").alias("component"))
    repeated = fuzzy.union(exact)
    keep = F.expr("doc_id <=> best.doc_id and line = best.line and doc_key = best.doc_key")
    removed = staged.select("doc_id", "doc_key", "line", "d1", "d2").join(repeated, ["d1", "d2"]).where(~keep)
    out = materialize(removed.select("doc_id", "doc_key", "line", "component").distinct())
    discard(staged, groups, linked)
    return out


def dedup_lines(docs: DataFrame, drop_emptied: bool = False, counts: bool = False, **options) -> DataFrame:
    """``docs`` with repeated lines removed from the text.

    drop_emptied: leave out the rows that had lines and lose all of them. counts: add n_lines and
    n_removed.
    """
    removed = removed_lines(docs, **options)
    gone = removed.groupBy("doc_id", "doc_key").agg(F.collect_list("line").alias("_lost"))  # one document's
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit(""))).alias("_key"))
    both = keyed.join(gone, (F.col("_key") == F.col("doc_key")) & F.col("_id").eqNullSafe(F.col("doc_id")), "left")
    text = F.col("_row")["text"]
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_lost"))
    cleaned = F.when(F.col("_lost").isNull(), text).otherwise(F.transform(F.array(lines), lambda x: F.array_join(F.transform(kept, lambda i: F.get(x, i)), "\n"))[0])  # split once
    n_lines = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D][^\n]*")), F.lit(0)).cast("bigint")  # from a line's first word to its end
    n_removed = F.coalesce(F.size("_lost"), F.lit(0)).cast("bigint")
    n_removed = F.when(F.col("_lost").isNull(), 0).otherwise(n_removed).cast("bigint")
    n_lines = F.when(text.isNull(), 0).otherwise(n_lines).cast("bigint")
    if drop_emptied:
        both = both.where(F.col("_lost").isNull() | (n_removed < n_lines))
    out = []
    for f in docs.schema.fields:
        value = F.col("_row")[f.name]
        if f.name == "text":
            value = cleaned
        elif f.name == "n_chars":
            value = F.when(F.col("_lost").isNull(), value).otherwise(F.length(cleaned)).cast(f.dataType)
        out.append(value.alias(f.name))
    return both.select(*out, *([n_lines.alias("n_lines"), n_removed.alias("n_removed")] if counts else []))
