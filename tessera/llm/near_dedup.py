"""MinHash near-duplicate documents with sequential Bayesian verification.

Equal shingle sets are folded into one node first, by a partially aggregated group-by on a 128-bit
set digest, so thousands of exact copies cost one node. Candidates of banded signatures are
compared in batches of hashes; a pair is dropped as soon as the posterior mass at or above the
threshold falls below the chosen miss probability. Survivors are confirmed on full sets.

Defined results: null or empty text, or white space only: n_shingles 0, a component of its own.
Fewer words than the shingle width: the whole sequence is one shingle. Nodes are sets, not ids:
rows that repeat a doc_id are each judged on their own text, and rows without doc_id link like all
others. A component is named by its smallest doc_id, null only if it has none. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, in_bitmap, join_salted, key_bitmap, materialize, set_digest, sliced, word_shingles
from .linking import Banding, band_batch, link

HASHES = 144
BAND_MISS = 2e-5
POSTERIOR_MISS = 1e-6
#: Sets whose band keys one task has emitted and that it leaves out when they come again.
SEEN = 200_000


def _row_key(id_column: str, text_column: str):
    """Names a row by its id and text; rows equal in both are one document."""
    return F.xxhash64(F.col(id_column).cast("bigint"), F.coalesce(F.col(text_column), F.lit("")))


def _verdicts(
    docs: DataFrame, num: int, den: int, width: int, hashes: int, band_miss: float, posterior_miss: float, id_column: str, text_column: str,
) -> DataFrame:
    """(doc_id, row_key, n_shingles, component_id, chosen) per row; chosen: the row that stands for its component."""
    plan = Banding.for_threshold(num, den, hashes, band_miss)
    rows = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"), _row_key(id_column, text_column).alias("row_key"), F.col(text_column).alias("text")
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign, seen = plan.signer(), set()
        for batch in sliced(batches):
            n, one, two, signatures = [], [], [], []
            for text in batch.column(2):
                shingles = word_shingles(text.as_py(), width)
                n.append(len(shingles))
                digest = set_digest(shingles) if len(shingles) else (None, None)
                one.append(digest[0])
                two.append(digest[1])
                new = len(shingles) > 0 and digest not in seen
                if new and len(seen) < SEEN:
                    seen.add(digest)
                signatures.append(sign(shingles) if new else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), band_batch(plan, signatures)],
                ["doc_id", "row_key", "n_shingles", "d1", "d2", "bands"],
            )

    feats = materialize(rows.mapInArrow(features, "doc_id bigint, row_key bigint, n_shingles bigint, d1 bigint, d2 bigint, bands binary"))

    def fetch(involved: DataFrame):
        # One row of each set is enough, and its key picks it out before its text is cut again.
        named = feats.where("octet_length(bands) > 0").join(involved, F.col("d1") == F.col("node"), "left_semi")
        named = materialize(named.groupBy("d1").agg(F.min("row_key").alias("row_key")))
        wanted = key_bitmap(named, "row_key")

        def sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            sign = plan.signer()
            hit = np.ones(batch.num_rows, dtype=bool) if wanted is None else in_bitmap(wanted.value, batch.column(0).to_numpy(zero_copy_only=False))
            node, sig, full = [], [], []
            for i in np.flatnonzero(hit).tolist():
                shingles = word_shingles(batch.column(1)[i].as_py(), width)
                if len(shingles):
                    node.append(set_digest(shingles)[0])
                    sig.append(sign(shingles).tobytes())
                    full.append(shingles.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()), pa.array(sig, pa.binary()), pa.array(full, pa.binary())], ["node", "sig", "set"]
            )

        return arrow_map(rows.select("row_key", "text"), sets, "node bigint, sig binary, set binary"), wanted

    linked = link(feats.where("octet_length(bands) > 0").select(F.col("d1").alias("node"), "bands"), fetch, plan, posterior_miss)
    own = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "d1", "d2")
    groups = feats.where("d1 is not null").groupBy("d1", "d2").agg(F.min(own).alias("first"))
    groups = materialize(groups.join(linked, F.col("d1") == F.col("node"), "left").select("d1", "d2", "first", "comp"))
    best = groups.where("comp is not null").groupBy("comp").agg(F.min("first").alias("best"))
    classes = (
        join_salted(groups.where("comp is not null"), best, "comp", "d1").select("d1", "d2", "best")
        .union(groups.where("comp is null").select("d1", "d2", F.col("first").alias("best")))
    )
    out = feats.select("doc_id", "row_key", "n_shingles", "d1", "d2").join(classes, ["d1", "d2"], "left")
    alone = F.col("d1").isNull()
    out = materialize(out.select(
        "doc_id", "row_key", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"),
        (alone | own.eqNullSafe(F.col("best"))).alias("chosen"),
    ))
    discard(feats, groups, linked)
    return out


def near_duplicates(
    docs: DataFrame, num: int = 80, den: int = 100, width: int = 5, hashes: int = HASHES,
    band_miss: float = BAND_MISS, posterior_miss: float = POSTERIOR_MISS, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row; links: Jaccard of word shingles >= num / den."""
    found = _verdicts(docs, num, den, width, hashes, band_miss, posterior_miss, id_column, text_column)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_representatives(
    docs: DataFrame, num: int = 80, den: int = 100, width: int = 5, hashes: int = HASHES,
    band_miss: float = BAND_MISS, posterior_miss: float = POSTERIOR_MISS, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """The documents with one of each near-duplicate group; all columns as they were.

    The one kept has the group's smallest doc_id (without any, the smallest set digest). Rows equal in
    doc_id and text are one document: they stay or go together. Rows without a word all stay.
    """
    found = _verdicts(docs, num, den, width, hashes, band_miss, posterior_miss, id_column, text_column)
    chosen = found.where("chosen").select(F.col("row_key").alias("_kept_key")).distinct()
    return docs.join(chosen, _row_key(id_column, text_column) == F.col("_kept_key"), "left_semi")
