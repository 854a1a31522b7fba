"""Mixing, nearest neighbours and the pipeline."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from helpers import SCHEMA, edge_rows, frame, prose, table
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ann, mixing, near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_apportion(votes: list[float], seats: int) -> list[int]:
    out = [0] * len(votes)
    for _ in range(seats if sum(votes) else 0):
        i = max(range(len(votes)), key=lambda k: (votes[k] / (2 * out[k] + 1), -k))
        out[i] += 1
    return out


def test_apportionment_equals_seat_by_seat():
    rng = random.Random(8)
    for _ in range(300):
        votes = [float(rng.choice([0, 1, 5, rng.randint(0, 1000)])) for _ in range(rng.randint(1, 12))]
        seats = rng.randint(0, 200)
        assert mixing.apportion(votes, seats) == slow_apportion(votes, seats), (votes, seats)


def test_targets_stop_at_their_caps():
    got = {s: t for s, _, t in mixing.source_targets({"b": 100, "a": 1000, None: 10, "c": 5})}
    assert sum(got.values()) == pytest.approx(1.5 * 1115)
    assert got[None] == 20 and got["c"] == 10 and got["b"] == 200 and got["a"] == pytest.approx(1442.5)
    assert [s for s, *_ in mixing.source_targets({"é": 1, "z": 1, "Z": 1, None: 1})] == ["Z", "z", "é", None]
    assert mixing.source_targets({}) == [] and mixing.source_targets({"a": 0}) == [("a", 0, 0.0)]


def corpus() -> list[tuple]:
    rng = random.Random(3)
    return [(i, prose(i, rng.randint(1, 400)), "en", rng.choice("aaaaaabcd"), 0) for i in range(500)] + edge_rows()


def test_mix_meets_its_targets(spark):
    df = frame(spark, corpus(), True)
    got = table(mixing.mix(df), "doc_id", "size", "taken")
    again = table(mixing.mix(df.repartition(7)), "doc_id", "size", "taken")
    assert got.equals(again)
    assert (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    assert sorted(got["size"]) == sorted(len(WORD.findall(r[1] or "")) for r in corpus())
    for _, g in got.groupby("target"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(64, 0.01 * g.target.iloc[0])
        assert g["size"].sum() == g.source_size.iloc[0]


def test_mixture_holds_what_the_mix_says(spark):
    df = frame(spark, corpus(), True)
    rows = mixing.mixture(df)
    assert rows.columns == df.columns
    words = rows.select("source", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n")).groupBy("source").agg(F.sum("n").alias("n"))
    taken = mixing._plan(df, mixing.SEED, mixing.BLOCK_WORDS, mixing.SHARD_DIGITS).groupBy("source").agg(F.sum("_taken").alias("t")).where("t > 0")
    assert {r.source: r.n for r in words.collect()} == {r.source: r.t for r in taken.collect()}
    texts = {r[1] for r in corpus()}
    assert all(any(t.startswith(r.text) for t in texts if t) for r in rows.limit(40).collect())


def test_mix_of_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


# --- nearest neighbours ------------------------------------------------------------------------


def brute(vectors: dict[int, np.ndarray], query: int, k: int) -> list[tuple[int, float]]:
    scores = [(i, float((v.astype(np.float64) * vectors[query]).sum())) for i, v in vectors.items() if i != query]
    return sorted(scores, key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize(("size", "spread"), [(64, 0.0), (20, 0.0), (64, 0.5)])
def test_recall(spark, size, spread):
    rng = np.random.default_rng(size)
    x = rng.normal(size=(900, size))
    x[300:600] = x[:300] + 0.3 * rng.normal(size=(300, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= 1 + spread * rng.random((900, 1))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = table(ann.nearest(df, F.col("vec_id") % 20 == 0), "query_id", "rank")
    vectors = dict(enumerate(x.astype(np.float64)))
    hits = 0
    for q, g in got.groupby("query_id"):
        expected = brute(vectors, q, 20)
        assert g["rank"].tolist() == list(range(1, 21))
        assert g.score.is_monotonic_decreasing
        exact = {i: float((vectors[i] * vectors[q]).sum()) for i in g.vec_id}
        assert all(abs(exact[i] - s) < 1e-12 for i, s in zip(g.vec_id, g.score, strict=True))
        hits += len({i for i, _ in expected} & set(g.vec_id))
    assert got.query_id.nunique() == 45
    assert hits >= 0.9 * 45 * 20


def test_ties_few_rows_and_unsound_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0, 0.5], "x") for i in (0, 7, 3, 40)] + [(20, [0.0, 1.0, 0.0], "x"), (20, [0.0, 1.0, 0.0], "x")]
    rows += [(60, None, "x"), (80, [0.0, 0.0, 0.0], "x"), (100, [1.0, None, 0.0], "x"), (120, [nan, 1.0, 0.0], "x"), (140, [inf, 1.0, 0.0], "x"), (160, [1.0], "x"), (None, [1.0, 1.0, 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, cell string")
    got = table(ann.nearest(df, F.col("vec_id") % 20 == 0), "query_id", "rank")
    assert got[got.query_id == 0].vec_id.tolist() == [3, 7, 40, 20]
    assert got[got.query_id == 20].vec_id.tolist() == [0, 3, 7, 40]
    assert sorted(got.query_id.unique()) == [0, 20, 40]
    one = spark.createDataFrame([(0, [1.0])], "vec_id bigint, embedding array<float>")
    assert ann.nearest(one, F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(one.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_repeated_ids_hide_no_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 16))
    x[1:60] = x[0] + 0.3 * rng.normal(size=(59, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    # Every row twice, the query 40 times, and three hot ids near it 60 times each.
    ids = [*range(700), *range(700), *[0] * 38, *[i for i in (1, 2, 3) for _ in range(58)]]
    df = spark.createDataFrame([(i, x[i].tolist()) for i in ids], "vec_id bigint, embedding array<double>")
    got = table(ann.nearest(df, F.col("vec_id") % 100 == 0, probes=1.0), "query_id", "rank")
    vectors = dict(enumerate(x))
    for q in range(0, 700, 100):
        assert got[got.query_id == q].vec_id.tolist() == [i for i, _ in brute(vectors, q, 20)]


def test_rotation_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(50, 64))
    index = ann.CrossPolytope(64, 2, False, 1.0)
    assert np.allclose(np.linalg.norm(index.rotate(x, 0, True), axis=1), np.linalg.norm(x, axis=1))
    assert (index.probes(x, 0, 1)[:, 0] == index.cell(x, 0)).all()


# --- pipeline ----------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], sf_dir).cache())
    for out in frames[1:-1]:
        assert out.columns == columns
    docs, clean, lines, single, mixed, packed = frames
    assert 0.8 * docs.count() < clean.count() <= docs.count()
    assert lines.select("doc_id").subtract(clean.select("doc_id")).count() == 0
    verdict = near_dedup.near_duplicates(lines)
    assert single.count() == verdict.where("kept").count()
    assert near_dedup.near_duplicates(single).where("not kept").count() == 0
    assert mixed.select("doc_id").subtract(single.select("doc_id")).count() == 0
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
    assert packed.count() >= mixed.count()
    for f in frames[1:]:
        f.unpersist()
