"""Operators against brute force and on edge cases."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.functions import predicates as P
from tessera.operators import relational as R
from tessera.streaming.replication import SCHEMA, Replica


def test_interval_join_matches_brute_force(spark):
    rng = random.Random(3)
    left = [(i, a := rng.randint(-40, 40), a + rng.randint(0, 30)) for i in range(80)] + [(99, None, 3), (98, 5, None), (97, 9, 3)]
    right = [(i, a := rng.randint(-40, 40), a + rng.randint(0, 9)) for i in range(80)]
    one = spark.createDataFrame(left, "i int, a int, b int")
    two = spark.createDataFrame(right, "j int, c int, d int")
    got = sorted((r.i, r.j) for r in R.interval_join(one, two, ("a", "b"), ("c", "d"), 7).collect())
    expected = sorted((i, j) for i, a, b in left for j, c, d in right if None not in (a, b) and a <= b and a <= d and b >= c)
    assert got == expected


def test_null_keys_never_join(spark):
    one = spark.createDataFrame([(1,), (None,)], "a int")
    two = spark.createDataFrame([(1,), (None,)], "b int")
    assert R.equi_join(one, two, [("a", "b")]).count() == 1
    assert R.anti_join(one, two, [("a", "b")]).count() == 1
    for strategy in ("hash", "merge", "broadcast"):
        assert R.equi_join(one, two, [("a", "b")], strategy=strategy).count() == 1


def test_rankings_order_nulls(spark):
    df = spark.createDataFrame([(1, 150), (2, 150), (3, 400), (4, None)], "id int, amount int")
    up = {r.id: r.RANK for r in R.ranking(df, "rank", [], [("amount", False)]).collect()}
    down = {r.id: r.DENSE_RANK for r in R.ranking(df, "dense_rank", [], [("amount", True)]).collect()}
    assert up == {1: 1, 2: 1, 3: 3, 4: 4}
    assert down == {4: 1, 3: 2, 1: 3, 2: 3}


def test_empty_global_aggregate(spark):
    row = R.aggregate(spark.createDataFrame([], "x int"), [], {"n": F.count(F.lit(1)), "s": F.sum("x")}).first()
    assert (row.n, row.s) == (0, None)


def test_predicates_on_nulls(spark):
    df = spark.createDataFrame([(None, None, None)], "t string, a array<int>, j string")
    row = df.select(P.contains_word("t", "x"), P.array_has("a", 1), P.json_text("j", "k")).first()
    assert list(row) == [None, None, None]
    odd = spark.createDataFrame([("no json",), ('{"k": 42.0}',), ('{"k": "a\'b"}',)], "j string")
    assert [r[0] for r in odd.select(P.json_text("j", "k")).collect()] == [None, "42", "a'b"]


def test_replication_applies_whole_transactions(spark, tmp_path):
    replica = Replica(spark, str(tmp_path / "replica"))
    first = [(1, 1, "put", "a", "1"), (2, 2, "put", "b", "2"), (1, 3, "commit", None, None), (3, 4, "put", "c", "3"), (3, 5, "rollback", None, None)]
    second = [(2, 6, "delete", "a", None), (2, 7, "commit", None, None)]
    replica.apply(spark.createDataFrame(first, SCHEMA), 0)
    assert sorted(map(tuple, replica.rows().collect())) == [("a", "1")]
    for _ in range(2):  # a batch that runs again changes nothing
        replica.apply(spark.createDataFrame(second, SCHEMA), 1)
        assert sorted(map(tuple, replica.rows().collect())) == [("b", "2")]


def test_replication_follows_a_folder(spark, tmp_path):
    log = tmp_path / "log"
    spark.createDataFrame([(1, 1, "put", "a", "1"), (1, 2, "commit", None, None)], SCHEMA).coalesce(1).write.json(str(log))
    replica = Replica(spark, str(tmp_path / "replica"))
    replica.follow(str(log), str(tmp_path / "checkpoint")).awaitTermination()
    assert [tuple(r) for r in replica.rows().collect()] == [("a", "1")]
