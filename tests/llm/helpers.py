from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside; extra columns of the input may have them too.
CLASHES = (
    "node", "key", "hub", "comp", "set", "sig", "bands", "rep", "d1", "size", "target", "taken", "piece", "length", "offset", "sequence_id",
    "start", "rank", "uid", "hash", "at", "n", "g", "x0", "d2", "kept", "score", "id", "v", "cell", "line", "spans", "label", "_gone", "n_lines",
)
WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper kapok larch maple nutmeg oak pine quince rowan spruce teak".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + str(rng.randint(0, 30)))
        if i % 12 == 11:
            out[-1] += rng.choice([".", ".\n"])
    return " ".join(out).replace("\n ", "\n")


def edge_rows() -> list[tuple]:
    """Nulls, empty and long texts, copies, repeated rows and ties."""
    long = prose(1, 9000)
    rows = [
        (1, prose(2, 200), "en", "a", 1), (2, prose(2, 200), "en", "a", 1), (3, None, "en", None, None), (4, "", None, "b", 0), (5, " \t\n", "de", "b", 3),
        (6, "one", "en", "c", 3), (7, "One", None, None, 3), (8, long, "fr", "a", len(long)), (9, prose(3, 60), "en", "a", 1), (9, prose(3, 60), "en", "a", 1),
        (9, prose(4, 60), "en", "b", 1), (None, prose(5, 60), "en", "b", 1), (None, None, None, None, None), (10, "é è ü 日本 \U0001f600 <|endoftext|>", "es", "é", 9),
        (11, long + " tail", "fr", "a", 1),
    ]
    return rows


def frame(spark, rows: list[tuple], clashes: bool = False):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES]) if clashes else df


def table(df, *order: str) -> pd.DataFrame:
    out = df.toPandas()
    return out.sort_values(list(order)).reset_index(drop=True) if order else out
