"""Near-duplicate documents and lines against brute force."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
from helpers import SCHEMA, edge_rows, frame, prose

from tessera.llm import line_dedup, linking, near_dedup
from tessera.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, width: int = 5) -> frozenset:
    words = WORD.findall((text or "").translate(FOLD))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def classes(sets: list, num: int, den: int) -> list[int]:
    """Index of the class of each set; empty sets link with nothing."""
    of = list(range(len(sets)))

    def find(i: int) -> int:
        while of[i] != i:
            i = of[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if both and den * both >= num * len(sets[i] | sets[j]):
            of[find(j)] = find(i)
    return [find(i) for i in range(len(sets))]


def corpus() -> list[tuple]:
    rng = random.Random(7)
    rows, base = [], [prose(100 + i, rng.choice([30, 80, 200])) for i in range(25)]
    for i, text in enumerate(base):
        rows.append(text)
        for _ in range(rng.choice([0, 1, 3, 8])):
            words = text.split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"new{rng.randint(0, 999)}"
            rows.append(" ".join(words))
    chain = prose(999, 150).split(" ")
    for k in range(12):  # a chain: neighbours are linked, its ends are not
        rows.append(" ".join(chain))
        chain[6 * k + 3] = f"step{k}"
    rng.shuffle(rows)
    return [(i, t, "en", "a", len(t)) for i, t in enumerate(rows)]


@pytest.mark.parametrize("num", [80, 85])
def test_classes_equal_brute_force(spark, num):
    rows = corpus()
    sets = [shingles(r[1]) for r in rows]
    expected = classes(sets, num, 100)
    least = {}
    for i, c in enumerate(expected):
        least.setdefault(c, i)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(frame(spark, rows), num=num).collect()}
    for i, c in enumerate(expected):
        assert got[i].component_id == least[c]
        assert got[i].n_shingles == len(sets[i])
        assert got[i].kept == (least[c] == i)


def test_document_edge_cases(spark):
    rows = edge_rows()
    got = near_dedup.near_duplicates(frame(spark, rows, True), num=85).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for r in by[2]} == {1} and not by[2][0].kept
    for i in (3, 4, 5):
        assert by[i][0].n_shingles == 0 and by[i][0].component_id == i and by[i][0].kept
    assert by[7][0].component_id == 6 and by[6][0].n_shingles == 1
    assert by[11][0].component_id == 8
    assert all(r.component_id == 9 for r in by[9])
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(r[1])) for r in rows)
    kept = near_dedup.keep_representatives(frame(spark, rows, True), num=85)
    assert kept.columns == frame(spark, rows, True).columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 3, 4, 5, 6, 8, 9, 9, 9, 10]


def test_crowded_bucket_is_compared_across_blocks(spark):
    """More members under one hub than a block holds, linked to each other but not to the hub."""
    rng = random.Random(11)
    base = prose(50, 120).split(" ")
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 9999)}"
        rows.append((i, " ".join(words), "en", "a", 0))
    expected = classes([shingles(r[1]) for r in rows], 85, 100)
    least = {}
    for i, c in enumerate(expected):
        least.setdefault(c, i)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows), num=85).collect()}
    assert got == {i: least[c] for i, c in enumerate(expected)}


def test_components_of_long_paths(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 30)] + [(5, 5)]
    rng.shuffle(links)
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 130)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_screen_keeps_what_may_be_alike():
    plan = linking.Banding.for_threshold(85, 100, 144, 2e-5)
    rng, sign = np.random.default_rng(3), None
    sign = plan.signer()
    lost = 0
    for _ in range(200):
        union = rng.integers(0, 2**63, 400, dtype=np.uint64)
        one, two = np.sort(union[:370]), np.sort(union[30:])
        pair = np.stack([sign(one)]), np.stack([sign(two)])
        lost += not len(linking._screen(*pair, plan.screen_table(1e-6)))
    assert lost == 0
    far = np.stack([sign(rng.integers(0, 2**63, 300, dtype=np.uint64)) for _ in range(2)])
    assert not len(linking._screen(far[:1], far[1:], plan.screen_table(1e-6)))


def lines_removed(rows: list[tuple], num: int = 80, width: int = 8) -> dict[int, int]:
    lines = [(i, k, raw.strip(" \t\n\x0b\x0c\r")) for i, text, *_ in rows if text for k, raw in enumerate(text.split("\n"))]
    lines = [x for x in lines if x[2]]
    distinct = list(dict.fromkeys(x[2] for x in lines))
    sets = [frozenset(l[a : a + width] for a in range(max(1, len(l) - width + 1))) if len(l) > width else frozenset(["=" + l]) for l in distinct]
    of = dict(zip(distinct, classes(sets, num, 100), strict=True))
    seen, out = set(), {}
    for i, _, line in sorted(lines, key=lambda x: x[:2]):
        out[i] = out.get(i, 0) + (of[line] in seen)
        seen.add(of[line])
    return out


def test_line_bands_lose_few_pairs():
    plan = linking.Banding.for_threshold(line_dedup.NUM, line_dedup.DEN, line_dedup.HASHES, line_dedup.BAND_MISS)
    for alike, most in ((0.80, 2.3e-4), (0.85, 7.5e-6), (0.90, 4.5e-8)):
        assert (1 - alike**plan.rows) ** plan.bands <= most


def test_lines_equal_brute_force(spark):
    rng = random.Random(5)
    pool = [prose(200 + i, rng.choice([3, 8, 20])).replace("\n", " ") for i in range(40)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            line = rng.choice(pool)
            if rng.random() < 0.4:
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice("xyzé") + line[at:]
            lines.append(line + rng.choice(["", " ", "\r"]))
        rows.append((i, "\n".join([*lines, ""]), "en", "a", 0))
    got = line_dedup.dedup_lines(frame(spark, rows), counts=True).collect()
    expected = lines_removed(rows)
    assert {r.doc_id: r.n_removed for r in got} == expected
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert set(r.text.split("\n")) <= set(texts[r.doc_id].split("\n"))


def test_line_edge_cases(spark):
    rows = [
        (1, "same line here\n\nother words stay", "en", "a", 7), (2, "same line here\n\n", "en", "a", 7), (3, None, None, None, None), (4, "", "en", "a", 0),
        (5, "tiny\ntiny", "en", "a", 9), (None, "same line here", "en", "a", 1), (6, "fresh", "en", "a", 1), (6, "fresh", "en", "a", 1), (7, "x" * 300_000, "en", "a", 1),
    ]
    df = frame(spark, rows, True)
    got = line_dedup.dedup_lines(df)
    assert got.columns == df.columns
    texts = sorted(((r.doc_id or 0), r.text) for r in got.collect() if r.text is not None)
    assert texts == [(0, ""), (1, "same line here\n\nother words stay"), (2, "\n"), (4, ""), (5, "tiny"), (6, "fresh"), (6, "fresh"), (7, "x" * 300_000)]
    left = line_dedup.dedup_lines(df, drop_emptied=True).collect()
    assert sorted(r.doc_id for r in left) == [1, 3, 4, 5, 6, 6, 7]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_dedup.near_duplicates(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0


def test_nodes_are_texts_not_ids(spark):
    """Repeated doc_ids with other texts, and near copies without an id."""
    base, other = prose(61, 120).split(" "), prose(62, 90)
    near = [" ".join([*base[:60], f"edit{i}", *base[61:]]) for i in range(3)]
    rows = [(1, " ".join(base)), (9, near[0]), (9, other), (None, near[1]), (None, prose(63, 50)), (None, prose(63, 50) + " more"), (9, other)]
    df = frame(spark, [(i, t, "en", "a", 0) for i, t in rows])
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(df).collect())
    n = [len(shingles(t)) for _, t in rows]
    assert got == sorted([(1, n[0], 1, True), (9, n[1], 1, False), (9, n[2], 9, True), (0, n[3], 1, False), (0, n[4], 0, False), (0, n[5], 0, False), (9, n[2], 9, True)])
    kept = [r.text for r in near_dedup.keep_representatives(df).collect()]
    assert sorted(kept)[:0] == [] and kept.count(other) == 2 and " ".join(base) in kept and len(kept) == 4


def test_complementary_words_do_not_collide(spark):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    twin = word.translate(str.maketrans("ab", "ba"))
    rows = [(i, f"{w} {w}x {w}y {w}z {w}q", "en", "a", 0) for i, w in enumerate((word, twin))]
    assert [r.component_id for r in near_dedup.near_duplicates(frame(spark, rows)).orderBy("doc_id").collect()] == [0, 1]


def test_local_and_distributed_components_agree(spark):
    rng = random.Random(4)
    links = spark.createDataFrame([(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)], "a bigint, b bigint")
    one, two = ({r.node: r.comp for r in components(links, local=n).collect()} for n in (0, 1_000))
    assert one == two and len(one) > 100


def test_ranges_are_signed_like_single_sets(monkeypatch):
    """Many lines' signatures come from one product, also where a line is cut by the products' bounds."""
    monkeypatch.setattr(linking, "SIGNED", 50)
    plan = linking.Banding.for_threshold(80, 100, 42, 1e-3)
    hashes = np.random.default_rng(2).integers(0, 2**63, 700, dtype=np.uint64)
    starts, ends = np.array([0, 3, 60, 100, 150, 420, 699]), np.array([3, 40, 61, 150, 410, 500, 700])
    expected = [plan.signer()(hashes[a:b]) for a, b in zip(starts, ends, strict=True)]
    assert np.array_equal(plan.range_signer()(hashes, starts, ends), expected)
    assert plan.range_signer()(hashes[:9], starts[:0], ends[:0]).shape == (0, plan.hashes)


def test_lines_hashed_together_equal_lines_alone(monkeypatch):
    lines = [b"short", b"a line of more than eight", "日本語の長い行はここにあります".encode(), b"exactly8", b"x" * 300, b"exactly 9", "é".encode() * 8]
    alone = [line_dedup._shingled([x], 8)[0].tolist() for x in lines]
    assert [len(x) for x in alone] == [0, 18, 8, 0, 293, 2, 0]
    for piece in (1, 40, 1 << 15):
        monkeypatch.setattr(line_dedup, "PIECE", piece)
        assert [x.tolist() for x in line_dedup._shingled(lines, 8)] == alone


def test_band_keys_travel_packed(spark, monkeypatch):
    """The keys that several nodes have, each with its smallest node, from far fewer shuffled rows than keys."""
    rng = random.Random(8)
    rows = [(rng.randint(-400, 400), [rng.choice([7, -7, rng.randint(-(2**63), 2**63 - 1), rng.randint(-900, 900)]) for _ in range(5)]) for _ in range(3000)]
    nodes = {}
    for node, bands in rows:
        for key in bands:
            nodes.setdefault(key, set()).add(node)
    packed_rows = [(node, np.array(bands, dtype=np.int64).tobytes()) for node, bands in rows]
    table = spark.createDataFrame(packed_rows, "node bigint, bands binary").repartition(3)
    for packed in (1 << 20, 500):
        monkeypatch.setattr(linking, "PACKED", packed)
        found = linking.crowded_keys(table)
        assert sorted((r.key, r.hub) for r in found.collect()) == sorted((k, min(v)) for k, v in nodes.items() if len(v) > 1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan and "Generate" not in plan
    assert linking.crowded_keys(table.where("node > 1000")).count() == 0


def test_lines_with_a_word_are_counted_as_they_are_split(spark):
    texts = ["", "\n", " \t\r\n\x0b\x0c\n", "one", "\none\n\n two \n", "a\x0b\nb\x85\n \n ", "\r\n x\r\n\r\n", "\U0001f600\n\n.\n"]
    got = line_dedup.dedup_lines(frame(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)]), counts=True)
    assert {r.doc_id: r.n_lines for r in got.collect()} == {i: sum(bool(WORD.search(x)) for x in t.split("\n")) for i, t in enumerate(texts)}
