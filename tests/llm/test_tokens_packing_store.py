"""Token ids, packing and the store against the tokenizers library itself."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import SCHEMA, edge_rows, frame, prose, table
from tokenizers import Tokenizer

from tessera.llm import packing, token_store
from tessera.llm.common import work_folder
from tessera.llm.tokens import Encoder

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
TRICKY = [
    "", " ", "\n", "a's b'll  x", "  lead", "tail ", "x\n\ny z", "É.è É!? don't I'm. we'RE", "a\tb c d", "İstanbul ΣΑΣ. ſ", "é á. ́x",
    "12 a1b2. #$%&| x|y", "<|endoftext|> a <|startoftext|>b", "\x1c a\x1cb", "a b c.\n d", "a  b", "a  b c", "...", "日本語。 テスト", " .a", "x .\ny", "\0a \0b", None,
]


def plain(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_equal_the_library(path):
    t, e = plain(path), Encoder(path)
    texts = [*TRICKY, prose(1, 500), prose(1, 500)]
    rng = random.Random(5)
    texts += ["".join(rng.choice("ab'.é \n\t　s1") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    expected = [np.array(t.encode(x or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]
    assert e.many(texts) == expected
    assert [e(x) for x in texts[:30]] == expected[:30]


def ids_of(t: Tokenizer, text: str | None) -> list[int]:
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("clashes", [False, True])
def test_packing_places_every_piece(spark, clashes):
    rows = edge_rows()
    got = table(packing.pack_documents(frame(spark, rows, clashes), WORD))
    t = plain(WORD)
    expected = Counter()
    for doc_id, text, *_ in rows:
        ids = ids_of(t, text)
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            expected[(doc_id, k // 2048, k, len(part), crc(part))] += 1
    found = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    assert found == expected
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
        assert g.length.sum() <= 2048


def best_fit(lengths: list[int], room: int) -> int:
    spaces: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [s for s in spaces if s >= n]
        if fit:
            spaces.remove(min(fit))
            spaces.append(min(fit) - n)
        else:
            spaces.append(room - n)
    return len(spaces)


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_about_as_good_as_best_fit(spark, seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5.5, 1.2, 1500), 1, 2048).astype(int).tolist()
    pieces = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id bigint, piece int, length bigint")
    got = table(packing.pack(pieces))
    assert sorted(got.length) == sorted(lengths)
    sums = got.groupby("sequence_id").length.sum()
    assert sums.max() <= 2048
    assert len(sums) <= 1.01 * best_fit(lengths, 2048) + 1


@pytest.mark.parametrize("median", [1, 5, 20, 100, 300, 700])
def test_plan_goes_by_true_lengths(median):
    rng = np.random.default_rng(median)
    spread = 0 if median <= 5 else 0.8
    lengths = np.clip(median * np.exp(spread * rng.normal(size=6000)), 1, 2048).astype(int)
    plan = packing.plan_packing(np.bincount(lengths, minlength=2049))
    assert -(-lengths.sum() // 2048) <= plan.sequences <= best_fit(lengths.tolist(), 2048)
    if median == 20:
        assert plan.sequences == -(-lengths.sum() // 2048)


def test_plan_of_odd_sequence_lengths():
    for sequence in (1, 7, 1027, 2047, 2500, 2501):
        counts = np.random.default_rng(sequence).integers(0, 9, sequence + 1)
        counts[0] = 0
        plan = packing.plan_packing(counts)
        room = np.zeros(plan.sequences)
        ends = np.append(plan.low[1:], 0)
        last = np.append(plan.cls[1:] != plan.cls[:-1], True)
        ends[last] = counts[plan.cls[last]]
        for cls, low, high, first, each in zip(plan.cls, plan.low, ends, plan.sequence, plan.each, strict=True):
            np.add.at(room, first + np.arange(high - low) // each, cls)
        assert room.max() <= sequence and room.sum() == (counts * np.arange(sequence + 1)).sum()


def test_plan_counts():
    rng = np.random.default_rng(0)
    for _ in range(20):
        counts = rng.integers(0, 40, 65) * (rng.random(65) < 0.4)
        counts[0] = 0
        plan = packing.plan_packing(counts)
        assert plan.sequences >= -(-int((counts * np.arange(65)).sum()) // 64)


def test_sequences_hold_their_documents(spark):
    rows = [(i, prose(i, 40 * i), "en", "a", 0) for i in range(1, 9)]
    got = packing.packed_sequences(frame(spark, rows), WORD, 256).collect()
    t = plain(WORD)
    whole = {i: ids_of(t, text) for i, text, *_ in rows}
    seen = Counter()
    for r in got:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.n_tokens <= 256
        for doc, low, high in zip(r.doc_ids, r.offsets, [*r.offsets[1:], len(ids)]):
            part = ids[low:high]
            assert any(whole[doc][k : k + 256] == part for k in range(0, len(whole[doc]), 256))
            seen[doc] += len(part)
    assert seen == {i: len(x) for i, x in whole.items()}


@pytest.mark.parametrize("clashes", [False, True])
def test_store_round_trip(spark, clashes):
    rows = edge_rows()
    got = token_store.store_round_trip(frame(spark, rows, clashes), BYTE).collect()
    t = plain(BYTE)
    whole = Counter((doc, len(ids), crc(ids)) for doc, ids in ((r[0], ids_of(t, r[1])) for r in rows))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == whole
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1].tolist()]
    known = [r.doc_id for r in ordered if r.doc_id is not None]
    assert known == sorted(known) and ordered[0].doc_id is None


def test_store_keeps_equal_chunks_once_and_notices_damage(spark):
    text = prose(9, 3000)
    rows = [(i, text, "en", "a", 0) for i in range(6)] + [(10, "start " + text, "en", "a", 0)]
    folder = work_folder(spark)
    token_store.write_store(frame(spark, rows), folder, BYTE)
    chunks = spark.read.parquet(f"{folder}/chunks")
    recipes = spark.read.parquet(f"{folder}/recipes")
    assert chunks.count() == chunks.select("hash").distinct().count()
    assert recipes.count() > 5 * chunks.count()
    whole = {r.doc_id: r.ids for r in token_store.read_ids(spark, folder).collect()}
    t = plain(BYTE)
    assert np.frombuffer(whole[10], dtype="<u2").tolist() == ids_of(t, rows[-1][1])
    changed = spark.createDataFrame([(r.hash, r.n, bytes(len(r.ids))) for r in chunks.collect()], chunks.schema)
    changed.write.mode("overwrite").parquet(f"{folder}/chunks")
    with pytest.raises(Exception, match="differs from the hash"):
        token_store.read_store(spark, folder).collect()


def test_crc_parts_combine():
    rng = random.Random(1)
    for _ in range(50):
        parts = [rng.randbytes(4 * rng.randint(0, 300)) for _ in range(rng.randint(1, 6))]
        total = 0
        for i, p in enumerate(parts):
            rest = sum(map(len, parts[i + 1 :]))
            total ^= int(token_store.shift_crc(np.array([zlib.crc32(p)]), np.array([rest]))[0])
        assert total == zlib.crc32(b"".join(parts))


def test_cuts_follow_content():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 50_000, 40_000)
    ends = token_store.cut_points(ids)
    assert ends[-1] == len(ids) and max(np.diff([0, *ends])) <= token_store.MAXIMUM
    moved = token_store.cut_points(np.concatenate([ids[:5], ids]))
    assert len({e - 5 for e in moved} & set(ends)) > 0.9 * len(ends)
    assert token_store.cut_points(np.array([0])) == [1]
    documents = [rng.integers(0, 50_000, n) for n in (1, 70, 5000, 3, 64, 12_000, 200)]
    bounds = np.cumsum([len(d) for d in documents]).tolist()
    alone = [low + e for d, low in zip(documents, [0, *bounds]) for e in token_store.cut_points(d)]
    assert token_store.cut_points(np.concatenate(documents), bounds) == alone


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.pack_documents(empty, WORD).count() == 0
    assert token_store.store_round_trip(empty, BYTE).count() == 0


def test_words_that_powers_of_one_base_confuse():
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word, word.translate(str.maketrans("ab", "ba")), f"{word} {word[::-1]}"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encode = Encoder(public_tokenizers.path(name))
        expected = [np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        assert encode.many(texts) == expected
