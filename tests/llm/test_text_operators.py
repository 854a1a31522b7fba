"""Secrets, toxicity, html and quality rules."""

from __future__ import annotations

import itertools
import time
import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib

import numpy as np
import pytest
from helpers import SCHEMA, edge_rows, frame, prose, table
from pyspark.sql import functions as F

from tessera.llm import html_extract, quality, secret_scan, toxicity

KEY = "AKIA" + "QRSTUVWXYZ234567"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def brute(text: str) -> list[str]:
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(4)
    parts = ["password", "API_KEY", "apikey", ": ", " = '", '"', "hunter2hunter2", KEY, "AKIA", "ab12" * 9, "é", "\n", "ſecret=abcdefgh", "tokeN=", "deadbeef", " "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))), "en", "a", 0) for i in range(300)] + edge_rows()
    got = secret_scan.scan(frame(spark, rows, True)).collect()
    for r, row in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(rows, key=lambda r: str(r[0])), strict=True):
        base = brute(row[1] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(b.startswith(k) for b in base) for k in secret_scan.KINDS]
        assert set(base) <= set(r.spans.split(",")) | {""}


@pytest.mark.parametrize("wrap", [
    lambda s: base64.b64encode(s.encode()).decode(),
    lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="),
    lambda s: base64.b64encode(base64.b64encode(s.encode())).decode(),
    lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    lambda s: base64.b64encode(zlib.compress(base64.b64encode(s.encode()))).decode(),
])
def test_nested_layers_map_to_their_run(wrap):
    run = wrap(f"the key is {KEY} indeed")
    text = f"prose before é {run} and after"
    spans = secret_scan.all_spans(text, secret_scan.base_spans(text))
    assert (text.index(run), text.index(run) + len(run), 1) in spans


def test_escapes_map_character_by_character():
    text = "x token%3Dabcdefgh%C3%A9 y"
    assert (2, 18, 0) in secret_scan.all_spans(text, secret_scan.base_spans(text))
    escaped = "\\u0070assword: \\x68unter2hunter2 rest"
    (span,) = secret_scan.all_spans(escaped, [])
    assert escaped[span[0] : span[1]] == "\\u0070assword: \\x68unter2hunter2"
    twice = urllib.parse.quote(urllib.parse.quote("secret=abcdefghij"))
    assert (0, len(twice), 0) in secret_scan.all_spans(twice, [])
    assert secret_scan.all_spans("&#112;assword=abcdefgh", []) == [(0, 22, 0)]


def test_odd_layers_end():
    for text in ("%25" * 50, "%" * 40, "A" * 5000, base64.b64encode(b"\x1f\x8b broken").decode(), "\\u{110000} \\ud800", "&#0;" * 9):
        assert secret_scan.all_spans(text, []) == []


def test_compressed_layers_are_read_to_their_end():
    def found(data: bytes) -> bool:
        run = base64.b64encode(data).decode()
        return (2, 2 + len(run), 1) in secret_scan.all_spans(f"a {run} b", [])

    secret = f"the key is {KEY} indeed".encode()
    log = "one line of a lóng log, as they are\n".encode() * 500_000  # over 16 MiB
    assert len(log) > 1 << 24
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress):
        assert found(pack(log + secret))
        assert found(pack(b"first member") + pack(secret))
        assert found(pack(secret[:15]) + pack(secret[15:]))
        assert not found(pack(log))
    assert found(gzip.compress("é".encode() * (9 << 20) + b"\n" + secret))
    assert found(gzip.compress(b"gzip, then bz2") + bz2.compress(secret))
    nested = secret
    for _ in range(40):
        nested = zlib.compress(nested)
    assert found(nested)
    assert found(b"x^2 is no zlib stream: " + secret)
    assert found(gzip.compress(secret)[:-8])


@pytest.mark.parametrize("width", [64, 76])
@pytest.mark.parametrize("break_", ["\n", "\r\n", "\n    "])
def test_wrapped_base64_is_joined(width, break_):
    rng = random.Random(width)
    filler = "".join(rng.choice("abcdefgh é\n") for _ in range(300))
    secret = f"the key is {KEY} indeed"
    payloads = [gzip.compress((filler + secret).encode()), zlib.compress((filler + secret).encode())]
    payloads += [("é" + "x" * n + " " + secret + filler).encode() for n in range(20, 60)]
    for data in payloads:
        flat = base64.b64encode(data).decode()
        run = break_.join(flat[i : i + width] for i in range(0, len(flat), width))
        for after in ("\nand after", "\n-----END", ""):
            text = f"before:\n{run}{after}"
            assert (8, 8 + len(run), 1) in secret_scan.all_spans(text, [])


def test_redaction(spark):
    text = f"a {KEY} b"
    out = secret_scan.redact(frame(spark, [(1, text, "en", "a", 1), (2, None, None, None, None)])).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["a [secret] b", None]


# --- toxicity ----------------------------------------------------------------------------------


def labelled(n: int) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.25)
        sentences = [prose(1000 + 7 * i + k, rng.randint(4, 15)).replace("\n", " ") for k in range(rng.randint(1, 8))]
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] = f"you {rng.choice(['grobian', 'lumpazi', 'grobiane'])} {sentences[at]}"
        rows.append((i, ". ".join(sentences) + ".", "en", "a", 0))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_accuracy_and_location(spark):
    rows, marks = labelled(900)
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = table(toxicity.score(docs, model), "doc_id")
    truth = np.array([m[2] for m in marks])
    out = got.held_out.to_numpy()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(900)]).all()
    assert (got.predicted.to_numpy() == truth)[out].mean() > 0.97
    found = toxicity.offending_sentences(docs, model).collect()
    texts = {r[0]: r[1] for r in rows}
    hits = [r for r in found if re.search("grobian|lumpazi", r.sentence)]
    assert len(hits) > 0.9 * len(found) > 100
    assert all(texts[r.doc_id][r.start : r.end] == r.sentence for r in found)
    kept = toxicity.remove_toxic(docs, labels)
    assert {r.doc_id for r in kept.collect()} == set(got.doc_id[got.predicted == 0])


def test_toxicity_edge_cases(spark):
    docs = frame(spark, edge_rows(), True)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, none)).collect()
    assert len(got) == len(edge_rows()) and {r.score for r in got} == {0.0}
    odd = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (9, None, 0), (None, 1, 1), (6, 1, None), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, toxicity.fit(docs, odd)).collect())
    assert toxicity.score(spark.createDataFrame([], SCHEMA), toxicity.fit(docs, odd)).count() == 0


def test_labels_of_the_fold_are_never_used(spark):
    rows, marks = labelled(200)
    docs = frame(spark, rows)
    schema = "doc_id bigint, quality int, toxic int"
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in marks]
    a, b = (toxicity.fit(docs, spark.createDataFrame(m, schema)).weights for m in (marks, flipped))
    assert (a == b).all()


# --- html --------------------------------------------------------------------------------------

LONG = "A sentence with words, commas, and an end. Another one follows it, as they do; then a third."


def test_article_only():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>{LONG}</p>";</script></head><body>
    <header><p>{LONG}</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad --><div class="ad">{LONG}</div>
    <div class="cookie-notice"><p>{LONG}</p></div><article><h1>A heading</h1><p><b>First &amp; {LONG}<br><p>Second  para&nbsp;graph,
    {LONG}</p><p>Short.</p><form><p>{LONG}</p></form><ul><li>item one</li><li>item two</li></ul></article>
    <aside><p>{LONG}</p></aside><div id="comments"><p>{LONG}</p></div><footer>&copy; {LONG}"""
    assert html_extract.main_text(page).split("\n") == [
        "A heading", f"First & {LONG}", f"Second para graph, {LONG}", "Short.", "item one", "item two",
    ]


def test_page_without_article():
    page = f"<body><div><a href=x>menu</a> <a href=y>links</a></div><div class=content><p>{LONG}</p><p>{LONG}</p></div><div class='sidebar'>{LONG}</div>"
    assert html_extract.main_text(page) == f"{LONG}\n{LONG}"


@pytest.mark.parametrize("page", [None, "", "   ", "<p>", "<script>x", "<!-- <p>a</p>", "</p></div>", "<nav>menu</nav>"])
def test_pages_without_text(page):
    assert html_extract.main_text(page) == ""


def test_broken_markup():
    assert html_extract.main_text("just text & <b>bold") == "just text & bold"
    assert html_extract.main_text('<p title="a>b">x < y</p>') == "x < y"
    assert html_extract.main_text("<p>" + "<b>" * 3000 + LONG) == LONG
    assert html_extract.main_text("<table><tr><td>a, b.<td>c, d.<tr><td>e, f.</table>") == "a, b.\nc, d.\ne, f."


def test_html_table(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", "x"), (1, "u", f"<p>{LONG}</p>", "x"), (2, None, None, None), (None, "u", "", "x")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, LONG, len(LONG)), (1, LONG, len(LONG)), (2, "", 0)]
    assert html_extract.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# --- quality -----------------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    places: dict[tuple, list[int]] = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_statistics_equal_brute_force(spark):
    rng = random.Random(2)
    rows = edge_rows()
    for i in range(80):
        part = prose(500 + i % 9, rng.randint(1, 30))
        rows.append((100 + i, "\n".join(rng.choice([part, prose(i, 9), "# * | x", ""]) for _ in range(rng.randint(1, 6))), "en", "a", 0))
    rows.append((500, "spam " * 3000, "en", "a", 0))
    got = quality.judge(frame(spark, rows, True)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((str(r.doc_id), *[r[n] for n in names]) for r in got) == sorted((str(r[0]), *measured(r[1])) for r in rows)
    assert not any(r.kept for r in got if r.base_failed)


def test_outliers_are_rejected_and_clean_documents_kept(spark):
    rows = [(i, prose(i, 60 + i % 200), "en", "a" if i % 3 else "b", 0) for i in range(600)]
    odd = [(1000 + i, " ".join(w + "###" for w in prose(i, 120).split()), "en", "a", 0) for i in range(30)]
    got = {r.doc_id: r.kept for r in quality.judge(frame(spark, rows + odd)).collect()}
    assert not any(got[r[0]] for r in odd)
    assert sum(got[r[0]] for r in rows) >= 0.995 * len(rows)


def test_one_statistic_alone_rejects(spark):
    rng = random.Random(8)
    rows = [(i, prose(i, 60 + i % 200), "en", "a", 0) for i in range(600)]
    lines, repeats, once = [], [], []
    for i in range(20):
        short = prose(2000 + i, 10).split()
        lines.append((1000 + i, "\n".join(short + [rng.choice(short) for _ in range(40)]), "en", "a", 0))
        words = prose(3000 + i, 860).split()
        repeats.append((1100 + i, " ".join(words + words[:140]), "en", "a", 0))
        parts = [" ".join(prose(4000 + 9 * i + k, 9).split()) for k in range(8)]
        once.append((1200 + i, "\n".join([*parts, parts[0]]), "en", "a", 0))
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows + lines + repeats + once)).collect()}
    assert not any(got[r[0]].base_failed for r in lines + repeats + once)
    assert not any(got[r[0]].kept for r in lines)
    assert not any(got[r[0]].kept for r in repeats)
    assert all(got[r[0]].kept for r in once)
    assert sum(got[r[0]].kept for r in rows) >= 0.995 * len(rows)


def test_concentration_resists_what_a_plain_covariance_does_not(spark):
    rng = np.random.default_rng(0)
    good = rng.normal(0, 1, (400, 4))
    bad = rng.normal(0, 0.1, (90, 4)) + 12
    rows = [("g", *map(float, x)) for x in np.concatenate([good, bad])]
    df = spark.createDataFrame(rows, "g string, x0 double, x1 double, x2 double, x3 double")
    estimate = quality._start(df)
    for _ in range(4):
        estimate = quality.materialize(quality._moments(quality._inner(df, estimate, 0.75), quality._consistency(0.75, 4)))
    far = quality._with_distance(df, estimate).where(F.col("d2") > quality._chi2(1 - 1e-5, 4))
    assert far.where("x0 > 8").count() == 90
    assert far.where("x0 < 8").count() <= 2
    plain = quality._with_distance(df, quality._moments(df, 1.0))
    assert plain.where(F.col("d2") > quality._chi2(1 - 1e-5, 4)).count() == 0


def brute_distances(rows: list[tuple]) -> dict[int, float]:
    """Squared distances by the method spelled out in numpy: levels, steps and reweighting, group by group."""
    ridge = np.array(quality.RIDGE)
    vectors = {}
    for doc_id, text, lang, source, _ in rows:
        n, chars, symbols, dup, repeats, failed = measured(text)
        if not failed:
            lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
            x = (np.log(max(chars, 1) / n), np.sqrt(symbols / max(chars, 1)), np.sqrt(dup / (lines + quality.MORE_LINES)), np.sqrt(repeats / (n + quality.MORE_WORDS)))
            vectors[doc_id] = (np.array(x), lang, source)

    def reached(bins: np.ndarray, share: float) -> float:
        return np.sort(bins)[int(np.ceil(share * len(bins) - 1e-9)) - 1]

    def squared(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
        away = x - mean
        return (away * np.linalg.solve(cov + np.diag(ridge**2), away.T).T).sum(axis=1)

    def moments(x: np.ndarray, factor: float, above) -> tuple:
        n, k = len(x), 0 if above is None else quality.PRIOR
        mean = x.mean(axis=0) if n else above[0]
        cov = factor * np.cov(x.T, bias=True) if n > 1 else np.zeros((4, 4))
        if above is None:
            return mean, cov
        apart = mean - above[0]
        return (n * mean + k * above[0]) / (n + k), (n * cov + k * above[1]) / (n + k) + n * k / (n + k) ** 2 * np.outer(apart, apart)

    def estimate(x: np.ndarray, above) -> tuple:
        middle = (np.array([reached(np.floor(c * 200), 0.5) for c in x.T]) + 0.5) / 200
        spread = np.array([reached(np.floor(c * 200), 0.5) for c in np.abs(x - middle).T])
        now, det = (middle, np.diag((1.4826 * (spread + 0.5) / 200) ** 2)), np.inf
        while True:
            bins = np.floor(64 * np.log2(squared(x, *now) + 1e-6))
            step = moments(x[bins <= reached(bins, quality.SUPPORT)], quality._consistency(quality.SUPPORT, 4), above)
            new = np.linalg.slogdet(step[1] + np.diag(ridge**2))[1]
            last, now, det = det, step if new < det else now, min(new, det)
            if new >= last - quality.SETTLED:
                return moments(x[squared(x, *now) <= quality._chi2(0.975, 4)], quality._consistency(0.975, 4), above)

    found, out = {}, {}
    for depth in range(3):
        for key in {(lang, source)[:depth] for _, lang, source in vectors.values()}:
            ids = [i for i, v in vectors.items() if v[1:][:depth] == key]
            x = np.array([vectors[i][0] for i in ids])
            found[key] = estimate(x, found[key[:-1]] if depth else None)
            if depth == 2:
                out |= dict(zip(ids, squared(x, *found[key]), strict=True))
    return out


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(260):
        text = prose(7000 + i, rng.randint(30, 160))
        lang, source = ("en", "de", None)[i % 3], ("a", "b", None, "d")[i % 7 % 4]
        if lang == "de":
            text = text.replace("e", "eee")
        if i % 20 == 3:
            text = text.replace("a", "##")
        if i % 20 == 9:
            text = "\n".join([text, *text.split("\n")[:3]])
        rows.append((i, text, lang, source, 0))
    rows += [(900, prose(1, 90), "xx", "one", 0), (901, "#" + prose(2, 90).replace("e", "###"), "en", "lone", 0), (902, None, "en", "none", 0)]
    want = brute_distances(rows)
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows)).collect()}
    assert {i for i, r in got.items() if not r.base_failed} == set(want)
    for i, d in want.items():
        assert got[i].distance == pytest.approx(d, rel=1e-6, abs=1e-9)
        assert got[i].kept == (d <= quality._chi2(1 - quality.TAIL, 4))
    assert not got[901].kept and got[900].kept and not got[902].kept


def test_chi_square_values():
    assert quality._chi2(0.975, 4) == pytest.approx(11.1433, abs=1e-3)
    assert quality._gamma_cdf(7.7794, 2) == pytest.approx(0.9, abs=1e-4)


def test_quality_of_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_main_path_has_no_python(spark):
    plan = quality.judge(frame(spark, edge_rows()))._jdf.queryExecution().executedPlan().toString()
    plan += quality.statistics(frame(spark, edge_rows()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_escape_depth_costs_little_and_is_followed_to_its_end():
    for depth in (1, 3, 16, 10_000):
        text = "x %" + "25" * depth + "70assword=hunter2hunter2"
        began = time.monotonic()
        assert (2, len(text), 0) in secret_scan.all_spans(text, secret_scan.base_spans(text))
        assert time.monotonic() - began < 1


def test_planted_nested_secrets_are_found():
    """Every chain of up to three wrappings around a secret, behind paths and prefixes too."""
    wrap = {
        "percent": lambda s: "".join(f"%{b:02x}" for b in s.encode()), "unicode": lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        "base64": lambda s: base64.b64encode(s.encode()).decode(), "gzip": lambda s: base64.b64encode(gzip.compress(s.encode(), mtime=0)).decode(),
        "zlib": lambda s: base64.urlsafe_b64encode(zlib.compress(s.encode())).decode(),
    }
    for depth in (1, 2, 3):
        for chain in itertools.product(wrap.values(), repeat=depth):
            inner = "note password=correcthorse9 end"
            for one in chain:
                inner = one(inner)
            for before in ("", "see ", "https://h/path/", "prefix_"):
                text = f"{before}{inner} tail"
                assert any(kind == 0 and a >= len(before) - 1 for a, _, kind in secret_scan.all_spans(text, secret_scan.base_spans(text))), text[:200]


def test_names_of_wrappers_lose_no_article():
    body = "<p>The first full paragraph, with commas, and words enough to count here.</p><p>A second one, which follows; it ends the piece.</p>"
    plain = html_extract.main_text(f"<div>{body}</div>")
    assert plain.count("\n") == 1
    for page in (
        f'<div class="layout has-sidebar">{body}</div>', f'<div class="post comments-open">{body}</div>', f'<div class="widget"><div class="share">{body}</div></div>',
        f'<div id="page" class="menu-open"><article>{body}</article><div class="comments"><p>Nice post, thanks, all of you.</p></div></div>',
        f'<div class="notice"><main>{body}</main></div><div class="sidebar"><p>Buy now, it is cheap.</p></div>',
    ):
        assert html_extract.main_text(page) == plain, page
