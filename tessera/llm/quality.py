"""Quality rules by robust multivariate outliers: minimum covariance determinant (MCD).

Whole texts give per-document statistics; transformed, they form a vector. Per language and source
the MCD location and scatter are estimated by concentration steps from a robust start: the share
``SUPPORT`` of documents with the smallest distances gives the next mean and covariance, until the
group's determinant settles. A reweighting step follows, and documents whose squared Mahalanobis
distance exceeds the cutoff are rejected.

The estimates are regularized alike at every size: each group of language and source is given the
moments of its language as if ``PRIOR`` more documents had them, and each language those of the
corpus. Large groups hardly notice, one of a single document is mostly judged by its language, and
no size switches from one estimate to another.

Everything is DataFrame expressions: statistics are array functions within a row; quantiles are
read off fixed-width histograms (so no group is ever sorted or collected, and reruns agree); means,
covariances and Cholesky factors are columns.

Defined results: null or empty text has no words and fails the base rule. Documents that fail it
are not part of any estimate. A null language or source is a value of its own. Repeated rows are
judged row by row. An empty table gives an empty result. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize

# The base rule of the query's contract.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW_WORDS = 8
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

#: Share of a group's documents that the estimate rests on.
SUPPORT = 0.75
#: Tail mass of the chi-square beyond which a document is rejected.
TAIL = 1e-5
#: Documents, five a statistic, that a group is given with the moments of the level above it.
PRIOR = 20
#: A group's logarithm of the determinant has settled where a step lowers it by less.
SETTLED = 1e-3
#: Standard deviations added to each transformed statistic, so that one which is the same for most
#: documents (no symbols, no repeats) does not make every other value an outlier.
#: Small enough that each statistic can pass the cutoff by itself.
RIDGE = (0.05, 0.06, 0.12, 0.09)
#: Lines and words without repeats that every document is given, so that one repeated line is not
#: most of a short document, while long ones keep their shares.
MORE_LINES = 3
MORE_WORDS = 64
FEATURES = ("x0", "x1", "x2", "x3")


def _let(value: Column, body) -> Column:
    """Evaluates ``value`` once and gives it to ``body``."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside windows of eight words that occur twice or more in the text."""
    n = F.size(words)
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = _let(hashes, lambda h: F.transform(F.sequence(F.lit(1), n - WINDOW_WORDS + 1), lambda i: F.xxhash64(F.slice(h, i, WINDOW_WORDS))))

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(
                F.transform(s, lambda x, j: F.when(
                    ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | (F.get(s, j + 1)["h"] == x["h"]), x["i"])),
                lambda i: i.isNotNull(),
            )
            return _let(F.sort_array(twice), lambda p: F.aggregate(
                F.transform(p, lambda i, k: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW_WORDS)))),
                F.lit(0).cast("bigint"), lambda total, x: total + x))

        return _let(pairs, places)

    some = _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0).cast("bigint")))
    return F.when(n > WINDOW_WORDS, some).otherwise(F.lit(0).cast("bigint"))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) per row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    of_words = _let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), _repeat_words(w).alias("n_repeat_words")),
    )
    of_lines = _let(
        F.transform(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)), lambda x: F.xxhash64(x)),
        lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")),
    )
    rows = docs.select(
        F.col("doc_id").alias("doc_id"), F.col("lang").alias("lang"), F.col("source").alias("source"),
        of_words.alias("w"), of_lines.alias("l"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("bigint").alias("n_symbols"),
    )
    return rows.select("doc_id", "lang", "source", "w.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")


def _gamma_cdf(x: float, half: int) -> float:
    """Chi-square distribution function for 2 * half degrees of freedom."""
    term, total = 1.0, 1.0
    for k in range(1, half):
        term *= x / 2 / k
        total += term
    return 1 - exp(-x / 2) * total


def _chi2(p: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma_cdf(mid, freedom // 2) < p else (low, mid)
    return high


def _consistency(share: float, freedom: int) -> float:
    """Factor that makes a covariance of the inner ``share`` of normal data consistent."""
    return share / _gamma_cdf(_chi2(share, freedom), freedom // 2 + 1)


def _quantile_bins(rows: DataFrame, values: dict[str, Column], share: float) -> DataFrame:
    """(g, names..): for each integer column the smallest value that at least ``share`` of a group reach."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), v.cast("bigint").alias("bin")) for i, v in enumerate(values.values())]))
    counts = rows.select("g", each.alias("x")).groupBy("g", "x.i", "x.bin").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("g", "i")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(whole))
    first = [F.min(F.when(F.col("i") == i, F.col("bin"))).alias(name) for i, name in enumerate(values)]
    return reached.where(F.col("upto") >= share * F.col("all")).groupBy("g").agg(*first)


PLACES = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]
#: Columns of an estimate: location, scatter without the ridge, Cholesky factor of the ridged scatter.
ESTIMATE = [*[f"m{i}" for i in range(len(FEATURES))], *[f"c{i}{j}" for i, j in PLACES], *[f"l{i}{j}" for i, j in PLACES], "log_det"]


def _moments(rows: DataFrame, factor: float, above: DataFrame | None = None, prior: float = PRIOR) -> DataFrame:
    """(g, estimate..): mean, covariance and Cholesky factor of the ridged covariance of each group.

    above: (g, estimate..), what each group is given as ``prior`` documents; its groups are the result's.
    """
    sums = [F.count("*").alias("n")]
    sums += [F.sum(x).alias(f"s{i}") for i, x in enumerate(FEATURES)]
    sums += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}{j}") for i, j in PLACES]
    out = rows.groupBy("g").agg(*sums)
    d = len(FEATURES)
    out = out.select(
        "g", "n", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(d)],
        *[(factor * (F.col(f"q{i}{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * F.col(f"s{j}") / F.col("n"))).alias(f"c{i}{j}") for i, j in PLACES],
    )
    if above is not None:
        given = above.select("g", *[F.col(c).alias(f"a_{c}") for c in ESTIMATE if c[0] in "mc"])
        out = given.join(out, "g", "left")
        n = F.coalesce("n", F.lit(0))
        own, theirs = n / (n + F.lit(prior)), F.lit(prior) / (n + F.lit(prior))
        apart = [F.coalesce(F.col(f"m{i}") - F.col(f"a_m{i}"), F.lit(0.0)) for i in range(d)]
        out = out.select(
            "g", *[(F.col(f"a_m{i}") + own * apart[i]).alias(f"m{i}") for i in range(d)],
            *[(own * F.coalesce(f"c{i}{j}", F.lit(0.0)) + theirs * F.col(f"a_c{i}{j}") + own * theirs * apart[i] * apart[j]).alias(f"c{i}{j}") for i, j in PLACES],
        )
    for i, j in PLACES:
        rest = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        rest = rest + F.lit(RIDGE[i] ** 2 if i == j else 0.0)
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(RIDGE[i] ** 2 / 4))) if i == j else rest / F.col(f"l{j}{j}"))
    log_det = sum((2 * F.log(f"l{i}{i}") for i in range(d)), F.lit(0.0))
    return out.withColumn("log_det", log_det).select("g", *ESTIMATE)


def _with_distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    names, d = rows.columns, len(FEATURES)
    out = rows.join(estimate, "g")
    for i, x in enumerate(FEATURES):
        rest = F.col(x) - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    return out.select(*names, sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(d)), F.lit(0.0)).alias("d2"))


def _bin(d2: Column) -> Column:
    """Distances on a logarithmic grid of 64 steps per doubling."""
    return F.floor(64 * F.log2(d2 + 1e-6))


def _limits(rows: DataFrame, estimate: DataFrame, share: float) -> DataFrame:
    """(g, limit): the bin of distances that the share of each group's rows reach."""
    return _quantile_bins(_with_distance(rows, estimate), {"limit": _bin(F.col("d2"))}, share)


def _inner(rows: DataFrame, estimate: DataFrame, share: float, limits: DataFrame | None = None) -> DataFrame:
    """The share of each group's rows that lies nearest to the estimate.

    limits: those of ``_limits`` where they are a table already; its size lets Spark broadcast it, so that
    the rows of a large group need not meet in one task.
    """
    limits = limits or _limits(rows, estimate, share)
    return _with_distance(rows, estimate).join(limits, "g").where(_bin(F.col("d2")) <= F.col("limit"))


def _start(rows: DataFrame) -> DataFrame:
    """Coordinate-wise medians and median absolute deviations as a first, diagonal estimate."""
    medians = materialize(_quantile_bins(rows, {f"b{i}": F.floor(F.col(x) * 200) for i, x in enumerate(FEATURES)}, 0.5))
    away = {f"a{i}": F.floor(F.abs(F.col(x) - (F.col(f"b{i}") + 0.5) / 200) * 200) for i, x in enumerate(FEATURES)}
    spread = _quantile_bins(rows.join(medians, "g"), away, 0.5).join(medians, "g")
    return spread.select(
        "g", *[((F.col(f"b{i}") + 0.5) / 200).alias(f"m{i}") for i in range(len(FEATURES))],
        *[F.lit(None).cast("double").alias(f"c{i}{j}") for i, j in PLACES],
        *[(F.sqrt((1.4826 * (F.col(f"a{i}") + 0.5) / 200) ** 2 + RIDGE[i] ** 2) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in PLACES],
        F.lit(float("inf")).alias("log_det"),
    )


def _settle(rows: DataFrame, support: float, above: DataFrame | None, prior: float) -> DataFrame:
    """Concentration steps for each group until its determinant settles, then the reweighting step.

    Every step lowers an open group's determinant by ``SETTLED`` or closes the group, and the ridge
    bounds determinants from below, so the steps end. Closed groups are not worked on again.
    """
    factor, d = _consistency(support, len(FEATURES)), len(FEATURES)
    now = materialize(_start(rows).withColumn("open", F.lit(True)))
    while not now.where("open").isEmpty():
        estimate = now.where("open").drop("open")
        limits = materialize(_limits(rows, estimate, support))
        step = _moments(_inner(rows, estimate, support, limits), factor, above, prior)
        step = step.select("g", *[F.col(c).alias(f"t_{c}") for c in ESTIMATE])
        lower = F.col("t_log_det") < F.col("log_det")
        better = [F.when(F.col("open") & lower, F.col(f"t_{c}")).otherwise(F.col(c)).alias(c) for c in ESTIMATE]
        still = F.coalesce(F.col("open") & (F.col("t_log_det") < F.col("log_det") - SETTLED), F.lit(False))
        before, now = now, materialize(now.join(step, "g", "left").select("g", *better, still.alias("open")))
        discard(before, limits)
    inner = _with_distance(rows, now.drop("open")).where(F.col("d2") <= _chi2(0.975, d))
    out = materialize(_moments(inner, _consistency(0.975, d), above, prior))
    discard(now)
    return out


def judge(docs: DataFrame, support: float = SUPPORT, tail: float = TAIL, prior: float = PRIOR) -> DataFrame:
    """Statistics, base_failed, kept and the squared distance of every row of documents."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = statistics(docs).withColumns({
        "base_failed": base,
        "x0": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "x1": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "x2": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + MORE_LINES)),
        "x3": F.sqrt(F.col("n_repeat_words") / (F.col("n_words") + MORE_WORDS)),
        "fine": F.to_json(F.struct("lang", "source")),
        "coarse": F.to_json(F.struct("lang")),
        "every": F.lit("*"),
    })
    rows = materialize(rows)
    good, above = rows.where(~F.col("base_failed")), None
    for level, parent in (("every", None), ("coarse", "every"), ("fine", "coarse")):
        if parent:
            inside = good.select(F.col(level).alias("child"), F.col(parent).alias("g")).distinct()
            above = materialize(inside.join(above, "g").drop("g").withColumnRenamed("child", "g"))
        above = _settle(good.select(F.col(level).alias("g"), *FEATURES), support, above, prior)
    judged = _with_distance(good.withColumn("g", F.col("fine")), above)
    judged = judged.withColumn("kept", F.coalesce(F.col("d2") <= _chi2(1 - tail, len(FEATURES)), F.lit(True)))
    failed = rows.where("base_failed").withColumns({"g": F.col("fine"), "d2": F.lit(None).cast("double"), "kept": F.lit(False)})
    both = judged.unionByName(failed)
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("d2").alias("distance"))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id has a kept verdict; all columns as they were."""
    good = judge(docs, **options).where("kept").select(F.col("doc_id").alias("_good")).distinct()
    return docs.join(good, F.col("doc_id") == F.col("_good"), "left_semi")
