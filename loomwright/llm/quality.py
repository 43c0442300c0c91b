"""Operator 8 - quality rules: fixed rules and robust multivariate outliers.

Each document gets a vector of transformed text statistics. For each (lang, source) group a minimum-covariance-
determinant estimate of location and scatter is fitted by concentration steps, and documents whose Mahalanobis
distance exceeds a cutoff are rejected. Everything is DataFrame functions.

A concentration step is one aggregation: distances are binned on a fine logarithmic grid and moments are summed by
(group, bin) with partial aggregation, so a hot group never meets in one task; the h-subset is the lowest bins that
hold at least the support fraction of the group. Steps read the small statistics table, never the texts.

Every group is judged by its own estimate, whatever its size: a group's moments are shrunk towards those of its language, and
these towards those of all documents, as if the wider estimate were SHRINK documents more. So the weight of a group's own
documents grows smoothly, n / (n + SHRINK).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, discard, let, materialize, null_safe_join

#: Statistics of the outlier rule and the least spread each is given (its square is added to the variance), so that
#: a statistic that is nearly always zero neither makes the scatter singular nor rejects a single occurrence. Each
#: statistic's reach is beyond its spread times the root of CUTOFF, so that any of them can reject a text by itself.
STATS = {
    "x_word": 0.08,  # log of mean word length, shrunk for short texts
    "x_symbol": 0.05,  # root of symbols per word
    "x_punct": 0.10,  # root of other loud punctuation per word
    "x_line": 0.10,  # share of duplicate lines, shrunk for few lines
    "x_repeat": 0.055,  # share of words in repeated 8-word windows; under 0.3 where the fixed rules hold
}
SUPPORT = 0.75
#: Most concentration steps, and the change of the groups' mean log determinant below which they end.
STEPS, SETTLED = 8, 1e-3
#: Documents that the wider estimate counts for in a narrower one.
SHRINK = 50.0
#: Share of normal data within the cutoff.
WITHIN = 0.999
BINS_PER_OCTAVE = 16
WINDOW_WORDS = 8


def text_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns keep, and of each whole text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_punct.

    Words are runs of characters other than space and tab to carriage return. Null and empty texts have none.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(*keep, text.alias("__t"))
    split = base.select(*keep, "__t", F.array_remove(F.split("__t", SPACE_CLASS + "+"), "").alias("__w"), F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"))
    hashed = split.select("*", F.when(F.size("__w") > WINDOW_WORDS, F.transform("__w", lambda w: F.xxhash64(w))).alias("__h1"))
    windows = hashed.select("*", _windows(F.col("__h1")).alias("__h"))
    return windows.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("__h") > F.size(F.array_distinct("__h")), _covered(F.col("__h"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.regexp_count("__t", F.lit(r"[!?=_~^{}\[\]\\]")).cast("long").alias("n_punct"),
    )


def _windows(h: Column) -> Column:
    """Hashes of all windows of 8 words, from word hashes, by three doublings."""
    for step in (1, 2, 4):
        h = let(h, _doubling(step))
    return h


def _doubling(step: int) -> Callable[[Column], Column]:
    return lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) - step), F.slice(x, F.lit(step + 1), F.size(x) - step), lambda a, b: F.xxhash64(a, b))


def _covered(h: Column) -> Column:
    """How many words lie in windows whose hash occurs twice or more.

    Windows sorted by (hash, position): one is repeated if a neighbour has its hash. In order of position, each
    repeated window adds the words up to the next one, at most 8.
    """
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    last = F.array(F.struct(F.lit(0).alias("i"), F.lit(False).alias("s")))

    def starts(order):
        before = F.concat(none, F.slice(order, F.lit(1), F.size(order) - 1))
        same = F.zip_with(order, before, lambda a, b: F.struct(a["i"].alias("i"), F.coalesce(a["h"] == b["h"], F.lit(False)).alias("s")))
        return let(same, lambda x: F.zip_with(x, F.concat(F.slice(x, F.lit(2), F.size(x) - 1), last), lambda a, b: F.when(a["s"] | b["s"], a["i"])))

    def total(at):
        far = F.concat(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.lit(2**30)))
        return F.aggregate(F.zip_with(at, far, lambda a, b: F.least(b - a, F.lit(WINDOW_WORDS))), F.lit(0), lambda s, x: s + x)

    order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return let(F.array_sort(F.filter(let(order, starts), lambda i: i.isNotNull())), total)


def base_failed() -> Column:
    """Fixed rules: under 20 words, or over 30 % of the words in repeated windows."""
    return (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))


def vector(stats: DataFrame) -> DataFrame:
    """Adds the transformed statistics. Texts without words get the zero vector."""
    w = F.greatest("n_words", F.lit(1)).cast("double")
    return stats.withColumns(
        {
            "x_word": F.log((F.col("word_chars") + 200.0) / (F.col("n_words") + 40.0)),
            "x_symbol": F.sqrt(F.col("n_symbols") / (w + 20)),
            "x_punct": F.sqrt(F.col("n_punct") / (w + 20)),
            "x_line": F.col("n_dup_lines") / (F.col("n_lines") + 4.0),
            "x_repeat": F.col("n_repeat_words") / (w + 20),
        }
    )


def _chi2_cdf(x: float, k: int) -> float:
    """Of the chi-squared distribution, by the series of the incomplete gamma function."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > 1e-15 * total:
        n += 1
        term *= z / (a + n)
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi2_quantile(share: float, k: int) -> float:
    lo, hi = 1e-6, 200.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, k) < share else (lo, mid)
    return lo


def consistency(support: float, p: int) -> float:
    """Factor that makes the scatter of the closest share `support` of normal data that of all of them."""
    return support / _chi2_cdf(chi2_quantile(support, p), p + 2)


NAMES = list(STATS)
GROUP = ["g_lang", "g_source"]
#: Squared distance beyond which a document is rejected.
CUTOFF = chi2_quantile(WITHIN, len(NAMES))
PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(NAMES)), *(F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"q{i}_{j}") for i, j in PAIRS))


def _model(sums: DataFrame, by: list[str], factor: float) -> DataFrame:
    """Mean, and rows of the inverse Cholesky-like factors, of each group's scatter; from summed moments.

    The lower factor L of the scatter is written out by columns, one projection each, so that nothing is repeated.
    """
    mean = sums.select(*by, "n", *(F.expr(f"s{i} / n").alias(f"m{i}") for i in range(len(NAMES))), *(f"q{i}_{j}" for i, j in PAIRS))
    out = mean.select(*by, "n", *(f"m{i}" for i in range(len(NAMES))), *((F.lit(factor) * (F.col(f"q{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) + F.lit(STATS[NAMES[i]] ** 2 if i == j else 0.0)).alias(f"c{i}_{j}") for i, j in PAIRS))
    for j in range(len(NAMES)):
        diag = F.sqrt(F.greatest(F.col(f"c{j}_{j}") - sum((F.col(f"l{j}_{k}") ** 2 for k in range(j)), F.lit(0.0)), F.lit(STATS[NAMES[j]] ** 2 / 4)))
        out = out.withColumn(f"l{j}_{j}", diag)
        out = out.select("*", *(((F.col(f"c{i}_{j}") - sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}_{j}")).alias(f"l{i}_{j}") for i in range(j + 1, len(NAMES))))
    return out.select(*by, "n", *(f"m{i}" for i in range(len(NAMES))), *(f"l{i}_{j}" for i, j in PAIRS))


MODEL_COLUMNS = [f"m{i}" for i in range(len(NAMES))] + [f"l{i}_{j}" for i, j in PAIRS]


def with_distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution with the joined model columns."""
    for i, x in enumerate(NAMES):
        rest = sum((F.col(f"l{i}_{j}") * F.col(f"z{j}") for j in range(i)), F.lit(0.0))
        rows = rows.withColumn(f"z{i}", (F.col(x) - F.col(f"m{i}") - rest) / F.col(f"l{i}_{i}"))
    d2 = sum((F.col(f"z{i}") ** 2 for i in range(len(NAMES))), F.lit(0.0))
    return rows.withColumn("d2", d2).drop(*(f"z{i}" for i in range(len(NAMES))), *MODEL_COLUMNS)


SUMS = ["n", *(f"s{i}" for i in range(len(NAMES))), *(f"q{i}_{j}" for i, j in PAIRS)]


def _closest(bins: DataFrame, by: list[str]) -> DataFrame:
    """Summed moments of the lowest bins that hold the support share of each group of `by`; bins: one row for each of GROUP and bin."""
    sums = bins.groupBy(*by, "bin").agg(*(F.sum(c).cast("double").alias(c) for c in SUMS))
    own = Window.partitionBy(*(by or [F.lit(0)]))  # at most as many rows as bins
    ranked = sums.withColumn("upto", F.sum("n").over(own.orderBy("bin"))).withColumn("all", F.sum("n").over(own))
    near = ranked.filter(F.col("upto") - F.col("n") < F.lit(SUPPORT) * F.col("all"))
    return near.groupBy(*by).agg(*(F.sum(c).alias(c) for c in SUMS))


def shrunk(bins: DataFrame) -> DataFrame:
    """Each group's moments, with those of its language added, which have those of all documents added.

    At each level the subset is chosen anew, so that a group that consists of outliers does not draw the wider estimates.
    """
    total = _closest(bins, []).first()  # nulls if there are no rows
    langs = _closest(bins, GROUP[:1]).select(GROUP[0], *((F.col(c) + F.lit(SHRINK * (total[c] or 0.0) / (total["n"] or 1.0))).alias(c) for c in SUMS))
    right = langs.select(F.col(GROUP[0]).alias("w_lang"), *(F.col(c).alias(f"w_{c}") for c in SUMS))
    both = null_safe_join(_closest(bins, GROUP), right, [(GROUP[0], "w_lang")], "left")
    return both.select(*GROUP, *((F.col(c) + F.lit(SHRINK) * F.col(f"w_{c}") / F.col("w_n")).alias(c) for c in SUMS))


def _concentrate(rows: DataFrame, factor: float) -> DataFrame:
    """The model of each group's rows that are closest by d2."""
    grid = F.floor(F.log2(F.greatest("d2", F.lit(2.0**-10))) * BINS_PER_OCTAVE).cast("int")
    bins = materialize(_moments(rows.withColumn("bin", grid), [*GROUP, "bin"]), "quality-bins")
    return _model(shrunk(bins), GROUP, factor)


def fit(stats: DataFrame, steps: int = STEPS) -> DataFrame:
    """The minimum-covariance-determinant model of each group: one row for each.

    Steps end when the mean of the groups' log determinants settles. (On binned subsets and with shrinkage a single step need not
    lower each determinant.)
    """
    factor = consistency(SUPPORT, len(NAMES))
    model, last = materialize(_start(stats), "quality-model"), None
    for _ in range(steps):
        near = _join_model(stats, model)
        step = materialize(_concentrate(with_distance(near), factor), "quality-model")
        discard(model)
        model = step
        now = model.agg(F.avg(sum((F.log(f"l{i}_{i}") for i in range(len(NAMES))), F.lit(0.0))).alias("d")).first()["d"]
        if now is None or (last is not None and abs(now - last) < SETTLED):
            break
        last = now
    return model


def _start(stats: DataFrame) -> DataFrame:
    """Coordinate-wise medians with the least spreads as the scatter: robust, so that junk does not draw the start."""
    med = stats.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(x, 0.5, 1000).alias(f"m{i}") for i, x in enumerate(NAMES)))
    return med.select("*", *(F.lit(STATS[NAMES[i]] if i == j else 0.0).alias(f"l{i}_{j}") for i, j in PAIRS))


def _join_model(stats: DataFrame, model: DataFrame) -> DataFrame:
    right = model.select(*(F.col(c).alias(f"__{c}") for c in GROUP), *MODEL_COLUMNS)
    return null_safe_join(stats, right, [(c, f"__{c}") for c in GROUP], "left")


def _judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns keep with the base statistics, base_failed, d2 and kept.

    What is kept is written beside the statistics once, so a verdict comes back to its row without a join; the steps of the fit
    read the statistics' columns alone.
    """
    named = docs.select(*keep, "text", F.col("lang").alias("g_lang"), F.col("source").alias("g_source"))
    stats = materialize(vector(text_statistics(named, [*keep, *GROUP])).withColumn("base_failed", base_failed()), "quality-stats")
    model = fit(stats.filter(~F.col("base_failed")).select(*GROUP, *NAMES))
    far = with_distance(_join_model(stats, model))
    verdict = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUTOFF)
    return far.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.alias("kept"), "d2")


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base statistics, base_failed, kept, d2 (null where no group has an estimate).

    Defined cases: a null or empty text has no words and fails; null lang or source is a group like any other, and so is a
    group of one document; identical rows get identical verdicts; an empty table gives no rows; further columns are
    ignored, whatever their names.
    """
    return _judged(docs.select("doc_id", "text", "lang", "source"), ["doc_id"])


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns, whatever their names.

    Each row is judged by itself, repeated ids and rows included; a null or empty text fails; an empty table gives no rows.
    """
    whole = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("__row"), "text", "lang", "source")
    return _judged(whole, ["__row"]).filter("kept").select("__row.*")
