import re
from collections import Counter

import numpy as np
import pytest

from loomwright.llm import quality
from loomwright.llm.queries import op8_quality

SCHEMA = "doc_id long, text string, lang string, source string, n_words long"


def brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c, inside = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
    for i in range(len(w) - 7):
        if c[tuple(w[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(inside), n < 20 or 100 * len(inside) > 30 * n


def values(r):
    return tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))


def test_base_statistics(spark):
    phrase = "one two three four five six seven eight"
    texts = [None, "", "   \n\t", phrase, f"{phrase} {phrase}", f"{phrase} x {phrase}", "a " * 500, f"{phrase}\n{phrase}\n \n \n{phrase} # $ é", "x\n" * 30, "w" * 50000, " ".join(f"w{k}" for k in range(3000)), " ".join(f"w{k % 90}" for k in range(400))]
    df = spark.createDataFrame([(k, t, None if k % 3 else "en", None if k % 2 else "s", 0) for k, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    for k, t in enumerate(texts):
        assert values(got[k]) == brute(t), k
        assert not (got[k]["base_failed"] and got[k]["kept"])
    assert quality.judge(df.limit(0)).count() == 0


def test_query_and_labels(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op8_quality(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert values(r) == brute(texts[r["doc_id"]])
    passed = [r for r in rows if not r["base_failed"]]
    assert np.mean([r["kept"] for r in passed if labels.get(r["doc_id"]) == 1]) == 1
    assert np.mean([r["kept"] for r in passed if labels.get(r["doc_id"]) == 0]) < 0.2


def concentration(x, groups):
    """The estimate in numpy: binned concentration steps for each group, shrunk to its language and to all. (means, factors) by group."""
    p, least = x.shape[1], np.array(list(quality.STATS.values()))
    own = {g: x[[k for k, y in enumerate(groups) if y == g]] for g in dict.fromkeys(groups)}
    model = {g: (np.sort(v, axis=0)[(len(v) - 1) // 2], np.diag(least)) for g, v in own.items()}
    last = None
    for _ in range(quality.STEPS):
        d2 = {g: (np.linalg.solve(model[g][1], (v - model[g][0]).T) ** 2).sum(axis=0) for g, v in own.items()}

        def closest(names):
            v = np.concatenate([own[g] for g in names])
            bins = np.floor(np.log2(np.maximum(np.concatenate([d2[g] for g in names]), 2.0**-10)) * quality.BINS_PER_OCTAVE).astype(int)
            use = v[np.array([(bins < k).sum() for k in bins]) < quality.SUPPORT * len(v)]
            return len(use), use.sum(axis=0), use.T @ use

        add = lambda a, b, w: tuple(s + w * t / b[0] for s, t in zip(a, b, strict=True))
        total = closest(list(own))
        langs = {lang: add(closest([g for g in own if g[0] == lang]), total, quality.SHRINK) for lang in {g[0] for g in own}}
        for g in own:
            n, s, q = add(closest([g]), langs[g[0]], quality.SHRINK)
            mean = s / n
            scatter = quality.consistency(quality.SUPPORT, p) * (q / n - np.outer(mean, mean)) + np.diag(least**2)
            model[g] = (mean, np.linalg.cholesky(scatter))
        now = np.mean([np.log(np.diag(low)).sum() for _, low in model.values()])
        if last is not None and abs(now - last) < quality.SETTLED:
            break
        last = now
    return model


def distances(x, groups, model):
    return np.array([(np.linalg.solve(model[g][1], v - model[g][0]) ** 2).sum() for v, g in zip(x, groups, strict=True)])


def test_fit_is_a_robust_estimate(spark):
    """Equal to the concentration steps in numpy, and not drawn by a fifth of outliers; small groups borrow from wider ones."""
    rng = np.random.default_rng(1)
    clean = rng.normal([1.6, 0, 0, 0, 0], [0.2, 0.3, 0.3, 0.2, 0.2], (400, 5))
    x = np.concatenate([clean, rng.normal(6, 0.1, (100, 5)), rng.normal([1.8, 0, 0, 0, 0], 0.2, (6, 5)), rng.normal(9, 0.1, (1, 5))])
    groups = [(None, "s")] * 500 + [("en", "t")] * 6 + [("en", None)]
    df = spark.createDataFrame([(k, *g, *map(float, r)) for k, (g, r) in enumerate(zip(groups, x, strict=True))], "k long, g_lang string, g_source string, " + ", ".join(f"{n} double" for n in quality.NAMES))
    got = quality.with_distance(quality._join_model(df, quality.fit(df))).select("k", "d2").toPandas().sort_values("k")["d2"].to_numpy()
    model = concentration(x, groups)
    assert np.allclose(got, distances(x, groups, model), rtol=1e-6)
    assert np.allclose(model[None, "s"][0], clean.mean(axis=0), atol=0.06)
    assert got[400:500].min() > quality.CUTOFF > got[:400].max()
    assert got[500:506].max() < quality.CUTOFF < got[506]


def test_query_verdicts_equal_numpy(spark):
    """All documents of the table, by group: distances and verdicts."""
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in op8_quality(spark, sf).collect()}
    sound = [i for i, r in rows.items() if not r["base_failed"]]

    def vector(i):
        t = docs[i]["text"] or ""
        n, chars, symbols, dup, repeat, _ = brute(t)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in t.split("\n"))
        punct = len(re.findall(r"[!?=_~^{}\[\]\\]", t))
        return [np.log((chars + 200) / (n + 40)), np.sqrt(symbols / (n + 20)), np.sqrt(punct / (n + 20)), dup / (lines + 4), repeat / (n + 20)]

    x, groups = np.array([vector(i) for i in sound]), [(docs[i]["lang"], docs[i]["source"]) for i in sound]
    assert len(set(groups)) > 50
    want = distances(x, groups, concentration(x, groups))
    assert np.allclose([rows[i]["d2"] for i in sound], want, rtol=1e-5, atol=1e-7)
    assert [rows[i]["kept"] for i in sound] == (want <= quality.CUTOFF).tolist()
    assert any(want > quality.CUTOFF)


def test_consistency_factor():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200_000, 3))
    d = (x**2).sum(axis=1)
    near = x[d <= np.quantile(d, 0.75)]
    assert quality.consistency(0.75, 3) == pytest.approx(1 / near.var(axis=0).mean(), rel=0.02)


def test_keep_good_keeps_columns_and_own_texts(spark):
    good = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(1, good, "en", "a", 5), (1, "too short", "en", "a", 6), (None, good, None, None, 7), (None, None, None, None, 8)], SCHEMA)
    out = quality.keep_good(df)
    assert out.columns == df.columns and sorted(r["n_words"] for r in out.collect()) == [5, 7]


def test_each_statistic_rejects_by_itself(spark):
    """Texts that are bad in one statistic alone, among sound ones; a few duplicate lines of many reject nothing."""
    rng = np.random.default_rng(5)
    line = lambda k: f"l{k:04d}"
    fresh = lambda n: [f"w{k:04d}" for k in rng.permutation(9000)[:n]]
    sound = ["\n".join(" ".join(fresh(10)) for _ in range(12)) for _ in range(150)]
    words = fresh(200)
    one = {
        "lines": "\n".join(line(k) for k in rng.integers(0, 12, 80)),
        "repeat": " ".join(words + words[20:53]),
        "symbols": " ".join(fresh(100) + ["#abcd"] * 7 + ["$efgh"] * 3),
        "punct": " ".join(w + ("!" if k % 3 == 0 else "") for k, w in enumerate(fresh(100))),
        "word": " ".join(w * 4 for w in fresh(100)),
    }
    few = "\n".join([line(k) for k in range(1000)] + [line(k * 7) for k in range(20)])
    texts = sound + [few, *one.values()]
    rows = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], SCHEMA)).collect()}
    assert all(rows[k]["kept"] for k in range(151))
    assert rows[151]["n_dup_lines"] > 60 and rows[151]["n_repeat_words"] == 0
    for k, name in enumerate(one, 151):
        assert not rows[k]["base_failed"] and not rows[k]["kept"], name
    assert quality.CUTOFF == pytest.approx(20.515, abs=1e-3)
