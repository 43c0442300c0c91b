"""Language identification, language-model scoring and toxicity."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

from loomwright.llm import langid, lmscore, toxicity
from loomwright.llm.common import hash_words
from loomwright.llm.queries import op3_language, op7_lm_score, op9_toxicity, oracle_sql

SCHEMA = "doc_id long, text string, lang string, source string, score double"
VOCAB = public_tokenizers.path("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    lattice = langid.Lattice(["▁", "a", "b", "ab", "▁a", "ba", "aba"])
    p = np.array([0.1, 0.2, 0.15, 0.05, 0.3, 0.07, 0.02, 1e-9])

    def brute(s):
        if not s:
            return 1.0
        total = 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in lattice.number:
                total += p[lattice.number[s[:k]]] * brute(s[k:])
            elif k == 1:
                total += p[-1] * brute(s[1:])
        return total

    words = ["▁abab", "▁a", "▁bxa", "▁ababa"]
    w, a, b, piece, n = lattice.edges(words)
    alpha = langid.forward((w, a, b, piece), p[piece], n)
    beta = langid.backward((w, a, b, piece), p[piece], n)
    for k, s in enumerate(words):
        assert alpha[k, n[k]] == pytest.approx(brute(s)) and beta[k, 0] == pytest.approx(brute(s))


def test_expected_pieces_cover_each_word():
    pieces = langid.load_pieces(VOCAB)
    table = np.full((len(pieces) + 1, 1), 1 / len(pieces))
    words = [b"hello", "größe".encode(), b"x" * 70]
    got = langid.expected_pieces(langid.Lattice(pieces), words, np.zeros(3, int), np.array([1.0, 2.0, 3.0]), table)
    size = np.array([len(x) for x in pieces] + [1])
    assert (got[:, 0] * size).sum() == pytest.approx(6 + 2 * 6 + 3 * 71)


def log_brute(word, number, logs, unknown):
    """Log of the sum over all segmentations, over whole prefixes."""
    best = [0.0]
    for j in range(1, len(word) + 1):
        parts = [best[i] + logs[number[word[i:j]]] for i in range(j) if word[i:j] in number]
        if word[j - 1 : j] not in number:
            parts.append(best[j - 1] + unknown)
        best.append(float(np.logaddexp.reduce(parts)))
    return best[-1]


def test_long_words_are_scored_whole():
    """Words around and far beyond SHORT: one sum over all segmentations, whatever path computes it."""
    pieces = langid.load_pieces(VOCAB)
    rng = np.random.default_rng(3)
    table = rng.dirichlet(np.full(len(pieces), 0.3), 2).T + 1e-12
    table = np.concatenate([table, np.full((1, 2), langid.UNKNOWN)])
    lattice = langid.Lattice(pieces)
    compound = "donaudampfschifffahrtselektrizitätenhauptbetriebswerkbauunterbeamtengesellschaft"
    words = [w.encode() for w in (compound[:30], compound[:31], compound[:32], compound, compound * 30, "中文没有空格" * 40, "x" * 3000)]
    scorer = langid.Scorer(pieces, table)
    got = [scorer.score([w.decode()])[0] for w in words]
    for w, g in zip(words, got, strict=True):
        for lang in range(2):
            assert g[lang] == pytest.approx(log_brute("▁" + w.decode(), lattice.number, np.log(table[:, lang]), math.log(langid.UNKNOWN)), rel=1e-9)
        assert langid.long_log(lattice, "▁" + w.decode(), table) == pytest.approx(g, rel=1e-9)
    uses = langid.expected_pieces(lattice, words, np.array([0, 1, 0, 1, 0, 1, 0]), np.ones(7), table)
    size = np.array([len(x) for x in pieces] + [1])
    assert (uses.sum(axis=1) * size).sum() == pytest.approx(sum(len(w.decode()) + 1 for w in words))
    short = words[0]
    one = langid.expected_pieces(lattice, [short], np.array([0]), np.ones(1), table)[:, 0]
    for x, n in langid.long_expected(lattice, "▁" + short.decode(), table[:, 0]).items():
        assert one[x] == pytest.approx(n, abs=1e-9)


def test_language_query_equals_brute_force(spark, sf):
    """Expectation-maximisation over the training words and every document's posterior, without the operator's passes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    pieces = langid.load_pieces(VOCAB)
    lattice, size = langid.Lattice(pieces), len(pieces)
    learn = [r for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["lang"] and r["text"] is not None]
    langs = sorted({r["lang"] for r in learn})
    counts = Counter((r["lang"], w) for r in learn for w in langid.words_of(r["text"]))
    table = np.full((size + 1, len(langs)), 1 / size)
    table[size] = langid.UNKNOWN
    for _ in range(3):
        new = np.full((size, len(langs)), 0.05)
        for (lang, w), n in counts.items():
            k = langs.index(lang)
            for x, uses in langid.long_expected(lattice, "▁" + w.decode("utf-8", "replace"), table[:, k]).items():
                if x < size:
                    new[x, k] += n * uses
        table = np.concatenate([new / new.sum(axis=0), np.full((1, len(langs)), langid.UNKNOWN)])
    logs, known = np.log(table), {}
    got = {r["doc_id"]: r for r in op3_language(spark, sf).collect()}
    for r in docs:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        total = np.zeros(len(langs))
        for w in langid.words_of(r["text"]):
            if w not in known:
                known[w] = np.array([log_brute("▁" + w.decode("utf-8", "replace"), lattice.number, logs[:, k], math.log(langid.UNKNOWN)) for k in range(len(langs))])
            total += known[w]
        best = int(total.argmax())
        assert got[r["doc_id"]]["lang_pred"] == langs[best]
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / np.exp(total - total[best]).sum(), abs=1e-6)


def test_language_query(spark, sf):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_language(spark, sf).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    texts = [(k, "the house and the dog" if k % 2 else "das haus und der hund", "en" if k % 2 else "de", None, 0.0) for k in range(40)]
    texts += [(100, None, "en", None, 0.0), (101, "", None, None, 0.0), (102, "12 34 !!", "de", None, 0.0), (103, "z" * 5000, None, None, 0.0), (103, "hund " * 9000, None, None, 0.0), (None, "haus", None, None, 0.0)]
    df = spark.createDataFrame(texts, SCHEMA)
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(df, VOCAB).collect()]
    assert {x for i, x in got if i in (100, 101, 102)} == {"und"} and (103, "de") in got and (None, "de") in got
    assert all(x == ("en" if i % 2 else "de") for i, x in got if i is not None and i < 40)
    assert langid.identify(df.limit(0), VOCAB).count() == 0
    assert {r["lang_pred"] for r in langid.identify(spark.createDataFrame([(1, "some text", None, None, 0.0)], SCHEMA), VOCAB).collect()} == {"und"}


def brute_lm(texts, target, size):
    strip = str.maketrans("", "", "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()))
    toks = [(t or "").lower().translate(strip).split() for _, t in texts]
    count = Counter(w for t in toks for w in t)
    mark = {w: int(hash_words([w])[0].view(np.int64)[0]) for w in count}
    top = set(sorted(count, key=lambda w: (-count[w], mark[w]))[:size])
    toks = [[w if w in top else None for w in t] for t in toks]

    def model(rows):
        pair, first, single = Counter(), Counter(), Counter()
        for t in rows:
            v = "<s>"
            for w in t:
                pair[v, w] += 1
                first[v] += 1
                single[w] += 1
                v = w
        return pair, first, single, sum(single.values())

    every, aim = model(toks), model([t for (i, _), t in zip(texts, toks, strict=True) if i in target])
    kinds = len(every[2])
    loss = lambda m, v, w: -math.log(0.6 * m[0][v, w] / max(1, m[1][v]) + 0.4 * (m[2][w] + 0.5) / (m[3] + 0.5 * kinds))
    out = []
    for t in toks:
        prev = ["<s>", *t]
        out.append((len(t), sum(loss(aim, v, w) - loss(every, v, w) for v, w in zip(prev, t, strict=False)) / len(t) if t else None))
    return out


@pytest.mark.parametrize("chunk", [50, 2_000_000])
def test_lm_scores_equal_brute_force(spark, chunk):
    rng = np.random.default_rng(4)
    texts = [(k, " ".join(f"{'ab'[k % 2]}{x}" for x in rng.zipf(1.7, rng.integers(1, 60)) % 40)) for k in range(80)]
    texts += [(200, None), (201, ""), (202, "!! ..."), (203, "A1 " * 400), (5, "b3 b4"), (None, "a1 a2")]
    df = spark.createDataFrame([(i, t, "en", "s", 0.0) for i, t in texts], SCHEMA)
    target = spark.createDataFrame([(i,) for i in [*range(0, 80, 2), 0, 999, None]], "doc_id long")
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ce_diff"]) for r in lmscore.score(df, target, words=30, chunk_tokens=chunk).collect()), key=lambda x: (x[0], x[1]))
    want = sorted(((i if i is not None else -1, *x) for (i, _), x in zip(texts, brute_lm(texts, set(range(0, 80, 2)), 30), strict=True)), key=lambda x: (x[0], x[1]))
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and (g[2] is None) == (w[2] is None) and (w[2] is None or g[2] == pytest.approx(w[2], abs=1e-5))
    assert lmscore.score(df.limit(0), target).count() == 0


def test_lm_query_equals_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(oracle_sql()["op7_lm_score"])
    got = op7_lm_score(spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_lm_query(spark, sf):
    rows = op7_lm_score(spark, sf).collect()
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["quality"] == 1}
    assert np.mean([r["ce_diff"] for r in rows if r["doc_id"] in good]) < np.mean([r["ce_diff"] for r in rows if r["doc_id"] not in good and r["ce_diff"] is not None])


def test_risk_is_bounded_below():
    f = np.array([5.0, 6.0])
    assert toxicity.nn_risk(f, np.array([-5.0, -6.0]), 0.5)[1] < 0


def test_gradient_is_that_of_the_risk():
    """Against differences of the risk, on both sides of the bound."""
    rng = np.random.default_rng(2)
    telling = np.array([True, False, False, False])
    for prior, sign in ((0.2, 1), (0.5, -1)):
        pos, unl = (toxicity.Sparse(rng.random((n, 4)) < dense, telling) for n, dense in ((7, 0.4 if sign > 0 else 0.9), (11, 0.4 if sign > 0 else 0.05)))
        theta = rng.normal(size=6) * 0.1 + (0 if sign > 0 else np.array([3.0] * 5 + [-4.0]))

        def risk(t):
            a, b = toxicity.nn_risk(pos.dot(t[:5]) + t[5], unl.dot(t[:5]) + t[5], prior)
            assert (b >= 0) == (sign > 0)
            return a + b if b >= 0 else -b

        got = toxicity.risk_gradient(pos, unl, theta, prior)
        for k in range(6):
            d = np.zeros(6)
            d[k] = 1e-6
            assert got[k] == pytest.approx((risk(theta + d) - risk(theta - d)) / 2e-6, abs=1e-6)


def brute_features(texts, toxic, prior):
    """Features and telling ones from the counts of all training texts; and each text's features."""
    sets = [set(words(t)) for t in texts]
    n_pos, n_all = Counter(), Counter()
    for s, y in zip(sets, toxic, strict=True):
        n_all.update(s)
        if y:
            n_pos.update(s)
    a, b, out = sum(toxic), len(texts), {}
    for w, c in n_pos.items():
        p, u, both = c / a, n_all[w] / b, (c + n_all[w]) / (a + b)
        if c >= toxicity.LEAST_TEXTS and (p - u) / math.sqrt(both * (1 - both) * (1 / a + 1 / b) + 1e-12) >= toxicity.LEAST_Z:
            out[w] = prior * p >= toxicity.TELLING * u
    return out


def words(t):
    return (t or "").lower().translate(str.maketrans("", "", "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()))).split()


def test_toxicity_query_equals_brute_force(spark):
    """Features from all training texts, weights from dense numpy, and the score of every document."""
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    known = [y for i, y in labels.items() if y is not None and not held(i)]
    prior = min(max(sum(known) / len(known), 1e-3), 0.5)
    ids = [i for i in docs if not held(i)]
    toxic = [labels.get(i) == 1 for i in ids]
    features = brute_features([docs[i] for i in ids], toxic, prior)
    names = sorted(features, key=lambda w: hash_words([w])[0][0])
    telling = np.array([features[w] for w in names])

    def matrix(rows):
        x = np.array([[w in s for w in names] for s in (set(words(docs[i])) for i in rows)], float).reshape(len(rows), -1)
        return np.column_stack([x, (x[:, telling] > 0).any(axis=1), np.ones(len(rows))])

    pos, unl = matrix([i for i, y in zip(ids, toxic, strict=True) if y]), matrix(ids)
    sig = lambda x: 1 / (1 + np.exp(-x))
    n = len(names) + 1
    theta, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    theta[n] = np.log(prior / (1 - prior))
    for t in range(1, 1501):
        f_p, f_u = pos @ theta, unl @ theta
        down = unl.T @ sig(f_u) / len(unl) - prior * pos.T @ sig(f_p) / len(pos)
        rest = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
        grad = down - prior * pos.T @ sig(-f_p) / len(pos) if rest >= 0 else -down
        grad[:n] += 1e-4 * theta[:n]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    want = dict(zip(docs, sig(matrix(list(docs)) @ theta), strict=True))
    got = {r["doc_id"]: r["score"] for r in op9_toxicity(spark, sf).collect()}
    assert len(names) >= 3 and np.allclose([got[i] for i in docs], [want[i] for i in docs], atol=2e-3)


def test_toxicity_learns_from_positives_alone(spark):
    rng = np.random.default_rng(0)
    word = lambda: f"w{rng.integers(500)}"
    bad = [f"bad{k}" for k in range(5)]
    texts = []
    for k in range(900):
        w = [word() for _ in range(rng.integers(30, 120))]
        if k % 5 == 0:
            w[3], w[9], w[20] = rng.choice(bad, 3)
        texts.append((k, " ".join(w), "en", "s", 0.0))
    texts += [(5000, None, None, None, 0.0), (5001, "", None, None, 0.0), (5002, "bad1 bad2 " * 5000, None, None, 0.0), (5002, "w1", None, None, 0.0)]
    df = spark.createDataFrame(texts, SCHEMA)
    labels = spark.createDataFrame([(k, 1) for k in range(0, 900, 10)] + [(k, None) for k in range(3)] + [(None, 1)], "doc_id long, toxic int")
    rows = [r for r in toxicity.score(df, labels, prior=0.2).collect()]
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 900]
    assert np.mean([r["predicted"] for r in held if r["doc_id"] % 5 == 0]) > 0.9 and np.mean([r["predicted"] for r in held if r["doc_id"] % 5]) < 0.02
    one = {(r["doc_id"], r["predicted"]) for r in rows if r["doc_id"] >= 5000}
    assert one == {(5000, 0), (5001, 0), (5002, 1), (5002, 0)}
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert toxicity.score(df.limit(0), labels).count() == 0
    assert {r["predicted"] for r in toxicity.score(df, labels.limit(0)).collect()} == {0}


def test_toxicity_query(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in op9_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in toxic]
    assert np.mean([r["predicted"] for r in held if toxic[r["doc_id"]]]) > 0.7
    assert np.mean([r["predicted"] for r in held if not toxic[r["doc_id"]]]) < 0.01


def test_lm_every_word_counts_by_itself(spark):
    """More words than 16 bits number: rare ones are told apart, and equal brute force."""
    common = [(k, " ".join(f"c{j}" for j in range(k * 700, k * 700 + 700)) + " ") for k in range(100)]
    texts = [(k, t * 2) for k, t in common] + [(200, "rare of target"), (201, "rare of target"), (202, "other rare words")]
    df = spark.createDataFrame([(i, t, "en", "s", 0.0) for i, t in texts], SCHEMA)
    target = spark.createDataFrame([(200,), (3,)], "doc_id long")
    got = {r["doc_id"]: r["ce_diff"] for r in lmscore.score(df, target, chunk_tokens=20_000).collect()}
    want = brute_lm(texts, {200, 3}, 10**9)
    for (i, _), (_, x) in zip(texts, want, strict=True):
        assert got[i] == pytest.approx(x, abs=1e-6), i
    assert got[201] < got[202] - 1
