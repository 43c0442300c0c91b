import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import ngram_join as nj
from loomwright.llm.queries import op1_ngram_join

SCHEMA = "doc_id long, text string, class_id long, lang string"


def shingles(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(texts):
    """{position: (class, links)} by comparing all pairs."""
    sets, parent, links = [shingles(t) for _, t in texts], list(range(len(texts))), [0] * len(texts)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(texts):
        least[root(k)] = min(least.get(root(k), i), i)
    return {k: (least[root(k)], links[k]) for k in range(len(texts))}


def edited(words, share, rng):
    return " ".join(rng.choice(["alpha", "beta"]) + str(rng.random()) if rng.random() < share else w for w in words)


@pytest.mark.parametrize("block", [768, 5])
def test_groups_chains_and_edges(spark, block):
    rng = random.Random(3)
    base = [[f"t{d}w{k}" for k in range(120)] for d in range(6)]
    texts = [(k, edited(base[k % 6], 0.006, rng)) for k in range(60)]
    texts += [(100 + k, " ".join(base[0])) for k in range(20)]  # exact copies
    chain = [f"c{k}" for k in range(200)]
    texts += [(200 + k, " ".join(chain[k * 8 : k * 8 + 120])) for k in range(10)]  # each is like the next alone
    texts += [(300, None), (301, ""), (302, " \n"), (303, "one two"), (304, "one  two"), (305, "one three"), (306, "x " * 3000)]
    df = spark.createDataFrame([(i, t, 1, "en") for i, t in texts], SCHEMA)
    got = {r["doc_id"]: r for r in nj.near_duplicates(df, block=block).collect()}
    for k, want in brute(texts).items():
        i = texts[k][0]
        assert (got[i]["class_id"], got[i]["n_links"]) == want, i
    assert nj.near_duplicates(df.limit(0)).count() == 0


def test_query(spark, sf):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in op1_ngram_join(spark, sf).collect()}
    assert got == {texts[k][0]: v for k, v in brute(texts).items()}


def test_repeated_rows_are_copies(spark):
    t = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(7, t, 1, "en"), (7, t, 1, "en"), (7, "other " + t[:60], 1, "en"), (9, t, 1, "en")], SCHEMA)
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in nj.near_duplicates(df).collect()) == [(7, 7, 0), (7, 7, 2), (7, 7, 2), (9, 7, 2)]
    kept = nj.keep_first(df)
    assert kept.columns == df.columns and sorted((r["doc_id"], r["text"][:5]) for r in kept.collect()) == [(7, "other"), (7, "w0 w1")]


def test_first_documents_are_told_apart_by_id_and_text(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(None, a), (None, b), (None, b), (None, a + " more"), (3, b), (4, None), (4, None), (5, ""), (None, "")]
    got = [(r["doc_id"], r["text"]) for r in nj.keep_first(spark.createDataFrame([(i, t, 1, "en") for i, t in rows], SCHEMA)).collect()]
    assert (3, b) in got and got.count((4, None)) == 2 and (5, "") in got and (None, "") in got
    assert len(got) == 6 and sum(t is not None and t.startswith("a") for _, t in got) == 1


def test_bands_reach_the_recall():
    for recall in (0.9, 0.99, 0.9999):
        bands, rows = nj.bands_and_rows(0.8, recall)
        assert 1 - (1 - 0.8**rows) ** bands >= recall and bands * rows <= 128


def test_minhash_recall_at_the_threshold():
    rng, mh = np.random.default_rng(5), nj.MinHash(*nj.bands_and_rows(0.8, 0.9999))
    met = 0
    for _ in range(400):
        x = rng.integers(0, 2**63, 1000, dtype=np.uint64)
        a, b = np.sort(x[:900]), np.sort(x[100:])  # similarity 0.8
        met += bool((mh.band_hashes(a) == mh.band_hashes(b)).any())
    assert met >= 398


def test_linked_matrix_and_components(spark):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 60)).astype(np.uint64)) for _ in range(40)]
    got = nj.linked(sets, 0.5)
    for a in range(40):
        for b in range(40):
            i = len(np.intersect1d(sets[a], sets[b]))
            assert got[a, b] == (i / (len(sets[a]) + len(sets[b]) - i) >= 0.5)
    edges = [(k, k + 1) for k in range(40) if k % 10] + [(100, 100), (5, 95)]
    roots = {r["node"]: r["root"] for r in nj.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert roots[95] == 1 and roots[29] == 21 and 100 not in roots and roots[1] == 1


def test_query_equals_sql(spark):
    import duckdb

    from loomwright.llm.queries import oracle_sql

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(oracle_sql()["op1_ngram_join"])
    assert sorted(map(tuple, op1_ngram_join(spark, sf).select(*want.columns).collect())) == sorted(want.fetchall())


def test_hot_keys_join_as_others(spark):
    """A star with most of all edges and a set with most of all rows, beside many small ones."""
    from loomwright.llm.common import hot_join

    rows = spark.createDataFrame([(0, k) for k in range(900)] + [(1 + k % 50, k) for k in range(100)], "u long, v long")
    look = rows.groupBy("u").agg(F.count(F.lit(1)).alias("c"), (F.first("u") * 2).alias("m"))
    got = hot_join(rows, look, ["u"], "c", 1000)
    assert got.columns == ["u", "v", "m"] and got.count() == 1000 and got.filter("m != 2 * u").count() == 0


def test_columns_of_any_name(spark):
    names = ["key", "row", "root", "d_id", "d_key", "s1", "s2", "b_id", "size", "__key", "n"]
    texts = ["one two three four five six seven"] * 3 + [None, None, "other words that stand alone here"]
    rows = [(i, t, *names) for i, t in zip([1, 1, 2, 3, None, None], texts, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = nj.keep_first(df)
    assert out.columns == df.columns
    assert sorted((str(r["doc_id"]), (r["text"] or "-")[:5]) for r in out.collect()) == [("1", "one t"), ("3", "-"), ("None", "-"), ("None", "other")]
    assert all([r[n] for n in names] == names for r in out.collect())
