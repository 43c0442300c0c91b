import random

import numpy as np
import pytest

from loomwright.llm import decontam
from loomwright.llm.common import hash_words
from loomwright.llm.queries import op5_decontamination

DOCS, ITEMS = "doc_id long, text string, item_id long", "item_id long, text string, doc_id long"


def brute_align(text, item):
    h, best = [[0.0] * (len(text) + 1) for _ in range(len(item) + 1)], 0.0
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            s = 1.0 if item[i - 1] == text[j - 1] else -0.5
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] - 0.5, h[i][j - 1] - 0.5)
            best = max(best, h[i][j])
    return best


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(0)
    for _ in range(100):
        a, b = rng.integers(0, 4, rng.integers(1, 25)), rng.integers(0, 4, rng.integers(1, 12))
        assert decontam.align(a, b)[0] == pytest.approx(brute_align(a.tolist(), b.tolist()))


def test_copies_edits_and_clean_texts(spark):
    rng = random.Random(1)
    word = lambda: "w" + str(rng.randrange(3000))
    items_text = "item without an id but with words of its own"
    items = [(k, " ".join(word() for _ in range(40)), 0) for k in range(12)] + [(90, None, 0), (91, "", 0), (92, "Two words!", 0), (93, "single", 0), (None, items_text, 0), (94, "?!", 0)]
    filler = lambda n: " ".join(word() for _ in range(n))
    texts, want = [], set()
    for k in range(12):
        w = items[k][1].split()
        edited = [x if n % 6 else word() for n, x in enumerate(w)]
        dropped = [x for n, x in enumerate(w) if n % 7]
        for v, body in enumerate((" ".join(w).upper(), " ".join(edited), " ".join(dropped), ", ".join(w) + ".")):
            texts.append((k * 10 + v, f"{filler(80)} {body} {filler(50)}", 0))
            want.add((k * 10 + v, k))
    texts += [(1000 + k, filler(300), 0) for k in range(40)] + [(2000, None, 0), (2001, "", 0), (2002, "two words", 0), (2004, f"a {items_text} b", 0), (2005, "just a single one", 0), (2006, "two other words", 0), (None, "no id, two words", 0), (2003, filler(30000) + " " + items[3][1], 0), (2003, "repeated id", 0)]
    want |= {(2003, 3), (2002, 92), (2004, None), (2005, 93), (None, 92)}
    df, bench = spark.createDataFrame(texts, DOCS), spark.createDataFrame(items, ITEMS)
    got = decontam.contaminated(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(0.5 <= r["score"] <= 1 for r in got)
    kept = decontam.keep_clean(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, *_ in texts} - {i for i, _ in want} | {2003}
    assert decontam.contaminated(df.limit(0), bench).count() == 0 and decontam.contaminated(df, bench.limit(0)).count() == 0


def test_passage_in_most_documents_is_found(spark):
    item = " ".join(f"q{k}" for k in range(30))
    df = spark.createDataFrame([(k, f"start {k} {item} end" if k % 3 else f"only {k} common words here", 0) for k in range(60)], DOCS)
    got = decontam.contaminated(df, spark.createDataFrame([(1, item, 0)], ITEMS)).collect()
    assert {r["doc_id"] for r in got} == {k for k in range(60) if k % 3}


def brute(docs, items):
    """All pairs whose best alignment over the whole text reaches the score."""
    words = lambda t: hash_words([t], True)[0]
    items = {j: words(t) for j, t in items}
    out = set()
    for i, t in docs:
        h = words(t)
        for j, w in items.items():
            shared = np.isin(h, w)
            if len(w) and shared.sum() >= 0.5 * len(np.unique(w)) * 0.5 and decontam.align(h, w)[0] / len(w) >= 0.5 and (len(w) >= 3 or w.tobytes() in h.tobytes()):
                out.add((i, j))
    return out


def test_query_equals_brute_force(spark):
    """No pair more or less than by aligning every text with every item."""
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute(docs, items)
    got = [(r["doc_id"], r["item_id"]) for r in op5_decontamination(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_recall_of_planted_edits(spark):
    """Copies with words replaced, left out, added, or a part missing, of items of several lengths; many copies of each item."""
    rng = random.Random(3)
    word = lambda: "v" + str(int(rng.paretovariate(0.6)) % 5000)
    items = [(k, " ".join(word() for _ in range(rng.choice([12, 40, 150]))), 0) for k in range(60)]
    docs, want = [], set()
    for k, text, _ in items:
        for v in range(6):
            w = text.split()
            if v == 1:
                w = [word() if rng.random() < 0.15 else x for x in w]
            elif v == 2:
                w = [x for x in w if rng.random() > 0.15]
            elif v == 3:
                w = [y for x in w for y in ([x, word()] if rng.random() < 0.1 else [x])]
            elif v == 4:
                w = w[: int(0.7 * len(w))]
            elif v == 5:
                w = [word() if n % 5 == 4 else x for n, x in enumerate(w)]
            docs.append((k * 10 + v, " ".join([word() for _ in range(100)] + w + [word() for _ in range(60)]), 0))
            want.add((k * 10 + v, k))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    every = brute([d[:2] for d in docs], [i[:2] for i in items])
    assert len(got & want & every) >= 0.97 * len(want & every) and len(got & want) >= 0.9 * len(want)
    assert got <= every


def test_columns_of_any_name(spark):
    names = ["key", "row", "bad_id", "bad_key", "body", "words", "candidates", "hits", "gram", "__key", "score"]
    df = spark.createDataFrame([(1, "w1 w2 w3 w4 w5", *names), (2, "clean text", *names), (None, None, *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = decontam.keep_clean(df, spark.createDataFrame([(1, "w1 w2 w3 w4 w5", 0)], ITEMS))
    assert out.columns == df.columns and sorted(str(r["doc_id"]) for r in out.collect()) == ["2", "None"]
    assert all([r[n] for n in names] == names for r in out.collect())
