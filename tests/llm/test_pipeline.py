import corpus_pipeline
from loomwright.llm import ngram_join, quality
from loomwright.llm.common import materialize

from .test_decontam import hash_words
from .test_ngram_join import brute as classes
from .test_packing import check as packed
from .test_pii import brute as private


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = materialize(stage(spark, docs, sf), "test-stage")
        kept[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == columns
    before, rows = kept["quality rules"]
    good = {r["doc_id"] for r in quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r["kept"]}
    assert {r["doc_id"] for r in rows} == good
    before, rows = kept["n-gram Jaccard join"]
    texts = list(before.items())
    assert {r["doc_id"] for r in rows} == {c for c, _ in classes(texts).values()}
    before, rows = kept["benchmark decontamination"]
    words = lambda t: hash_words([t], True)[0].tobytes()
    items = [words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {i for i, t in before.items() if any(b in words(t) for b in items)}
    assert {r["doc_id"] for r in rows} == set(before) - leaked
    before, rows = kept["personal data"]
    assert {r["doc_id"] for r in rows} == set(before) and not any(private(r["text"]) for r in rows)
    assert all(r["text"] == before[r["doc_id"]] for r in rows if not private(before[r["doc_id"]]))
    before, rows = kept["packing"]
    packed(rows, list(before.items()), 1024)


def test_run_gives_pieces(spark, sf):
    assert "sequence_id" in corpus_pipeline.run(spark, sf).columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "personal data", "packing"]


def test_stages_take_awkward_tables(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, class_id string, kept string"
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, text, None, None, 1, "c", "k"), (1, text, None, None, 1, "c", "k"), (2, text + " me@corp.org", "en", "s", 1, "c", "k"), (None, text + " null id", "en", "s", 1, "c", "k"), (3, None, None, None, None, None, None), (4, "", "en", "s", 0, "c", "k")]
    for n in (len(rows), 0):
        docs = spark.createDataFrame(rows, schema).limit(n)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            docs = materialize(out, "test-stage")
        got = docs.collect()
        assert len(got) == (1 if n else 0)
        assert all("@" not in r["text"] for r in got)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == len(got)
    assert ngram_join.THRESHOLD == 0.8
