"""Operator 7 - cross-entropy difference scoring with matched n-gram models.

A target model (texts marked as target) and a background model (all texts) share one vocabulary, one order and one
smoothing: p(w | v) = a * c(v w) / c(v) + (1 - a) * p(w), p(w) = (c(w) + b) / (N + b * V), counts over all documents. A
document's score is the mean over its tokens of target loss minus background loss; low means like the target.

Every word counts by itself: it is its 64-bit hash, and no vocabulary is collected unless the caller bounds it. Counts are
neither broadcast nor joined row by row. Documents are grouped in chunks of bounded size. What a chunk must know (its distinct
bigrams, contexts and words) are 64-bit keys, spread evenly over `shards` ranges of keys; they go to the shards with their counts
as compressed arrays; each shard adds them up, and answers each chunk with the sums of the keys it asked for. So what is shuffled
is proportional to the distinct bigrams of chunks. With as many shards as chunks, what one shard is asked is about as much as
one chunk asks, and is held by its task. Of 10^10 distinct bigrams
about ten share a key with another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, discard, hash_words, materialize, mix64, text_groups

#: Hashes that are no word's: any word outside a bounded vocabulary, and what stands before a text.
OTHER, FIRST = np.uint64(0), np.uint64(1)
#: Lowest two bits of a key: what it counts.
BIGRAM, CONTEXT, SINGLE = np.uint64(0), np.uint64(1), np.uint64(2)
CHUNK_TOKENS = 500_000
INTERPOLATION, PSEUDO = 0.6, 0.5


def _zip(a: np.ndarray) -> bytes:
    """Byte by byte of all values in turn, so that the zeros of small numbers cost nothing."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def _unzip(b: bytes, kind) -> np.ndarray:
    import zstandard

    raw, size = zstandard.ZstdDecompressor().decompress(b), np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def vocabulary(docs: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of the most frequent words of all documents, ties by hash; for a vocabulary that the caller bounds."""

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in text_groups(texts):
                w, n = np.unique(hash_words(texts[lo:hi], normalised=True)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64), pa.int64()), pa.array(n, pa.int64())], names=["word", "n"])

    counts = materialize(docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    # a fine logarithmic histogram tells which counts can be among the first, so that few more rows than those are ordered
    level = F.floor(F.log2("n") * 64)
    bins = sorted(((r["b"], r["c"]) for r in counts.groupBy(level.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)
    seen, least = 0, 0
    for least, c in bins:
        seen += c
        if seen >= size:
            break
    top = counts.filter(level >= least).orderBy(F.desc("n"), "word").limit(size).select("word").collect()
    discard(counts)
    return np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64))


def hashed(batches, words: np.ndarray | None, rows: int = 512) -> Iterator[tuple]:
    """(doc_id, target, tokens) of each row: its text as uint64 word hashes; OTHER for those outside words, if given.

    Texts leave Arrow some rows at a time, so that a batch is not held twice.
    """
    for b in batches:
        for at in range(0, b.num_rows, rows):
            ids, target, texts = (b.column(c).slice(at, rows).to_pylist() for c in ("doc_id", "target", "text"))
            for lo, hi in text_groups(texts):
                h, off = hash_words(texts[lo:hi], normalised=True)
                known = np.ones(len(h), bool) if words is None else np.isin(h, words)
                h = np.where(known, np.maximum(h, np.uint64(2)), OTHER)
                for i in range(lo, hi):
                    yield ids[i], target[i], h[off[i - lo] : off[i - lo + 1]].tobytes()


CHUNKS = "chunk long, ids array<long>, lengths array<int>, target array<boolean>, words binary, tokens binary"


def chunked(docs: DataFrame, words: np.ndarray | None, size: int) -> DataFrame:
    """Documents (doc_id, target, text) of one task in chunks of about `size` tokens; a longer document is a chunk of its own.

    tokens are places in words, the chunk's distinct hashes. Arrays inside rows are compressed here, so tables of them are
    written as they are.
    """

    def run(batches):
        from pyspark import TaskContext

        number, ids, target, blobs, n = TaskContext.get().partitionId() << 32, [], [], [], 0

        def row():
            distinct, at = np.unique(np.frombuffer(b"".join(blobs), np.uint64), return_inverse=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(x) // 8 for x in blobs]], pa.list_(pa.int32())), pa.array([target], pa.list_(pa.bool_())), *(pa.array([_zip(x)], pa.binary()) for x in (distinct, at.astype(np.uint32)))],
                names=[x.split()[0] for x in CHUNKS.split(", ")],
            )

        for i, t, x in hashed(batches, words):
            if n and n + len(x) // 8 > size:
                yield row()
                number, ids, target, blobs, n = number + 1, [], [], [], 0
            ids.append(i)
            target.append(t)
            blobs.append(x)
            n += len(x) // 8
        if ids:
            yield row()

    return docs.select("doc_id", "target", "text").mapInArrow(run, CHUNKS)


def events(words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """What a chunk must know of its texts, each preceded by FIRST.

    Returns keys (sorted, distinct), each token's bigram, and the places in keys of each bigram's own, context's and word's count.
    """
    h = np.append(words, FIRST)
    before = np.empty(len(tokens), np.uint64)
    before[1:] = tokens[:-1]
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = len(words)
    pair, own = np.unique(before << np.uint64(32) | tokens.astype(np.uint64), return_inverse=True)
    v, w = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
    mark = lambda x, kind: mix64(x) & ~np.uint64(3) | kind
    parts = (mark(mix64(h[v]) * np.uint64(0x9E3779B97F4A7C15) + h[w], BIGRAM), mark(h[v], CONTEXT), mark(h[w], SINGLE))
    keys, at = np.unique(np.concatenate(parts), return_inverse=True)
    return keys, own, *at.reshape(3, -1)


def _rows(batches, names: list[str]) -> Iterator[tuple]:
    """One row at a time: rows are large."""
    for b in batches:
        cols = [b.column(c) for c in names]
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in cols)


def requests(chunks: DataFrame, shards: int) -> DataFrame:
    """(shard, chunk, keys, counts, targets): a chunk's keys by shard, as compressed arrays."""

    def run(batches):
        for chunk, lengths, target, words, blob in _rows(batches, ["chunk", "lengths", "target", "words", "tokens"]):
            lengths = np.array(lengths, np.int64)
            keys, own, *places = events(_unzip(words, np.uint64), _unzip(blob, np.uint32), lengths)
            aimed = np.repeat(np.array(target, bool), lengths)
            per = (np.bincount(own, minlength=len(places[0])), np.bincount(own, aimed, len(places[0])))
            n, t = (sum(np.bincount(at, x, len(keys)) for at in places).astype(np.uint32) for x in per)
            shard = ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
            cut = np.searchsorted(shard, np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(cut)):
                part = slice(cut[s], cut[s + 1])
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([chunk], pa.int64()), *(pa.array([_zip(x)], pa.binary()) for x in (np.diff(keys[part], prepend=np.uint64(0)), n[part], t[part]))], names=["shard", "chunk", "keys", "counts", "targets"])

    return chunks.select("chunk", "lengths", "target", "words", "tokens").mapInArrow(run, "shard long, chunk long, keys binary, counts binary, targets binary")


def log_probability(pair: np.ndarray, context: np.ndarray, word: np.ndarray, size: int, kinds: int) -> np.ndarray:
    """Interpolated log probability of bigrams from their own, their context's and their word's counts."""
    return np.log(INTERPOLATION * pair / np.maximum(context, 1) + (1 - INTERPOLATION) * (word + PSEUDO) / (size + PSEUDO * kinds))


ANSWERS = "chunk long, shard long, counts binary, targets binary, n long, t long, kinds long"


def answers(asked: DataFrame) -> DataFrame:
    """The sums of the keys that each chunk asked for, in their order; and of each shard, as chunk -1, its tokens n, those of
    target texts t, and its different words."""

    def rows(shard, parts):
        keys, at = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
        n, t = (np.bincount(at, np.concatenate([p[k] for p in parts]), len(keys)).astype(np.int64) for k in (2, 3))
        single = keys & np.uint64(3) == SINGLE
        lo = 0
        for chunk, own, *_ in parts:
            mine = at[lo : lo + len(own)]
            lo += len(own)
            yield chunk, shard, _zip(n[mine]), _zip(t[mine]), None, None, None
        yield -1, shard, None, None, int(n[single].sum()), int(t[single].sum()), int(single.sum())

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        batch = lambda row: pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in ANSWERS.split(", ")])
        last, parts = None, []
        for shard, chunk, k, a, b in _rows(batches, ["shard", "chunk", "keys", "counts", "targets"]):
            if parts and shard != last:
                yield from map(batch, rows(last, parts))
                parts = []
            last = shard
            parts.append((chunk, np.cumsum(_unzip(k, np.uint64), dtype=np.uint64), _unzip(a, np.uint32), _unzip(b, np.uint32)))
        if parts:
            yield from map(batch, rows(last, parts))

    return asked.repartition("shard").sortWithinPartitions("shard", "chunk").mapInArrow(run, ANSWERS)


def sizes(got: DataFrame) -> tuple[int, int, int]:
    """How many tokens all texts and target texts have, and how many different words."""
    r = got.filter(F.col("chunk") < 0).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "t", "kinds"))).first()
    return int(r["n"]), int(r["t"]), int(r["kinds"])


SCORED = "doc_id long, n_tokens long, ce_diff double"


def scored(chunks: DataFrame, got: DataFrame, n_all: int, n_target: int, kinds: int) -> DataFrame:
    def run(batches):
        parts = []
        for kind, ids, lengths, a, b in _rows(batches, ["kind", "ids", "lengths", "a", "b"]):
            if kind == 0:
                parts.append((_unzip(a, np.int64), _unzip(b, np.int64)))
                continue
            lengths = np.array(lengths, np.int64)
            _, own, *places = events(_unzip(a, np.uint64), _unzip(b, np.uint32), lengths)
            n, t = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in (0, 1))
            parts = []
            diff = log_probability(*(n[at] for at in places), n_all, kinds) - log_probability(*(t[at] for at in places), n_target, kinds)
            total = np.bincount(np.repeat(np.arange(len(lengths)), lengths), diff[own], len(lengths))
            mean = pa.array(total / np.maximum(lengths, 1), pa.float64(), mask=lengths == 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), mean], names=["doc_id", "n_tokens", "ce_diff"])

    left = got.filter(F.col("chunk") >= 0).select("chunk", F.lit(0).alias("kind"), "shard", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<int>").alias("lengths"), F.col("counts").alias("a"), F.col("targets").alias("b"))
    right = chunks.select("chunk", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("shard"), "ids", "lengths", F.col("words").alias("a"), F.col("tokens").alias("b"))
    return left.unionByName(right).repartition("chunk").sortWithinPartitions("chunk", "kind", "shard").mapInArrow(run, SCORED)


def score(docs: DataFrame, target: DataFrame, words: int | None = None, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row per document: doc_id, n_tokens, ce_diff (mean target loss minus background loss; lower is more like the target).

    target: doc_id of target documents. words: so many most frequent words alone, any other being one (default: every word by
    itself). Defined cases: null and empty texts, or of punctuation alone, have no tokens and a
    null score; without target documents both models differ by smoothing alone; repeated rows are counted and scored
    as often as they come; a null doc_id is no target; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = target.select(F.col("doc_id").cast("long").alias("t_id")).filter(F.col("t_id").isNotNull()).distinct().withColumn("is_target", F.lit(True))
    marked = checked(materialize(marked, "lm-target"))  # beyond its bound texts are shuffled, which are smaller than their hashes
    aimed = rows.join(marked, F.col("doc_id") == F.col("t_id"), "left").select("doc_id", "text", F.coalesce("is_target", F.lit(False)).alias("target"))
    chunks = materialize(chunked(aimed, None if words is None else vocabulary(rows, words), chunk_tokens), "lm-chunks", "none")
    shards = int(min(65536, max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chunks.count())))
    got = materialize(answers(requests(chunks, shards)), "lm-answers", "none")
    return scored(chunks, got, *sizes(got))


def _loss(pair: str, context: str, word: str, size: str) -> str:
    return f"ln(CAST({INTERPOLATION} AS DOUBLE) * {pair} / greatest({context}, 1) + CAST({1 - INTERPOLATION} AS DOUBLE) * ({word} + CAST({PSEUDO} AS DOUBLE)) / ({size} + CAST({PSEUDO} AS DOUBLE) * kinds))"


#: DuckDB SQL for the scores of documents against those labelled as of quality 1, rounded to 6 decimals. '' stands before a text.
ORACLE = rf"""
WITH g AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL),
x AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id IN (SELECT doc_id FROM g), false) AS aim,
  regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[!-/:-@\[-`{{-~]', '', 'g'), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT r, aim, unnest(w) AS w, unnest(range(len(w))) AS i FROM x),
b AS (SELECT r, aim, w, coalesce(lag(w) OVER (PARTITION BY r ORDER BY i), '') AS v FROM e),
p AS (SELECT v, w, count(*) AS n, count(*) FILTER (aim) AS t FROM b GROUP BY v, w),
c AS (SELECT v, sum(n) AS cn, sum(t) AS ct FROM p GROUP BY v),
s AS (SELECT w, sum(n) AS sn, sum(t) AS st FROM p GROUP BY w),
z AS (SELECT sum(sn) AS zn, sum(st) AS zt, count(*) AS kinds FROM s),
d AS (SELECT p.v, p.w, {_loss("n", "cn", "sn", "zn")} - {_loss("t", "ct", "st", "zt")} AS diff FROM p JOIN c USING (v) JOIN s USING (w), z),
m AS (SELECT r, round(avg(diff), 6) AS ce_diff FROM b JOIN d USING (v, w) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, ce_diff FROM x LEFT JOIN m USING (r)"""
