"""Operator 5 - benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Test items are reduced to their different word sequences (bodies), and these to n-grams. A bit table of the n-grams' hash
   prefixes, of fixed size whatever the number of items, goes to every task.
2. One pass over the documents counts in how many of them each of those n-grams occurs: tasks pre-aggregate what passes the
   bit table, and a join by n-gram removes what passed by chance.
3. A body's seeds are its rare n-grams among those that occur in documents: `seeds` of every STRETCH consecutive ones at every
   level of frequency (a factor of LEVEL each) up to LEVEL times what most of its n-grams reach. Rare is thus relative to the
   body: a passage that leaked everywhere keeps its seeds, a turn of phrase that is far more common than the body is none; and
   a copy that lacks the rarest n-grams, or a part of the body, has seeds too.
4. A second pass finds the seeds in every whole text; a join by n-gram tells the bodies. Where at least `least_seeds` of a
   body meet in a text, the text's window around them is aligned with the body. The alignment's score, as a share of the body's
   words, decides.

Neither items nor texts are collected. Texts are joined with their candidates by id and hash: without a shuffle of texts up to
BROADCAST_ROWS candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, hash_words, materialize, mix64, ngrams, text_groups

N, STRETCH, SEEDS, LEAST_SEEDS, LEAST_SCORE = 3, 8, 3, 2, 0.5
#: Factor between levels of frequency, and the share of a body's n-grams whose frequency bounds that of seeds.
LEVEL, MOST = 16.0, 0.8
MATCH, MISMATCH, GAP = 1.0, 0.5, 0.5
#: Bits of a hash that the table of n-grams tells apart; its size in every task is 2^PREFIX_BITS bytes.
PREFIX_BITS = 24


def align(text: np.ndarray, item: np.ndarray) -> tuple[float, int]:
    """Best local alignment score of two word sequences, and the end of it in text (exclusive).

    A gap in the text is taken in one go for a whole row: the running maximum of score plus gap cost by position.
    """
    ramp = GAP * np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1)
    best, end = 0.0, 0
    for w in item:
        new = np.maximum(row - GAP, 0.0)
        np.maximum(new[1:], row[:-1] + np.where(text == w, MATCH, -MISMATCH), out=new[1:])
        row = np.maximum.accumulate(new + ramp) - ramp
        k = int(row.argmax())
        if row[k] > best:
            best, end = float(row[k]), k
    return best, end


def grams_of(h: np.ndarray, offsets: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams of the given lengths: hash (a length's own), position, number of the text."""
    parts = [ngrams(h, offsets, n) for n in lengths]
    marked = [mix64(g ^ np.uint64(0x9E3779B97F4A7C15) * np.uint64(n)) for (g, _, _), n in zip(parts, lengths, strict=True)]
    return np.concatenate(marked), np.concatenate([p for _, p, _ in parts]), np.concatenate([t for _, _, t in parts])


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])


ITEMS = "item_id long, body long, words binary"


def bodies_of(items: DataFrame) -> DataFrame:
    """(item_id, body, words): each item's word hashes, and a hash of them all. Items without words are left out."""

    def run(batches):
        for b in batches:
            ids, texts = b.column("item_id").to_pylist(), b.column("text").to_pylist()
            for lo, hi in text_groups(texts):
                h, off = hash_words(texts[lo:hi], normalised=True)
                rows = []
                for i in range(hi - lo):
                    w = h[off[i] : off[i + 1]]
                    if len(w):
                        place = np.arange(1, len(w) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                        rows.append((ids[lo + i], int(mix64(w ^ mix64(place)).sum().view(np.int64)), w.tobytes()))
                if rows:
                    yield _batch(ITEMS, list(zip(*rows, strict=True)))

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, ITEMS)


GRAMS = "body long, gram long, q int, size int, words int"


def item_grams(bodies: DataFrame, n: int) -> DataFrame:
    """Each different n-gram of each body, at its first position; a body of fewer words is one n-gram of them all."""

    def run(batches):
        for b in batches:
            for body, blob in zip(b.column("body").to_pylist(), b.column("words").to_pylist(), strict=True):
                w = np.frombuffer(blob, np.uint64)
                size = min(n, len(w))
                g, q, _ = grams_of(w, np.array([0, len(w)]), [size])
                g, first = np.unique(g, return_index=True)
                yield _batch(GRAMS, [np.full(len(g), body), g.view(np.int64), q[first].astype(np.int32), np.full(len(g), size, np.int32), np.full(len(g), len(w), np.int32)])

    return bodies.mapInArrow(run, GRAMS)


class Prefixes:
    """Which hash prefixes occur among n-grams, and the n-grams' lengths; packed for sending, a byte each in a task."""

    def __init__(self, grams: DataFrame):
        found = grams.select(F.shiftrightunsigned("gram", 64 - PREFIX_BITS).cast("int").alias("x")).distinct().toArrow().column("x").to_numpy()
        table = np.zeros(1 << PREFIX_BITS, bool)  # at most so many rows come
        table[found] = True
        self.packed = np.packbits(table)
        self.lengths = sorted(r["size"] for r in grams.select("size").distinct().collect())  # 1 to n

    def table(self) -> np.ndarray:
        return np.unpackbits(self.packed).view(bool)


def _passing(texts: list[str | None], table: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, ...]:
    """Of the n-grams that pass the table: hash, position in the text, number of the text."""
    h, off = hash_words(texts, normalised=True)
    g, pos, text = grams_of(h, off, lengths)
    near = np.flatnonzero(table[(g >> np.uint64(64 - PREFIX_BITS)).astype(np.int64)])
    return g[near].view(np.int64), pos[near] - off[text[near]], text[near]


def document_counts(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(gram, docs): in how many documents n-grams occur; some pass the bit table that are none of the given."""
    known = Prefixes(grams)

    def run(batches):
        table = known.table()
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in text_groups(texts):
                if known.lengths:
                    g, _, text = _passing(texts[lo:hi], table, known.lengths)
                    order = np.lexsort((text, g))
                    g, text = g[order], text[order]
                    new = np.ones(len(g), bool)
                    new[1:] = (np.diff(g) != 0) | (np.diff(text) != 0)
                    yield _batch("gram long, docs long", list(np.unique(g[new], return_counts=True)))

    return docs.select("text").mapInArrow(run, "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))


def choose_seeds(grams: DataFrame, counts: DataFrame, seeds: int) -> DataFrame:
    """(body, gram, q, words, size, own): the seeds of each body, chosen by hash within a stretch and level; own: how many the body has."""
    shared = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("bodies"))
    cost = F.coalesce("docs", F.lit(0)) * F.col("bodies")
    rated = materialize(grams.join(shared, "gram").join(counts, "gram", "left").withColumn("cost", cost), "decontam-rated")
    bound = rated.groupBy("body").agg(F.greatest(F.percentile_approx("cost", MOST, 1000), F.lit(1)).alias("most"))
    rare = rated.filter(F.col("cost") > 0).join(bound, "body").filter(F.col("cost") <= F.lit(LEVEL) * F.col("most"))
    level = F.floor(F.log2(F.col("cost")) / F.log2(F.lit(LEVEL)))
    order = Window.partitionBy("body", F.floor(F.col("q") / STRETCH), level).orderBy(F.xxhash64("gram"), "gram")
    chosen = rare.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= seeds)
    return chosen.select("body", "gram", "q", "words", "size", F.count(F.lit(1)).over(Window.partitionBy("body")).cast("int").alias("own"))


HITS = "doc_id long, key long, gram long, p int"


def seed_hits(keyed: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc_id, key, gram, p): where n-grams that pass the seeds' bit table stand."""
    known = Prefixes(seeds)

    def run(batches):
        table = known.table()
        for b in batches:
            texts, ids, keys = (b.column(c).to_pylist() for c in ("text", "doc_id", "key"))
            for lo, hi in text_groups(texts):
                if known.lengths:
                    g, pos, text = _passing(texts[lo:hi], table, known.lengths)
                    yield _batch(HITS, [[ids[lo + t] for t in text], [keys[lo + t] for t in text], g, pos.astype(np.int32)])

    return keyed.mapInArrow(run, HITS)


def windows(p: np.ndarray, q: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Of seeds at text positions p and body positions q: merged windows (start, end, different seeds)."""
    slack = max(4, size // 4)
    order = np.argsort(p - q, kind="stable")
    out: list[list] = []
    for k in order:
        lo, hi = int(p[k] - q[k]) - slack, int(p[k] - q[k]) + size + slack
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
            out[-1][2].add(int(q[k]))
        else:
            out.append([lo, hi, {int(q[k])}])
    return [(lo, hi, len(seeds)) for lo, hi, seeds in out]


ALIGNED = "doc_id long, key long, body long, score double, seeds long, start_word long, end_word long"


def aligned(rows: DataFrame, least_seeds: int, least_score: float) -> DataFrame:
    """The best alignment of each text with each of its candidates, where it reaches the score.

    rows: doc_id, key, text, candidates (body, words, own, hits (p, q)).
    """

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                doc_id, key, text, found = (b.column(c)[k].as_py() for c in ("doc_id", "key", "text", "candidates"))
                h, _ = hash_words([text], normalised=True)
                out = []
                for c in found:
                    words, best = np.frombuffer(c["words"], np.uint64), None
                    p, q = (np.array([x[i] for x in c["hits"]], np.int64) for i in ("p", "q"))
                    for start, end, seeds in windows(p, q, len(words)):
                        if seeds >= min(least_seeds, c["own"]):
                            start = max(start, 0)
                            score, stop = align(h[start:end], words)
                            share = score / (MATCH * len(words))
                            if share >= least_score and (best is None or share > best[0]):
                                best = (share, seeds, start, start + stop)
                    if best:
                        out.append((doc_id, key, c["body"], *best))
                if out:
                    yield _batch(ALIGNED, list(zip(*out, strict=True)))

    return rows.mapInArrow(run, ALIGNED)


def contaminated(docs: DataFrame, items: DataFrame, n: int = N, seeds: int = SEEDS, least_seeds: int = LEAST_SEEDS, least_score: float = LEAST_SCORE) -> DataFrame:
    """Pairs of a document and a test item that it contains, whole or edited: best alignment of each pair.

    Columns: doc_id, key (hash of the text), item_id, score (share of the item's words, less penalties), seeds,
    start_word and end_word (where in the text, in words without punctuation). Defined cases: null and empty texts or items, or
    of punctuation alone, match nothing; an item of fewer than n words must occur as a whole; an item without an id is matched
    under a null id; items of equal words are found alike; repeated rows give repeated pairs; empty tables give no rows; other
    columns are ignored.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text").filter(F.col("text").isNotNull())
    known = materialize(bodies_of(items.filter(F.col("text").isNotNull())), "decontam-items")
    bodies = materialize(known.groupBy("body").agg(F.first("words").alias("words")), "decontam-bodies")
    grams = materialize(item_grams(bodies, n), "decontam-grams")
    counts = materialize(document_counts(keyed, grams), "decontam-counts")
    chosen = materialize(choose_seeds(grams, counts, seeds), "decontam-seeds")
    hits = materialize(seed_hits(keyed, chosen), "decontam-hits")
    met = hits.join(checked(chosen), "gram").groupBy("doc_id", "key", "body").agg(F.collect_set(F.struct("p", "q")).alias("hits"), F.count_distinct("q").alias("met"), F.first("own").alias("own"))
    enough = materialize(met.filter(F.col("met") >= F.least(F.lit(least_seeds), "own")), "decontam-met")
    full = enough.join(bodies, "body").groupBy("doc_id", "key").agg(F.collect_list(F.struct("body", "words", "own", "hits")).alias("candidates"))
    wanted = materialize(full.select(F.col("doc_id").alias("c_id"), F.col("key").alias("c_key"), "candidates"), "decontam-wanted")
    same = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("key") == F.col("c_key"))
    texts = keyed.join(checked(wanted.select("c_id", "c_key")), same, "left_semi")  # two numbers a row; what follows is small
    rows = texts.join(wanted, same).select("doc_id", "key", "text", "candidates")
    found = materialize(aligned(rows, least_seeds, least_score), "decontam-found")
    return found.join(known.select("body", "item_id"), "body").select("doc_id", "key", "item_id", "score", "seeds", "start_word", "end_word")


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a test item, with all their columns, whatever their names.

    Defined cases: null and empty texts are clean; repeated rows are judged alike and all returned; documents of one id with
    different texts are judged apart; a null id is an id like any other; empty tables drop nothing.
    """
    bad = materialize(contaminated(docs, items).select(F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key")).distinct(), "decontam-bad")
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("bad_id")) & (F.xxhash64("row.text") == F.col("bad_key"))
    return rows.join(checked(bad), same, "left_anti").select("row.*")
