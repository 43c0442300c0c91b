"""Operator 3 - language identification by segmentation-marginalised unigrams.

The pieces are a fixed public vocabulary. For each language there is a probability for each piece; a word's probability is the
sum, over all its segmentations into pieces, of the product of their probabilities. A forward pass computes it for many
words at once; expectation-maximisation with a backward pass fits the probabilities. Words of more than SHORT characters, as in
scripts without spaces, go through the same passes one by one: forward with a rescaled window of the last positions that a piece
can reach back to, so that memory does not grow with the word. No word is cut. A text's score is the sum over all
its words. Word scores are remembered in each worker, bounded by WORDS_KEPT, so that scoring costs a lookup for most words.

The model is fitted on at most about `per_language` training documents for each language, chosen by a hash of the id;
every document is scored whole. The driver sees only piece counts (pieces x languages), and sends as many probabilities to each
task; more than LANGUAGES languages are an error.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, discard, materialize, sampled, text_groups

WORDS_KEPT = 400_000
#: Characters up to which words are scored many at once, without rescaling: the least product is above 1e-300.
SHORT = 32
#: Most languages of a model, so that its size is bounded.
LANGUAGES = 256
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
UNKNOWN = 1e-9


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation, as UTF-8."""
    return [] if text is None else text.lower().encode("utf-8", "replace").translate(None, PUNCTUATION).split()


def load_pieces(path: str) -> list[str]:
    """The text pieces of a sentencepiece model file: no control, unknown or byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


class Lattice:
    """All places of pieces in words. The number of pieces stands for an unknown character."""

    def __init__(self, pieces: list[str]):
        self.number = {p: i for i, p in enumerate(pieces)}
        self.size = len(pieces)
        self.starts = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
        self.reach = max(map(len, pieces), default=1)

    def places(self, word: str, i: int) -> list[tuple[int, int]]:
        """Ends and numbers of the pieces that start at position i; a character that is no piece is an unknown one."""
        out, single = [], False
        for j in range(i + 1, min(len(word), i + self.reach) + 1):
            part = word[i:j]
            if part not in self.starts:
                break
            x = self.number.get(part)
            if x is not None:
                out.append((j, x))
                single = single or j == i + 1
        return out if single else [*out, (i + 1, self.size)]

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Arrays word, start, end, piece of all edges, sorted by end; and the words' lengths."""
        number, starts, size = self.number, self.starts, self.size
        w, a, b, p = [], [], [], []
        for k, word in enumerate(words):
            n = len(word)
            for i in range(n):
                single = False
                for j in range(i + 1, n + 1):
                    part = word[i:j]
                    if part not in starts:
                        break
                    x = number.get(part)
                    if x is not None:
                        w.append(k)
                        a.append(i)
                        b.append(j)
                        p.append(x)
                        single = single or j == i + 1
                if not single:
                    w.append(k)
                    a.append(i)
                    b.append(i + 1)
                    p.append(size)
        w, a, b, p = (np.array(x, np.int64) for x in (w, a, b, p))
        order = np.argsort(b, kind="stable")
        return w[order], a[order], b[order], p[order], np.array([len(x) for x in words], np.int64)


def marked(words: list[bytes]) -> list[str]:
    return ["▁" + w.decode("utf-8", "replace") for w in words]


def long_log(lattice: Lattice, word: str, table: np.ndarray) -> np.ndarray:
    """For each language the log of the sum over all segmentations of a word of any length.

    Only the sums of the positions that pieces reach from here on are kept, scaled to a maximum of one.
    """
    size = lattice.reach + 1
    ring, log = np.zeros((size, table.shape[1])), np.zeros(table.shape[1])
    ring[0] = 1
    for i in range(len(word)):
        top = ring.max(axis=0)
        ring /= top
        log += np.log(top)
        here = ring[i % size].copy()
        ring[i % size] = 0
        for j, x in lattice.places(word, i):
            ring[j % size] += here * table[x]
    return log + np.log(ring[len(word) % size])


def long_expected(lattice: Lattice, word: str, prob: np.ndarray) -> dict[int, float]:
    """Expected uses of each piece in one long word, by sums of logs in both directions. prob: of each piece in its language."""
    n, log = len(word), np.log(np.maximum(prob, 1e-300))
    edges = [lattice.places(word, i) for i in range(n)]
    before, after = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    before[0] = after[n] = 0
    for i, own in enumerate(edges):
        for j, x in own:
            before[j] = np.logaddexp(before[j], before[i] + log[x])
    for i in range(n - 1, -1, -1):
        for j, x in edges[i]:
            after[i] = np.logaddexp(after[i], after[j] + log[x])
    out: dict[int, float] = {}
    for i, own in enumerate(edges):
        for j, x in own:
            out[x] = out.get(x, 0.0) + float(np.exp(before[i] + log[x] + after[j] - before[n]))
    return out


def forward(edges, prob: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of prefixes: (words, longest + 1). prob: of each edge."""
    w, a, b, _ = edges
    alpha = np.zeros((len(lengths), int(lengths.max(initial=0)) + 1))
    alpha[:, 0] = 1
    cut = np.searchsorted(b, np.arange(alpha.shape[1] + 1))
    for j in range(1, alpha.shape[1]):
        own = slice(cut[j], cut[j + 1])
        alpha[:, j] = np.bincount(w[own], alpha[w[own], a[own]] * prob[own], len(lengths))
    return alpha


def backward(edges, prob: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    w, a, b, _ = edges
    beta = np.zeros((len(lengths), int(lengths.max(initial=0)) + 1))
    beta[np.arange(len(lengths)), lengths] = 1
    order = np.argsort(-a, kind="stable")
    w, a, b, prob = w[order], a[order], b[order], prob[order]
    cut = np.searchsorted(-a, -np.arange(beta.shape[1], -1, -1))
    for k, i in enumerate(range(beta.shape[1] - 1, -1, -1), 1):
        own = slice(cut[k], cut[k + 1] if k + 1 < len(cut) else len(a))
        beta[:, i] += np.bincount(w[own], beta[w[own], b[own]] * prob[own], len(lengths))
    return beta


def expected_pieces(lattice: Lattice, words: list[bytes], langs: np.ndarray, counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Expected uses of each piece by each language in the words, under the table (pieces + 1, languages)."""
    out = np.zeros_like(table)
    texts = marked(words)
    short = [k for k, x in enumerate(texts) if len(x) <= SHORT]
    for k in set(range(len(texts))).difference(short):
        for x, uses in long_expected(lattice, texts[k], table[:, langs[k]]).items():
            out[x, langs[k]] += uses * counts[k]
    for at in range(0, len(short), 20_000):
        own = np.array(short[at : at + 20_000], np.int64)
        w, a, b, p, lengths = lattice.edges([texts[k] for k in own])
        lang, n = langs[own], counts[own]
        prob = table[p, lang[w]]
        alpha, beta = forward((w, a, b, p), prob, lengths), backward((w, a, b, p), prob, lengths)
        total = alpha[np.arange(len(lengths)), lengths]
        share = alpha[w, a] * prob * beta[w, b] / total[w]
        np.add.at(out, (p, lang[w]), share * n[w])
    return out


class Scorer:
    """Log probabilities of words in each language, with a bounded memory."""

    def __init__(self, pieces: list[str], table: np.ndarray):
        self.lattice, self.table = Lattice(pieces), table
        self.rows: dict[bytes, int] = {}
        self.logs = np.zeros((1024, table.shape[1]))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """(texts, languages): log probability of each text. The caller keeps groups of texts small."""
        docs = [words_of(t) for t in texts]
        seen = set().union(*docs)
        missing = [x for x in seen if x not in self.rows]
        if len(self.rows) + len(missing) > WORDS_KEPT:
            self.rows, missing = {}, list(seen)
        self._learn(missing)
        out = np.zeros((len(texts), self.table.shape[1]))
        for k, d in enumerate(docs):
            if d:
                out[k] = self.logs[np.fromiter(map(self.rows.__getitem__, d), np.int64, len(d))].sum(axis=0)
        return out

    def _learn(self, new: list[bytes]) -> None:
        at = len(self.rows)
        while at + len(new) > len(self.logs):
            self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
        texts = marked(new)
        short = [k for k, x in enumerate(texts) if len(x) <= SHORT]
        for k in set(range(len(texts))).difference(short):
            self.logs[at + k] = long_log(self.lattice, texts[k], self.table)
        for k in range(0, len(short), 20_000):
            own = np.array(short[k : k + 20_000], np.int64)
            w, a, b, p, lengths = self.lattice.edges([texts[i] for i in own])
            for lang in range(self.table.shape[1]):
                alpha = forward((w, a, b, p), self.table[p, lang], lengths)
                self.logs[at + own, lang] = np.log(np.maximum(alpha[np.arange(len(lengths)), lengths], 1e-300))
        self.rows.update((x, at + i) for i, x in enumerate(new))


_SCORERS: dict[int, Scorer] = {}


def scorer(pieces: list[str], table: np.ndarray) -> Scorer:
    """One scorer for each worker process and model; only the last model is kept."""
    key = zlib.crc32(table.tobytes())
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(pieces, table)
    return _SCORERS[key]


def training_words(docs: DataFrame, per_language: int) -> tuple[DataFrame, list[str]]:
    """(lang, word, n) of the training sample, and the languages. docs: doc_id, lang, text, all for training."""
    use = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in use.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if len(langs) > LANGUAGES:
        raise ValueError(f"{len(langs)} languages to learn, more than {LANGUAGES}")
    share = F.lit(0.0)
    for x in langs:
        share = F.when(F.col("lang") == x, F.lit(per_language / sizes[x])).otherwise(share)
    sample = use.withColumn("__n", F.length("text")).filter(sampled(share, "doc_id", "__n")).select("lang", "text")

    def run(batches):
        for b in batches:
            got: dict[str, Counter] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                got.setdefault(lang, Counter()).update(words_of(text))
            for lang, c in got.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    return sample.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), langs


def fit(words: DataFrame, langs: list[str], pieces: list[str], rounds: int = 3) -> np.ndarray:
    """Probabilities (pieces + 1, languages) by expectation-maximisation from equal ones. The last row is of an unknown character."""
    size, number = len(pieces), {x: i for i, x in enumerate(langs)}
    table = np.full((size + 1, len(langs)), 1 / size)
    table[size] = UNKNOWN
    for _ in range(rounds):

        def run(batches, table=table):
            lattice, out = Lattice(pieces), np.zeros_like(table)
            for b in batches:
                lang = np.array([number[x] for x in b.column("lang").to_pylist()], np.int64)
                out += expected_pieces(lattice, b.column("word").to_pylist(), lang, b.column("n").to_numpy().astype(np.float64), table)
            p, k = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(k, pa.int64()), pa.array(out[p, k], pa.float64())], names=["piece", "lang", "n"])

        got = words.mapInArrow(run, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect()
        counts = np.full((size, len(langs)), 0.05)
        for r in got:
            if r["piece"] < size:
                counts[r["piece"], r["lang"]] += r["n"]
        table = np.concatenate([counts / counts.sum(axis=0), np.full((1, len(langs)), UNKNOWN)])
    return table


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(docs: DataFrame, vocabulary: str, folds: int = 5, per_language: int = 3000, rounds: int = 3) -> DataFrame:
    """One row per document: doc_id, held_out (crc32 of the id modulo folds is 0), lang_pred, score.

    The score is the predicted language's posterior with equal priors. Only training rows' lang is read. Defined cases: a
    null text or one without a letter is und with score 0, and so is everything if nothing can be learned; ties go to the
    first language by name; repeated rows get equal predictions; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", (crc_mod("doc_id", folds) == 0).alias("held_out"))
    pieces = load_pieces(vocabulary)
    words, langs = training_words(rows.filter(~F.col("held_out")), per_language)
    table = None
    if langs:
        kept = materialize(words.repartition("word"), "lang-words")
        table = fit(kept, langs, pieces, rounds)
        discard(kept)

    def run(batches):
        for b in batches:
            texts, preds, scores = b.column("text").to_pylist(), [], []
            for lo, hi in text_groups(texts, 1_000_000):
                part = texts[lo:hi]
                logs = scorer(pieces, table).score(part) if table is not None else None
                for k, t in enumerate(part):
                    if logs is None or t is None or not any(map(str.isalpha, t)):
                        preds.append("und")
                        scores.append(0.0)
                    else:
                        best = int(logs[k].argmax())
                        preds.append(langs[best])
                        scores.append(float(1 / np.exp(logs[k] - logs[k][best]).sum()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, PREDICTED)
