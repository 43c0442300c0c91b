"""Operator 9 - toxicity by non-negative positive-unlabelled learning.

A linear classifier on word presence is trained from confirmed toxic texts (P) and unlabelled ones (U). With class prior p,
loss l and classifier f, the risk is p * E_P[l(f)] + max(0, E_U[l(-f)] - p * E_P[l(-f)]): the second term estimates the risk on
clean texts without any, and its lower bound keeps the estimate from going negative, as it would when P is overfitted.

Features are 64-bit word hashes that are significantly more frequent in P than in U, and one that tells whether any telling word
occurs: a word whose share of U is about what toxic texts in U explain, prior * share of P. Both shares are counted over all
training texts by aggregation. Gradient steps use bounded samples, chosen by a hash of the id, of which the driver sees one bit
for each feature: at most (POSITIVES + UNLABELLED) * FEATURES / 8 bytes in expectation, 12 MB. Every document is scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, crc_mod, hash_words, materialize, sampled, text_groups

#: Bounds of the samples for gradient steps, in expectation.
POSITIVES, UNLABELLED = 8_000, 16_000
#: Most features; least confirmed texts and least z score of one.
FEATURES, LEAST_TEXTS, LEAST_Z = 4_000, 3, 3.0
#: Least share of a telling word's texts that toxic ones explain.
TELLING = 0.75


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n_pos, n_all): in how many confirmed and in how many training texts each word occurs. rows: text, toxic."""

    def run(batches):
        for b in batches:
            texts, toxic = b.column("text").to_pylist(), b.column("toxic").to_numpy(zero_copy_only=False)
            for lo, hi in text_groups(texts):
                h, off = hash_words(texts[lo:hi], normalised=True)
                text = np.repeat(np.arange(hi - lo), np.diff(off))
                order = np.lexsort((text, h))
                h, text = h[order], text[order]
                new = np.ones(len(h), bool)
                new[1:] = (np.diff(h) != 0) | (np.diff(text) != 0)
                word, at, n = np.unique(h[new], return_inverse=True, return_counts=True)
                pos = np.bincount(at, toxic[lo:hi][text[new]].astype(np.float64), len(word)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(pos), pa.array(n.astype(np.int64))], names=["word", "n_pos", "n_all"])

    return rows.select("text", "toxic").mapInArrow(run, "word long, n_pos long, n_all long").groupBy("word").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_all").alias("n_all"))


def choose_features(counts: DataFrame, n_pos: int, n_all: int, prior: float, most: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """The most significant words of confirmed texts as sorted hashes, and which of them are telling."""
    p, u = F.col("n_pos") / n_pos, F.col("n_all") / n_all
    both = (F.col("n_pos") + F.col("n_all")) / float(n_pos + n_all)
    z = (p - u) / F.sqrt(both * (F.lit(1.0) - both) * (1 / n_pos + 1 / n_all) + 1e-12)
    best = counts.filter(F.col("n_pos") >= LEAST_TEXTS).select("word", z.alias("z"), (prior * p >= TELLING * u).alias("telling")).filter(F.col("z") >= LEAST_Z)
    rows = best.orderBy(F.desc("z"), "word").limit(most).collect()
    words = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], np.array([r["telling"] for r in rows], bool)[order]


def feature_hits(texts: list[str | None], features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a text's number and a feature's, each once, by text."""
    h, off = hash_words(texts, normalised=True)
    if not len(features) or not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(features, h), len(features) - 1)
    hit = np.flatnonzero(features[at] == h)
    pairs = np.unique((np.searchsorted(off, hit, "right") - 1) * len(features) + at[hit])
    return pairs // len(features), pairs % len(features)


def presence(rows: DataFrame, features: np.ndarray) -> np.ndarray:
    """A row of booleans for each text: which features occur. In an order that does not depend on the partitions."""

    def run(batches):
        for b in batches:
            texts, out = b.column("text").to_pylist(), []
            for lo, hi in text_groups(texts):
                bits = np.zeros((hi - lo, len(features)), bool)
                bits[feature_hits(texts[lo:hi], features)] = True
                out += [x.tobytes() for x in np.packbits(bits, axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["bits"])

    got = sorted(bytes(r["bits"]) for r in rows.select("text").mapInArrow(run, "bits binary").collect())
    packed = np.frombuffer(b"".join(got), np.uint8).reshape(len(got), -1)
    return np.unpackbits(packed, axis=1, count=len(features)).view(bool)


class Sparse:
    """Presence matrix of texts by features, and a last column for any telling one."""

    def __init__(self, bits: np.ndarray, telling: np.ndarray):
        row, at = np.nonzero(bits)
        any_row = np.unique(row[telling[at]])
        self.row, self.col = np.append(row, any_row), np.append(at, np.full(len(any_row), bits.shape[1]))
        self.shape = (len(bits), bits.shape[1] + 1)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.shape[1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def nn_risk(f_pos: np.ndarray, f_unl: np.ndarray, prior: float) -> tuple[float, float]:
    """The two terms of the risk with logistic loss: of positives, and the estimate for negatives before the bound."""
    loss = lambda x: np.logaddexp(0, -x)
    return prior * loss(f_pos).mean(), loss(-f_unl).mean() - prior * loss(-f_pos).mean()


def risk_gradient(pos: Sparse, unl: Sparse, theta: np.ndarray, prior: float) -> np.ndarray:
    """Of the risk by weights and intercept. Where the estimate for negatives is below zero: that of its negation alone, as the method has it."""
    n = pos.shape[1]
    f_p, f_u = pos.dot(theta[:n]) + theta[n], unl.dot(theta[:n]) + theta[n]
    up = lambda x, g: np.append(x.back(g), g.sum()) / len(g)
    negative = up(unl, _sigmoid(f_u)) - prior * up(pos, _sigmoid(f_p))
    return negative - prior * up(pos, _sigmoid(-f_p)) if nn_risk(f_p, f_u, prior)[1] >= 0 else -negative


def train(pos: Sparse, unl: Sparse, prior: float, rounds: int = 1500, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the non-negative risk, by Adam over whole samples."""
    n = pos.shape[1]
    theta, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    theta[n] = np.log(prior / (1 - prior))
    for t in range(1, rounds + 1):
        grad = risk_gradient(pos, unl, theta, prior)
        grad[:n] += decay * theta[:n]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:n], float(theta[n])


def _sample(rows: DataFrame, n: int, most: int) -> DataFrame:
    """About `most` of n rows by a hash of their id."""
    return rows if n <= most else rows.filter(sampled(most / n, "doc_id"))


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED, cut: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out (crc32 of the id modulo folds is `held`), score, predicted (score >= cut).

    labels: doc_id, toxic. Only labels and texts outside the held-out part train. The class prior is a parameter; by
    default the toxic share of training labels. Defined cases: null and empty texts get the score of no words;
    without confirmed toxic texts every score is the prior's; repeated rows get equal scores; an empty table gives no
    rows; other columns, lang and source included, are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc_mod("doc_id", folds) == held).alias("held_out"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(F.col("toxic").isNotNull() & (crc_mod("doc_id", folds) != held))
    count = known.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("p")).first()
    n_toxic = int(count["p"] or 0)
    share = min(max(prior if prior is not None else n_toxic / max(1, count["n"]), 1e-3), 0.5)
    weights, bias, features, telling = np.zeros(1), float(np.log(share / (1 - share))), np.zeros(0, np.uint64), np.zeros(0, bool)
    if n_toxic:
        toxic = checked(materialize(known.filter(F.col("toxic") == 1).select(F.col("doc_id").alias("t_id"), F.lit(True).alias("t")).distinct(), "toxic-ids"))
        train_rows = rows.filter(~F.col("held_out") & F.col("text").isNotNull())
        marked = train_rows.join(toxic, F.col("doc_id") == F.col("t_id"), "left").select("doc_id", "text", F.coalesce("t", F.lit(False)).alias("toxic"))
        seen = marked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("toxic").cast("long")).alias("p")).first()
        n_all, n_pos = int(seen["n"]), int(seen["p"] or 0)
        if n_pos:
            features, telling = choose_features(materialize(word_counts(marked), "toxic-words"), n_pos, n_all, share)
        if len(features):
            pos = presence(_sample(marked.filter("toxic"), n_pos, positives), features)
            unl = presence(_sample(train_rows, n_all, unlabelled), features)
            weights, bias = train(Sparse(pos, telling), Sparse(unl, telling), share)

    def run(batches):
        for b in batches:
            texts, out = b.column("text").to_pylist(), []
            for lo, hi in text_groups(texts):
                f = np.full(hi - lo, bias)
                if len(features):
                    text, own = feature_hits(texts[lo:hi], features)
                    f += np.bincount(text, weights[own], hi - lo)
                    f[np.unique(text[telling[own]])] += weights[-1]
                out.append(_sigmoid(f))
            s = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= cut).astype(np.int32), pa.int32())], names=[x.split()[0] for x in SCORED.split(", ")])

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, SCORED)
