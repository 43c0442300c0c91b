"""Operator 10 - mixture-controlled packing by deficit round-robin.

Each source is a queue of tokens (its documents one after another). In every round, a queue whose weight is
w gets a quantum of w / sum(w of the queues that still hold tokens) of a window; what rounding leaves unsent
is its deficit, kept in 1/65536 of a token and carried to the next window. Rounds of all queues follow each
other in one token stream that is cut into sequences of `seq_len`; the last, shorter one is the only padded one.

Because a queue's share after r rounds is floor(deficit + r * quantum), every piece's place follows from the
document's offset in its queue alone. So documents are tokenised once, offsets come from sums over (source,
chunk), and pieces are placed in parallel, without a shuffle of tokens and without state between tasks: deficits
carry over windows and partitions by arithmetic.

A source whose share is at least 1 / OWN has a queue of its own; there are at most OWN of those. Smaller ones share TAILS queues by
hash, each with the weight of its sources, and are served in order of chunk there. So the driver and each task know at most
OWN + TAILS + 1 queues, whatever the number of sources.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

FRACTION = 1 << 16
#: Queues of single sources, and queues that smaller sources share.
OWN, TAILS = 256, 16
#: Chunks kept per worker for encoding, and the longest chunk that is kept.
CACHE_ENTRIES, CACHE_CHARS = 800_000, 48


class _Known(dict):
    """Ids of chunks, encoded when first asked for. Forgets all at CACHE_ENTRIES; long chunks are not kept."""

    def __init__(self, encode: Callable[[str], list[int]], prefix: str, code: str):
        super().__init__()
        self.encode, self.prefix, self.code = encode, prefix, code

    def __missing__(self, chunk: str) -> bytes:
        ids = array(self.code, self.encode(self.prefix + chunk)).tobytes()
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = ids
        return ids


class ChunkEncoder:
    """Token ids of texts by the given tokenizer file, as uint16 or uint32 bytes.

    Byte-level pre-tokenisation never joins across a single space between two non-space characters, so a text's
    ids are those of its chunks " word"; these are remembered, and only new ones are encoded, by a merge engine that is built
    from the same file. A text's first chunk has no space before it and is remembered apart. Texts that hold an added token of
    the file, and all texts of tokenizers that are not plain byte-level BPE, are encoded whole by the tokenizer itself.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.kind = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        code = "H" if self.kind.itemsize == 2 else "I"
        self.merger = _merger(path)
        if self.merger:
            self.heads, self.chunks = _Known(self.merger.encode_ordinary, "", code), _Known(self.merger.encode_ordinary, " ", code)
        self.double = re.compile(r"\s\s")
        self.cut = re.compile(r"(?<=\S) (?=\S)")

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.merger:
            return [np.array(e.ids, self.kind).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        out, known = [], self.chunks.__getitem__
        for t in texts:
            if self.added and self.added.search(t):
                out.append(np.array(self.tok.encode(t, add_special_tokens=False).ids, self.kind).tobytes())
                continue
            parts = self.cut.split(t) if self.double.search(t) else t.split(" ")
            out.append(self.heads[parts[0]] + b"".join(map(known, islice(parts, 1, None))))
        return out


#: The pre-tokenisation pattern of byte-level tokenizers.
BYTE_LEVEL_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _merger(path: str):
    """A faster merge engine with the file's own vocabulary, or None if the file is not plain byte-level BPE.

    Equal ids need that each id is its merge's rank; that holds if merge k makes the k-th id after the 256 bytes.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or spec.get("post_processor") or model.get("ignore_merges"):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    vocab = model["vocab"]
    if any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
        return None
    own = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in own}
    return tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


TOKENS = "chunk long, queue string, doc_id long, chunk_start long, n_tokens long, ids binary"


def tokenise(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """One row per document: its ids with end_id appended, and the tokens of its queue before it in the same chunk.

    A chunk is what one task reads. A null text is empty (end_id alone); a null source is a queue of its own.
    """

    def run(batches):
        from pyspark import TaskContext

        enc, chunk = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], enc.kind).tobytes()
        sent: dict[str, int] = {}
        for b in batches:
            texts, queues, ids = b.column("text").to_pylist(), b.column("queue").to_pylist(), b.column("doc_id")
            size, at = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size < 2_000_000 and i + 1 < len(texts):
                    continue
                blobs = [x + end for x in enc.encode(texts[at : i + 1])]
                counts = [len(x) // enc.kind.itemsize for x in blobs]
                starts = []
                for q, n in zip(queues[at : i + 1], counts, strict=True):
                    starts.append(sent.get(q, 0))
                    sent[q] = starts[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(blobs), pa.int64()), pa.array(queues[at : i + 1], pa.string()), ids.slice(at, len(blobs)), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())],
                    names=["chunk", "queue", "doc_id", "chunk_start", "n_tokens", "ids"],
                )
                size, at = 0, i + 1

    queue = F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("source")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), queue.alias("queue"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, TOKENS)


@dataclass
class Phase:
    """Rounds 1..rounds in which the same queues are active. Arrays are by active queue, in queue order."""

    base: int
    rounds: int
    active: list[int]
    taken: np.ndarray  # tokens of each active queue sent before this phase
    deficit: np.ndarray  # carried in, in 1/FRACTION tokens
    quantum: np.ndarray  # for each round, in 1/FRACTION tokens
    last: np.ndarray | None = None  # for a phase of one round: the tokens sent, where a queue runs dry

    def sent(self, k, r):
        """Tokens that queue number k of the active ones has sent after r rounds."""
        if self.last is not None:
            return np.where(np.asarray(r) > 0, self.last[k], 0)
        return (self.deficit[k] + np.asarray(r, np.int64) * self.quantum[k]) >> 16


@dataclass
class Plan:
    queues: dict[str, int]
    phases: list[Phase] = field(default_factory=list)
    #: Of each queue the offsets at which its phases start, and the phases with the queue's place in them.
    starts: dict[int, list[int]] = field(default_factory=dict)
    own: dict[int, list[tuple[Phase, int]]] = field(default_factory=dict)

    def add(self, p: Phase) -> None:
        self.phases.append(p)
        for k, q in enumerate(p.active):
            if int(p.sent(k, p.rounds)):
                self.starts.setdefault(q, []).append(int(p.taken[k]))
                self.own.setdefault(q, []).append((p, k))


def plan_rounds(totals: dict[str, int], weights: dict[str, float] | None, window: int) -> Plan:
    """Deficit round-robin over the queues' totals. Weights default to the totals: every window has the corpus mixture.

    A phase ends before a queue lacks its quantum; then follows one round in which the queues give what they have, up
    to their share. Less than a window left in all is one last round. At most two phases for each queue.
    """
    names = sorted(totals)
    left = np.array([totals[q] for q in names], np.int64)
    w = np.array([float((weights or totals).get(q, 0)) for q in names])
    w[w <= 0] = (w[w > 0].min() if (w > 0).any() else 1.0) * 1e-3  # a queue without a target still drains
    plan, base, taken, deficit = Plan({q: i for i, q in enumerate(names)}), 0, np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    while (left > 0).any():
        act = np.flatnonzero(left > 0)
        quantum = np.maximum(1, np.rint(w[act] / w[act].sum() * window * FRACTION)).astype(np.int64)
        rounds = int(((left[act] * FRACTION - deficit[act]) // quantum).min()) if left.max() < 1 << 46 else min((int(x) * FRACTION - int(d)) // int(q) for x, d, q in zip(left[act], deficit[act], quantum, strict=True))
        if left.sum() <= window:
            rounds, last = 0, left[act].copy()
        else:
            last = np.minimum(left[act], (deficit[act] + quantum) >> 16)
        if rounds > 0:
            p = Phase(base, rounds, act.tolist(), taken[act].copy(), deficit[act].copy(), quantum)
            gone = np.array([int(p.sent(k, rounds)) for k in range(len(act))], np.int64)
            deficit[act] = deficit[act] + rounds * quantum - (gone << 16)
        else:
            p = Phase(base, 1, act.tolist(), taken[act].copy(), deficit[act].copy(), quantum, last)
            gone = last
            deficit[act] = np.where(left[act] > gone, deficit[act] + quantum - (gone << 16), 0)
        plan.add(p)
        base += int(gone.sum())
        taken[act] += gone
        left[act] -= gone
    return plan


def place(plan: Plan, queue: int, start: int, n: int) -> list[tuple[int, int, int]]:
    """Where tokens [start, start + n) of a queue go: (offset in the queue, length, position in the stream)."""
    out = []
    end = start + n
    for p, k in plan.own.get(queue, [])[max(0, bisect_right(plan.starts.get(queue, []), start) - 1) :]:
        if start >= end:
            break
        total = int(p.sent(k, p.rounds))
        lo = start - int(p.taken[k])
        if lo >= total:
            continue
        hi = min(end - int(p.taken[k]), total)
        while lo < hi:
            if p.last is not None:
                r, upto = 0, total
            else:
                d, q = int(p.deficit[k]), int(p.quantum[k])
                r = max(0, -(-(((lo + 1) << 16) - d) // q) - 1)
                upto = int(p.sent(k, r + 1))
            stop = min(hi, upto)
            before = int(np.sum(p.sent(slice(None), r)))
            ahead = int(np.sum(p.sent(slice(0, k), r + 1) - p.sent(slice(0, k), r))) if k else 0
            out.append((lo + int(p.taken[k]), stop - lo, p.base + before + ahead + lo - int(p.sent(k, r))))
            lo = stop
        start = int(p.taken[k]) + hi
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _served(sums: DataFrame, weights: dict[str, float] | None) -> tuple[DataFrame, dict[str, float] | None]:
    """sums with the queue that serves each source, and the served queues' weights (None: their totals)."""
    source = F.col("queue")
    tail = F.concat(F.lit("tail "), F.pmod(F.xxhash64(source), F.lit(TAILS)).cast("string"))
    if weights is None:
        by_source = sums.groupBy("queue").agg(F.sum("n").alias("n"))
        whole = by_source.agg(F.sum("n").alias("n")).first()["n"] or 0
        own = [r["queue"] for r in by_source.filter(F.col("n") * OWN >= whole).select("queue").collect()]  # at most OWN
        return sums.withColumn("served", F.when(source.isin(own), source).otherwise(tail)), None
    keyed = {("null" if s is None else f"={s}"): float(w) for s, w in weights.items() if w > 0}
    whole = sum(keyed.values())
    own = {s: w for s, w in keyed.items() if w * OWN >= whole}
    small = F.when(source.isin([s for s in keyed if s not in own]), F.lit("tail of targets")).otherwise(tail)
    return sums.withColumn("served", F.when(source.isin(list(own)), source).otherwise(small)), own | {"tail of targets": whole - sum(own.values())}


def pack(docs: DataFrame, tokenizer: str, seq_len: int = 1024, weights: dict[str, float] | None = None, window_sequences: int = 64, with_ids: bool = False) -> DataFrame:
    """Pack documents (doc_id, source, text) into sequences; one row per piece.

    weights: target share of each source (default: its share of all tokens). Window: window_sequences sequences, in
    which each queue's tokens are within one of its share while it has any. A window of more sequences cuts documents in fewer
    pieces; one sequence gives each the target mixture. Defined cases: a null or empty text is the end id alone; a null source is
    one more queue; a source without a target weight is served last and slowly; repeated rows are packed as often as they come; an
    empty table gives no rows; a text of any length is cut freely; texts that hold special tokens get their ids, as from the plain
    tokenizer; further columns are ignored, whatever their names. with_ids adds the piece's ids as little-endian bytes, for training.
    """
    tokens = materialize(tokenise(docs, tokenizer), "packing-tokens")
    sums, targets = _served(materialize(tokens.groupBy("queue", "chunk").agg(F.sum("n_tokens").alias("n")), "packing-sums"), weights)
    before = F.sum("n").over(Window.partitionBy("served").orderBy("chunk", "queue").rowsBetween(Window.unboundedPreceding, -1))
    base = materialize(sums.select("queue", "chunk", "served", "n", F.coalesce(before, F.lit(0)).alias("queue_start")), "packing-base")
    totals = {r["served"]: int(r["n"]) for r in base.groupBy("served").agg(F.sum("n").alias("n")).collect()}
    plan = plan_rounds(totals, targets, seq_len * window_sequences)
    kind = encoder(tokenizer).kind
    schema = PIECES + (", ids binary" if with_ids else "")

    def run(batches):
        names = [f.split()[0] for f in schema.split(", ")]
        for b in batches:
            rows: list[tuple] = []
            cols = [b.column(c).to_pylist() for c in ("doc_id", "served", "at", "n_tokens")]
            for doc, queue, at, n, blob in zip(*cols, b.column("ids"), strict=True):
                ids = np.frombuffer(blob.as_buffer(), kind).astype("<u4").tobytes()
                for first, size, pos in place(plan, plan.queues[queue], at, n):
                    start = first - at
                    while size:
                        step = min(size, seq_len - pos % seq_len)
                        part = ids[4 * start : 4 * (start + step)]
                        rows.append((doc, start, step, zlib.crc32(part), n, pos // seq_len, pos % seq_len, *([part] if with_ids else [])))
                        start, size, pos = start + step, size - step, pos + step
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if x == "ids" else pa.int64()) for x, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    placed = tokens.join(base.select("queue", "chunk", "served", "queue_start"), ["queue", "chunk"])
    return placed.select("doc_id", "served", (F.col("queue_start") + F.col("chunk_start")).alias("at"), "n_tokens", "ids").mapInArrow(run, schema)


def padded_share(pieces: DataFrame, seq_len: int = 1024) -> float:
    """Share of padding when every sequence is filled up to seq_len."""
    r = pieces.agg(F.sum("length").alias("n"), F.max("sequence_id").alias("m")).first()
    return 0.0 if r["n"] is None else 1 - r["n"] / ((r["m"] + 1) * seq_len)


def sequence_count(tokens: int, seq_len: int = 1024) -> int:
    return math.ceil(tokens / seq_len)


__all__ = ["pack", "tokenise", "plan_rounds", "place", "discard", "padded_share", "sequence_count"]
