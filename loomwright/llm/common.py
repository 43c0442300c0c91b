"""Shared helpers of the corpus operators: durable intermediate tables and vectorised word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.plans.session import shared_root

#: Word separators: space and the ASCII controls tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folder for the tables of the work that goes on in this thread, if it has one of its own.
_WORK: ContextVar[str | None] = ContextVar("work", default=None)


@contextmanager
def working(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A folder of its own for the tables that are materialized inside, removed at the end.

    Gives a function that materializes outside of it: for what is to stay.
    """
    folder, kept = f"{_WORK.get() or shared_root(spark)}/{name}-{uuid.uuid4().hex}", _WORK.get()
    token = _WORK.set(folder)
    try:
        yield lambda df: materialize(df, name, root=kept or shared_root(spark))
    finally:
        _WORK.reset(token)
        _remove(spark, folder)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str, compression: str = "zstd", root: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: a lost executor costs a re-read, never a recomputation.

    The reread table has file statistics, so Spark broadcasts it in a join only below its size threshold.
    """
    spark = df.sparkSession
    path = f"{root or _WORK.get() or shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a materialized table that nothing reads any more."""
    path = getattr(df, "_shared_path", None)
    if path:
        _remove(df.sparkSession, path)


#: Rows of a few numbers that may be broadcast: some tens of MB.
BROADCAST_ROWS = 500_000


def checked(keys: DataFrame) -> DataFrame:
    """A materialized table of keys for a join: broadcast up to BROADCAST_ROWS rows, beyond that left to a shuffled join."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


#: A key with a larger share of all rows than one in so many is hot: there are at most as many of those.
HOT = 1_000


def hot_join(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """rows joined with their one lookup row by keys; every row must have one. weight: how many of the `total` rows a key has.

    Hot keys' lookup rows, at most HOT, are broadcast, so a key never meets in one task; only the other rows are shuffled.
    """
    hot = F.broadcast(lookup.filter(F.col(weight) * HOT > total).drop(weight))
    rest = lookup.filter(F.col(weight) * HOT <= total).drop(weight)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(rest, keys))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Equi-join whose keys may be null (null matches null); the right key columns are dropped."""
    cond = None
    for a, b in keys:
        c = left[a].eqNullSafe(right[b])
        cond = c if cond is None else cond & c
    out = left.join(right, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[right[b] for _, b in keys])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: as a lambda variable, it is not copied to each place that uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sampled(share: Column | float, *keys: str) -> Column:
    """Whether a row is in a sample of the given share by a hash of its keys; fine enough for a few rows in 10^12."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 50)).cast("double") < F.lit(float(1 << 50)) * share


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")) % n


# ---------------------------------------------------------------------------------------------
# vectorised hashing of words

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POW = np.empty(4096, np.uint64)
_POW[0] = 1
with np.errstate(over="ignore"):
    for _i in range(1, len(_POW)):
        _POW[_i] = _POW[_i - 1] * np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_IS_PUNCT = np.zeros(256, bool)
_IS_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
#: Bytes hashed at once; bounds the working memory whatever the length of a text.
SLICE_BYTES = 1 << 20


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def _hash_slice(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and byte starts of the words in a buffer that ends with a space."""
    word = ~_IS_SPACE[buf]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    lens = ends - starts
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    pos = np.arange(int(lens.sum())) - np.repeat(first, lens)
    h = np.add.reduceat(_BYTE[buf[word]] * _POW[pos & 4095], first)
    return mix64(h + lens.astype(np.uint64)), starts


def hash_words(texts: Iterable[str | None], normalised: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and the offsets of each text's words (one more than texts).

    Words are runs of characters other than space and tab to carriage return; null and empty texts have none. With
    normalised, texts are first lower-cased and freed of ASCII punctuation. Works on slices of SLICE_BYTES that are cut
    between words.
    """
    blobs = [b"" if t is None else (t.lower() if normalised else t).encode("utf-8", "surrogatepass") for t in texts]
    starts_of = np.concatenate(([0], np.cumsum([len(b) + 1 for b in blobs], dtype=np.int64))) if blobs else np.zeros(1, np.int64)
    buf = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
    if normalised:
        keep = ~_IS_PUNCT[buf]
        starts_of = np.concatenate(([0], np.cumsum(keep)))[np.minimum(starts_of, len(buf))]
        buf = buf[keep]
    hashes, starts, at = [], [], 0
    while at < len(buf):
        end = min(at + SLICE_BYTES, len(buf))
        while end < len(buf) and not _IS_SPACE[buf[end - 1]]:
            step = np.flatnonzero(_IS_SPACE[buf[end : end + 65536]])
            end += int(step[0]) + 1 if len(step) else min(65536, len(buf) - end)
        h, s = _hash_slice(buf[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    s = np.concatenate(starts) if starts else np.empty(0, np.int64)
    return h, np.searchsorted(s, starts_of)


def text_groups(texts: list[str | None], chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about so many characters, a longer text alone."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= chars:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def ngrams(h: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-word sequences within texts: hash, position of the first word, number of the text."""
    if len(h) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    g = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        g = mix64(g * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = np.flatnonzero(text[: len(g)] == text[n - 1 :])
    return g[inside], inside, text[inside]
