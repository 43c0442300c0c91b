"""Operator 1 - n-gram Jaccard join: MinHash banding, then verification on the full n-gram sets.

1. Each text becomes its set of word 5-gram hashes; of it leave a task only a 128-bit fingerprint, the size, and one hash
   for each band. Texts with equal sets are one class, grouped with partial aggregation (a copy costs a counter).
2. Class representatives are shuffled on band hashes. Buckets of one are dropped. A bucket of more than `block`
   members is split by a hash into blocks, and block pairs are spread over the tasks, so no task gets a hot bucket.
   Equal member lists of different bands are kept once.
3. Only the sets of representatives in some bucket are built again and sent to their groups. There all
   pairs that share the band, and no earlier one, are verified at once by a product of incidence matrices. A task returns for
   each member its number of links and one edge of a spanning forest: pairs are never rows.
4. Connected components by alternating large and small stars, with a written table after each round. A node is its class's
   (first id, fingerprint), so that the least node of a component tells the class id, and no join by component follows. Lookups
   of hot nodes and hot classes (more than 1 in 1000 rows) are broadcast, those of all others are shuffled.

Band and row counts follow from the target recall at the threshold. The work left in a hot group of n different but
similar texts is its n * n / 2 verifications, done block by block; that many links are its result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked, discard, hash_words, hot_join, materialize, mix64, ngrams, text_groups

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: N-grams in one side of a comparison; bounds a task's memory where texts are long.
BLOCK_SHINGLES = 1_000_000


def bands_and_rows(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows (fewest false candidates) whose bands within most_hashes reach the recall.

    A pair of similarity s meets in some band with probability 1 - (1 - s^rows)^bands, which grows with s.
    """
    best = (most_hashes, 1)
    for rows in range(1, 17):
        miss = 1 - threshold**rows
        bands = int(np.ceil(np.log(1 - recall) / np.log(miss)))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """For each text its sorted set of n-word hashes. A text of 1 to n - 1 words has one; one without words has none."""
    h, off = hash_words(texts)
    g, pos, _ = ngrams(h, off, n)
    cut = np.searchsorted(pos, off)
    for i in range(len(texts)):
        if off[i + 1] - off[i] >= n:
            yield np.unique(g[cut[i] : cut[i + 1]])
        elif off[i + 1] > off[i]:
            x = np.array([off[i + 1] - off[i]], np.uint64)
            for k in range(off[i], off[i + 1]):
                x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + 1])
            yield x
        else:
            yield np.empty(0, np.uint64)


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 2**32, bands * rows, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 2**32, bands * rows, dtype=np.uint64).astype(np.uint32)[:, None]

    def band_hashes(self, s: np.ndarray) -> np.ndarray:
        x = (s >> np.uint64(16)).astype(np.uint32)[None, :]
        low = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        for k in range(0, x.shape[1], 2048):
            np.minimum(low, (x[:, k : k + 2048] * self.a + self.b).min(axis=1), out=low)
        rows = low.reshape(self.bands, self.rows).astype(np.uint64)
        out = np.arange(1, self.bands + 1, dtype=np.uint64)
        for r in range(self.rows):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
        return out.view(np.int64)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    one, two = mix64(s), mix64(s ^ np.uint64(0xA5A5A5A55A5A5A5A))
    return int(one.sum().view(np.int64)), int(two.sum().view(np.int64))


SIGNED = "doc_id long, key long, s1 long, s2 long, size int, bands array<long>"


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """One row per document; key is a hash of the text; s1, s2 and bands are null without words."""

    def run(batches):
        mh = MinHash(bands, rows)
        for b in batches:
            texts, ids, keys = b.column("text").to_pylist(), b.column("doc_id"), b.column("key")
            for lo, hi in text_groups(texts):
                s1, s2, size, marks = [], [], [], []
                for s in shingle_sets(texts[lo:hi], n):
                    f = fingerprint(s) if len(s) else (None, None)
                    s1.append(f[0])
                    s2.append(f[1])
                    size.append(len(s))
                    marks.append(mh.band_hashes(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), keys.slice(lo, hi - lo), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(size, pa.int32()), pa.array(marks, pa.list_(pa.int64()))], names=[x.split()[0] for x in SIGNED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text").mapInArrow(run, SIGNED)


def band_groups(classes: DataFrame, block: int) -> DataFrame:
    """(group, side, band, rid): which representatives to compare. In a group with a side 1, only across the sides.

    A bucket is split in parts of about `block` members and BLOCK_SHINGLES n-grams at most, each compared with each.
    """
    marks = classes.select("rid", "size", F.posexplode("bands").alias("band", "mark")).select("rid", "band", "size", F.xxhash64("band", "mark").alias("key"))
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    full = marks.groupBy("key").agg(F.count(F.lit(1)).alias("n"), parts.alias("parts")).filter(F.col("n") > 1).select("key", "parts")
    members = materialize(marks.drop("size").join(full, "key"), "join-members")
    few = members.filter(F.col("parts") == 1).groupBy("key").agg(F.min("band").alias("band"), F.array_sort(F.collect_list("rid")).alias("rids"))
    lists = few.groupBy("rids").agg(F.min("band").alias("band")).select(F.xxhash64("rids").alias("group"), F.lit(0).alias("side"), "band", F.explode("rids").alias("rid"))
    many = members.filter(F.col("parts") > 1).select("key", "band", "rid", "parts", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int").alias("own"))
    with_other = many.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    pairs = with_other.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"), F.lit("pair")).alias("group"), (F.col("own") > F.col("other")).cast("int").alias("side"), "band", "rid")
    return lists.unionByName(pairs)


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(rid, shingles): the sets of the wanted classes (rid, first_id, s1, s2), from their first documents' texts."""

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in text_groups(texts):
                sets = list(shingle_sets(texts[lo:hi], n))
                marks = [fingerprint(s) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["s1", "s2", "shingles"])

    first = checked(materialize(wanted.select(F.col("first_id").alias("__first")).distinct(), "join-first"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull())
    built = texts.join(first, F.col("doc_id").eqNullSafe(F.col("__first")), "left_semi").select("text").mapInArrow(run, "s1 long, s2 long, shingles binary")
    return built.join(wanted.select("rid", "s1", "s2"), ["s1", "s2"]).groupBy("rid").agg(F.first("shingles").alias("shingles"))


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of at least the threshold, as a matrix."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    if m == 2:
        shared = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))]] * 2, np.float64)
        shared[1] = shared[0][::-1]
    else:
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(m), sizes.astype(np.int64))
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        new = np.concatenate(([True], every[1:] != every[:-1]))
        number = np.cumsum(new) - 1
        common = np.bincount(number)[number] > 1
        owner, number = owner[common], number[common]
        number = np.unique(number, return_inverse=True)[1]
        shared = np.zeros((m, m), np.float32)
        step = 4096
        cuts = np.searchsorted(number, np.arange(0, (number[-1] if len(number) else 0) + 1 + step, step))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            x = np.zeros((m, step), np.float32)
            x[owner[a:b], number[a:b] - k * step] = 1
            shared += x @ x.T
    both = sizes[:, None] + sizes[None, :] - shared
    return shared >= threshold * np.maximum(both, 1) - 1e-9


def _forest(adjacent: np.ndarray) -> np.ndarray:
    """For each node the least node of its component."""
    m = len(adjacent)
    label = np.arange(m)
    while True:
        new = np.minimum(label, np.where(adjacent, label[None, :], m).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


#: A representative in components: without an id last, then by id, then by the set's fingerprint.
NODE = "struct<none:boolean,id:bigint,s1:bigint,s2:bigint>"


def node(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}id").isNull().alias("none"), F.col(f"{prefix}id").alias("id"), F.col(f"{prefix}s1").alias("s1"), F.col(f"{prefix}s2").alias("s2"))


FOUND = "id long, s1 long, s2 long, links long, root_id long, root_s1 long, root_s2 long"


def verify(groups: DataFrame, sets: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(id, s1, s2, links, root_*): for each representative with links in a group, how many documents it is linked to there, and an edge."""
    rows = groups.join(sets.join(classes.select("rid", "n", "bands", "first_id", "s1", "s2"), "rid"), "rid")
    names = ["group", "side", "band", "rid", "n", "bands", "shingles", "first_id", "s1", "s2"]
    dealt = rows.select(*names).repartition("group").sortWithinPartitions("group", "rid", "side")

    def compare(own: list[tuple]) -> Iterator[tuple]:
        index: dict[int, int] = {}
        sides: list[set[int]] = []
        kept = []
        for r in own:
            if r[3] not in index:
                index[r[3]] = len(kept)
                kept.append(r)
                sides.append(set())
            sides[index[r[3]]].add(r[1])
        if len(kept) < 2:
            return
        band = kept[0][2]
        marks = np.array([r[5] for r in kept], np.int64)
        fresh = np.ones((len(kept), len(kept)), bool)
        np.fill_diagonal(fresh, False)
        one = np.array([1 in s for s in sides])
        if one.any():
            fresh &= one[:, None] != one[None, :]
        fresh &= marks[:, band][:, None] == marks[:, band][None, :]
        for k in range(band):
            fresh &= marks[:, k][:, None] != marks[:, k][None, :]
        if not fresh.any():
            return
        use = np.flatnonzero(fresh.any(axis=1))
        near = linked([np.frombuffer(kept[i][6], np.uint64) for i in use], threshold) & fresh[np.ix_(use, use)]
        copies = np.array([kept[i][4] for i in use], np.int64)
        count, label = near @ copies, _forest(near)
        for k in np.flatnonzero(near.any(axis=1)):
            yield *kept[use[k]][7:10], int(count[k]), *kept[use[label[k]]][7:10]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    def run(batches):
        group, own, out = None, [], []
        for b in batches:
            cols = [b.column(c) for c in names]
            for k in range(b.num_rows):
                r = tuple(c[k].as_py() for c in cols)
                if r[0] != group:
                    out.extend(compare(own))
                    group, own = r[0], []
                own.append(r)
            if out:
                yield batch(out)
                out = []
        out.extend(compare(own))
        if out:
            yield batch(out)

    return dealt.mapInArrow(run, FOUND)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for edges (u, v). Nodes without edges are left out.

    Alternating stars: large stars hang a node's greater neighbours on its least neighbour, small stars the lesser ones.
    The edges of a fixed point are (node, root). All steps are partial aggregations and equi-joins.
    """

    def stars(e: DataFrame, large: bool, n: int) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("c")), "join-least")
        joined = hot_join(both, least, ["u"], "c", 2 * n if large else n)
        if large:
            out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return materialize(out.filter(F.col("u") > F.col("v")).distinct(), "join-edges")

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") > F.col("v")).distinct(), "join-edges")
    last = mark(edges)
    while last[0]:
        half = stars(edges, True, last[0])
        new = stars(half, False, half.count())
        discard(edges)
        discard(half)
        edges, now = new, mark(new)
        if now == last:
            break
        last = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _classified(docs: DataFrame, threshold: float, n: int, recall: float, block: int) -> DataFrame:
    """One row per document: doc_id, key, s1, s2, size, root (the least node of its component; null without words), class_id, n_links, n_copies."""
    bands, rows = bands_and_rows(threshold, recall)
    signed = materialize(signatures(docs, n, bands, rows), "join-signed")
    grouped = signed.filter(F.col("s1").isNotNull()).groupBy("s1", "s2").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    classes = materialize(grouped.select(F.monotonically_increasing_id().alias("rid"), "*"), "join-classes")
    groups = materialize(band_groups(classes, block), "join-groups")
    wanted = classes.join(groups.select("rid").distinct(), "rid", "left_semi").select("rid", "first_id", "s1", "s2")
    sets = materialize(_sets(docs, materialize(wanted, "join-wanted"), n), "join-sets")
    found = materialize(verify(groups, sets, classes, threshold), "join-found")
    discard(sets)
    discard(groups)
    links = found.groupBy("s1", "s2").agg(F.sum("links").alias("links"))
    tree = components(found.select(node().alias("u"), node("root_").alias("v"))).select("node.s1", "node.s2", "root")
    joined = classes.select("s1", "s2", "n", "first_id").join(links, ["s1", "s2"], "left").join(tree, ["s1", "s2"], "left")
    own = F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("id"), "s1", "s2")
    lookup = materialize(joined.select("s1", "s2", F.coalesce("root", own).alias("root"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("n").alias("n_copies"), F.col("n").alias("rows")), "join-lookup")
    named = signed.select("doc_id", "key", "s1", "s2", "size")
    empty = named.filter(F.col("s1").isNull()).select("*", F.lit(None).cast(NODE).alias("root"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    full = hot_join(named.filter(F.col("s1").isNotNull()), lookup, ["s1", "s2"], "rows", signed.count()).unionByName(empty)
    none = F.col("root").isNull()
    return full.select(
        "doc_id", "key", "s1", "s2", "size", "root",
        F.when(none, F.col("doc_id")).otherwise(F.col("root.id")).alias("class_id"),
        F.col("n_links").cast("long").alias("n_links"), F.col("n_copies").cast("long").alias("n_copies"),
    )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE_WORDS, recall: float = 0.9999, block: int = 768) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_copies, n_shingles (size of its n-gram set).

    class_id is the least doc_id of the document's component of links; n_links counts the other documents whose n-gram
    sets have a Jaccard similarity of at least the threshold, copies included; n_copies those with the same set, itself
    included. Defined cases: texts that are null or without words have no set and no links and are classes of their own;
    texts of 1 to n - 1 words have one n-gram, all their words; repeated rows are copies of each other; a component without any
    id has a null class_id; an empty table gives no rows; other columns are ignored.
    """
    rows = _classified(docs, threshold, n, recall, block)
    return rows.select("doc_id", "class_id", "n_links", "n_copies", F.col("size").alias("n_shingles"))


def keep_first(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE_WORDS, recall: float = 0.9999, block: int = 768) -> DataFrame:
    """One document of each component, with all its columns: that of the least doc_id (null last), then of the least set and text hash.

    Documents are told apart by id and text, so an id that comes twice with different texts is two documents. Rows that
    repeat both stay once. Documents that are null or without words all stay; an empty table stays empty; all columns are
    kept, whatever their names.
    """
    rows = materialize(_classified(docs, threshold, n, recall, block).filter(F.col("root").isNotNull()).select("doc_id", "key", "s1", "s2", "root"), "join-rooted")
    first = F.col("doc_id").eqNullSafe(F.col("root.id")) & (F.col("s1") == F.col("root.s1")) & (F.col("s2") == F.col("root.s2"))
    best = materialize(rows.filter(first).groupBy("doc_id", "s1", "s2").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("c")), "join-best")
    # all rows of a first document but those of its least text, then the documents that come more than once
    several = best.filter(F.col("c") > 1).select(F.col("doc_id").alias("b_id"), F.col("s1").alias("b_s1"), F.col("s2").alias("b_s2"), F.col("key").alias("b_key"))
    same = F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("s1") == F.col("b_s1")) & (F.col("s2") == F.col("b_s2")) & (F.col("key") != F.col("b_key"))
    named = [F.col("doc_id").alias("d_id"), F.col("key").alias("d_key")]
    drop = materialize(rows.filter(~first).select(*named).unionByName(rows.filter(first).join(several, same, "left_semi").select(*named)).distinct(), "join-drop")
    twice = materialize(several.select(F.col("b_id").alias("d_id"), F.col("b_key").alias("d_key")), "join-twice")
    drop, twice = checked(drop), checked(twice)
    whole = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"))
    at = F.col("row.doc_id").cast("long").eqNullSafe(F.col("d_id")) & (F.xxhash64("row.text") == F.col("d_key"))
    kept = whole.join(drop, at, "left_anti")
    once = kept.join(twice, at).groupBy("d_id", "d_key").agg(F.first("row").alias("row")).select("row")
    return kept.join(twice, at, "left_anti").unionByName(once).select("row.*")


#: The same by comparing all texts that share an n-gram; feasible where no n-gram is in very many texts.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
d AS (SELECT doc_id, s, len(s) AS n, CASE WHEN len(s) > 0 THEN count(*) OVER (PARTITION BY s) ELSE 1 END AS copies FROM s),
e AS (SELECT doc_id, n, unnest(s) AS g FROM d),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p WHERE shared >= 0.8 * (nx + ny - shared) - 1e-9),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.root = l.x),
c AS (SELECT doc_id, min(root) AS class_id FROM r GROUP BY doc_id),
k AS (SELECT x, count(*) AS links FROM l GROUP BY x)
SELECT d.doc_id, c.class_id, coalesce(k.links, 0) AS n_links, d.copies AS n_copies, CAST(d.n AS INTEGER) AS n_shingles
FROM d JOIN c USING (doc_id) LEFT JOIN k ON k.x = d.doc_id
"""
