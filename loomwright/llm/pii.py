"""Operator 2 - personal data: fixed patterns, and information-theoretic sanitisation of what gives them away.

The patterns' findings (emails, ip addresses, payment cards, phones) are the protected entities, and so are the parts that
identify by themselves: an email's user name and domain, an address's first three numbers, a card's first six digits, a phone
number but for its last four. Corpus co-occurrence tells how much a term near an entity reveals of it. With information
content IC(e) = -log2 P(e) and point-wise mutual information PMI(t; e), what the term leaves unknown of the entity is
IC(e) - PMI(t; e) = -log2 P(e | t) bits. P(e | t) is smoothed over all contexts, (n(t, e) + K P(e)) / (n(t) + K), so that a
single meeting says little and no count of contexts is demanded. A term that leaves at most GENERALISE bits is generalised,
one that leaves at most REMOVE bits is removed; each of its occurrences is, in any document, as it reveals e most where e
itself does not stand.

A term is generalised to the class of corpus words with its longest prefix that leaves at least CLASS bits of every entity that
the term discloses ("thinb*"), or where there is none, to "<term>".

Only DataFrame functions. Words are counted once over all documents, with partial aggregation, so that what is joined is a
vocabulary and never a word as often as it occurs. Texts are read for the patterns and the terms in a window around each
finding, for that count, and for the places of disclosive terms. Up to BROADCAST_ROWS terms and documents with any, no pass
shuffles a text or a text's words; beyond, those two joins are shuffled. No group of documents meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked, let, materialize

KINDS = ("email", "ip", "card", "phone")
#: The patterns. Possessive quantifiers and the look-behinds change no match (what follows a run can't be in it, and a
#: run that fails from its start fails from inside) but keep the time linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Stands for a letter of a finding, so that a word that reaches into one is no term. Alone among findings, emails hold letters.
MASK = "\ue000"
TERM = rf"(?<![\p{{L}}{MASK}])\p{{L}}{{4,}}+(?!{MASK})"
#: The same between two characters: a word that a window cuts is none.
WHOLE_TERM = rf"(?<=[^\p{{L}}{MASK}])\p{{L}}{{4,}}+(?=[^{MASK}])"
#: Code points on each side of a finding in which terms are looked for.
CONTEXT = 60
#: Bits of an entity that a term may leave unknown to be removed or generalised, and that a class of terms must leave.
REMOVE, GENERALISE, CLASS = 0.25, 0.9, 2.0
#: Weight of the prior in P(e | t), in occurrences.
PRIOR = 1.0
SPAN = "array<struct<s:int,o:int,e:int,k:string,v:string>>"
#: Values in a block of a running fold: appending copies a block, and the list of blocks once for each.
FOLD_BLOCK = 256


def running(x: Column, merge) -> Column:
    """Running sums or maxima of an integer array, from 0, in blocks, so that no append copies the whole result."""
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("at"), none.alias("block"), F.array().cast("array<array<int>>").alias("done"))

    def step(acc, v):
        at, full = merge(acc["at"], v), F.size(acc["block"]) >= FOLD_BLOCK
        block = F.concat(F.when(full, none).otherwise(acc["block"]), F.array(at))
        return F.struct(at.alias("at"), block.alias("block"), F.when(full, F.concat(acc["done"], F.array(acc["block"]))).otherwise(acc["done"]).alias("done"))

    return F.aggregate(x, start, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["block"]))))


def located(text: Column, pattern: str) -> Column:
    """All matches as (s, e, v): start and end in code points, and the match.

    Ends are running sums over the pieces between matches and the matches.
    """
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def placed(m):
        sizes = F.zip_with(m, F.slice(gaps, F.lit(1), F.size(m)), lambda v, g: F.length(g) + F.length(v))
        return F.zip_with(m, running(sizes, lambda a, b: a + b), lambda v, e: F.struct((e - F.length(v)).alias("s"), e.alias("e"), v.alias("v")))

    return F.when(text.rlike(pattern), let(match, placed)).otherwise(F.array().cast("array<struct<s:int,e:int,v:string>>"))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:

    def total(back):
        def add(acc, i):
            d = F.substring(back, i, 1).cast("int")
            return acc + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

        return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add)

    return let(F.reverse(_digits(v)), total) % 10 == 0


def _holds(kind: str, v: Column) -> Column:
    """What a match must fulfil beyond its pattern."""
    n = F.length(_digits(v))
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: p.rlike("^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return n.between(14, 19) & _luhn(v)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


#: A cheap test that a text may hold a match at all.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}


def base_spans(text: Column) -> Column:
    """Findings of all kinds, ordered by start and then by kind, as (s, o, e, k, v)."""
    return F.array_sort(F.concat(*(_kind_spans(text, o, kind) for o, kind in enumerate(KINDS))))


def _kind_spans(text: Column, o: int, kind: str) -> Column:
    hint = text.contains(HINTS[kind]) & text.rlike(PATTERNS[kind]) if HINTS[kind] else text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")
    held = F.filter(located(text, PATTERNS[kind]), lambda x: _holds(kind, x["v"]))
    spans = F.transform(held, lambda x: F.struct(x["s"].alias("s"), F.lit(o).alias("o"), x["e"].alias("e"), F.lit(kind).alias("k"), x["v"].alias("v")))
    return F.when(hint, spans).otherwise(F.array().cast(SPAN))


def identifiers(kind: Column, value: Column) -> Column:
    """The protected entities of a finding: itself, and its identifying parts, each marked by its sort."""
    low = F.lower(value)
    digits = _digits(value)
    mark = lambda sort, x: F.concat(F.lit(sort + ":"), x)
    parts = (
        F.when(kind == "email", F.array(mark("user", F.substring_index(low, "@", 1)), mark("domain", F.substring_index(low, "@", -1))))
        .when(kind == "ip", F.array(mark("net", F.substring_index(low, ".", 3))))
        .when(kind == "card", F.array(mark("issuer", F.substring(digits, 1, 6))))
        .otherwise(F.array(mark("line", F.substring(digits, F.lit(1), F.length(digits) - 4))))
    )
    return F.concat(F.array(mark("whole", low)), parts)


def masked(text: Column) -> Column:
    """The text, of equal length, with MASK for the letters of its emails."""
    plain = F.translate(text, MASK, " ")

    def joined(gaps):
        found = F.concat(F.regexp_extract_all(plain, F.lit(PATTERNS["email"]), F.lit(0)), F.array(F.lit("")))
        return F.array_join(F.zip_with(gaps, found, lambda g, v: F.concat(g, F.regexp_replace(v, "[A-Za-z]", MASK))), "")

    return F.when(text.contains("@") & plain.rlike(PATTERNS["email"]), let(F.split(plain, PATTERNS["email"], -1), joined)).otherwise(plain)


def _context_terms(text: Column, spans: Column) -> Column:
    """Terms around each finding: (kind, value, term, s), without those that reach into a finding or that the window cuts."""

    def around(t):
        size = F.length(t) - 2  # a space is on each side

        def terms(x):
            lo = F.greatest(x["s"] - CONTEXT, F.lit(0))
            part = F.lower(F.substring(t, lo + 1, F.least(x["e"] + CONTEXT, size) - lo + 2))
            return F.transform(located(part, WHOLE_TERM), lambda w: F.struct(x["k"].alias("kind"), x["v"].alias("value"), w["v"].alias("term"), (lo + w["s"]).alias("s")))

        return F.flatten(F.transform(spans, terms))

    return let(F.concat(F.lit(" "), masked(text), F.lit(" ")), around)


def findings(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, key (a hash of the text), row (a number, once written), spans, terms."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__t")).select("doc_id", "__t", base_spans(F.col("__t")).alias("spans"))
    none = F.array().cast("array<struct<kind:string,value:string,term:string,s:int>>")
    terms = F.when(F.size("spans") > 0, _context_terms(F.col("__t"), F.col("spans"))).otherwise(none)
    return rows.select("doc_id", F.xxhash64("__t").alias("key"), F.monotonically_increasing_id().alias("row"), "spans", terms.alias("terms"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(term, n_t): how often each word, lower-cased, occurs in all texts; words are runs of letters."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\P{L}+")).alias("term"))
    return words.filter(F.length("term") >= 4).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))


def left_bits(n_te: Column, n_t: Column, n_e: Column, n: float) -> Column:
    """What a term leaves unknown of an entity: IC(e) - PMI(t; e), with P(e | t) smoothed."""
    posterior = (F.least(n_te, n_t) + F.lit(PRIOR) * n_e / F.lit(n)) / (n_t + F.lit(PRIOR))
    information = -F.log2(F.least(n_e / F.lit(n), F.lit(1.0)))
    return information - (F.log2(posterior) + information)


def disclosive(found: DataFrame, words: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, least_class: float = CLASS) -> DataFrame:
    """(term, bits, put): terms that leave at most `generalise` bits of some entity, the least they leave, and what they become.

    words: the materialized vocabulary.
    """
    near = found.select("row", F.explode("terms").alias("x")).select("row", F.explode(identifiers(F.col("x.kind"), F.col("x.value"))).alias("entity"), "x.term", "x.s")
    joint = near.groupBy("entity", "term").agg(F.count_distinct("row", "s").alias("n_te"))  # an occurrence near two findings counts once
    entities = found.select(F.explode("spans").alias("x")).select(F.explode(identifiers(F.col("x.k"), F.col("x.v"))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    n = float(words.agg(F.sum("n_t").alias("n")).first()["n"] or 1)
    pairs = joint.join(words, "term").join(entities, "entity").withColumn("bits", left_bits(F.col("n_te"), F.col("n_t"), F.col("n_e"), n))
    held = materialize(pairs.filter(F.col("bits") <= generalise), "pii-pairs")
    terms = held.groupBy("term").agg(F.min("bits").alias("bits"))
    prefix = lambda x: F.transform(F.sequence(F.lit(2), F.length(x) - 1), lambda k: F.substring(x, F.lit(1), k))
    own = held.select("entity", "term", "n_e", F.explode(prefix(F.col("term"))).alias("prefix"))
    asked = checked(materialize(own.select("prefix").distinct(), "pii-prefixes"))
    # words of the class: all with the prefix; the entity meets some of them
    classes = materialize(words.select("term", "n_t", F.explode(prefix(F.col("term"))).alias("prefix")).join(asked, "prefix", "left_semi").groupBy("prefix").agg(F.sum("n_t").alias("n_t")), "pii-classes")
    met = joint.select("entity", F.explode(prefix(F.col("term"))).alias("prefix"), "n_te").join(own.select("entity", "prefix").distinct(), ["entity", "prefix"], "left_semi").groupBy("entity", "prefix").agg(F.sum("n_te").alias("n_te"))
    general = own.join(classes, "prefix").join(met, ["entity", "prefix"]).withColumn("left", left_bits(F.col("n_te"), F.col("n_t"), F.col("n_e"), n))
    safe = general.groupBy("term", "prefix").agg(F.min("left").alias("left")).filter(F.col("left") >= least_class).groupBy("term").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    put = F.when(F.col("bits") <= remove, F.lit("")).otherwise(F.coalesce(F.concat("prefix", F.lit("*")), F.lit("<term>")))
    return terms.join(safe, "term", "left").select("term", "bits", put.alias("put"))


def _places(text: Column, puts: Column) -> Column:
    """All places of the terms in the map puts, outside findings and ordered, as (s, o, e, k, v); v: what is put there."""
    held = lambda x: F.element_at(puts, F.lower(x))
    hits = let(masked(text), lambda t: F.filter(located(t, TERM), lambda x: held(x["v"]).isNotNull()))
    return F.transform(hits, lambda x: F.struct(x["s"].alias("s"), F.lit(len(KINDS)).alias("o"), x["e"].alias("e"), F.lit("term").alias("k"), held(x["v"]).alias("v")))


def held_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(h_id, h_key, puts): the disclosive terms of each text that has any, near their entity or not, by id and text hash."""
    known = checked(materialize(terms.select("term", "put"), "pii-disclosive"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__t"))
    words = rows.select("doc_id", F.xxhash64("__t").alias("key"), F.explode(F.array_distinct(F.split(F.lower("__t"), r"\P{L}+"))).alias("term"))
    held = words.join(known, "term").groupBy("doc_id", "key").agg(F.map_from_entries(F.collect_set(F.struct("term", "put"))).alias("puts"))
    return checked(materialize(held.select(F.col("doc_id").alias("h_id"), F.col("key").alias("h_key"), "puts"), "pii-held"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def base_digest(spans: Column) -> Column:
    """Lowercase hex SHA-256 of the spans as kind:start:end, joined by commas."""
    return F.sha2(_written(spans), 256)


def _treated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The findings of all documents, and the rows (doc_id, text, h_id, h_key, puts) of those that hold a disclosive term."""
    found = materialize(findings(docs), "pii-found")
    words = materialize(vocabulary(docs), "pii-words")
    return found, held_terms(docs, disclosive(found, words))


def detect(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts by kind, base_sha256, spans, n_term.

    Defined cases: a null text is empty and has no findings; repeated rows are judged alike and all returned; texts
    of an id that comes twice are kept apart by their hash; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    found, held = _treated(docs)
    same = F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("key") == F.col("h_key"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    places = materialize(rows.join(held, same).select("h_id", "h_key", _places(F.col("text"), F.col("puts")).alias("more")).dropDuplicates(["h_id", "h_key"]), "pii-places")
    full = found.select("doc_id", "key", "spans").join(places, same, "left").select("doc_id", "spans", F.coalesce("more", F.array().cast(SPAN)).alias("more"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long").alias(f"n_{k}")
    return full.select("doc_id", *(count(k) for k in KINDS), base_digest(F.col("spans")).alias("base_sha256"), _written(F.array_sort(F.concat("spans", "more"))).alias("spans"), F.size("more").cast("long").alias("n_term"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each ordered span (s, o, e, k, v) replaced: a base kind by its name, a term by what its v says.

    Of overlapping spans the first counts, and the rest of a longer later one.
    """
    put = lambda x: F.when(x["k"] == "term", x["v"]).otherwise(F.concat(F.lit("<"), x["k"], F.lit(">")))

    def pieces(reach):
        before = F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.size(reach) - 1))
        parts = F.zip_with(spans, before, lambda x, at: F.when(x["e"] > at, F.concat(F.substring(text, at + 1, F.greatest(x["s"] - at, F.lit(0))), put(x))).otherwise(F.lit("")))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(reach, -1) + 1, F.length(text)))

    return let(running(F.transform(spans, lambda x: x["e"]), lambda a, b: F.greatest(a, b)), pieces)


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with findings and disclosive terms replaced in their texts.

    The patterns run again on each text rather than moving texts to their spans; only the terms that a text holds are joined.
    Defined cases: a null text stays null and an empty one empty; repeated rows are treated alike and all returned; a null id
    is an id like any other; an empty table gives no rows; all columns are kept, whatever their names.
    """
    narrow = docs.select("doc_id", "text")
    _, held = _treated(narrow)
    row = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"))
    text = F.col("row.text")
    full = row.join(held, F.col("row.doc_id").eqNullSafe(F.col("h_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("h_key")), "left")
    spans = full.select("row", base_spans(text).alias("base"), F.when(F.col("puts").isNotNull(), _places(text, F.col("puts"))).otherwise(F.array().cast(SPAN)).alias("more"))
    every = spans.select("row", F.array_sort(F.concat("base", "more")).alias("every"))
    done = F.when(F.size("every") > 0, redacted(text, F.col("every"))).otherwise(text)
    return every.select(*(done.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
