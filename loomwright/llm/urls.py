"""Operator 6 - URL filters: listed rules first, association rules for the rest.

Listed rules (host, path) judge the urls that they fit; those verdicts are also the labels. FP-growth mines the token
combinations of labelled urls, labels among the items. Tokens that always occur together become one item before, which changes
no support and no confidence and keeps a path that many urls share from multiplying the combinations. Rules whose consequent is
a label are pruned by confidence and support, by simpler rules that are as good, and by what they are worth elsewhere: a rule must
be better than the verdict's share, hold on several hosts, and be as confident on hosts that were held out from mining. They match by
an inverted index: each rule is filed under its rarest token, and url token sets look their tokens up. Sets are matched
once each, however many urls share one.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked, materialize

#: Verdict, host, path of the listed rules.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
LEAST_SUPPORT, LEAST_PAGES, LEAST_CONFIDENCE = 0.002, 20, 0.95
#: Hosts on which a rule must hold, its least confidence relative to the verdict's share, and 1 of so many hosts is held out.
LEAST_HOSTS, LEAST_LIFT, HELD = 3, 1.05, 4
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; empty without "://"."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The url's items: scheme, host labels by place from the right, words of the path, query names, fragment, extension.

    Numbers are one token, whatever their value.
    """
    number = lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("#")).otherwise(x)
    labels = F.reverse(F.split(host, r"\."))
    names = F.transform(labels, lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit("="), x))
    steps = F.filter(F.split(F.regexp_replace(path, r"\.[A-Za-z0-9]{1,5}$", ""), "/"), lambda x: x != "")
    words = F.transform(steps, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), number(x)))
    ext = F.concat(F.lit("ext="), F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1))
    query = F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "&")
    keys = F.transform(F.filter(query, lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.substring_index(x, "=", 1)))
    extra = F.array(F.concat(F.lit("scheme="), F.substring_index(F.coalesce(url, F.lit("")), "://", 1)), ext, F.when(F.coalesce(url, F.lit("")).contains("#"), F.lit("fragment")))
    return F.array_sort(F.array_distinct(F.array_compact(F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(names, words, keys, extra)))))


def collapsed(rows: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(items, verdict, kept) rows, and (item, members): tokens of at least `least` rows, those of equal rows as one item.

    Rows are told apart by two hashes of their token sets, whose sums over a token's rows are the token's signature.
    """
    rows = rows.select("items", "verdict", F.xxhash64(F.lit(1), "items").alias("a"), F.xxhash64(F.lit(2), "items").alias("b"))
    sets = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.first("items").alias("items"))
    tokens = materialize(sets.select("a", "b", "n", F.explode("items").alias("token")), "url-tokens")
    big = lambda x: F.sum(F.col(x).cast("decimal(38,0)")).alias(x)
    signed = tokens.groupBy("token").agg(F.sum("n").alias("n"), big("a"), big("b")).filter(F.col("n") >= least)
    # at most a url's tokens over the support
    classes = materialize(signed.groupBy("n", "a", "b").agg(F.min("token").alias("item"), F.array_sort(F.collect_set("token")).alias("members")).select("item", "members"), "url-classes")
    mapped = tokens.join(F.broadcast(classes.select(F.col("item").alias("token"))), "token", "left_semi").groupBy("a", "b").agg(F.array_sort(F.collect_set("token")).alias("kept"))
    return rows.join(mapped, ["a", "b"]).select("items", "verdict", "kept"), classes


def simplest(rules: DataFrame) -> DataFrame:
    """Without the rules that have a part of their antecedent, of any size, as a rule of the same verdict and no less confidence."""
    filed = rules.select(F.col("antecedent").alias("part"), F.col("verdict").alias("other"), F.col("confidence").alias("as_good"), F.element_at("antecedent", 1).alias("token"))
    longer = rules.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("token"))
    inside = (F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0)
    beaten = longer.join(filed, "token").filter((F.col("other") == F.col("verdict")) & (F.col("as_good") >= F.col("confidence")) & inside)
    return rules.join(beaten.select("antecedent", "verdict").distinct(), ["antecedent", "verdict"], "left_anti")


def mine(labelled: DataFrame, least_support: float = LEAST_SUPPORT, least_pages: int = LEAST_PAGES, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """(antecedent, verdict, confidence, support) from (items, verdict) rows.

    A token combination counts from least_support of the labelled urls, and from least_pages of them. An antecedent has all
    tokens that always occur with its items.
    """
    n = labelled.count()
    share = min(1.0, max(least_support, least_pages / max(1, n)))
    kept, classes = collapsed(labelled, share * n)
    rows = kept.select(F.concat("kept", F.array(F.concat(F.lit("label="), F.col("verdict")))).alias("items"))
    total = rows.count()  # rows without a frequent token have no part in any rule
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, share * n / max(1, total)), minConfidence=least_confidence).fit(rows)
    label = F.element_at("consequent", 1)
    found = model.associationRules.filter(label.startswith("label=")).filter(~F.exists("antecedent", lambda x: x.startswith("label=")))
    support = F.col("support") * total / max(1, n)
    rules = materialize(found.select(F.array_sort("antecedent").alias("antecedent"), F.substring(label, 7, 100).alias("verdict"), "confidence", support.alias("support")), "url-rules")
    short = simplest(rules).select("antecedent", "verdict", "confidence", "support", F.explode("antecedent").alias("item"))
    return short.join(F.broadcast(classes), "item").groupBy("antecedent", "verdict", "confidence", "support").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("all")).select(F.col("all").alias("antecedent"), "verdict", "confidence", "support")


def _hits(sets: DataFrame, rules: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of sets (items and more) with the rules within them, by the rarest token of each rule. counts: (token, n)."""
    words = rules.select("*", F.explode("antecedent").alias("token")).join(counts, "token", "left")
    filed = words.groupBy(*rules.columns).agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), F.col("token"))).alias("token"))
    return sets.select("*", F.explode("items").alias("token")).join(checked(materialize(filed, "url-filed")), "token").filter(F.size(F.array_except("antecedent", "items")) == 0).drop("token")


def token_counts(sets: DataFrame) -> DataFrame:
    return sets.select(F.explode("items").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def held_out(host: Column) -> Column:
    """Whether a host's urls are kept from mining, to judge the rules."""
    return F.pmod(F.xxhash64(host), F.lit(HELD)) == 0


def validated(rules: DataFrame, labelled: DataFrame, least_confidence: float = LEAST_CONFIDENCE, least_hosts: int = LEAST_HOSTS, least_lift: float = LEAST_LIFT) -> DataFrame:
    """The rules that hold elsewhere, with hosts, lift and held_confidence. labelled: items, host, verdict."""
    sets = materialize(labelled.groupBy("items", "host", F.col("verdict").alias("label")).agg(F.count(F.lit(1)).alias("pages")), "url-labelled")
    shares = sets.groupBy(F.col("label").alias("verdict")).agg(F.sum("pages").alias("n"))
    whole = sets.agg(F.sum("pages").alias("whole"))  # one row
    base = shares.join(F.broadcast(whole)).select("verdict", (F.col("n") / F.col("whole")).alias("share"))
    hits = _hits(sets, rules, token_counts(sets)).withColumn("right", F.col("label") == F.col("verdict")).withColumn("held", held_out(F.col("host")))
    worth = hits.groupBy(*rules.columns).agg(
        F.count_distinct(F.when(F.col("right"), F.col("host"))).alias("hosts"),
        F.sum(F.when(F.col("held") & F.col("right"), F.col("pages")).otherwise(0)).alias("held_right"),
        F.sum(F.when(F.col("held"), F.col("pages")).otherwise(0)).alias("held_pages"),
    )
    scored = worth.join(F.broadcast(base), "verdict").select(*rules.columns, "hosts", (F.col("confidence") / F.col("share")).alias("lift"), "held_pages", F.try_divide("held_right", "held_pages").alias("held_confidence"))
    return scored.filter((F.col("hosts") >= least_hosts) & (F.col("lift") >= least_lift) & (F.col("held_confidence") >= least_confidence))


def match(sets: DataFrame, rules: DataFrame, counts: DataFrame) -> DataFrame:
    """(items, mined): for each token set the verdict of the best rule within it: by confidence, support, then text."""
    hits = _hits(sets.select("items"), rules.select("antecedent", "verdict", "confidence", "support"), counts)
    return hits.groupBy("items").agg(F.max_by("verdict", F.struct("confidence", "support", F.array_join("antecedent", " "), "verdict")).alias("mined"))


def learned(labelled: DataFrame) -> DataFrame:
    """The rules from labelled urls (items, host, verdict): mined on some hosts, judged on the others."""
    return validated(materialize(mine(labelled.filter(~held_out(F.col("host"))).select("items", "verdict")), "url-mined"), labelled)


def judge(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, by_rule (whether a listed rule decided).

    Defined cases: a null url or one without "://" has an empty host and path and no tokens, and is allowed; without labels
    or matching rules a url is allowed; repeated rows are judged alike; an empty table gives no rows; other columns
    are ignored.
    """
    host, path = parts(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = listed(F.col("host"), F.col("path"))
    rows = materialize(split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("listed"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("items")), "url-rows")
    labelled = rows.filter(F.col("listed").isNotNull() & (F.size("items") > 0)).select("items", "host", F.col("listed").alias("verdict"))
    free = materialize(rows.filter(F.col("listed").isNull()).select("items").distinct(), "url-sets")
    mined = materialize(match(free, materialize(learned(labelled), "url-learned"), token_counts(free)), "url-verdicts")
    full = rows.join(mined, "items", "left")
    return full.select("page_id", "host", "path", "rule", F.coalesce("listed", "mined", F.lit(DEFAULT)).alias("verdict"), F.col("listed").isNotNull().alias("by_rule"))
