"""What the contracts of three operators fix besides their methods, as queries of its own that DuckDB can replay.

They read the same expressions as the operators: the findings of the personal-data patterns, the text statistics with the fixed
quality rules, and the listed url rules. Each covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii, quality, urls
from .common import documents, table

_BYTE = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
#: Each kind's pattern and what its matches must fulfil beyond it, in SQL.
_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", rf"regexp_full_match(v, '0*{_BYTE}(\.0*{_BYTE}){{3}}')"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda d, i: CASE WHEN i % 2 = 1 THEN CAST(d AS INT) WHEN d > '4' THEN CAST(d AS INT) * 2 - 9 ELSE CAST(d AS INT) * 2 END)) % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
}


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts of the patterns' findings by kind, base_sha256."""
    found = pii.findings(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in pii.KINDS), pii.base_digest(F.col("spans")).alias("base_sha256"))


def _places(kind: str, order: int) -> str:
    """Matches with their places: ends are running sums of the pieces between matches and the matches."""
    pattern, holds = _KINDS[kind]
    return (
        f"SELECT r, '{kind}' AS k, {order} AS o, e - length(v) AS s, e FROM (SELECT r, v, sum(length(g) + length(v)) OVER (PARTITION BY r ORDER BY i) AS e FROM "
        f"(SELECT r, unnest(m) AS v, unnest(g[:len(m)]) AS g, unnest(range(len(m))) AS i FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM t))) WHERE {holds}"
    )


_PII = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_places(k, o) for o, k in enumerate(_KINDS))}),
d AS (SELECT r, {", ".join(f"count(*) FILTER (k = '{k}') AS n_{k}" for k in _KINDS)}, string_agg(k || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, o) AS spans FROM f GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _KINDS)}, sha256(coalesce(spans, '')) AS base_sha256 FROM t LEFT JOIN d USING (r)"""


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base statistics, base_failed."""
    stats = quality.text_statistics(documents(spark, sf_dir), ["doc_id"])
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.base_failed().alias("base_failed"))


_QUALITY = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
e AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS i FROM w),
k AS (SELECT r, i, {" || ' ' || ".join(f"lead(x, {n}) OVER o" for n in range(8))} AS k FROM e WINDOW o AS (PARTITION BY r ORDER BY i)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM k WHERE k IS NOT NULL) WHERE n > 1),
c AS (SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS c FROM d),
n AS (SELECT r, CAST(sum(c) AS BIGINT) AS n FROM c GROUP BY r),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN n USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s"""


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, and the listed rule with its verdict (nulls where none fits)."""
    host, path = urls.parts(F.col("url"))
    split = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = urls.listed(F.col("host"), F.col("path"))
    return split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("listed"))


_URLS = f"""
WITH l AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)}) AS l(verdict, h, p)),
u AS (SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
f AS (SELECT r, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS listed FROM u JOIN l ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, listed FROM u LEFT JOIN f USING (r)"""

QUERIES = {f.__name__: f for f in (pii_base, quality_base, url_rules)}
ORACLES = {"pii_base": _PII, "quality_base": _QUALITY, "url_rules": _URLS}
