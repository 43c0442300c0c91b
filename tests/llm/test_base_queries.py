"""The parts that contracts fix, against DuckDB, over the driver's tables and over awkward rows."""

import duckdb
import pytest

from loomwright.llm import base_queries

TEXTS = [
    None,
    "",
    " \n\t",
    "a@b.c 1.2.3.4.5.6.7.8 999.1.1.1 00255.0.0.1 x@y @z.z a@b..c é@ü.de",
    "4111 1111 1111 1111 4111-1111-1111-1112 +1 (202) 555-0100 +123 ++49.30.1234567, 5500005555555559",
    "😀 a.b@c-d.ef 😀😀 10.0.0.1\r\n+44 20 7946 0958 - 1",
    "one two three four five six seven eight nine " * 4,
    "same line\n same line\nsame line\n\n\nx#*$%&|<>\x0b\x0cy",
    "w " * 30,
]
URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/a?b#c", "a://b://example.com/en/", "https://example.com/en/x", "x://com", "x://com/", "x://a.net/es/?q", "x://anet/es/", "x://www.example.com/fr/\nz", "x://ÄB.net/fr/é"]


def check(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if 'testdata' not in str(folder) else ''}'")
    want = con.sql(base_queries.ORACLES[name])
    got = base_queries.QUERIES[name](spark, str(folder))
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(base_queries.QUERIES))
def test_equal_to_sql(spark, sf, name):
    check(spark, sf, name)


@pytest.mark.parametrize("name", sorted(base_queries.QUERIES))
def test_awkward_rows_equal_sql(spark, tmp_path, name):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    check(spark, tmp_path, name)
