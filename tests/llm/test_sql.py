"""Queries of operators that SQL can express, against their SQL in DuckDB, as multisets of rows."""

from collections import Counter

import duckdb
import pytest

from plumbline.llm import queries, quality, urlgraph

DIR = "/root/testdata/sf0.01"


def rows_of(frame, columns):
    return Counter(tuple(round(x, 6) if isinstance(x := r[c], float) else x for c in columns) for r in frame.collect())


def expected_of(db, name):
    found = db.execute(queries.oracle_sql()[name])
    return [d[0] for d in found.description], Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    columns, expected = expected_of(db, name)
    got = queries.queries()[name](spark, DIR)
    assert sorted(columns) == sorted(got.columns)
    assert rows_of(got, columns) == expected and expected


def test_urls_with_links_equal_sql(spark):
    hosts = ["good.com", "spam.net", "a.org", "b.org", "c.org", "d.org", "Spam.NET"]
    to = {"good.com": ["x.org"], "a.org": ["b.org", "c.org"], "b.org": ["spam.net"], "c.org": ["spam.net", "spam.net", "a.org"], "d.org": ["b.org"]}
    pages = [(i, f"http://{h}/{p}/x", "".join(f'<a href="//{x}/">y</a>' for x in to.get(h, []))) for i, (h, p) in enumerate((h, p) for h in hosts for p in ("es", "en"))]
    pages += [*((k, "http://spam.net/fr/", "") for k in (70, 71, 72)), (90, None, None), (91, "no host", ""), (92, "https://a.org?q", '<a href=http://B.org/z>'), (92, "https://a.org?q", "")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    db = duckdb.connect()
    db.register("given", frame.toArrow())
    db.execute("CREATE VIEW pages AS SELECT * FROM given")
    columns, expected = expected_of(db, "op7_url_filters")
    assert rows_of(urlgraph.judge_urls(frame), columns) == expected
    assert {"allow", "block"} == {r[4] for r in expected if r[3] is None}


def test_odd_texts_equal_sql(spark):
    texts = ["a b c " * 40, "x\ny\nx\n \n\ny", None, "", " \t\n\x0b\x0c\r", "ñandú \u00a0 日本 #$ <a>|&*%", "w " * 3 + "w", "\x1c \x85 q"] + ["one two three four " * 20] * 2
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, None if i % 3 else "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    db = duckdb.connect()
    db.register("given", docs.toArrow())
    db.execute("CREATE VIEW documents AS SELECT * FROM given")
    columns, expected = expected_of(db, "op9_quality_rules")
    assert rows_of(quality.quality_verdicts(docs), columns) == expected
