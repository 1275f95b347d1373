"""The contract of the query catalog, and a few of its queries against their check SQL."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
from provenir import catalog
from tools.check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(catalog.QUERIES) - set(catalog.ORACLES) <= {"excerpt", "link_signals"}
    assert set(catalog.QUERIES) <= set(contract.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", ["domain_evidence", "links", "body_scores", "shortlist_reserved", "robots_verdict", "cache_fold", "integrity"])
def test_query_matches_its_sql(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    result = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", ["url_features", "placeholder_text"])
def test_more_queries_match_their_sql(spark, duck, name):
    test_query_matches_its_sql(spark, duck, name)


@pytest.mark.parametrize("name", ["clean_text", "domain_evidence", "titles"])
def test_odd_character_references_match_their_sql(spark, tmp_path, name):
    odd = ["a&amp", "b&amp;c", "&lt;x&gt", "&#65;&#66", "&#x43;&#x1F600;", "&#0;&#xD800;&#9999999;", "&Alpha;&nosuch;&am", "&copy1; &apos;", "x&;y&&z"]
    con = duckdb.connect()
    rows = [
        (i, f"https://the{i % 3}.example.net/{lang}/{i}", f"<html><title>{x}</title><body><h1>{x}</h1><a href=\"/p{i}\">to {x}</a><p>{x}<p>{x}</body>")
        for i, (x, lang) in enumerate((x, lang) for x in odd for lang in ("en", "de"))
    ]
    rows.append((99, "https://the.example.net/en/99", "<p>" + "<p>".join(f"{'part' * 20}.{'name' * 20}.a{i}" for i in range(6))))
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    con.execute(f"COPY pages TO '{tmp_path}/pages.parquet'")
    df = contract.queries()[name](spark, str(tmp_path))
    result = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_body_scores_cover_every_document(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    scored = contract.queries()["body_scores"](spark, FOLDER).select("doc_id").distinct()
    every = contract.queries()["body_scores_tables"](spark, FOLDER).select("doc_id").distinct()
    assert docs.select("source").distinct().count() > 1
    assert sorted(r[0] for r in scored.collect()) == sorted(r[0] for r in every.collect())


def test_titles_of_sources_decode_what_their_sql_decodes(spark, tmp_path):
    test_odd_character_references_match_their_sql(spark, tmp_path, "source_ids")
