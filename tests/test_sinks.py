from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from provenir import schemas
from provenir.sources import readers, writers

WHEN = datetime(2026, 8, 13, 9)


def test_search_responses(table):
    body = json.dumps({"web": {"results": [{"url": "https://a", "title": "T"}, {"title": "no url"}, {"url": 7}, {"url": ""}, {"url": "https://b", "description": "d"}]}})
    rows = table([("q", 0, body), ("none", 1, "{}"), ("bad", 2, "not json")], "query string, query_seq int, body string")
    got = [(r["rank"], r["url"], r["title"], r["snippet"]) for r in readers.read_search_responses(rows).orderBy("rank").collect()]
    assert got == [(0, "https://a", "T", ""), (4, "https://b", "", "d")]


def test_cache_round_trip_and_misses(spark, table, tmp_path):
    ddl = schemas.PAGE_CACHE
    old = table([("u", "u", WHEN, "old", "h0", 200, None, None), ("v", "v", WHEN, "keep", "h1", 200, None, None)], ddl)
    new = table([("u", "u", WHEN.replace(hour=10), "new", "h2", 200, "e", None)], ddl)
    path = str(tmp_path / "cache")
    writers.write_page_cache(old, new, path)
    with open(f"{path}/extra.json", "w") as handle:
        handle.write('{"url": "broken\n{"url": "w", "fetched_at": "2026-08-13T09:00:00.000Z", "schema_version": 2}\n')
    cache = readers.read_page_cache(spark, path)
    got = {r["url"]: r["content"] for r in cache.collect()}
    assert got == {"u": "new", "v": "keep"}
    wanted = table([("u",), ("w",)], "url string")
    assert {r["url"]: r["content"] for r in readers.lookup_pages(wanted, cache).collect()} == {"u": "new", "w": None}


def test_corridor_store(spark, table, tmp_path):
    ddl = schemas.RESOLVED_CORRIDORS
    rows = table([("k", WHEN, [], ["fees"], ["n"], ["q"], 0, 3)], ddl)
    writers.write_corridors(None, rows, str(tmp_path / "c"))
    assert readers.read_corridors(spark, str(tmp_path / "c")).first()["unresolved_roles"] == ["fees"]


def test_equal_stamps_are_settled_by_the_row(spark, table, tmp_path):
    rows = [("u", "u", WHEN, c, f"h{c}", 200, None, None) for c in ("b", "d", "a", "c")]
    table(rows, schemas.PAGE_CACHE).withColumn("schema_version", F.lit(1)).repartition(4).write.json(str(tmp_path / "c"))
    assert readers.read_page_cache(spark, str(tmp_path / "c")).first()["content"] == "d"


def test_two_runs_of_one_stamp(spark, table, tmp_path):
    schema = "corridor_key string, recorded_at timestamp, run_id string, url string"
    rows = table([("k", WHEN, "r1", "old"), ("k", WHEN, "r2", "n1"), ("k", WHEN, "r2", "n2"), ("j", WHEN, "r1", "j")], schema)
    writers.write_recall_records(rows, str(tmp_path / "r"))
    assert {r["url"] for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {"n1", "n2", "j"}


def test_registry_keeps_trust_order(spark, table, tmp_path):
    ddl = schemas.AUTHORITY_REGISTRY
    rows = table([("VN", "V", ["z.gov.vn", "a.gov.vn"], [{"domain": "r.vn", "evidence": "e"}], []), ("GB", "G", ["x.gov.uk"], [], ["y.uk"])], ddl)
    path = str(tmp_path / "registry")
    writers.write_registry(rows, path)
    files = list(tmp_path.glob("registry/part-*.json"))
    lines = [json.loads(line) for f in files for line in f.read_text().splitlines()]
    assert len(files) == 1 and [x["code"] for x in lines] == ["GB", "VN"] and lines[1]["trusted"] == ["z.gov.vn", "a.gov.vn"]
    assert readers.read_registry(spark, path).count() == 2


def test_dimension_loader_refuses_a_repeated_code(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"domain": "a.b", "category": "x"}\n{"domain": "a.b", "category": "y"}\n')
    with pytest.raises(ValueError, match="unique"):
        readers.read_denylist(spark, str(tmp_path / "d.json"))


def test_extra_columns_are_refused(table):
    with pytest.raises(ValueError, match="unexpected"):
        readers.assert_schema(table([("a", "b", "c")], "domain string, category string, more string"), schemas.DENYLIST)


def test_recall_records_keep_the_newest_run(spark, table, tmp_path):
    schema = "corridor_key string, recorded_at timestamp, url string"
    rows = table([("k", WHEN, "old"), ("k", WHEN.replace(hour=11), "n1"), ("k", WHEN.replace(hour=11), "n2")], schema)
    writers.write_recall_records(rows, str(tmp_path / "r"))
    assert {r["url"] for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {"n1", "n2"}


def test_snapshot(spark, table, tmp_path):
    for name, content in {"a": " text ", "b": "  ", "c": "x" * 50, "d": "undeclared"}.items():
        (tmp_path / f"{name}.txt").write_text(content)
    manifest = table([("a", "T"), ("b", "T"), ("c", "T"), ("e", "T")], "source_id string, title string")
    files = readers.read_snapshot_files(spark, str(tmp_path))
    sources, problems = readers.read_snapshot(manifest, files, 20, F.lit(WHEN))
    assert [(r["source_id"], r["content"]) for r in sources.collect()] == [("a", "text")]
    assert {r["source_id"]: r["problem"] for r in problems.collect()} == {
        "b": "the text is empty", "c": "the text is too long", "d": "has a text but is not declared", "e": "declared but has no text",
    }


def test_query_templates(table):
    rows = table([("Japan", "India", "Spain", "tourism", ["a.jp", "b.jp"])], "name string, nationality string, residence string, purpose string, trusted array<string>")
    got = [r["query"] for r in readers.corridor_queries(rows, ["name"]).orderBy("query_seq").collect()]
    assert len(got) == 6 and got[0] == "site:a.jp Japan visa requirements India" and got[5] == "site:b.jp visa application Spain"
