"""The registered queries over a whole small set of tables."""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"


def rows_of(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pylist()


def test_each_operator_has_one_query():
    names = [n for n in contract.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_language_is_right_on_held_out_documents(spark):
    out = {r["doc_id"]: r for r in contract.queries()["op4_language"](spark, FOLDER).collect()}
    held = [r for r in rows_of("documents") if out[r["doc_id"]]["held_out"]]
    assert len(out) == len(rows_of("documents"))
    assert sum(out[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) > 0.95 * len(held)


def test_html(spark):
    out = {r["page_id"]: r for r in contract.queries()["op6_html"](spark, FOLDER).collect()}
    for page in rows_of("pages"):
        r = out[page["page_id"]]
        assert r["n_chars"] == len(r["text"]) and "<" not in r["text"]
        article = re.search(r"<article>(.*)</article>", page["html"], re.S)[1]
        assert len(re.findall(r"<(?:p|h1)>", article)) >= len(r["text"].split("\n")) > 0


def test_warc(spark):
    out = {r["page_id"]: r for r in contract.queries()["op8_warc"](spark, FOLDER).collect()}
    for page in rows_of("pages"):
        body, r = (page["html"] or "").encode(), out[page["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r["record_type"] == "response") == (r["refers_to"] is None)


def test_packing(spark):
    out = contract.queries()["op7_packing"](spark, FOLDER).collect()
    filled = {}
    for r in out:
        filled[r["sequence_id"]] = filled.get(r["sequence_id"], 0) + r["length"]
    assert max(filled.values()) <= 1024 and sum(filled.values()) > 0.97 * 1024 * len(filled)


@pytest.mark.parametrize("name", ["op1_transcripts", "op5_decontamination", "op9_quality"])
def test_results_name_their_rows(spark, name):
    out = contract.queries()[name](spark, FOLDER)
    ids = {r[0] for r in out.select(out.columns[0]).collect()}
    known = {r[out.columns[0]] for r in rows_of("conversations" if name.startswith("op1_") else "documents")}
    assert ids and ids <= known and (name == "op5_decontamination" or ids == known)
