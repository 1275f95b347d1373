from __future__ import annotations

import gzip
import hashlib
import base64
import io
import random

import pytest

from provenir.llm import warc

SCHEMA = "page_id long, url string, html string, sha string, n int"


def test_round_trip(spark, table, prose):
    pages = [(i, f"http://x/{i}", prose(i % 40, 30 + i % 40), "s", 1) for i in range(120)]
    pages += [(500, None, None, None, None), (501, "a\r\nb", "", "", 0), (502, "u", "é" * 3000, "", 0), (503, "u", prose(7, 60_000), "", 0)]
    folder = warc.archive_folder(spark)
    warc.write_archive(table(pages, SCHEMA), folder)
    got = {int(r["record_id"]): r for r in warc.read_archive(spark, folder, range_bytes=701).collect()}
    assert sorted(got) == sorted(p[0] for p in pages)
    keeper = {}
    for i, _, html, *_ in pages:
        keeper[html or ""] = max(i, keeper.get(html or "", -1))
    for i, _, html, *_ in pages:
        body, r = (html or "").encode(), got[i]
        assert r["payload_bytes"] == len(body)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        if keeper[html or ""] == i:
            assert (r["record_type"], r["refers_to_id"], bytes(r["payload"])) == ("response", None, body)
        else:
            assert (r["record_type"], int(r["refers_to_id"]), r["payload"]) == ("revisit", keeper[html or ""], None)


def test_small_payloads_are_responses_and_repeated_rows_stay(spark, table):
    pages = [(1, "u", "abc", "", 0), (2, "u", "abc", "", 0), (2, "u", "abc", "", 0), (None, "u", "abc", "", 0)]
    for least, kinds in ((4, ["response"] * 4), (0, ["response", "response", "revisit", "revisit"])):
        folder = warc.archive_folder(spark)
        warc.write_archive(table(pages, SCHEMA), folder, least=least)
        assert sorted(r["record_type"] for r in warc.read_archive(spark, folder).collect()) == kinds


def test_empty_table(spark, table):
    folder = warc.archive_folder(spark)
    warc.write_archive(table([], SCHEMA), folder)
    assert warc.read_archive(spark, folder).collect() == []


@pytest.mark.parametrize("step", [1, 7, 64, 1000])
def test_ranges_share_out_the_records(step):
    rng = random.Random(3)
    made, places, data = [], [], b"junk " + warc.MAGIC + b" junk"
    for i in range(40):
        raw = warc.record("response", str(i), "u", rng.randbytes(rng.randrange(400)) + warc.MAGIC, None)
        places.append(len(data))
        data += raw + (warc.EMPTY_MEMBER if i % 3 else b"") + (warc.MAGIC if i % 7 == 0 else b"")
        made.append(gzip.decompress(raw))
    data += gzip.compress(b"not a record")
    found = []
    for start in range(0, len(data), step):
        found += warc.records_in(warc._File(io.BytesIO(data), len(data)), start, min(start + step, len(data)))
    assert found == list(zip(places, made))


def test_a_changed_payload_is_noticed():
    raw = gzip.decompress(warc.record("response", "1", "u", b"payload", None))
    assert warc.parse(raw)[-1] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))
