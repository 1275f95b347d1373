from __future__ import annotations

from pyspark.sql import functions as F

from provenir.functions import text as tx
from provenir.operators import pages as pg
from provenir.params import PLACEHOLDER_LINE

PAGE = """<html><head><title>Tab &amp; title</title><script>var t="</p>";</script></head><body>
<nav><a href="/home">Home</a></nav><h1>Visa <b>info</b></h1>
<a href="detail">Check  if <i>you</i> need</a><a href="  ">blank</a><a href="mailto:x@y">m</a><a href="#top">t</a>
<h2></h2><a href='/visa/?utm_source=a&amp;b=1#x'>Empty heading</a><h3>Fees</h3>
<a href="https://cheap.example/apply">Partner</a><a href="http://bad host/x">bad</a><a href="detail#again">again</a>
<p>First line<br>second<footer>gone</footer><form>gone<p>too</form>
</body>"""


def test_links(table):
    df = table([(1, "https://Gov.example/visa/index.html", PAGE)], "page_id int, url string, html string")
    got = [(r["url"], r["text"], r["heading"]) for r in pg.extract_links(df).orderBy("pos").collect()]
    assert got == [
        ("https://gov.example/home", "Home", ""),
        ("https://gov.example/visa/detail", "Check if you need", "Visa info"),
        ("https://gov.example/visa?b=1", "Empty heading", ""),
        ("https://cheap.example/apply", "Partner", "Fees"),
    ]
    assert pg.extract_links(df, 2).count() == 2


def test_hidden_character_in_a_link(table):
    html = '<a href="https://tdac.gov.th​/x">a</a>'
    df = table([(1, "https://gov.th/", html)], "page_id int, url string, html string")
    assert pg.extract_links(df).first()["url"] == "https://tdac.gov.th/x"


def test_title_and_text(table):
    pages = [PAGE, "<h1> </h1><h1>x</h1><title>T</title>", "<p>no title"]
    df = table(list(enumerate(pages)), "i int, html string")
    got = df.select("i", pg.page_title(F.col("html")).alias("t"), pg.readable_text(F.col("html")).alias("x")).orderBy("i").collect()
    assert [r["t"] for r in got] == ["Visa info", "T", ""]
    text = got[0]["x"]
    assert "First line\nsecond" in text and "gone" not in text and "Home" not in text and "var t" not in text


def test_forward_target(table):
    cases = [
        ('<meta http-equiv="Refresh" content="0; URL=\'/files/a.pdf\'">', "https://g.example/files/a.pdf"),
        ("<meta http-equiv=refresh content=\"5;url=next\">", "https://g.example/visa/next"),
        ('<meta charset="utf-8"><meta name="refresh" content="0;url=/x">', None),
        ('<meta http-equiv="refresh" content="30">', None),
    ]
    df = table([(i, h) for i, (h, _) in enumerate(cases)], "i int, html string")
    got = df.select("i", pg.forward_target(F.col("html"), F.lit("https://g.example/visa/p")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == [t for _, t in cases]


def test_content_types(table):
    df = table([("application/JSON; x", "https://a/b"), ("text/html", "https://a/b.PDF"), ("application/pdf", "https://a/b")], "c string, u string")
    got = [(r[0], r[1]) for r in df.select(pg.is_machine_readable(F.col("c")), pg.is_pdf_response(F.col("c"), F.col("u"))).collect()]
    assert got == [(True, False), (False, True), (False, True)]


def test_placeholder_lines_of_any_length(table):
    lines = ["a.b", "a--", "a-.b", "a._b", "a.b.", "aB", "aBc0D", "a", "A.b", "a.é", "a-b-.c", "a0_b.c-d", "aB.c"]
    df = table([(line,) for line in lines], "line string")
    marked = df.select("line", F.rlike("line", F.lit(PLACEHOLDER_LINE)).alias("want"), tx.is_placeholder_line(F.col("line")).alias("got"))
    assert [r["line"] for r in marked.collect() if r["want"] != r["got"]] == []
    # The pattern with its repeated groups overflows the stack on these.
    long = "\n".join([".".join(["wort"] * 20_000), "a" + "Wort" * 20_000] * 2)
    assert table([(long,)], "text string").select(tx.looks_untranslated(F.col("text"))).first()[0]
