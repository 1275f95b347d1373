from __future__ import annotations

from pyspark.sql import functions as F

from provenir.functions import hosts, text as tx, urls
from provenir.functions.keys import age_hours


def apply(table, fn, values):
    df = table([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["out"] for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def test_canonical_url(table):
    same = [
        "https://WWW.MOFA.GO.JP/visa/?utm_source=x&b=2&a=1",
        "https://www.mofa.go.jp/visa?a=1&b=2",
        "https://www.mofa.go.jp/visa/?b=2&a=1&fbclid=y",
        " https://www.mofa.go.jp:443/visa​/?UTM_Source=z&a=1&b=2#top ",
    ]
    assert set(apply(table, urls.canonical_url, same)) == {"https://www.mofa.go.jp/visa?a=1&b=2"}
    got = apply(
        table,
        urls.canonical_url,
        [
            "https://www.mofa.go.jp/visa/#section",
            "https://www.mofa.go.jp/visa?id=7",
            "http://h.com:80",
            "http://h.com//",
            "http://h.com/A/b?q=a+b&q=a%20b&e=&x=%zz&flag",
            "https://h.com/p?é=ü~*",
        ],
    )
    assert got == [
        "https://www.mofa.go.jp/visa",
        "https://www.mofa.go.jp/visa?id=7",
        "http://h.com/",
        "http://h.com",
        "http://h.com/A/b?e=&flag=&q=a+b&q=a+b&x=%25zz",
        "https://h.com/p?%C3%A9=%C3%BC~%2A",
    ]


def test_host_and_parts(table):
    given = ["https://WWW.ICA.GOV.SG/visa?a=1", "not a url", "http://u:p@h.com.:8080/x", "//h.org/x", "https://a.b"]
    assert apply(table, urls.host, given) == ["www.ica.gov.sg", "", "h.com", "h.org", "a.b"]
    assert apply(table, urls.segments, ["https://www.ica.gov.sg/enter//Visa_requirements/india?x=1"]) == [
        ["enter", "visa_requirements", "india"]
    ]
    assert apply(table, urls.policy_path, ["https://a.b", "https://a.b/x?y=1"]) == ["/", "/x?y=1"]
    assert apply(table, urls.agent_token, ["Agent/0.1 (x)", "/1", "A"]) == ["Agent", "*", "A"]
    assert apply(table, urls.searchable, ["https://A.b/c-d_e+f"]) == ["https:  a b c d e f"]


def test_published_date(table):
    given = [
        "https://x/qzxz/201303/t20130315_3383966.htm", "https://x/t20240802_11465159.htm", "https://x/202408/a",
        "https://x/100000/", "https://x/201399/", "https://x/2013",
    ]
    assert apply(table, urls.published_date, given) == ["2013-03", "2024-08-02", "2024-08", None, None, None]


def test_crawlable_shapes(table):
    given = [
        "https://x/search/results", "https://x/privacy", "https://x/en/login", "https://x/assets/logo.png",
        "https://x/style.css", "https://x/list.PDF", "https://x/researching", "ftp://x/a",
        "https://api.x/a", "https://x/client-service/a", "https://x/apiary",
    ]
    expected = [False, False, False, False, False, True, True, False, False, False, True]
    assert apply(table, urls.looks_crawlable, given) == expected


def test_resolve(table):
    base = "http://h/a/b/c?k=1"
    cases = {
        "../d": "http://h/a/d", "//o/x/./y": "http://o/x/y", "?z=1": "http://h/a/b/c?z=1", "": "http://h/a/b/c?k=1",
        "g/../../x/": "http://h/a/x/", "/für x": "http://h/f%C3%BCr%20x", "https://q/w?e#r": "https://q/w?e",
    }
    assert apply(table, lambda v: urls.resolve(F.lit(base), v), list(cases)) == list(cases.values())


def test_suffixes(table):
    given = ["gov.sg", "gov.uk", "go.jp", "gouv.fr", "co.uk", "com", "gov", "ica.gov.sg", "service.gov.uk", "usa.gov"]
    assert apply(table, hosts.is_bare_suffix, given) == [True] * 7 + [False] * 3
    given = ["www.ica.gov.sg", "uk.emb-japan.go.jp", "www.example.com", "www.gov.br", "localhost"]
    assert apply(table, hosts.registrable_domain, given) == [
        "ica.gov.sg", "emb-japan.go.jp", "example.com", "www.gov.br", "localhost",
    ]


def test_governmental_and_hints(table):
    given = ["ica.gov.sg", "mofa.go.jp", "x.gouv.fr", "y.gob.mx", "z.govt.nz", "ircc.gc.ca", "sem.admin.ch", "home.europa.eu",
             "esteri.it", "notgov.com", "gov.example.com"]
    assert apply(table, hosts.looks_governmental, given) == [True] * 8 + [False] * 3
    given = ["immi.x", "emb-japan.go.jp", "consul.x", "mofa.go.jp", "mfa.x", "foreign.x", "plain.x", "africa.x"]
    assert apply(table, hosts.kind_hint, given) == [
        "immigration_authority", "embassy_or_high_commission", "embassy_or_high_commission", "foreign_ministry",
        "foreign_ministry", "foreign_ministry", None, "immigration_authority",
    ]


def test_clean_title(table):
    given = ["Visa: Temporary Visitor Visa | Embassy of Japan", "  ", "Short | Site", "A long  title — Site - x", "x" * 95]
    got = apply(table, lambda v: tx.clean_title(v, F.lit("fallback")), given)
    assert got == ["Visa: Temporary Visitor Visa", "fallback", "Short | Site", "A long title", "x" * 90]
    assert apply(table, lambda v: tx.clean_title(v, F.lit("fallback")), [None]) == ["fallback"]


def test_text_helpers(table):
    assert apply(table, tx.tidy_step_title, [" Apply,;: ", ",;:", "ok"]) == ["Apply", ",;:", "ok"]
    assert apply(table, tx.decode_entities, ["a &amp;&#65;&#x1F600; &nope; &copy;"]) == ["a &A😀 &nope; ©"]
    assert apply(table, lambda v: tx.contains_word(v, "us"), ["business", "the US, now", "us"]) == [False, True, True]
    keys = "\n".join(["home.banner-x", "lienKet", "vanBanQuyPham", "a.b", "Real words here"])
    assert apply(table, tx.looks_untranslated, [keys, "one.two\nthree.four", keys + "\nmore words" * 5]) == [True, False, False]
    assert apply(table, tx.thin_reason, ["short", "word " * 200]) == ["too little readable text", None]


def test_age_is_null_without_a_time(spark):
    row = spark.sql("select timestamp'2024-01-02' a, timestamp'2024-01-01' b, cast(null as timestamp) c")
    got = row.select(age_hours(F.col("b"), F.col("a")), age_hours(F.col("a"), F.col("b")), age_hours(F.col("c"), F.col("a"))).first()
    assert tuple(got) == (24.0, 0.0, None)
