from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from provenir.operators import excerpts as ex
from provenir.params import GAP_MARK


def model(text, terms, budget, head, window):
    """Character mask: head, then windows until the budget is full, then the earliest other text."""
    if budget <= 0:
        return ""
    if len(text) <= budget:
        return text
    head = min(head, budget)
    shown = [i < head for i in range(len(text))]
    half = min(window, budget - head) // 2
    longer = [t for t in terms if len(t) > 3]
    shorter = [t.upper() for t in terms if len(t) <= 3]
    for word in re.finditer(r"\w+", text):
        known = word.group().lower() in longer or word.group() in shorter
        if not known or word.start() < head:
            continue
        for i in range(max(word.start() - half, 0), min(word.end() + half, len(text))):
            shown[i] = True
        if sum(shown) >= budget:
            break
    kept = [i for i, on in enumerate(shown) if on][:budget]
    rest = [i for i in range(len(text)) if i not in set(kept)][: budget - len(kept)]
    out, previous = "", -1
    for i in sorted(kept + rest):
        out += (GAP_MARK if i > previous + 1 else "") + text[i]
        previous = i
    return out + (GAP_MARK if previous + 1 < len(text) else "")


def cut(table, text, terms, budget, head, window):
    df = table([(text,)], "t string")
    return df.select(ex.excerpt(F.col("t"), ex.mention_pattern(terms), budget, head, window)).first()[0]


def test_short_page_is_whole(table):
    assert cut(table, "Short page.", ["british"], 9000, 6000, 3000) == "Short page."


def test_mention_keeps_the_sentence_before_it(table):
    text = "Country list. " * 700 + "You do not need a visa. British citizen included. " + "Tail text. " * 400
    got = cut(table, text, ["british", "united kingdom"], 9000, 6000, 3000)
    assert "You do not need a visa. British citizen" in got and got.endswith(GAP_MARK)
    assert len(got.replace(GAP_MARK, "")) == 9000


def test_absent_term_reads_on(table):
    text = "abcdefghi " * 2000
    assert cut(table, text, ["british"], 9000, 6000, 3000) == text[:9000] + GAP_MARK


def test_many_mentions_never_exceed_the_budget(table):
    text = " ".join(f"British citizen {i}" for i in range(5000))
    got = cut(table, text, ["british"], 9000, 6000, 3000)
    assert len(got.replace(GAP_MARK, "")) == 9000


def test_short_words_match_in_upper_case_only(table):
    text = "Tell us about your trip. " * 500 + "US citizens need no visa."
    assert "US citizens need no visa." in cut(table, text, ["us", "usa", "united states"], 600, 100, 300)
    text = "Ukraine. " * 500 + "UK passport holders may enter. " + "More. " * 300
    assert "UK passport holders" in cut(table, text, ["uk", "british"], 600, 100, 300)


def test_against_the_mask_model(table):
    generator = random.Random(11)
    words = ["alpha", "beta", "british", "UK", "uk", "gamma", "é", "delta_x", "x"]
    rows = [(i, " ".join(generator.choice(words) for _ in range(generator.randrange(3, 400)))) for i in range(60)]
    df = table(rows, "i int, t string")
    for budget, head, window in [(200, 50, 60), (120, 120, 40), (300, 0, 500), (90, 30, 7)]:
        made = df.select("i", ex.excerpt(F.col("t"), ex.mention_pattern(["british", "uk"]), budget, head, window).alias("x"))
        got = {r["i"]: r["x"] for r in made.collect()}
        assert got == {i: model(t, ["british", "uk"], budget, head, window) for i, t in rows}


def test_packets(table):
    rows = table(
        [("c", 2, "s2", "", "link text", "https://x/2", None, "e2"), ("c", 1, "s1", "T", "", "https://x/1", "2024-01", "e1")],
        "k string, place int, source_id string, title string, text string, url string, published string, excerpt string",
    )
    corridors = table([("c", "T")], "k string, traveller string")
    packet = ex.candidate_packets(rows, corridors, ["k"], ["fees"]).first()["packet"]
    assert packet.index('"id":"s1"') < packet.index('"id":"s2"') and "score" not in packet and '"title":"link text"' in packet
    sources = table([("p", 1, "s", "t", "u", "a", "text")], "p string, seq int, source_id string, title string, url string, authority string, content string")
    asks = table([("p", "Land", "Japan (JP)")], "p string, destination string, traveller string")
    long_, short = (ex.research_packets(sources, asks, ["p"], n).first() for n in (10, 10_000))
    assert long_["packet"] is None and "longer than 10" in long_["rejected"] and '"content":"text"' in short["packet"]
