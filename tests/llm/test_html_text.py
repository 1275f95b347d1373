from __future__ import annotations

import numpy as np
import pytest

from provenir.llm.html_text import extract, main_text, smooth

LONG = "This is a sentence of the article with enough words to be told from a menu."
CASES = {
    None: "",
    "": "",
    "just text": "just text",
    "<p>": "",
    f"<body><nav><a>Home</a> <a>News</a></nav><article><h1>T</h1><p>{LONG}<p>Short.</article><footer>f</footer>": f"T\n{LONG}\nShort.",
    f"<article><p><b>{LONG}<br><p>Next\n  line &amp; &eacute;&#33;</article>": f"{LONG}\nNext line & é!",
    f"<div class='sidebar'><p>{LONG}</p></div><main><p>{LONG[:30]}</main>": LONG[:30],
    f"<header><h2>Site</h2></header><div id='site-menu'><a>A</a></div><div class=post><p>{LONG}<pre>a\n b</pre><table><tr><td>c<td>d</table></div>"
    f"<div class='comments'><p>{LONG} {LONG}</div>": f"{LONG}\na b\nc\nd",
    f"<article><p>{LONG}<script>var t='</p>'; x<y</script><style>p{{}}</style><form><p>{LONG}</form><p>{LONG}</article>": f"{LONG}\n{LONG}",
    f"<div><a>One</a> <a>Two</a></div><div><p>{LONG}</p><p>See <a>this</a> now.</p></div>": f"{LONG}\nSee this now.",
    "<nav>only</nav><footer>menus</footer>": "",
    f"<html><body><ul><li>{LONG}<li>b</ul></body>": f"{LONG}\nb",
    f"<article><p>{LONG}</b></i><p>x</article></div></div>": f"{LONG}\nx",
}


@pytest.mark.parametrize("html,text", CASES.items())
def test_main_text(html, text):
    assert main_text(html) == text


def test_deep_and_long_pages():
    assert main_text("<div>" * 3000 + LONG + "</div>" * 3000) == LONG
    assert main_text("<article>" + f"<p>{LONG}</p>" * 3000 + "</article>").count("\n") == 2999


def test_smoothing_keeps_a_constant_and_spreads_a_peak():
    assert np.allclose(smooth(np.ones(7)), 1)
    peak = smooth(np.array([0, 0, 0, 1.0, 0, 0, 0]))
    assert peak.argmax() == 3 and np.allclose(peak, peak[::-1]) and len(smooth(np.ones(1))) == 1


def test_rows_keep_their_other_columns(spark, table, rows):
    data = [(i, h, "old", 3) for i, h in enumerate(CASES)] + [(0, None, "old", 3), (None, "a", None, None)]
    got = extract(table(data, "page_id long, html string, text string, tags int"))
    want = [(i, CASES.get(h, h), n) for i, h, _, n in data]
    assert rows(got, "page_id", "text", "tags") == sorted(want, key=repr)
    assert extract(table([], "page_id long, html string, text string, tags int")).collect() == []


@pytest.mark.parametrize("tag", ["div", "section"])
def test_sibling_blocks_and_headings_outside_articles_stay(tag):
    many, few = f"<p>{LONG}</p>" * 6, f"<p>{LONG} Last.</p>"
    html = f"<body><div class=content><{tag}>{many}</{tag}><{tag}>{few}</{tag}></div><footer>f</footer></body>"
    assert main_text(html) == "\n".join([LONG] * 6 + [f"{LONG} Last."])
    assert main_text(f"<body><h1>Title</h1><{tag}>{many}</{tag}></body>") == "\n".join(["Title"] + [LONG] * 6)


def test_all_articles_stay():
    assert main_text(f"<body><article>{f'<p>{LONG}</p>' * 6}</article><article><p>{LONG} Last.</article></body>").endswith("Last.")


@pytest.mark.parametrize(
    "opening",
    ["<div class='content has-sidebar'>", "<div class=legal-guide>", "<div class='post comments-open'>", "<main><div class='post no-banner'>", "<div class=banner>", "<div id=sidebar-page>"],
)
def test_names_do_not_lose_an_article(opening):
    html = f"<body><nav><a>Home</a></nav>{opening}<h1>Title</h1>{f'<p>{LONG}</p>' * 4}</div></main><div class=comment-list><p>{LONG} reader</p></div></body>"
    assert main_text(html) == "\n".join(["Title"] + [LONG] * 4)


def test_headers_links_and_comments_of_an_article():
    assert main_text(f"<header><h2>Site</h2></header><article><header><h1>Title</h1></header><p>{LONG}</article>") == f"Title\n{LONG}"
    linked = f"<p><a href=x>{LONG}</a></p>"
    assert main_text(f"<div><p>{LONG}</p>{linked}<p>{LONG}</p></div><div><a>One</a></div>") == "\n".join([LONG] * 3)
    comments = f"<section class=comments><article class=comment><p>{LONG} reader</article></section>"
    assert main_text(f"<article><h1>T</h1><p>{LONG}</article>{comments}") == f"T\n{LONG}"


def test_unclosed_and_whole_page_containers():
    assert main_text(f"<body><nav><a>Home</a><div><h1>T</h1><p>{LONG}<p>{LONG}</div></body>") == f"T\n{LONG}\n{LONG}"
    assert main_text(f"<body><form id=page><h1>T</h1><p>{LONG}</p><p>{LONG}</p></form></body>") == f"T\n{LONG}\n{LONG}"
    assert main_text(f"<article><p>{LONG}</p><form><p>{LONG}</p></form></article>") == LONG


@pytest.mark.parametrize("broken", ["<![foo[x]]>", "<![*b", "<!x", "<![CDATA[y]]>", "<?php", "<!", "</", "<!--", "<!DOCTYPE", "&#xZZ;", "<a b='"])
def test_malformed_declarations_do_not_stop_a_page(broken):
    assert main_text(f"<article><p>{LONG}</p>{broken}</article>").startswith(LONG)
    main_text(f"{broken}<article><p>{LONG}</p></article>")
    assert main_text(f"<article>{broken}<p>{LONG}</p></article>") is not None


def test_depth_costs_nothing():
    import time

    start = time.process_time()
    html = "".join(f"<div>line {i} of an unclosed tree" for i in range(20_000))
    assert main_text(html).count("\n") > 15_000
    assert main_text("<b>" * 20_000 + "</i>" * 20_000 + LONG) == LONG
    assert time.process_time() - start < 5


def plain_smooth(ratio, sigma):
    out = []
    for i in range(len(ratio)):
        weights = [(np.exp(-0.5 * ((i - j) / sigma) ** 2), ratio[j]) for j in range(len(ratio)) if abs(i - j) <= round(3 * sigma)]
        out.append(sum(w * r for w, r in weights) / sum(w for w, _ in weights))
    return out


def test_smoothing_and_threshold_are_those_of_a_plain_model():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40):
        ratio = rng.random(n) * 50
        assert np.allclose(smooth(ratio), plain_smooth(ratio, 1.5))
    # Lines of very different ratios: the clusters of the plain model decide which container is the region.
    blocks = [[int(x) for x in rng.integers(1, 12, 6)] for _ in range(5)]
    words = [[" ".join(["word"] * n) for n in b] for b in blocks]
    html = "<body>" + "".join("<div>" + "".join(f"<p>{t}</p>" for t in b) + "</div>" for b in words) + "</body>"
    flat = [t for b in words for t in b]
    tags = [3 if k == 0 else 4 if k % 6 == 0 else 2 for k in range(len(flat))]
    ratio = plain_smooth(np.array([len(t) for t in flat]) / np.array(tags), 1.5)
    chosen = [k // 6 for k, r in enumerate(ratio) if r >= 0.5 * np.mean(ratio)]
    want = flat if len(set(chosen)) > 1 else words[chosen[0]]
    assert main_text(html) == "\n".join(want)
