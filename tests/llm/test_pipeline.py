from __future__ import annotations

import re
from collections import Counter

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from provenir.llm.packing import WordIds
from provenir.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def world(spark, table, prose, tmp_path_factory):
    """Documents of every kind a stage must handle, and the folder of the tables they go with."""
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, prose(i, 60 + i % 40), "en") for i in range(160)]
    junk = [(500 + i, prose(i, 50).upper().replace(" ", "!! "), "en") for i in range(8)]
    copies = [(300 + i, docs[i][1].replace(" ", "  ", 1), "en") for i in range(10)] + [(None, docs[20][1], "en"), docs[30], docs[30]]
    item = prose(900, 40)
    leaks = [(700 + i, f"{prose(910 + i, 40)} {item} {prose(930 + i, 40)}", "en") for i in range(5)]
    odd = [(800, None, "en"), (801, "", None), (802, "12 34 !? 5", "en"), (803, prose(803, 3000), None), (None, prose(804, 70), "en")]
    labels = [(i, 1, 0) for i in range(0, 120)] + [(500 + i, 0, 0) for i in range(8)] + [(None, 1, 0)]
    table(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    table([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = [(d, t, lang, "src", len(t or "")) for d, t, lang in docs + junk + copies + leaks + odd]
    table(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    return folder, rows, item


def run(spark, stage, rows, table, folder):
    out = dict(corpus_pipeline.STAGES)[stage](spark, table(rows, DOCS), folder)
    if stage != "packing":
        assert out.columns == [f.split()[0] for f in DOCS.split(", ")]
    return [tuple(r) for r in out.collect()]


def test_order_of_the_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_copies", "benchmark", "packing"]
    assert contract.queries()["pipeline"] is corpus_pipeline.run


def test_quality(spark, table, world):
    folder, rows, _ = world
    kept = run(spark, "quality", rows, table, folder)
    ids = Counter(r[0] for r in kept)
    assert not any(500 <= (d or 0) < 600 for d in ids) and not {800, 801} & set(ids)
    good = [r for r in rows if r[1] and (r[0] is None or r[0] < 500 or 700 <= r[0] < 800)]
    assert len([r for r in good if r in kept]) > 0.95 * len(good)
    assert all(r in rows for r in kept)


def test_language(spark, table, world):
    folder, rows, _ = world
    kept = run(spark, "language", rows, table, folder)
    wordy = [r for r in rows if re.search("[a-zA-Z]", r[1] or "")]
    assert sorted(kept, key=repr) == sorted(wordy, key=repr)


def test_one_of_each_group_of_near_copies_stays(spark, table, world):
    folder, rows, _ = world
    kept = run(spark, "near_copies", rows, table, folder)

    def grams(text):
        own = (text or "").lower().split()
        return {tuple(own[i : i + 5]) for i in range(len(own) - 4)} or {tuple(own)} - {()}

    groups: list[list[tuple]] = []
    for r in rows:
        g = grams(r[1])
        hit = [x for x in groups if any(g and len(g & grams(o[1])) >= 0.8 * len(g | grams(o[1])) for o in x)]
        groups = [x for x in groups if x not in hit] + [[r, *(o for x in hit for o in x)]]
    assert len(kept) == len(groups)
    for group in groups:
        named = [r[0] for r in group if r[0] is not None]
        stays = [r for r in kept if r in group]
        assert len(stays) == 1 and stays[0][0] == min(named, default=None)


def test_benchmark(spark, table, world):
    folder, rows, item = world
    kept = run(spark, "benchmark", rows, table, folder)
    assert sorted(kept, key=repr) == sorted((r for r in rows if item not in (r[1] or "")), key=repr)


def test_packing_and_the_whole_run(spark, table, world):
    folder, rows, _ = world
    words = WordIds(tokenizer_path())
    out = corpus_pipeline.run(spark, folder).collect()
    tokens = Counter()
    for r in out:
        tokens[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert all(n == total for (_, total), n in tokens.items())
    sizes = {(d, len(words.ids([(t or "").encode()])[0]) + 1) for d, t, *_ in rows}
    assert set(tokens) <= sizes
    left = {d for d, _ in tokens}
    assert not left & {*range(300, 310), *range(500, 508), *range(700, 705), 800, 801, 802}
    assert len(left & set(range(160))) > 150 and 803 in left


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_documents(spark, table, world, stage):
    assert run(spark, stage, [], table, world[0]) == []


NAMES = "n nats middle limit of rows kept score lang_pred perplexity threshold name component_id n_shingles _key key id node gram item a b label".split()


@pytest.mark.parametrize("stage", ["quality", "language", "near_copies", "benchmark"])
def test_columns_of_any_name_go_through(spark, table, world, stage):
    folder, rows, _ = world
    plain = run(spark, stage, rows, table, folder)
    wide = table([(*r, *[f"{c}{i}" for c in NAMES]) for i, r in enumerate(rows)], f"{DOCS}, " + ", ".join(f"{c} string" for c in NAMES))
    out = dict(corpus_pipeline.STAGES)[stage](spark, wide, folder)
    assert out.columns == wide.columns
    found = [tuple(r) for r in out.collect()]
    assert Counter(r[:5] for r in found) == Counter(plain)
    for r in found:
        place = {v[len(c) :] for c, v in zip(NAMES, r[5:])}
        assert len(place) == 1 and rows[int(place.pop())] == r[:5]
