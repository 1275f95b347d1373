from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from provenir.llm import language

ENDINGS = {"xa": "aria elno inda osta", "xe": "ung heit schrift ich", "xo": "tion ment eau oire"}


def text_of(lang, seed, n=60):
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice("bdkmprst") + "".join(rng.choices(ENDINGS[lang].split(), k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    out = [(i, text_of(lang, i), lang, "x") for i, lang in enumerate(list(ENDINGS) * 60)]
    return out + [(900, None, "xa", "x"), (901, "", None, "x"), (902, "12 3 !?", "xe", "x"), (None, text_of("xa", 1), "xa", "x"), out[4], (903, text_of("xe", 3, 9000), None, "x")]


def test_held_out_documents_are_told_apart(spark, table, docs):
    frame = table(docs, "doc_id long, text string, lang string, score string")
    got = language.identify(frame, language.learn(frame)).withColumn("held", language.held_out("doc_id")).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["held"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if r["doc_id"] in (900, 901, 902):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert 0 <= r["score"] <= 1 and r["lang_pred"] in ENDINGS
    named = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900]
    assert np.mean([r["lang_pred"] == r["lang"] for r in named if r["held"]]) > 0.98
    assert next(r for r in got if r["doc_id"] == 903)["lang_pred"] == "xe"


def test_held_out_languages_do_not_teach(spark, table, docs):
    rows = [(i, t, None if i is not None and zlib.crc32(str(i).encode()) % 3 != 1 else x) for i, t, x, _ in docs]
    rows = [r for r in rows if r[0] is not None]
    model = language.learn(table(rows, "doc_id long, text string, lang string"))
    assert model.languages == [] and language.predict(model, ["abc"]) == [("und", 0.0)]


def test_kernel_counts_shared_n_grams():
    def grams(text):
        return {(n, text[i : i + n]) for n in language.ORDERS for i in range(len(text) - n + 1)}

    a, b = "der baum", "ein baum und"
    table = language.spectra([language.letters(a), language.letters(b)])
    got = language.kernel(table, table.T, table.sum(axis=1))
    want = len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
    assert abs(got[0, 1] - want) < 0.05 and np.allclose(np.diag(got), 1)


def test_letters_of_a_text():
    text = "A1b  C\n\U0001f600é"
    assert "".join(map(chr, language.letters(text))) == "a b c é"


def test_empty_table(spark, table):
    frame = table([], "doc_id long, text string, lang string")
    assert language.identify(frame, language.learn(frame)).collect() == []


def test_every_language_teaches(spark, table):
    """Seventy languages of their own syllables: all can be predicted."""
    rng = random.Random(7)
    stems = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(70 * 5)]
    rows = []
    for lang in range(70):
        own = stems[5 * lang : 5 * lang + 5]
        for i in range(9):
            rows.append((1_000 * lang + i, " ".join("".join(rng.choices(own, k=2)) for _ in range(40)), f"l{lang:02}"))
    frame = table(rows, "doc_id long, text string, lang string")
    model = language.learn(frame)
    assert len(model.languages) == 70 and len(model.sizes) <= language.ALL_LANDMARKS
    got = language.identify(frame, model).filter(language.held_out("doc_id")).collect()
    assert len(got) > 100 and sum(r["lang_pred"] == r["lang"] for r in got) > 0.97 * len(got)


def test_any_part_of_a_text_teaches(spark, table):
    junk = "1234 !? " * 2_000
    rows = [(i, junk + text_of(lang, i) + junk, lang) for i, lang in enumerate(list(ENDINGS) * 12)]
    model = language.learn(table(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted(ENDINGS)
    assert [language.predict(model, [text_of(lang, 99)])[0][0] for lang in ENDINGS] == list(ENDINGS)


def test_ridge_is_that_of_plain_normal_equations():
    texts = [text_of(lang, i, 8) for i in range(12) for lang in ENDINGS]
    names = list(ENDINGS) * 12
    model = language.fit(texts, names, landmarks=100)
    table = language.spectra([language.letters(t) for t in texts]).astype(np.float64)
    size = np.sqrt(table.sum(axis=1))
    gram = (table @ table.T) / size[:, None] / size[None, :]
    target = np.where(np.array(names)[:, None] == np.array(model.languages), 1.0, -1.0)
    plain = gram @ np.linalg.solve(gram + language.RIDGE * len(texts) * np.eye(len(texts)), target)
    # All texts are landmarks, so the features span the kernel.
    got = language.kernel(table.astype(np.float32), model.landmarks, model.sizes) @ model.weights
    assert np.allclose(got, plain, atol=1e-3)
