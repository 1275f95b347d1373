from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenir.llm import transcripts
from provenir.llm.transcripts import ROLES, START, STATES, SYMBOLS, as_logs, best_paths, decode, format_turns, learn, lines_of, model_of

TURNS = "conv_id long, turn long, role string, text string, segment int, lines string"


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    return model_of(rng.integers(0, 9, (STATES, STATES)), rng.integers(0, 9, (STATES, SYMBOLS)))


def plain_score(model, enter, states, symbols):
    total = 0.0
    for a, b, s in zip([enter, *states], states, symbols):
        total += model.step[a, b] + model.shows[b, s]
    return total


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_is_the_best_of_all_paths(model, seed):
    symbols = random.Random(seed).choices(range(SYMBOLS), k=5)
    paths = list(itertools.product(range(START), repeat=5))
    best = max(plain_score(model, START, p, symbols) for p in paths)
    assert plain_score(model, START, decode(model, symbols, START), symbols) == pytest.approx(best)
    whole = best_paths(model, symbols)
    assert whole[START].max() == pytest.approx(best)
    cut = (best_paths(model, symbols[:2])[:, :, None] + best_paths(model, symbols[2:])[None]).max(axis=1)
    assert np.allclose(np.exp(cut), np.exp(whole))
    leave = int(whole[START].argmax())
    assert decode(model, symbols, START, leave)[-1] == leave


def test_lines_and_markers():
    kinds = {"User: hi": (1 + 1, "hi"), "### Assistant:": (3, ""), "[system] be": (1, "be"), "**Q:** a?": (2, "a?"), "<|assistant|>ok": (3, "ok"), "A. Smith came": (0, "A. Smith came"), "Anna: well": (4, "Anna: well"), "quiet": (0, "quiet"), "user friendly": (0, "user friendly")}
    for line, (kind, body) in kinds.items():
        (symbol, rest), = lines_of(line)
        assert (symbol // 8, rest) == (kind, body)
    assert lines_of(None) == lines_of(" \n") == [] and [s & 1 for s, _ in lines_of("\na\nb\n\nc")] == [1, 0, 1]


@pytest.fixture(scope="module")
def turns(prose):
    rng = random.Random(3)
    out = []
    for conv in range(60):
        n = 400 if conv == 7 else rng.randint(1, 8)  # one conversation over several segments
        roles = (["system"] if conv % 4 == 0 else []) + ["user", "assistant"] * n
        for turn, role in enumerate(roles[:n]):
            text = prose(conv * 1000 + turn, rng.randint(3, 30))
            out.append((conv, turn, role, text + ("?" if role == "user" else ""), 1, "x"))
    return out


def test_roles_and_texts_come_back(spark, table, turns, monkeypatch):
    logs = as_logs(table(turns, TURNS))
    got = format_turns(logs, learn(logs)).collect()
    found = {(r["conv_id"], r["start_piece"], r["start_line"]): r for r in got}
    lines = lambda t: "\n".join(x.strip() for x in t.split("\n") if x.strip())
    right = 0
    for conv, turn, role, text, *_ in turns:
        r = found.get((conv, turn, 0))
        right += r is not None and r["role"] == role and r["text"] == lines(text)
    assert right > 0.97 * len(turns)
    assert all(r["rendered"] == f"<|{r['role']}|>\n{r['text']}<|end|>\n" for r in got)
    monkeypatch.setattr(transcripts, "SEGMENT", 3)
    again = format_turns(logs, learn(logs))
    key = lambda r: repr(tuple(r))
    assert sorted(again.collect(), key=key) == sorted(got, key=key)


def test_defined_results_of_odd_pieces(spark, table, turns):
    model = learn(as_logs(table(turns, TURNS)))
    odd = [(None, None, "user", "User: a", 1, ""), (None, 2, None, "Assistant: b", 1, ""), (1, None, "x", None, 1, ""), (2, 0, "user", " \n", 1, ""), (3, 1, "user", "User: same", 1, ""), (3, 1, "user", "User: same", 1, "")]
    got = sorted((r["conv_id"] or -1, r["role"], r["text"]) for r in format_turns(table(odd, TURNS), model).collect())
    assert got[:2] == [(-1, "assistant", "b"), (-1, "user", "a")]
    assert [(c, x) for c, _, text in got[2:] for x in text.split("\n")] == [(3, "same")] * 2
    assert format_turns(table([], TURNS), model).collect() == []
    assert learn(table([], TURNS)).step.shape == (STATES, STATES) and ROLES[0] == "system"


def test_no_group_grows_with_a_transcript(spark, table, turns, monkeypatch):
    model = learn(as_logs(table(turns, TURNS)))
    say = lambda i: f"{('User: ', 'Assistant: ', '')[i % 3]}words {i:03}{'?' * (i % 2)}"
    null = [(None, None, None, say(i), 1, "") for i in range(45)]
    same = [(5, 1, None, say(7), 1, "")] * 30
    apart = [(6, 1000 * i, None, say(i), 1, "") for i in range(20)]
    sizes, real = [], transcripts._in_groups

    def watched(df, keys, *rest):
        sizes.append(df.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return real(df, keys, *rest)

    monkeypatch.setattr(transcripts, "_in_groups", watched)
    monkeypatch.setattr(transcripts, "SEGMENT", 2)
    monkeypatch.setattr(transcripts, "FAN", 3, raising=False)
    got = format_turns(table(null + same + apart, TURNS), model).collect()
    assert max(sizes) <= 3
    for conv, rows in ((None, null), (5, same), (6, apart)):
        found = [x for r in sorted(rows, key=lambda r: (r[1] or 0, [x for _, x in lines_of(r[3])])) for x in lines_of(r[3])]
        want, states = [], decode(model, [s for s, _ in found], START)
        for state, (_, line) in zip(states, found):
            if state % 2 == 0:
                want.append((ROLES[state // 2], []))
            want[-1][1].append(line)
        assert sorted((r["role"], r["text"]) for r in got if r["conv_id"] == conv) == sorted((r, "\n".join(x)) for r, x in want)


def test_repeated_turns_do_not_multiply(spark, table, turns):
    logs = table([(1, 1, "user", "User: hello there", 1, ""), (1, 2, "assistant", "Assistant: well\nyes", 1, "")], TURNS)
    many = logs.crossJoin(spark.range(50_000)).select(logs.columns)
    once, often = learn(logs), learn(many)
    # What follows what is counted once; a repeated turn's own lines are counted as often as they stand there.
    user, assistant = 2 * ROLES.index("user"), 2 * ROLES.index("assistant")
    assert np.isclose(often.step[START, user], once.step[START, user])
    assert np.isclose(often.step[user, assistant], once.step[user, assistant])
    assert often.step[assistant, assistant + 1] > once.step[assistant, assistant + 1]
