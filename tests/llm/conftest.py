from __future__ import annotations

import random

import pytest

SYLLABLES = "an er on the re ing ou th ti nd ed es st or en".split()


@pytest.fixture(scope="session")
def prose():
    """Invented prose: words of one to four syllables, sentences, lines."""

    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]
        return "".join(w + rng.choices([" ", ", ", ". ", ".\n"], [20, 2, 2, 1])[0] for w in words).strip()

    return make


@pytest.fixture(scope="session")
def rows():
    return lambda df, *columns: sorted(
        (tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr
    )
