from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of every awkward kind, with columns named like operators' own."""
    r = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta", "épée", "zeta", "eta", "theta's", "x1", "the", "of", "and", "a", "licence"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = say(120)
    rows = [
        (1, base), (2, base), (2, base), (3, base.upper()), (4, base + " end"), (None, base + " end"), (5, None), (6, ""),
        (7, " \n\t "), (8, "one"), (9, "one two"), (10, "ONE\x0btwo"), (None, None), (11, say(40_000)), (12, "!?!"),
        (13, "a\x00b c"), (14, "日本語 の 文"), (15, "<|endoftext|> x <|StartOfText|>"), (16, "𝒳   ý"),
        *[(100 + i, say(r.randint(1, 60)) + "\n" + say(r.randint(0, 9))) for i in range(40)],
        (-50, "Released under the MIT Licens\nreleased. under THE mit license, and"),
    ]
    langs = ["en", "fr", None]
    return spark.createDataFrame(
        [(i, t, langs[k % 3], "s", k, "d", k, 1.0, "k") for k, (i, t) in enumerate(rows)],
        DOCS + ", doc string, n int, score double, key string",
    ).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
