"""Small document tables with the awkward cases, and brute-force links."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, lines string, score string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]) + str(rng.randrange(60)) for _ in range(n))


def table(spark, texts: list[tuple]):
    """(doc_id, text[, lang, source]) rows with extra columns whose names the operators use themselves."""
    rows = [(t[0], t[1], t[2] if len(t) > 2 else "en", t[3] if len(t) > 3 else "s", len(t[1]) if t[1] is not None else None, 1, "x", "y", "z") for t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def awkward() -> list[tuple]:
    """Nulls, empty texts, white space alone, repeated rows and ids, one very long text, other scripts."""
    long = prose(1, 20_000)
    return [
        (0, None), (1, ""), (2, " \n\t "), (3, "Hello"), (4, long), (5, long), (6, prose(2, 40), None, None), (6, prose(2, 40), None, None),
        (7, "日本語 テキスト。\nÑandú ß 😀"), (8, "1234 !!! ..."), (9, prose(3, 30) + "\n" + prose(4, 30)), (9, prose(5, 10)), (None, prose(6, 12)), (10, "a  b　c\n\n d "),
    ]
