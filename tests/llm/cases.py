"""Small documents with the awkward cases that every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, tile long, key string"


def sentence(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6))) for _ in range(words))


def documents(spark, seed: int = 1, extra: list | None = None):
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows, clashing columns."""
    rng = random.Random(seed)
    shared = sentence(rng, 40)
    texts = [sentence(rng, rng.randrange(20, 80)) for _ in range(30)]
    base = sentence(rng, 60).split(" ")
    texts += [" ".join(base)] * 4
    for i in range(3):
        near = list(base)
        near[10 + 15 * i] = "changed"
        texts.append(" ".join(near))
    texts += [f"{sentence(rng, 10)}\n{shared}\n{sentence(rng, 12)}" for _ in range(5)]
    texts += ["", "", None, " \n\t ", "one", "one two three", "é ß 漢字 \x85 x", sentence(rng, 5000), "a " * 300]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, texts[3]), (7, "another text with the id of row seven"), (None, texts[5]), (None, None)]
    rows += extra or []
    full = [(i, t, None if i == 2 else "en", None if i == 4 else f"s{(i or 0) % 3}", None, 0.5, 1, "k") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
