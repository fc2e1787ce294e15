"""A small corpus with every awkward case, and brute-force versions."""

from __future__ import annotations

import random

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, vocabulary: int = 300) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(seed: int = 7, n: int = 80) -> list[tuple]:
    rng = random.Random(seed)
    passage = words(rng, 40)
    rows = []
    for i in range(n):
        text = words(rng, rng.randint(5, 120))
        if i % 4 == 1:
            text = rows[rng.randrange(len(rows))][1]
        if i % 5 == 2:
            text = f"{text}\n{passage}\nA line that repeats in very many documents of this corpus, {i % 2}\n{words(rng, 8)}"
        rows.append((i, text, "en" if i % 3 else "xx", f"s{i % 4}"))
    rows += [
        (1000, None, "en", "s0"), (1001, "", None, None), (1002, " \n\t", "en", "s1"), (1003, "one", None, "s2"),
        (1004, "!!! ... 123", "en", "s3"), (1005, "ünï çødé ☃ two", "xx", None), (1006, words(rng, 9000), "en", "s0"),
        (1007, "a\0b c\0d", "en", "s1"),
    ]
    rows.append(rows[3])  # a repeated row
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def frame(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(documents() if rows is None else rows, DDL)
