"""Fixtures of the training-data operators: odd rows, and invented prose."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, class int, rank int, __text string"
SYLLABLES = "the and of ing tion er on en re th wh ble ly ti at or es nd st ha".split()


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    out = []
    for i in range(words):
        w = "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))
        out.append(w.capitalize() if i % 9 == 0 else w + ("." if i % 9 == 8 else ""))
    lines = [" ".join(out[i : i + 27]) for i in range(0, len(out), 27)]
    return "\n".join(lines)


def docs(spark, rows):
    """rows: (doc_id, text[, source]); other columns clash with names that operators use."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or ""), "x", 1, 2, "y") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    long = prose(7, 30_000)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four"), (6, long), (7, prose(1, 120)), (7, prose(1, 120)), (8, prose(2, 60)), (8, prose(3, 60)),
        (None, prose(4, 80)), (9, "é" * 500), (10, "a " * 300), (11, "日本語 ÀÉ <|endoftext|> İ ²"), (12, "x" * 1000),
    ]
