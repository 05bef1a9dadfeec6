"""Small tables with awkward rows, shared by the tests of the corpus operators."""

from __future__ import annotations

import random

#: Columns that operators use inside; as input columns they must come out untouched.
CLASHING = ("row", "id", "key", "pos", "size", "copies", "h", "q", "of", "kept", "n", "class", "place", "lines", "score", "n_lines")

SYLLABLES = ("ka", "lo", "mi", "ren", "to", "su", "vel", "an", "dri", "po", "É", "ß", "ção")


def prose(seed: int, n_words: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(n_words)]
    for at in range(9, n_words, 17):
        words[at] += ".\n" if at % 2 else "."
    return " ".join(words)


def document_rows() -> list[tuple]:
    """(doc_id, text, source): nulls, empty and long texts, repeated rows and ids, near copies, shared lines."""
    base = prose(1, 120)
    near = base.replace("ka", "KA", 1).split(" ")
    near[60] = "changed"
    passage = prose(2, 70).replace("\n", " ")
    rows = [
        (1, None, "a"),
        (2, "", "a"),
        (3, " \t\n\x0b\x0c\r \n", None),
        (4, base, "a"),
        (5, base, "b"),
        (6, " ".join(near), "b"),
        (6, " ".join(near), "b"),  # a repeated row
        (7, "same id, first text " + prose(3, 30), "c"),
        (7, "same id, second text " + prose(4, 30), "c"),
        (None, prose(5, 40), "c"),
        (8, prose(6, 30) + " " + passage + " " + prose(7, 30), "é"),
        (9, prose(8, 25) + " " + passage + " " + prose(9, 25), "Z"),
        (10, prose(10, 4000) + "\n" + passage, "a"),  # long
        (11, "x" * 5000, "b"),  # one word, repeats itself
        (12, "one two three", "b"),
        (13, "ONE two  three", "b"),
        (14, "don't   stop\n\n   we'll go 12 345 \U0001f600 ́x <|endoftext|> end ", None),
    ]
    shared = "This line is shared by several documents"
    rows += [(20 + i, prose(30 + i, 12) + f"\n  {shared.upper() if i % 2 else shared}\t\n" + prose(40 + i, 9), "ab"[i % 2]) for i in range(5)]
    sizes = [(40 + i, prose(60 + i, 5 + 7 * i), ("a", "b", "c", "d", None)[i % 5]) for i in range(25)]
    return rows + sizes


def documents(spark, rows=None, clashing: bool = False):
    rows = document_rows() if rows is None else rows
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    if clashing:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(f"{c}!").alias(c) for c in CLASHING])
    return df
