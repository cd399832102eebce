"""Small tables with the awkward cases that every operator must take: nulls, empty, long, repeated and clashing."""

from __future__ import annotations

import random

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Extra columns whose names operators might use inside.
CLASHING = ("key", "th", "node", "n", "h", "a", "b", "_t", "_th", "root", "item", "Text_", "words", "found", "part")


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvé") for _ in range(2 + k % 9)) + ("." if rng.random() < 0.1 else "")
                    for k in (rng.randrange(vocabulary) for _ in range(n)))


def lines(seed: int, n: int, each: int = 12) -> str:
    return "\n".join(prose(seed * 1000 + k, each).capitalize() + "." for k in range(n))


def rows() -> list[tuple]:
    base = lines(1, 8)
    words = base.split(" ")
    near = " ".join(w if k != 40 else "changed" for k, w in enumerate(words))
    out = [(1, base, "en", "web"), (2, base, "en", "web"), (2, base, "en", "web"), (3, near, None, "web"),
           (4, None, "en", None), (5, "", None, "web"), (6, " \n\t\n ", "en", "web"), (7, "One two.", "en", "web"),
           (None, lines(2, 3), "en", "web"), (None, None, None, None), (8, "ab " * 3000, "en", "long"),
           (9, "x" * 70_000, "en", "long"), (10, lines(3, 400), "fr", "long"), (11, base.upper(), "en", "web"),
           (12, "\\ <|endoftext|> İK \U0001f600 é \x0b\x1c\x85 tail", "en", "odd"),
           (13, lines(4, 2) + "\n" + base.split("\n")[2], "en", "web"), (14, base.split("\n")[2].lower() + "!!", "en", None)]
    return out + [(100 + k, lines(50 + k, 3), "en", f"s{k % 3}") for k in range(12)]


def documents(spark: SparkSession):
    df = spark.createDataFrame(rows(), "doc_id bigint, text string, lang string, source string").withColumn(
        "n_chars", F.length("text").cast("bigint"))
    return df.withColumns({c: F.lit(k) for k, c in enumerate(CLASHING)}).repartition(3)


def empty(spark: SparkSession):
    return documents(spark).limit(0)
