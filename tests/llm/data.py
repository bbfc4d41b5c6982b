"""Rows that every operator has to live with."""

from __future__ import annotations

import os
import random

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
HAVE_TABLES = os.path.isdir(SF)
#: Extra columns whose names operators use inside.
EXTRA = "g int, key long, n int, bucket int, words string, member int, label int, component long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
_EXTRA_VALUES = (1, 2, 3, 4, "w", 5, 6, 7)

_r = random.Random(5)
VOCABULARY = ["".join(_r.choice("abcdefghijklmnop") for _ in range(_r.randint(2, 8))) for _ in range(300)]


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(words))


def edited(text: str, seed: int, changes: int) -> str:
    r, words = random.Random(seed), text.split(" ")
    for _ in range(changes):
        words[r.randrange(len(words))] = r.choice(VOCABULARY)
    return " ".join(words)


def frame(spark: SparkSession, rows: list[tuple[int | None, str | None]], lang: str | None = "en") -> DataFrame:
    return spark.createDataFrame([(i, t, lang, "s", 0, *_EXTRA_VALUES) for i, t in rows], SCHEMA)


#: Null, empty, blank and very long texts, ties, repeated rows, odd characters and a null id.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "one two"), (6, "one two"), (None, "one two"), (None, None),
    (7, "Ünï çødé “quotes” 中文 🙂   x"), (8, "it's 'quoted' don't <|endoftext|> \x1c \x00 z"), (9, prose(1, 30_000)), (10, "x" * 50_000), (11, "A B\rC\x0bD"),
]
