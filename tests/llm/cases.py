"""Small documents with nulls, empty and long texts, copies, near copies and repeated rows."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0D]+")


def sentence(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(words))


def changed(rng: random.Random, text: str, times: int) -> str:
    words = text.split(" ")
    for _ in range(times):
        words[rng.randrange(len(words))] = "zz" + str(rng.randint(0, 99))
    return " ".join(words)


def documents(seed: int = 1, count: int = 80) -> list[tuple]:
    rng = random.Random(seed)
    bases = [sentence(rng, rng.randint(30, 90)) for _ in range(8)]
    rows = []
    for i in range(count):
        text = changed(rng, rng.choice(bases), rng.choice([0, 0, 1, 2, 5])) if i % 3 else sentence(rng, rng.randint(1, 120))
        rows.append((i, text + ("\nall rights are reserved here" if i % 4 == 0 else ""), ["en", "fr", None][i % 3], [None, "a", "b", "a", "a"][i % 5], len(text)))
    rows += [(count, None, None, "b", None), (count + 1, "", "en", "a", 0), (count + 2, " \t\n ", "en", "a", 4), (count + 3, "one two", "en", "b", 7), (count + 4, "One TWO", "en", "b", 7)]
    rows += [(None, bases[0], "en", "a", 5), (None, bases[0], "en", "a", 5), rows[7], rows[7]]
    rows.append((count + 5, " ".join([bases[1]] * 300), "en", "a", 9))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
