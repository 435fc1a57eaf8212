"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

ALPHABET = ["the", "of", "and", "river", "stone", "Level", "price", "ÉTÉ", "straße", "x1", "42", "end.", "it's", "naïve"]


def words(rng, n):
    return " ".join(rng.choice(ALPHABET) + str(rng.randint(0, 400)) if rng.random() < 0.5 else rng.choice(ALPHABET) for _ in range(n))


def documents(seed=5):
    rng = random.Random(seed)
    base = words(rng, 120)
    changed = base.split()
    changed[7] = "changed"
    passage = words(rng, 60)
    rows = [
        (1, base, "en", "b"),
        (2, base, "en", "b"),
        (3, " ".join(changed), "en", None),
        (4, None, "en", "a"),
        (5, "", None, "a"),
        (6, "  \n\t ", "de", "a"),
        (7, "One two", "en", "c"),
        (8, "one TWO", "en", "c"),
        (9, words(rng, 30) + " " + passage + " " + words(rng, 25), "en", "c"),
        (10, words(rng, 12) + "\n" + passage, "fr", "c"),
        (11, words(rng, 30_000), "en", "a"),
        (12, 'key\nReleased under the MIT Licence.\ntoken = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end', "en", "a"),
        (None, words(rng, 40), "en", "a"),
        (None, None, None, None),
        (13, "Released under the MIT License!", "en", "d"),
        (13, "Released under the MIT License!", "en", "d"),
    ]
    rows += [(100 + i, words(rng, rng.randint(1, 90)), "en", rng.choice("abcd")) for i in range(40)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, rows=None, extra=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    if extra:  # columns whose names operators might use themselves
        df = df.withColumns({c: F.lit("clash") for c in ("component", "key", "size", "node", "digest", "start", "row", "_copy", "_kept", "n_tokens")})
    return df


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def split(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
