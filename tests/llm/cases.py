"""Documents with every odd case: nulls, empty, very long, ties, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, _did string, digest int, `_quality` double, start int"


def words(rng, n, pool=None):
    pool = pool or ["the", "of", "and", "Éa", "ing", "tion", "WORLD", "straße", "x1", "9,5"]
    return " ".join(rng.choice(pool) + rng.choice(pool) for _ in range(n))


def documents(spark, extra=True):
    rng = random.Random(11)
    passage = words(rng, 70)
    rows = [(i, words(rng, rng.randrange(1, 90))) for i in range(40)]
    rows += [(100 + i, words(rng, 5) + " " + passage + " " + words(rng, rng.randrange(9))) for i in range(12)]
    rows += [(200, None), (201, ""), (202, "   \n\t "), (203, "a"), (204, "!!! ... 123"), (205, None)]
    rows += [(210, "ab" * 3000), (211, words(rng, 9000)), (212, "日本語 текст ελληνικά <|endoftext|> 😀 \x00\x1c\x85")]
    rows += [(220, rows[3][1]), (221, rows[3][1].swapcase()), (221, rows[3][1].swapcase()), (None, rows[4][1]), (None, "lonely text"), (222, rows[4][1])]
    rows += [(230, rows[5][1]), (230, rows[6][1])]
    full = [(d, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s1", None]), None if t is None else len(t), 1, "f", "d", 2, 0.5, 3) for d, t in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def empty(spark):
    return documents(spark).where("1 = 0")
