"""A small table with what operators must stand: nulls, blanks, repeats, long texts, clashing names."""

import random

WORDS = [a + b for a in ("ba", "ko", "mi", "ru", "te", "sol", "vin") for b in ("la", "n", "ra", "sto", "x", "qu")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows() -> list[tuple]:
    base, shared = prose(1, 120), prose(2, 60)
    edited = base.split()
    edited[50] = "edited"
    texts = [
        base,
        base,
        " ".join(edited),
        prose(3, 80) + "\n" + shared + "\n" + prose(4, 70),
        shared + " " + prose(5, 90),
        prose(6, 4000) + " " + base + " " + prose(7, 3000),
        None,
        "",
        " \n\t ",
        "one two",
        "one  two",
        prose(8, 34),
        "añb " * 60,
        "Released under the MIT License.\n" + prose(9, 40),
        "mail ann.lee@mail.example.com or (555) 201-3344, card 4539578763621486, from 10.0.0.1 on 2021-03-04",
    ]
    out = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[0], (None, base, None, None, None), (None, None, None, None, None)]


def documents(spark, extra: bool = False):
    df = spark.createDataFrame(rows(), SCHEMA)
    if extra:  # names that operators use inside or return
        for name in ("score", "kept", "node", "size", "_row", "mz", "n_words", "_text_hash", "words", "_key", "item_id"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
