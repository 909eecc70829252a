"""Small awkward tables for the text operators."""

import random

import pyspark.sql.types as T

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Columns whose names operators use inside.
CLASHES = "key string, w int, g int, s int, rank int, place int, task int, fp int, starts int, b int, kind string, size int, ord int"


def documents(spark, texts, clashes=True):
    """texts: (doc_id, text) pairs or longer rows."""
    rows = [(*row, *["en", "a", 0][len(row) - 2 :]) for row in texts]
    df = spark.createDataFrame(rows, SCHEMA)
    if clashes:
        for column in CLASHES.split(", "):
            name, kind = column.split()
            df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], T._parse_datatype_string(SCHEMA))


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(seed=1):
    """Nulls, empty and very long texts, ties, repeated rows, equal texts and equal ids."""
    rng = random.Random(seed)
    long = words(rng, 30_000, 5_000)
    base = words(rng, 300)
    edited = base.split()
    edited[150] = "changed"
    return [
        (1, base), (2, " ".join(edited)), (3, base), (3, base), (4, None), (5, ""), (6, "   \n\t "), (7, long),
        (None, base), (None, None), (8, "one"), (9, "one"), (9, "two words"), (10, "\x00éÉ \U0001f600 ▁x"), (11, base[: len(base) // 2] + "\n" + words(rng, 80)),
    ]
