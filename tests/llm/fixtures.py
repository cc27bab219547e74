"""Small documents with the cases that every operator must stand: nulls, empties, ties, repeats, very long texts."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("bucket", T.StringType()),
        T.StructField("fp", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("shard", T.StringType()),
    ]
)


def texts(seed: int = 7) -> list[str | None]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]

    def prose(n: int) -> str:
        return " ".join(rng.choice(words) for _ in range(n))

    shared, page = prose(40), prose(120)
    out: list[str | None] = [None, "", " ", "\n\t ", "a", "A b", "x" * 5000, "ab " * 900, "12  34\n\n 5", "naïve  ﬁ Ⅷ", "é é É", "🎉🎉 ‍"]
    out += [page] * 6 + [page.upper(), page + " tail", page.replace(words[3], "q", 1), "\n ".join(page.split(" "))]
    out += [prose(rng.randint(1, 60)) for _ in range(30)]
    out += [prose(20) + " " + shared + " " + prose(20) for _ in range(8)]
    out += [shared + shared, prose(1500), "don't I'll we've  they'd  'S"]
    return out


def documents(spark, rows=None):
    data = [(i, t) for i, t in enumerate(texts())] if rows is None else rows
    return spark.createDataFrame([(k, t, "en", "s", 1, "b", "f", "g", "h") for k, t in data], SCHEMA)


def rows():
    """Ids out of order, a null id, repeated rows."""
    data = [(3 * i + 1, t) for i, t in enumerate(texts())]
    random.Random(3).shuffle(data)
    return data
