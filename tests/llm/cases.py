"""Small tables with the awkward rows that every operator must handle."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def prose(rng, words):
    syllables = ["an", "ber", "cio", "des", "ent", "la", "ou", "é", "ing", "th"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(words))


def rows(seed=7, n=60):
    """Nulls, empty texts, a very long text, exact and near copies, ties and repeated rows."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(n)]
    texts += ["", None, "   \n\t", "one", "two words", prose(rng, 20_000)]
    texts += [texts[3]] * 4 + [texts[5] + " tail", "x " + texts[5], texts[7].upper()]
    out = [(i, t, "en", f"src{i % 4}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    out += [(None, "no id here", None, None, None), out[2], out[2]]
    return out


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
