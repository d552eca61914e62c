"""Small tables shared by the operators' tests."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra: str = ""):
    """Documents from (doc_id, text[, source]) with the other columns null."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else None, None) for r in rows]
    df = spark.createDataFrame(full, DOCUMENTS)
    for name in extra.split():
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("own"))
    return df


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def by_id(df, key: str = "doc_id") -> dict:
    return {r[key]: r.asDict() for r in df.collect()}
