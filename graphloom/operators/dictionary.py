"""Terms as numbers and back; the engine itself works on the terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.cluster import written


def dictionary(df: DataFrame) -> DataFrame:
    """(term_id, term): a row for each distinct term. Ids are unique, not dense."""
    terms = df.select(F.explode(F.array("s", "p", "o")).alias("term")).dropna().distinct()
    return written(terms.withColumn("term_id", F.monotonically_increasing_id()).select("term_id", "term"))


def encode(df: DataFrame, terms: DataFrame) -> DataFrame:
    """(s, p, o) as ids."""
    out = df.select("s", "p", "o")
    for c in "spo":
        out = out.join(terms.select(F.col("term").alias(c), F.col("term_id").alias(f"{c}_id")), c).drop(c)
    return out.select(*[F.col(f"{c}_id").alias(c) for c in "spo"])


def decode(df: DataFrame, terms: DataFrame) -> DataFrame:
    """(s, p, o) as terms."""
    out = df.select("s", "p", "o")
    for c in "spo":
        out = out.join(terms.select(F.col("term_id").alias(c), F.col("term").alias(f"{c}_term")), c).drop(c)
    return out.select(*[F.col(f"{c}_term").alias(c) for c in "spo"])
