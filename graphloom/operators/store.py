"""The triple table: distinct, routing by predicate, scans, anti-joins, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import vocab as V


def triples(df: DataFrame) -> DataFrame:
    """Just (s, p, o)."""
    return df.select("s", "p", "o")


def insert(store: DataFrame, new: DataFrame) -> DataFrame:
    """store and the triples of ``new`` that it lacks."""
    return store.unionByName(triples(new).distinct().join(triples(store), ["s", "p", "o"], "left_anti"))


def route(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plain, types, schema) by predicate."""
    schema = F.col("p").isin(*V.SCHEMA)
    return df.filter(~schema & (F.col("p") != V.TYPE)), df.filter(F.col("p") == V.TYPE), df.filter(schema)


def part(p="p"):
    """The route of a triple as a column: plain, type or schema."""
    p = F.col(p)
    return F.when(p.isin(*V.SCHEMA), "schema").when(p == V.TYPE, "type").otherwise("plain")


def edges(df: DataFrame, predicate: str) -> DataFrame:
    """(sub, sup) of one schema predicate."""
    return df.filter(F.col("p") == predicate).select(F.col("s").alias("sub"), F.col("o").alias("sup"))


def entailed(df: DataFrame) -> DataFrame:
    return df.filter("entailed")


def membership_properties(df: DataFrame) -> DataFrame:
    """Predicates rdf:_x that are used, as one column p."""
    used = F.col("p").startswith(V.MEMBERSHIP) & (F.length("p") > len(V.MEMBERSHIP) + 1)
    return df.filter(used).select("p").distinct()


def new_only(derived: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct derived triples that are not known yet."""
    return triples(derived).distinct().join(triples(known), ["s", "p", "o"], "left_anti")


def semi(df: DataFrame, keys: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose column occurs among the keys."""
    return df.join(keys.select(F.col(key).alias(column)).distinct(), column, "left_semi")
