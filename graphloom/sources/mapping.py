"""Relational tables as triples, with a small schema over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import vocab as V

#: (sub, sup) between properties and between classes; (property, class) of domains and ranges.
PROPERTIES = (
    ("<v/placedBy>", "<v/related>"),
    ("<v/containsPart>", "<v/related>"),
    ("<v/shippedFrom>", "<v/related>"),
    ("<v/related>", "<v/linked>"),
    ("<v/inNation>", "<v/located>"),
    ("<v/located>", "<v/linked>"),
)
CLASSES = (
    ("<c/Part>", "<c/Product>"),
    ("<c/Product>", "<c/Thing>"),
    ("<c/Customer>", "<c/Agent>"),
    ("<c/Agent>", "<c/Thing>"),
)
DOMAINS = (("<v/placedBy>", "<c/Order>"), ("<v/containsPart>", "<c/Order>"))
RANGES = (("<v/placedBy>", "<c/Customer>"), ("<v/containsPart>", "<c/Part>"), ("<v/status>", "<c/Code>"))


def _iri(prefix: str, key: str):
    return F.concat(F.lit(f"<{prefix}/"), F.col(key).cast("string"), F.lit(">"))


def _rows(df: DataFrame, subject, *pairs) -> DataFrame:
    """One triple for each (predicate, object) of each row, in one scan."""
    return df.select(subject.alias("s"), F.inline(F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in pairs]))).dropna()


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, their lines, customers, suppliers and nations as plain triples; repeated ones are kept."""
    read = lambda name: _read(spark, sf_dir, name)
    status = F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('"'))
    parts = [
        _rows(read("orders"), _iri("order", "o_orderkey"), ("<v/placedBy>", _iri("cust", "o_custkey")), ("<v/status>", status)),
        _rows(read("lineitem"), _iri("order", "l_orderkey"), ("<v/containsPart>", _iri("part", "l_partkey")), ("<v/shippedFrom>", _iri("supp", "l_suppkey"))),
        _rows(read("customer"), _iri("cust", "c_custkey"), ("<v/inNation>", _iri("nation", "c_nationkey"))),
        _rows(read("supplier"), _iri("supp", "s_suppkey"), ("<v/inNation>", _iri("nation", "s_nationkey"))),
        _rows(read("nation"), _iri("nation", "n_nationkey"), ("<v/inRegion>", _iri("region", "n_regionkey"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def type_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by segment and parts by type."""
    cust = _rows(_read(spark, sf_dir, "customer"), _iri("cust", "c_custkey"), (V.TYPE, _iri("seg", "c_mktsegment")))
    return cust.unionByName(_rows(_read(spark, sf_dir, "part"), _iri("part", "p_partkey"), (V.TYPE, _iri("ptype", "p_type"))))


def edges(spark: SparkSession, pairs) -> DataFrame:
    return spark.createDataFrame(list(pairs), "sub string, sup string")


def class_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class hierarchy: the fixed edges, and a class for each part type and segment in the tables."""
    leaf = lambda name, prefix, key, sup: _read(spark, sf_dir, name).select(_iri(prefix, key).alias("sub"), F.lit(sup).alias("sup")).dropna().distinct()
    return leaf("part", "ptype", "p_type", "<c/Part>").unionByName(leaf("customer", "seg", "c_mktsegment", "<c/Customer>")).unionByName(edges(spark, CLASSES))


def as_triples(pairs: DataFrame, predicate: str) -> DataFrame:
    return pairs.select(F.col("sub").alias("s"), F.lit(predicate).alias("p"), F.col("sup").alias("o"))


def schema_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = as_triples(class_edges(spark, sf_dir), V.SUB_CLASS)
    for pairs, p in ((PROPERTIES, V.SUB_PROPERTY), (DOMAINS, V.DOMAIN), (RANGES, V.RANGE)):
        out = out.unionByName(as_triples(edges(spark, pairs), p))
    return out


def all_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_triples(spark, sf_dir).unionByName(type_triples(spark, sf_dir)).unionByName(schema_triples(spark, sf_dir))
