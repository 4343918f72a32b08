"""Streaming triples against a closed, static schema: stateless joins, then deduplication.

Beyond the reference, which reads one file once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import vocab as V
from graphloom.operators import rules as R
from graphloom.operators import store as S


def entail_stream(triples: DataFrame, schema: DataFrame, watermark: tuple[str, str] | None = None) -> DataFrame:
    """(s, p, o) entailed under rho-df by a stream of triples; ``schema`` holds static schema triples.

    The hierarchies are closed once, so each triple needs joins with static tables
    only. Every row is entailed by itself: inherited properties, domains and ranges,
    and the classes above. With ``watermark`` (column, delay) duplicates are dropped
    within the delay; without one each is dropped for ever, which keeps all triples
    as state.
    """
    sub_property = R.rdfs5(S.edges(schema, V.SUB_PROPERTY))
    sub_class = R.rdfs11(S.edges(schema, V.SUB_CLASS))
    domain, range_ = S.edges(schema, V.DOMAIN), S.edges(schema, V.RANGE)
    # what a predicate entails, over its own and its super-properties: a static table
    everywhere = sub_property.unionByName(domain.unionByName(range_).unionByName(sub_property).select(F.col("sub"), F.col("sub").alias("sup"))).distinct()
    classes = sub_class.unionByName(sub_class.select("sub", F.col("sub").alias("sup"))).distinct()

    def lifted(edge: DataFrame) -> DataFrame:
        direct = everywhere.join(edge.withColumnsRenamed({"sub": "mid", "sup": "class"}), F.col("sup") == F.col("mid")).select("sub", "class")
        above = direct.join(classes.withColumnsRenamed({"sub": "low", "sup": "high"}), F.col("class") == F.col("low"), "left")
        return above.select("sub", F.coalesce("high", "class").alias("sup")).unionByName(direct.select("sub", F.col("class").alias("sup"))).distinct()

    plain, types, _ = S.route(triples)
    keep = [watermark[0]] if watermark else []
    if watermark:
        plain, types = plain.withWatermark(*watermark), types.withWatermark(*watermark)
    def typed(rows: DataFrame, term: str, edge: DataFrame, on: str) -> DataFrame:
        rows = rows.filter(~F.col(term).startswith('"'))
        return rows.join(edge, rows[on] == edge["sub"]).select(F.col(term).alias("s"), F.lit(V.TYPE).alias("p"), F.col("sup").alias("o"), *keep)

    inherited = plain.join(sub_property, plain["p"] == sub_property["sub"]).select("s", F.col("sup").alias("p"), "o", *keep)
    out = inherited.unionByName(typed(plain, "s", lifted(domain), "p")).unionByName(typed(plain, "o", lifted(range_), "p")).unionByName(typed(types, "s", sub_class, "o"))
    return out.dropDuplicatesWithinWatermark(["s", "p", "o"]) if watermark else out.dropDuplicates(["s", "p", "o"])
