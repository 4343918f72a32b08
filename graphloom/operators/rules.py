"""The entailment rules, each a function of DataFrames to derived triples (not made distinct).

``plain`` holds triples whose predicate is neither a schema predicate nor rdf:type,
``types`` those of rdf:type; closed hierarchies are (sub, sup). Joins carry no hints:
schema tables are local relations or files whose size Catalyst knows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import vocab as V
from graphloom.functions.terms import is_literal

from .closure import transitive_closure


def _typed(term, of) -> list:
    return [term.alias("s"), F.lit(V.TYPE).alias("p"), (F.lit(of) if isinstance(of, str) else of).alias("o")]


def rdfs5(sub_property: DataFrame, **options) -> DataFrame:
    """The closed sub-property hierarchy."""
    return transitive_closure(sub_property, **options)


rdfs11 = rdfs5


def rdfs7(plain: DataFrame, sub_property: DataFrame) -> DataFrame:
    """s p o, p below q: s q o. q can be any term."""
    return plain.join(sub_property, plain["p"] == sub_property["sub"]).select("s", F.col("sup").alias("p"), "o")


def rdfs2(plain: DataFrame, domain: DataFrame) -> DataFrame:
    """s p o, p has domain c: s is a c; literal subjects get no type."""
    return plain.filter(~is_literal("s")).join(domain, plain["p"] == domain["sub"]).select(*_typed(F.col("s"), F.col("sup")))


def rdfs3(plain: DataFrame, range_: DataFrame) -> DataFrame:
    """s p o, p has range c: o is a c; literal objects get no type."""
    return plain.filter(~is_literal("o")).join(range_, plain["p"] == range_["sub"]).select(*_typed(F.col("o"), F.col("sup")))


def rdfs9(types: DataFrame, sub_class: DataFrame) -> DataFrame:
    """x is an a, a below b: x is a b."""
    return types.filter(~is_literal("s")).join(sub_class, types["o"] == sub_class["sub"]).select(*_typed(F.col("s"), F.col("sup")))


def chained(first: DataFrame, second: DataFrame) -> DataFrame:
    """(sub, sup) by an edge of ``first`` and then one of ``second``."""
    on = second.withColumnsRenamed({"sub": "mid", "sup": "top"})
    return first.join(on, F.col("sup") == F.col("mid")).select("sub", F.col("top").alias("sup"))


def with_above(used: DataFrame, sub_property: DataFrame) -> DataFrame:
    """Predicates (one column p) and those above them."""
    return used.unionByName(used.join(sub_property, used["p"] == sub_property["sub"]).select(F.col("sup").alias("p"))).distinct()


def composed(edges: DataFrame, sub_property: DataFrame, sub_class: DataFrame) -> DataFrame:
    """(property, class) that domain or range ``edges`` give over the properties above and the classes above."""
    direct = edges.unionByName(chained(sub_property, edges)).distinct()
    return direct.unionByName(chained(direct, sub_class)).distinct()


def rdf1(plain: DataFrame, v: V.Vocabulary) -> DataFrame:
    return plain.select("p").distinct().select(*_typed(F.col("p"), v.property))


def rdfs4a(plain: DataFrame, v: V.Vocabulary) -> DataFrame:
    return plain.filter(~is_literal("s")).select("s").distinct().select(*_typed(F.col("s"), v.resource))


def rdfs4b(plain: DataFrame, v: V.Vocabulary) -> DataFrame:
    return plain.filter(~is_literal("o")).select("o").distinct().select(*_typed(F.col("o"), v.resource))


def rdfs6(plain: DataFrame) -> DataFrame:
    """Each predicate in use is below itself."""
    return plain.select("p").distinct().select(F.col("p").alias("s"), F.lit(V.SUB_PROPERTY).alias("p"), F.col("p").alias("o"))


def _of(types: DataFrame, klass: str, predicate: str, above=None) -> DataFrame:
    hit = types.filter(F.col("o") == klass)
    return hit.select("s", F.lit(predicate).alias("p"), (F.lit(above) if above else F.col("s")).alias("o"))


def rdfs8(types: DataFrame, v: V.Vocabulary) -> DataFrame:
    return _of(types, v.klass, V.SUB_CLASS, v.resource)


def rdfs10(types: DataFrame, v: V.Vocabulary) -> DataFrame:
    return _of(types, v.klass, V.SUB_CLASS)


def rdfs12(types: DataFrame, v: V.Vocabulary) -> DataFrame:
    return _of(types, v.membership, V.SUB_PROPERTY, v.member)


def rdfs13(types: DataFrame, v: V.Vocabulary) -> DataFrame:
    return _of(types, v.datatype, V.SUB_CLASS, v.literal)


def axioms(spark, v: V.Vocabulary) -> DataFrame:
    return spark.createDataFrame(v.axioms(), "s string, p string, o string")


def membership_axioms(properties: DataFrame, v: V.Vocabulary) -> DataFrame:
    """Three axioms for each membership property (one column p) in use."""
    rows = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(o).alias("o")) for p, o in ((V.TYPE, v.membership), (V.DOMAIN, v.resource), (V.RANGE, v.resource))])
    return properties.select(F.col("p").alias("s"), F.inline(rows))
