"""The reasoner: rules in phases over DataFrames of triples."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import vocab as V
from graphloom.functions.cluster import written
from graphloom.functions.terms import TRIPLE, is_iri, is_literal, lexical, plain_literal
from graphloom.operators import rules as R
from graphloom.operators import store as S
from graphloom.operators.closure import CycleError


#: What a row of the closure is: the least of its kinds counts.
GIVEN, AXIOM, DERIVED = 0, 1, 2


class ReasonerError(Exception):
    """The closure could not be computed."""


def _union(*frames: DataFrame) -> DataFrame:
    out = frames[0].select("s", "p", "o")
    for f in frames[1:]:
        out = out.unionByName(f.select("s", "p", "o"))
    return out


def _edge_triples(pairs: DataFrame, predicate: str) -> DataFrame:
    return pairs.select(F.col("sub").alias("s"), F.lit(predicate).alias("p"), F.col("sup").alias("o"))


def merge_lexical(df: DataFrame) -> DataFrame:
    """Terms known by their text alone: literals lose type and language, and are the IRI of the same text if there is one."""
    iris = df.select(F.explode(F.array("s", "p", "o")).alias("t")).filter(is_iri("t")).distinct().select(lexical("t").alias("text"), F.col("t").alias("iri"))
    out = df.select(*[plain_literal(c).alias(c) for c in "spo"])
    # literals alone meet the IRIs, so that no null key gathers the other rows
    merged = out.filter(is_literal("o")).join(iris, lexical("o") == F.col("text"), "left").select("s", "p", F.coalesce("iri", "o").alias("o"))
    return out.filter(~is_literal("o")).unionByName(merged)


class Reasoner:
    """Materialises what triples (s, p, o) entail under rho-df or RDFS.

    mode="phased" runs the rules once in their order, sub-property inheritance to a
    fixpoint first; "complete" repeats all rules until nothing new follows.
    Hierarchies are closed and composed before they meet data: what a predicate
    entails over its super-properties, their domains and ranges and the classes above
    is one small table, so each rule is one join of the data as given, no derived
    triple is derived from again, and one aggregation ends the plan. That aggregation
    combines within tasks first; ``local_dedup`` makes each rule's output distinct
    before it, and without ``global_dedup`` it is left out: every match of a rule is a
    row, whether its triple is known or not.
    """

    def __init__(self, spark: SparkSession, ruleset: str = "rhodf", axioms: bool = False, vocab: str = "compat", identity: str = "rdf", mode: str = "phased", on_cycle: str = "close", local_dedup: bool = False, global_dedup: bool = True):
        for name, value, allowed in (("ruleset", ruleset, ("rhodf", "rdfs")), ("identity", identity, ("rdf", "lexical")), ("mode", mode, ("phased", "complete"))):
            if value not in allowed:
                raise ReasonerError(f"{name} {value!r}: one of {', '.join(allowed)}")
        self.local_dedup, self.global_dedup = local_dedup, global_dedup
        self.spark, self.ruleset, self.axioms, self.identity, self.mode, self.on_cycle = spark, ruleset, axioms, identity, mode, on_cycle
        self.vocab = V.Vocabulary(vocab)
        self.asserted = spark.createDataFrame([], TRIPLE)
        self.all: DataFrame | None = None
        self.given: DataFrame | None = None
        self._times: dict[str, float] = {}
        self._began = 0.0

    def add(self, df: DataFrame) -> Reasoner:
        """More asserted triples."""
        self.asserted, self.all = self.asserted.unionByName(S.triples(df)), None
        return self

    def closure(self, df: DataFrame | None = None) -> DataFrame:
        """(s, p, o, entailed): asserted and derived triples, each once."""
        if df is not None:
            self.add(df)
        self._times, self._began = {}, time.perf_counter()
        try:
            given = self.asserted.dropna()
            if self.identity == "lexical":
                given = merge_lexical(given)
            self.given = given = written(given)
            self._mark("input")
            every = self._every(given)
        except CycleError as e:
            raise ReasonerError(f"non-DAG: {e}") from e
        self.all = every.select("s", "p", "o", (F.col("kind") > GIVEN).alias("entailed"))
        self._mark("plan")
        return self.all

    def _mark(self, phase: str) -> None:
        now = time.perf_counter()
        self._times[phase] = self._times.get(phase, 0.0) + now - self._began
        self._began = now

    def _every(self, given: DataFrame) -> DataFrame:
        """(s, p, o, kind, derivations): each triple once, with the least kind of its rows and how often it was derived."""
        rows = [given.select("s", "p", "o", F.lit(GIVEN).alias("kind"))]
        base = given
        if self.axioms:
            axioms = _union(R.axioms(self.spark, self.vocab), R.membership_axioms(S.membership_properties(given), self.vocab))
            rows.append(axioms.withColumn("kind", F.lit(AXIOM)))
            base = _union(given, axioms)
            self._mark("axioms")
        derived = self._derive(base)
        if self.mode == "complete":
            base = written(base.distinct())
            while True:
                grown = written(_union(base, derived).distinct())
                if grown.count() == base.count():
                    break
                base, derived = grown, self._derive(grown)
        rows.append(derived.withColumn("kind", F.lit(DERIVED)))
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        if not self.global_dedup:
            return out.withColumn("derivations", (F.col("kind") == DERIVED).cast("long"))
        # one aggregation makes the triples distinct and tells asserted ones apart
        return out.groupBy("s", "p", "o").agg(F.min("kind").alias("kind"), F.sum((F.col("kind") == DERIVED).cast("long")).alias("derivations"))

    def _derive(self, base: DataFrame) -> DataFrame:
        """One run of the phases over ``base``: derived triples, not distinct."""
        plain, types, schema = S.route(base)
        sp = S.edges(schema, V.SUB_PROPERTY)
        while True:
            closed = R.rdfs5(sp, on_cycle=self.on_cycle)
            # only a property below subPropertyOf itself adds to the hierarchy
            adds = closed.filter(F.col("sup") == V.SUB_PROPERTY)
            if adds.isEmpty():
                break
            more = S.edges(R.rdfs7(plain, adds), V.SUB_PROPERTY).distinct().join(closed, ["sub", "sup"], "left_anti")
            more = written(more)
            if more.isEmpty():
                break
            sp = written(closed.unionByName(more))
        self._mark("properties")
        out = [R.rdfs7(plain, closed), _edge_triples(closed, V.SUB_PROPERTY)]
        # inherited schema and type triples, where a property is below one of their predicates
        special = F.col("sup").isin(*V.SCHEMA, V.TYPE)
        ruling = closed.filter(special)
        if not ruling.isEmpty():
            _, more_types, more_schema = S.route(written(R.rdfs7(plain, ruling).distinct()))
            types, schema = _union(types, more_types), _union(schema, more_schema)
        ordinary = closed.filter(~special)
        self._mark("inherited")
        sub_class = R.rdfs11(S.edges(schema, V.SUB_CLASS).distinct(), on_cycle=self.on_cycle)
        out.append(_edge_triples(sub_class, V.SUB_CLASS))
        self._mark("classes")
        domain, range_ = (R.composed(S.edges(schema, p).distinct(), ordinary, sub_class) for p in (V.DOMAIN, V.RANGE))
        typed = _union(R.rdfs2(plain, domain), R.rdfs3(plain, range_))
        above = R.rdfs9(types, sub_class)
        out += [typed, above]
        self._mark("typed")
        if self.ruleset == "rdfs":
            v = self.vocab
            used = written(R.with_above(plain.select("p").distinct(), ordinary))  # as many rows as predicates
            out += [R.rdf1(used, v), R.rdfs4a(plain, v), R.rdfs4b(plain, v), R.rdfs6(used)]
            declared = _union(types, typed, above)
            member = written(R.rdfs12(declared, v).distinct())
            out += [R.rdfs8(declared, v), R.rdfs10(declared, v), member, R.rdfs13(declared, v)]
            # inheritance once more over the hierarchy as it is now, if it has a new membership edge
            new = written(S.edges(member, V.SUB_PROPERTY).distinct().join(closed.unionByName(S.edges(base, V.SUB_PROPERTY)), ["sub", "sup"], "left_anti"))
            if not new.isEmpty():
                out.append(R.rdfs7(plain, new.unionByName(R.chained(ordinary, new)).distinct()))
            self._mark("vocabulary")
        if self.local_dedup:
            out = [x.distinct() for x in out]
        return _union(*out)

    @property
    def plain(self) -> DataFrame:
        return S.route(self._result())[0]

    @property
    def types(self) -> DataFrame:
        return S.route(self._result())[1]

    @property
    def schema(self) -> DataFrame:
        return S.route(self._result())[2]

    def _result(self) -> DataFrame:
        return self.closure() if self.all is None else self.all

    def stats(self) -> DataFrame:
        """One row: asserted (unique), inferred_unique, inferred_duplicates (derivations that gave nothing new).

        Derivations are counted over distinct input, one for each match of a rule with
        its composed schema table.
        """
        self._result()
        every = self._every(written(self.given.distinct()))
        long_sum = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
        kind = F.col("kind")
        return every.agg(long_sum(kind == GIVEN).alias("asserted"), long_sum(kind > GIVEN).alias("inferred_unique"), (F.coalesce(F.sum("derivations"), F.lit(0)) - long_sum(kind == DERIVED)).alias("inferred_duplicates"))

    def timings(self) -> dict[str, float]:
        """Seconds by phase: what the closure did before it returned its plan; reading and output are the caller's."""
        return dict(self._times)
