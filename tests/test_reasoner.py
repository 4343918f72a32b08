import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import vocab as V
from graphloom.operators import store as S
from graphloom.operators.closure import CycleError, transitive_closure
from graphloom.plans.cli import main
from graphloom.plans.reasoner import Reasoner, ReasonerError
from graphloom.sources.turtle import Parser

from . import evaluate

HEAD = "@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n@prefix : <http://depot/> .\n"
#: A tram depot. Classes in an uneven diamond: one way from Tram to Vehicle has two steps, the other three.
FLEET = """
:Tram rdfs:subClassOf :Electric, :Railed .
:Electric rdfs:subClassOf :Vehicle .
:Railed rdfs:subClassOf :Guided .
:Guided rdfs:subClassOf :Vehicle .
:t12 a :Tram ; :servedBy :line4 ; :fleetNumber "12" .
:t30 a :Railed ; :servedBy :line4 , :line9 .
:servedBy rdfs:domain :Vehicle ; rdfs:range :Line ; rdfs:subPropertyOf :related .
:related rdfs:domain :Thing ; rdfs:range :Thing .
:fleetNumber rdfs:range :Code ; rdfs:domain :Asset .
:Line rdfs:subClassOf :Service .
"""
#: Hierarchy edges that only follow from a property below a schema predicate, two levels down.
CATALOGUE = """
:narrower rdfs:subPropertyOf :kindOf .
:kindOf rdfs:subPropertyOf rdfs:subClassOf .
:Bogie :narrower :Part . :Part :kindOf :Item . :Axle :narrower :Bogie .
:typedAs rdfs:subPropertyOf rdf:type . :x7 :typedAs :Axle . :x8 a :Bogie .
"""
#: A property that is itself below subPropertyOf makes the hierarchy grow, and the data meet it again.
GROWING = """
:refines rdfs:subPropertyOf rdfs:subPropertyOf .
:drivenBy :refines :crewedBy . :crewedBy :refines :staffedBy . :staffedBy rdfs:range :Person .
:t12 :drivenBy :ana . :t30 :crewedBy "two people" .
"""
#: A blank node as super-property, with a domain.
NAMELESS = """
:parkedIn rdfs:subPropertyOf _:place . _:place rdfs:domain :Parked ; rdfs:range :Track . :t12 :parkedIn :track3 . :t30 :parkedIn "unknown" .
"""
#: Container membership, a class, a data type.
TIMETABLE = """
:monday rdf:_1 :t12 ; rdf:_2 :t30 ; rdf:_10 "spare" . :Tram a rdfs:Class . :platformCode a rdf:Datatype . :t12 a :Tram .
"""
#: A loop of three classes with a way in and a way out, and a class below itself.
LOOP = ":Red rdfs:subClassOf :Green . :Green rdfs:subClassOf :Blue . :Blue rdfs:subClassOf :Red , :Colour . :Pale rdfs:subClassOf :Red . :Plain rdfs:subClassOf :Plain . :wall a :Pale ."
EVERY = {"FLEET": FLEET, "CATALOGUE": CATALOGUE, "GROWING": GROWING, "NAMELESS": NAMELESS, "TIMETABLE": TIMETABLE, "LOOP": LOOP}


def parsed(text):
    return list(Parser(HEAD + text))


def frame(spark, text):
    return spark.createDataFrame(parsed(text), "s string, p string, o string")


def derived(spark, text, **kw):
    return {(r["s"], r["p"], r["o"]) for r in Reasoner(spark, **kw).closure(frame(spark, text)).filter("entailed").collect()}


@pytest.mark.parametrize("name", EVERY)
def test_rhodf(spark, name):
    assert derived(spark, EVERY[name]) == evaluate.entailed(parsed(EVERY[name]))


@pytest.mark.parametrize(("ruleset", "axioms", "mode"), [("rhodf", True, "phased"), ("rdfs", False, "phased"), ("rdfs", True, "phased"), ("rdfs", True, "complete")])
def test_rule_sets(spark, ruleset, axioms, mode):
    text = FLEET + CATALOGUE + TIMETABLE + NAMELESS
    assert derived(spark, text, ruleset=ruleset, axioms=axioms, mode=mode) == evaluate.entailed(parsed(text), ruleset, axioms, mode)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    node = [f"<n{k}>" for k in range(7)]
    predicate = [*node[:4], *V.SCHEMA, V.TYPE, f"{V.MEMBERSHIP}1>"]
    top = [*node, *V.SCHEMA, V.TYPE, V.Vocabulary().klass, V.Vocabulary().datatype]
    given = sorted({(r.choice(node), r.choice(predicate), r.choice([*top, '"x"'])) for _ in range(22)})
    ruleset = ("rhodf", "rdfs", "rdfs")[seed - 1]
    df = spark.createDataFrame(given + given[:3], "s string, p string, o string")
    got = Reasoner(spark, ruleset=ruleset, axioms=seed == 3).closure(df)
    assert {(x["s"], x["p"], x["o"]) for x in got.filter("entailed").collect()} == evaluate.entailed(given, ruleset, seed == 3)
    assert got.count() == got.select("s", "p", "o").distinct().count()


def test_cycles(spark):
    got = {(s, o) for s, p, o in derived(spark, LOOP) if p == V.SUB_CLASS}
    ring = [f"<http://depot/{c}>" for c in ("Red", "Green", "Blue")]
    assert {(a, b) for a in ring for b in ring} - {(ring[0], ring[1]), (ring[1], ring[2]), (ring[2], ring[0])} <= got
    with pytest.raises(ReasonerError, match="non-DAG"):
        Reasoner(spark, on_cycle="error").closure(frame(spark, LOOP))
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "sub string, sup string")
    for n in (0, 100):
        assert transitive_closure(edges, driver_edges=n).count() == 4
        with pytest.raises(CycleError):
            transitive_closure(edges, "error", driver_edges=n)
    assert transitive_closure(edges.limit(0)).count() == 0


def test_closure_larger_than_the_driver_takes(spark):
    chain = spark.range(60).selectExpr("CAST(id AS string) AS sub", "CAST(id + 1 AS string) AS sup")
    assert transitive_closure(chain, driver_paths=100).count() == 60 * 61 // 2


def test_closure_random(spark):
    rng = random.Random(3)
    for _ in range(3):
        e = {(str(rng.randrange(12)), str(rng.randrange(12))) for _ in range(14)}
        want, grown = set(e), True
        while grown:
            more = {(a, d) for a, b in want for c, d in e if b == c} - want
            grown, want = bool(more), want | more
        df = spark.createDataFrame(sorted(e), "sub string, sup string")
        for n in (0, 100):
            assert {(r["sub"], r["sup"]) for r in transitive_closure(df, driver_edges=n).collect()} == want


def test_literals_duplicates_and_options(spark):
    text = ':p rdfs:range :C ; rdfs:domain :D . :s :p "x" , :o . :s :p :o .'
    t = lambda x: f"<http://depot/{x}>"
    assert derived(spark, text) == {(t("s"), V.TYPE, t("D")), (t("o"), V.TYPE, t("C"))}
    r = Reasoner(spark).add(frame(spark, FLEET)).add(frame(spark, ":t12 a :Tram ."))
    n = r.stats().first()
    assert (n["asserted"], n["inferred_unique"]) == (len(set(parsed(FLEET))), len(evaluate.entailed(parsed(FLEET)))) and n["inferred_duplicates"] >= 1
    assert {"input", "properties", "inherited", "classes", "typed", "plan"} <= set(r.timings())
    again = Reasoner(spark).closure(Reasoner(spark).closure(frame(spark, FLEET)))
    assert again.filter("entailed").count() == 0  # a closure is closed
    with pytest.raises(ReasonerError):
        Reasoner(spark, ruleset="owl")
    nothing = Reasoner(spark, ruleset="rdfs").closure(spark.createDataFrame([], "s string, p string, o string"))
    assert nothing.count() == 0
    got = derived(spark, ':s :p "http://depot/o"@en , :o .', identity="lexical")
    assert got == set()


def test_complete_mode(spark):
    text = ":A a rdfs:Class . :x a :A ."
    got = derived(spark, text, ruleset="rdfs", mode="complete")
    assert ("<http://depot/x>", V.TYPE, f"<{V.RDFS}Resource>") in got
    assert ("<http://depot/x>", V.TYPE, f"<{V.RDFS}Resource>") not in derived(spark, text, ruleset="rdfs")


def test_vocabularies(spark):
    text = "<http://depot/D> a rdfs:Datatype ."
    above = (f"<http://depot/D>", V.SUB_CLASS, f"<{V.RDFS}Literal>")
    assert above in derived(spark, text, ruleset="rdfs", vocab="w3c")
    assert above not in derived(spark, text, ruleset="rdfs")
    assert len(set(V.Vocabulary().axioms())) == 38


def test_store(spark):
    a = frame(spark, ":s :p :o . :s :q :o .")
    b = frame(spark, ":s :p :o . :s :r :o . :s :r :o .")
    assert S.insert(a, b).count() == 3
    assert S.new_only(b, a).count() == 1
    assert [x.count() for x in S.route(frame(spark, FLEET))] == [4, 2, 13]
    assert S.membership_properties(frame(spark, TIMETABLE)).count() == 3


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "t.ttl").write_text(HEAD + FLEET)
    n = len(evaluate.entailed(parsed(FLEET)))
    assert main(["-i", str(tmp_path / "t.ttl"), "-p", "-t"]) == 0
    out = capsys.readouterr()
    assert len(out.out.splitlines()) == n and f"inferred triples: {n}" in out.err and "closure:" in out.err and "properties:" in out.err
    assert main(["-i", str(tmp_path / "t.ttl"), "-o", str(tmp_path / "o.nt")]) == 0
    assert spark.read.text(str(tmp_path / "o.nt")).count() == n
    assert main([]) == 1 and main(["--help"]) == 0
    assert main(["-i", str(tmp_path / "none.ttl")]) == 1
    (tmp_path / "r.ttl").write_text(HEAD + LOOP)
    assert main(["-i", str(tmp_path / "r.ttl"), "--on-cycle", "error"]) == 1


def test_streaming(spark, tmp_path):
    from graphloom.streaming.ingest import entail_stream

    schema = frame(spark, ":p rdfs:subPropertyOf :q . :q rdfs:domain :C ; rdfs:range :R . :C rdfs:subClassOf :T .")
    data = frame(spark, ':x :p :y . :x :p :y . :z :p "l" . :k a :C .')
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s string, p string, o string").parquet(str(tmp_path / "in"))
    q = entail_stream(stream, schema).writeStream.format("memory").queryName("entailed").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r["s"], r["p"], r["o"]) for r in spark.table("entailed").collect()}
    want = {(r["s"], r["p"], r["o"]) for r in Reasoner(spark).closure(data.unionByName(schema)).filter("entailed").collect()}
    assert got == {x for x in want if x[1] not in V.SCHEMA}
    assert spark.table("entailed").count() == len(got)
