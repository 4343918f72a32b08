"""The named queries over the relational tables, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions import vocab as V
from graphloom.functions.cluster import place
from graphloom.operators import dictionary as D
from graphloom.operators import rules as R
from graphloom.operators import store as S
from graphloom.operators.closure import transitive_closure
from graphloom.sources import mapping as M
from graphloom.sources import ntriples as N
from graphloom.sources.turtle import read_turtle

from .reasoner import Reasoner, ReasonerError

VOCAB = V.Vocabulary()
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _values(pairs) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in pairs)


#: Views that the statements build on; DuckDB computes only those that a statement uses.
_PLAIN = """plain(s, p, o) AS (
 SELECT '<order/' || o_orderkey || '>', '<v/placedBy>', '<cust/' || o_custkey || '>' FROM orders
 UNION ALL SELECT '<order/' || o_orderkey || '>', '<v/status>', '"' || o_orderstatus || '"' FROM orders
 UNION ALL SELECT '<order/' || l_orderkey || '>', '<v/containsPart>', '<part/' || l_partkey || '>' FROM lineitem
 UNION ALL SELECT '<order/' || l_orderkey || '>', '<v/shippedFrom>', '<supp/' || l_suppkey || '>' FROM lineitem
 UNION ALL SELECT '<cust/' || c_custkey || '>', '<v/inNation>', '<nation/' || c_nationkey || '>' FROM customer
 UNION ALL SELECT '<supp/' || s_suppkey || '>', '<v/inNation>', '<nation/' || s_nationkey || '>' FROM supplier
 UNION ALL SELECT '<nation/' || n_nationkey || '>', '<v/inRegion>', '<region/' || n_regionkey || '>' FROM nation)"""
_TYPES = f"""ty(s, p, o) AS (
 SELECT '<cust/' || c_custkey || '>', '{V.TYPE}', '<seg/' || c_mktsegment || '>' FROM customer
 UNION ALL SELECT '<part/' || p_partkey || '>', '{V.TYPE}', '<ptype/' || p_type || '>' FROM part)"""
_EDGES = f"""sp(sub, sup) AS (VALUES {_values(M.PROPERTIES)}),
dom(sub, sup) AS (VALUES {_values(M.DOMAINS)}),
rng(sub, sup) AS (VALUES {_values(M.RANGES)}),
sc(sub, sup) AS (SELECT DISTINCT '<ptype/' || p_type || '>', '<c/Part>' FROM part
 UNION SELECT DISTINCT '<seg/' || c_mktsegment || '>', '<c/Customer>' FROM customer
 UNION SELECT * FROM (VALUES {_values(M.CLASSES)}) v(a, b))"""
_CLOSED = """spc(sub, sup) AS (SELECT sub, sup FROM sp UNION SELECT spc.sub, sp.sup FROM spc JOIN sp ON spc.sup = sp.sub),
scc(sub, sup) AS (SELECT sub, sup FROM sc UNION SELECT scc.sub, sc.sup FROM scc JOIN sc ON scc.sup = sc.sub)"""
_SCHEMA = f"""sch(s, p, o) AS (SELECT sub, '{V.SUB_CLASS}', sup FROM sc UNION ALL SELECT sub, '{V.SUB_PROPERTY}', sup FROM sp
 UNION ALL SELECT sub, '{V.DOMAIN}', sup FROM dom UNION ALL SELECT sub, '{V.RANGE}', sup FROM rng)"""
_RHODF = f"""r2 AS (SELECT s, sup AS p, o FROM plain JOIN spc ON p = sub),
pl AS (SELECT * FROM plain UNION SELECT * FROM r2),
r45 AS (SELECT s, '{V.TYPE}' AS p, sup AS o FROM pl JOIN dom ON p = sub UNION SELECT o, '{V.TYPE}', sup FROM pl JOIN rng ON p = sub WHERE o NOT LIKE '"%'),
ty2 AS (SELECT * FROM ty UNION SELECT * FROM r45),
r7 AS (SELECT s, '{V.TYPE}' AS p, sup AS o FROM ty2 JOIN scc ON o = sub),
ty3 AS (SELECT * FROM ty2 UNION SELECT * FROM r7),
given AS (SELECT * FROM plain UNION SELECT * FROM ty UNION SELECT * FROM sch),
rho AS (SELECT * FROM r2 UNION SELECT * FROM r45 UNION SELECT * FROM r7 UNION SELECT sub, '{V.SUB_PROPERTY}', sup FROM spc UNION SELECT sub, '{V.SUB_CLASS}', sup FROM scc)"""
_RDFS = f"""rdfs AS (SELECT * FROM rho
 UNION SELECT p, '{V.TYPE}', '{VOCAB.property}' FROM pl UNION SELECT s, '{V.TYPE}', '{VOCAB.resource}' FROM pl
 UNION SELECT o, '{V.TYPE}', '{VOCAB.resource}' FROM pl WHERE o NOT LIKE '"%' UNION SELECT p, '{V.SUB_PROPERTY}', p FROM pl)"""


def _with(body: str, more: str = "") -> str:
    return f"WITH RECURSIVE {_PLAIN}, {_TYPES}, {_EDGES}, {_CLOSED}, {_SCHEMA}, {_RHODF}, {_RDFS}{more}\n{body}"


def _sp(spark: SparkSession) -> DataFrame:
    return M.edges(spark, M.PROPERTIES)


def _wide_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain triples and those inherited."""
    plain = M.plain_triples(spark, sf_dir)
    return plain.unionByName(R.rdfs7(plain, R.rdfs5(_sp(spark))))


@_query("q_triples", _with("SELECT CASE WHEN p = '" + V.TYPE + "' THEN 'type' ELSE 'plain' END AS part, p, count(*) AS n FROM (SELECT * FROM plain UNION ALL SELECT * FROM ty) GROUP BY 1, 2"))
def q_triples(spark, d):
    both = M.plain_triples(spark, d).unionByName(M.type_triples(spark, d))
    return both.groupBy(S.part().alias("part"), "p").agg(F.count(F.lit(1)).alias("n"))


@_query("q_distinct_triples", _with("SELECT DISTINCT s, p, o FROM plain"))
def q_distinct_triples(spark, d):
    return M.plain_triples(spark, d).distinct()


@_query("q_partition_counts", _with(f"SELECT part, count(*) AS n FROM (SELECT CASE WHEN p IN ({', '.join(repr(x) for x in V.SCHEMA)}) THEN 'schema' WHEN p = '{V.TYPE}' THEN 'type' ELSE 'plain' END AS part FROM given) GROUP BY part"))
def q_partition_counts(spark, d):
    return M.all_triples(spark, d).distinct().groupBy(S.part().alias("part")).agg(F.count(F.lit(1)).alias("n"))


@_query("q_entailed_scan", _with("SELECT p, count(*) AS n FROM (SELECT * FROM rho EXCEPT SELECT * FROM given) GROUP BY p"))
def q_entailed_scan(spark, d):
    return S.entailed(Reasoner(spark).closure(M.all_triples(spark, d))).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@_query("q_columns", _with("SELECT count(DISTINCT s) AS subjects, count(DISTINCT p) AS predicates, count(DISTINCT o) AS objects FROM plain"))
def q_columns(spark, d):
    # three passes over the distinct values of a column each, not one expanded pass
    t = M.plain_triples(spark, d)
    one = lambda c, name: t.select(c).distinct().agg(F.count(F.lit(1)).alias(name))
    out = [one(c, n).withColumn("k", F.lit(1)) for c, n in (("s", "subjects"), ("p", "predicates"), ("o", "objects"))]
    return out[0].join(out[1], "k").join(out[2], "k").drop("k")


@_query("q_sp_closure", _with("SELECT sub, sup FROM spc"))
def q_sp_closure(spark, d):
    return R.rdfs5(_sp(spark))


@_query("q_subproperty_inherit", _with("SELECT DISTINCT s, p, o FROM r2"))
def q_subproperty_inherit(spark, d):
    return R.rdfs7(M.plain_triples(spark, d).distinct(), R.rdfs5(_sp(spark))).distinct()


_EXTRA = ("<v/placedBy>", "<v/narrows>", "<v/about>"), ("<v/narrows>", V.SUB_PROPERTY, V.SUB_PROPERTY)


@_query(
    "q_subproperty_fixpoint",
    _with(
        "SELECT s, '<v/about>' AS p, o FROM plain WHERE p = '<v/placedBy>' "
        f"UNION SELECT '<v/placedBy>', '{V.SUB_PROPERTY}', '<v/about>'"
    ),
)
def q_subproperty_fixpoint(spark, d):
    """A property below subPropertyOf adds to the hierarchy, which then meets the data again."""
    given = M.plain_triples(spark, d).filter("p = '<v/placedBy>'").unionByName(spark.createDataFrame(list(_EXTRA), "s string, p string, o string"))
    return S.entailed(Reasoner(spark).closure(given)).select("s", "p", "o")


@_query("q_domain", _with(f"SELECT DISTINCT s, '{V.TYPE}' AS p, sup AS o FROM pl JOIN dom ON p = sub"))
def q_domain(spark, d):
    return R.rdfs2(_wide_plain(spark, d), M.edges(spark, M.DOMAINS)).distinct()


@_query("q_range", _with(f"SELECT DISTINCT o AS s, '{V.TYPE}' AS p, sup AS o FROM pl JOIN rng ON p = sub WHERE o NOT LIKE '\"%'"))
def q_range(spark, d):
    return R.rdfs3(_wide_plain(spark, d), M.edges(spark, M.RANGES)).distinct()


@_query("q_sc_closure", _with("SELECT sub, sup FROM scc"))
def q_sc_closure(spark, d):
    return R.rdfs11(M.class_edges(spark, d))


@_query("q_subclass_inherit", _with("SELECT DISTINCT s, sup AS o FROM ty JOIN scc ON o = sub EXCEPT SELECT s, o FROM ty"))
def q_subclass_inherit(spark, d):
    types = M.type_triples(spark, d)
    return S.new_only(R.rdfs9(types, R.rdfs11(M.class_edges(spark, d))), types).select("s", "o")


@_query("q_rdf1", _with(f"SELECT DISTINCT p AS s, '{V.TYPE}' AS p, '{VOCAB.property}' AS o FROM pl"))
def q_rdf1(spark, d):
    return R.rdf1(_wide_plain(spark, d), VOCAB)


@_query("q_rdfs4a", _with(f"SELECT DISTINCT s, '{V.TYPE}' AS p, '{VOCAB.resource}' AS o FROM plain"))
def q_rdfs4a(spark, d):
    return R.rdfs4a(M.plain_triples(spark, d), VOCAB)


@_query("q_rdfs4b", _with(f"SELECT DISTINCT o AS s, '{V.TYPE}' AS p, '{VOCAB.resource}' AS o FROM plain WHERE o NOT LIKE '\"%'"))
def q_rdfs4b(spark, d):
    return R.rdfs4b(M.plain_triples(spark, d), VOCAB)


@_query("q_rdfs6", _with(f"SELECT DISTINCT p AS s, '{V.SUB_PROPERTY}' AS p, p AS o FROM pl"))
def q_rdfs6(spark, d):
    return R.rdfs6(_wide_plain(spark, d))


def _declared(spark, d, klass: str) -> DataFrame:
    """Customer segments declared to be of a class of the vocabulary, part types of another one, and the types of the data."""
    one = F.when(F.col("sub").startswith("<seg/"), F.lit(klass)).otherwise(F.lit(VOCAB.resource))
    declared = M.class_edges(spark, d).select(F.col("sub").alias("s"), F.lit(V.TYPE).alias("p"), one.alias("o"))
    return declared.unionByName(M.type_triples(spark, d))


_SEGMENTS = "FROM sc WHERE sub LIKE '<seg/%'"


@_query("q_rdfs8", _with(f"SELECT DISTINCT sub AS s, '{V.SUB_CLASS}' AS p, '{VOCAB.resource}' AS o {_SEGMENTS}"))
def q_rdfs8(spark, d):
    return R.rdfs8(_declared(spark, d, VOCAB.klass), VOCAB).distinct()


@_query("q_rdfs10", _with(f"SELECT DISTINCT sub AS s, '{V.SUB_CLASS}' AS p, sub AS o {_SEGMENTS}"))
def q_rdfs10(spark, d):
    return R.rdfs10(_declared(spark, d, VOCAB.klass), VOCAB).distinct()


@_query("q_rdfs12", _with(f"SELECT DISTINCT sub AS s, '{V.SUB_PROPERTY}' AS p, '{VOCAB.member}' AS o {_SEGMENTS}"))
def q_rdfs12(spark, d):
    return R.rdfs12(_declared(spark, d, VOCAB.membership), VOCAB).distinct()


@_query("q_rdfs13", _with(f"SELECT DISTINCT sub AS s, '{V.SUB_CLASS}' AS p, '{VOCAB.literal}' AS o {_SEGMENTS}"))
def q_rdfs13(spark, d):
    return R.rdfs13(_declared(spark, d, VOCAB.datatype), VOCAB).distinct()


def _lines(spark, d) -> DataFrame:
    """Order lines as members of their order's container: rdf:_1, rdf:_2, ..."""
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    number = F.concat(F.lit(V.MEMBERSHIP), F.col("l_linenumber").cast("string"), F.lit(">"))
    return line.select(F.concat(F.lit("<order/"), F.col("l_orderkey").cast("string"), F.lit(">")).alias("s"), number.alias("p"), F.concat(F.lit("<part/"), F.col("l_partkey").cast("string"), F.lit(">")).alias("o"))


_LINES = f"SELECT '<order/' || l_orderkey || '>' AS s, '{V.MEMBERSHIP}' || l_linenumber || '>' AS p, '<part/' || l_partkey || '>' AS o FROM lineitem"


@_query("q_rdfs7_rerun", f"SELECT DISTINCT s, '{VOCAB.member}' AS p, o FROM ({_LINES})")
def q_rdfs7_rerun(spark, d):
    given = _lines(spark, d)
    declared = R.membership_axioms(S.membership_properties(given), VOCAB)
    return R.rdfs7(given, S.edges(R.rdfs12(declared, VOCAB), V.SUB_PROPERTY)).distinct()


#: The axioms as they should come out, spelt out beside the table that makes them.
_AXIOMS = """ax(s, p, o) AS (SELECT replace(replace(s, 'rdf:', '<http://www.w3.org/1999/02/22-rdf-syntax-ns#'), 'rdfs:', '<http://www.w3.org/2000/01/rdf-schema#') || '>',
 replace(replace(p, 'rdf:', '<http://www.w3.org/1999/02/22-rdf-syntax-ns#'), 'rdfs:', '<http://www.w3.org/2000/01/rdf-schema#') || '>',
 replace(replace(o, 'rdf:', '<http://www.w3.org/1999/02/22-rdf-syntax-ns#'), 'rdfs:', '<http://www.w3.org/2000/01/rdf-schema#') || '>' FROM (VALUES
 ('rdf:type', 'rdfs:domain', 'rdfs:Resource'), ('rdfs:domain', 'rdfs:domain', 'rdfs:Property'), ('rdfs:range', 'rdfs:domain', 'rdfs:Property'),
 ('rdfs:subPropertyOf', 'rdfs:domain', 'rdfs:Property'), ('rdfs:subClassOf', 'rdfs:domain', 'rdfs:Property'), ('rdf:subject', 'rdfs:domain', 'rdfs:Statement'),
 ('rdf:predicate', 'rdfs:domain', 'rdfs:Statement'), ('rdf:object', 'rdfs:domain', 'rdfs:Statement'), ('rdfs:member', 'rdfs:domain', 'rdfs:Resource'),
 ('rdf:first', 'rdfs:domain', 'rdf:List'), ('rdf:rest', 'rdfs:domain', 'rdf:List'), ('rdfs:seeAlso', 'rdfs:domain', 'rdfs:Resource'),
 ('rdfs:isDefinedBy', 'rdfs:domain', 'rdfs:Resource'), ('rdfs:comment', 'rdfs:domain', 'rdfs:Resource'), ('rdfs:label', 'rdfs:domain', 'rdfs:Resource'),
 ('rdf:value', 'rdfs:domain', 'rdfs:Resource'), ('rdf:type', 'rdfs:range', 'rdfs:Class'), ('rdfs:domain', 'rdfs:range', 'rdfs:Class'),
 ('rdfs:range', 'rdfs:range', 'rdfs:Class'), ('rdfs:subPropertyOf', 'rdfs:range', 'rdfs:Property'), ('rdfs:subClassOf', 'rdfs:range', 'rdfs:Class'),
 ('rdf:subject', 'rdfs:range', 'rdfs:Resource'), ('rdf:predicate', 'rdfs:range', 'rdfs:Resource'), ('rdf:object', 'rdfs:range', 'rdfs:Resource'),
 ('rdfs:member', 'rdfs:range', 'rdfs:Resource'), ('rdf:rest', 'rdfs:range', 'rdfs:Resource'), ('rdfs:seeAlso', 'rdfs:range', 'rdfs:Resource'),
 ('rdfs:isDefinedBy', 'rdfs:range', 'rdfs:Resource'), ('rdfs:comment', 'rdfs:range', 'rdfs:Literal'), ('rdfs:label', 'rdfs:range', 'rdfs:Literal'),
 ('rdf:value', 'rdfs:range', 'rdfs:Resource'), ('rdf:Alt', 'rdfs:subClassOf', 'rdfs:Container'), ('rdf:Bag', 'rdfs:subClassOf', 'rdfs:Container'),
 ('rdf:Seq', 'rdfs:subClassOf', 'rdfs:Container'), ('rdfs:ContainerMembershipProperty', 'rdfs:subClassOf', 'rdfs:Property'), ('rdf:XMLLiteral', 'rdfs:subClassOf', 'rdfs:Literal'),
 ('rdf:Datatype', 'rdfs:subClassOf', 'rdfs:Class'), ('rdf:XMLLiteral', 'rdf:type', 'rdf:Datatype')) v(s, p, o))"""


@_query("q_axioms", f"WITH {_AXIOMS} SELECT * FROM ax")
def q_axioms(spark, d):
    return R.axioms(spark, VOCAB)


_XML, _DATATYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#XMLLiteral>", VOCAB.datatype


@_query(
    "q_rdfs_axioms_closure",
    f"""WITH {_AXIOMS}, g AS (SELECT DISTINCT s, p, o FROM ({_LINES})), m AS (SELECT DISTINCT p FROM g),
e AS (SELECT * FROM ax
 UNION SELECT p, '{V.TYPE}', '{VOCAB.membership}' FROM m UNION SELECT p, '{V.DOMAIN}', '{VOCAB.resource}' FROM m UNION SELECT p, '{V.RANGE}', '{VOCAB.resource}' FROM m
 UNION SELECT p, '{V.TYPE}', '{VOCAB.property}' FROM m UNION SELECT p, '{V.SUB_PROPERTY}', p FROM m UNION SELECT p, '{V.SUB_PROPERTY}', '{VOCAB.member}' FROM m
 UNION SELECT s, '{V.TYPE}', '{VOCAB.resource}' FROM g UNION SELECT o, '{V.TYPE}', '{VOCAB.resource}' FROM g UNION SELECT s, '{VOCAB.member}', o FROM g
 UNION VALUES ('{_XML}', '{V.TYPE}', '{VOCAB.klass}'), ('{_XML}', '{V.SUB_CLASS}', '{VOCAB.resource}'), ('{_XML}', '{V.SUB_CLASS}', '{_XML}'), ('{_XML}', '{V.SUB_CLASS}', '{VOCAB.literal}'))
SELECT s, p, o, FALSE AS entailed FROM g UNION ALL (SELECT s, p, o, TRUE FROM e EXCEPT SELECT s, p, o, TRUE FROM g)""",
)
def q_rdfs_axioms_closure(spark, d):
    """RDFS with axioms over containers: membership axioms, the vocabulary's rules, and inheritance once more over rdfs:member."""
    return Reasoner(spark, ruleset="rdfs", axioms=True).closure(_lines(spark, d))


@_query(
    "q_membership_axioms",
    f"WITH m AS (SELECT DISTINCT p AS s FROM ({_LINES})) SELECT s, '{V.TYPE}' AS p, '{VOCAB.membership}' AS o FROM m "
    f"UNION ALL SELECT s, '{V.DOMAIN}', '{VOCAB.resource}' FROM m UNION ALL SELECT s, '{V.RANGE}', '{VOCAB.resource}' FROM m",
)
def q_membership_axioms(spark, d):
    return R.membership_axioms(S.membership_properties(_lines(spark, d)), VOCAB)


@_query("q_semi_join", _with("SELECT p, count(*) AS n FROM plain WHERE p IN (SELECT sub FROM sp) GROUP BY p"))
def q_semi_join(spark, d):
    return S.semi(M.plain_triples(spark, d), _sp(spark), "p", "sub").groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@_query("q_new_only_anti_join", _with(f"SELECT s, p, o FROM (SELECT o AS s, '{V.TYPE}' AS p, sup AS o FROM pl JOIN rng ON p = sub WHERE o NOT LIKE '\"%' UNION SELECT s, p, o FROM r7) EXCEPT SELECT s, p, o FROM ty"))
def q_new_only_anti_join(spark, d):
    plain, types = _wide_plain(spark, d), M.type_triples(spark, d)
    typed = R.rdfs2(plain, M.edges(spark, M.DOMAINS)).unionByName(R.rdfs3(plain, M.edges(spark, M.RANGES)))
    closed = R.rdfs11(M.class_edges(spark, d))
    return S.new_only(R.rdfs3(plain, M.edges(spark, M.RANGES)).unionByName(R.rdfs9(types.unionByName(typed), closed)), types)


@_query("q_local_dedup_equiv", _with("SELECT p, count(*) AS derived, count(DISTINCT s || ' ' || o) AS kept FROM (SELECT s, sup AS p, o FROM plain JOIN spc ON p = sub) GROUP BY p"))
def q_local_dedup_equiv(spark, d):
    """Derivations before and after the distinct: partial aggregation first, as a count by triple."""
    made = R.rdfs7(M.plain_triples(spark, d), R.rdfs5(_sp(spark)))
    once = made.groupBy("s", "p", "o").agg(F.count(F.lit(1)).alias("k"))
    return once.groupBy("p").agg(F.sum("k").alias("derived"), F.count(F.lit(1)).alias("kept"))


@_query("q_local_dedup", _with("SELECT p, count(*) AS n FROM (SELECT * FROM rho EXCEPT SELECT * FROM given) GROUP BY p"))
def q_local_dedup(spark, d):
    """Each rule's output made distinct first: the same closure."""
    return S.entailed(Reasoner(spark, local_dedup=True).closure(M.all_triples(spark, d))).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@_query("q_ntriples_lines", _with("SELECT s || ' ' || p || ' ' || o || ' .' AS line FROM (SELECT DISTINCT s, p, o FROM plain)"))
def q_ntriples_lines(spark, d):
    return N.to_lines(M.plain_triples(spark, d).distinct())


_MADE = (
    """(SELECT count(*) FROM pd JOIN spc ON p = sub) + (SELECT count(*) FROM pd JOIN dc ON p = sub) + (SELECT count(*) FROM pd JOIN rc ON p = sub WHERE o NOT LIKE '"%')
 + (SELECT count(*) FROM td JOIN scu ON o = sub) + (SELECT count(*) FROM spu) + (SELECT count(*) FROM scu) AS made""",
    """, pd AS (SELECT DISTINCT * FROM plain), td AS (SELECT DISTINCT * FROM ty), spu AS (SELECT DISTINCT * FROM spc), scu AS (SELECT DISTINCT * FROM scc),
 dl AS (SELECT sub, sup FROM dom UNION SELECT spu.sub, dom.sup FROM spu JOIN dom ON spu.sup = dom.sub), dc AS (SELECT sub, sup FROM dl UNION SELECT dl.sub, scu.sup FROM dl JOIN scu ON dl.sup = scu.sub),
 rl AS (SELECT sub, sup FROM rng UNION SELECT spu.sub, rng.sup FROM spu JOIN rng ON spu.sup = rng.sub), rc AS (SELECT sub, sup FROM rl UNION SELECT rl.sub, scu.sup FROM rl JOIN scu ON rl.sup = scu.sub)""",
)


@_query(
    "q_stats",
    _with(
        "SELECT asserted, inferred_unique, made - inferred_unique AS inferred_duplicates FROM (SELECT (SELECT count(*) FROM given) AS asserted, "
        f"(SELECT count(*) FROM (SELECT * FROM rho EXCEPT SELECT * FROM given)) AS inferred_unique, {_MADE[0]}) x",
        _MADE[1],
    ),
)
def q_stats(spark, d):
    """Counters: a derivation is a match of a rule with its composed schema table."""
    return Reasoner(spark).add(M.all_triples(spark, d)).stats()


@_query("q_no_global_dedup", _with(f"SELECT FALSE AS entailed, count(*) AS n FROM given UNION ALL SELECT TRUE, made FROM (SELECT {_MADE[0]}) x", _MADE[1]))
def q_no_global_dedup(spark, d):
    """Every derivation a row of its own."""
    every = Reasoner(spark, global_dedup=False).closure(M.all_triples(spark, d).distinct())
    return every.groupBy("entailed").agg(F.count(F.lit(1)).alias("n"))


@_query("q_dictionary_roundtrip", _with("SELECT DISTINCT s, p, o FROM ty"))
def q_dictionary_roundtrip(spark, d):
    types = M.type_triples(spark, d).distinct()
    terms = D.dictionary(types)
    return D.decode(D.encode(types, terms), terms)


_RING = "SELECT '<nation/' || n_nationkey || '>' AS sub, '<nation/' || CASE WHEN n_nationkey % 5 = 4 THEN n_nationkey - 4 ELSE n_nationkey + 1 END || '>' AS sup FROM nation"


@_query("q_cycle_closure", f"WITH RECURSIVE e AS ({_RING}), c AS (SELECT sub, sup FROM e UNION SELECT c.sub, e.sup FROM c JOIN e ON c.sup = e.sub) SELECT sub, sup FROM c")
def q_cycle_closure(spark, d):
    """Rings of five nations, by path doubling."""
    k = F.col("n_nationkey")
    name = lambda c: F.concat(F.lit("<nation/"), c.cast("string"), F.lit(">"))
    ring = spark.read.parquet(f"{d}/nation.parquet").select(name(k).alias("sub"), name(F.when(k % 5 == 4, k - 4).otherwise(k + 1)).alias("sup"))
    return transitive_closure(ring, driver_edges=0)


@_query("q_cycle_error", "SELECT TRUE AS cyclic, 'error' AS answer")
def q_cycle_error(spark, d):
    """on_cycle="error": a ring of nations is refused, a chain is not."""
    k = F.col("n_nationkey")
    name = lambda c: F.concat(F.lit("<nation/"), c.cast("string"), F.lit(">"))
    nations = spark.read.parquet(f"{d}/nation.parquet")
    as_triple = lambda to: nations.select(name(k).alias("s"), F.lit(V.SUB_CLASS).alias("p"), name(to).alias("o"))
    Reasoner(spark, on_cycle="error").closure(as_triple(k + 1))
    try:
        Reasoner(spark, on_cycle="error").closure(as_triple(F.when(k % 5 == 4, k - 4).otherwise(k + 1)))
        answer = "closed"
    except ReasonerError:
        answer = "error"
    return spark.createDataFrame([(answer == "error", answer)], "cyclic boolean, answer string")


#: A Turtle text for each nation: every form of the grammar, about what the table holds. {k}, {r}, {n}: key, region, name.
_TURTLE = """@base <http://w/> .
@prefix v: <http://v/> .
@prefix : <#> .
# a comment, with "quotes" . and a <http://stop> ;
<nation/{k}> a v:Nation , v:Place ; v:name "{n}"@en , 'single {n}' ; v:region <region/{r}> ;
  v:long \"\"\"{n} says "hi"
twice\"\"\" ; v:code {k} ; v:share -{k}.25 ; v:rate {k}.5e3 ; v:even true ; v:typed "{k}"^^v:key , "{k}"^^<http://v/key2> ;
  v:escaped "tab\\tline\\n\\u00e9\\U0001F600 \\"q\\" \\\\ é" ; :local\\-name v:a.b ; .
PREFIX w: <http://v/>
<nation/{k}> w:seat [ v:in <region/{r}> ; v:desk [ v:number {k} ] ] .
_:office v:of <nation/{k}> .
<nation/{k}> v:list ( {k} "x" ) .
"""
_NODE = "'<http://w/nation/' || n_nationkey || '>'"


def _turtle_rows() -> str:
    """The triples of these texts; a blank node is told by the way that leads through it."""
    k, r, n = "n_nationkey", "n_regionkey", "n_name"
    xsd = "http://www.w3.org/2001/XMLSchema#"
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    v = lambda x: f"'<http://v/{x}>'"
    rows = [
        (f"'{V.TYPE}'", v("Nation")),
        (f"'{V.TYPE}'", v("Place")),
        (v("name"), f"'\"' || {n} || '\"@en'"),
        (v("name"), f"'\"single ' || {n} || '\"'"),
        (v("region"), f"'<http://w/region/' || {r} || '>'"),
        (v("long"), f"'\"' || {n} || ' says \\\"hi\\\"\\ntwice\"'"),
        (v("code"), f"'\"' || {k} || '\"^^<{xsd}integer>'"),
        (v("share"), f"'\"-' || {k} || '.25\"^^<{xsd}decimal>'"),
        (v("rate"), f"'\"' || {k} || '.5e3\"^^<{xsd}double>'"),
        (v("even"), f"'\"true\"^^<{xsd}boolean>'"),
        (v("typed"), f"'\"' || {k} || '\"^^<http://v/key>'"),
        (v("typed"), f"'\"' || {k} || '\"^^<http://v/key2>'"),
        (v("escaped"), "'\"tab\\tline\\né😀 \\\"q\\\" \\\\ é\"'"),
        ("'<http://w/#local-name>'", v("a.b")),
        ("'<http://v/seat> <http://v/in>'", f"'<http://w/region/' || {r} || '>'"),
        ("'<http://v/seat> <http://v/desk> <http://v/number>'", f"'\"' || {k} || '\"^^<{xsd}integer>'"),
        (f"'<http://v/list> <{rdf}first>'", f"'\"' || {k} || '\"^^<{xsd}integer>'"),
        (f"'<http://v/list> <{rdf}rest> <{rdf}first>'", "'\"x\"'"),
        (f"'<http://v/list> <{rdf}rest> <{rdf}rest>'", f"'<{rdf}nil>'"),
    ]
    own = " UNION ALL ".join(f"SELECT {_NODE} AS s, {p} AS p, {o} AS o FROM nation" for p, o in rows)
    return f"{own} UNION ALL SELECT '_', '<http://v/of>', {_NODE} FROM nation"


def _turtle_texts(spark, d, template: str) -> DataFrame:
    text = F.lit(template)
    for mark, c in (("{k}", "n_nationkey"), ("{r}", "n_regionkey"), ("{n}", "n_name")):
        text = F.replace(text, F.lit(mark), F.col(c).cast("string"))
    return spark.read.parquet(f"{d}/nation.parquet").select(text.alias("value"))


def _ways(triples: DataFrame) -> DataFrame:
    """Triples with blank objects followed to what they lead to, up to three predicates; a blank subject that nothing leads to is _."""
    blank = lambda c: F.col(c).startswith("_:")
    led = triples.filter(blank("o")).select(F.col("o").alias("b"))
    out, here = [], triples.join(led.distinct(), F.col("s") == F.col("b"), "left_anti").withColumn("s", F.when(blank("s"), "_").otherwise(F.col("s")))
    steps = triples.select(F.col("s").alias("b"), F.col("p").alias("q"), F.col("o").alias("t"))
    for _ in range(3):
        out.append(here.filter(~blank("o")))
        here = here.filter(blank("o")).join(steps, F.col("o") == F.col("b")).select("s", F.concat_ws(" ", "p", "q").alias("p"), F.col("t").alias("o"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@_query("q_turtle_roundtrip", _turtle_rows())
def q_turtle_roundtrip(spark, d):
    """Turtle files in the shared folder, read by the parser."""
    path = place(spark, "turtle")
    _turtle_texts(spark, d, _TURTLE).repartition(4).write.text(path)
    return _ways(read_turtle(spark, path))


_BROKEN = "<http://w/{k}> <http://v/p> nope:x .\n<http://w/{k}> <http://v/p> <http://w/{r}> .\n<http://w/{k}> <http://v/p> ; ; , .\n<http://w/{k}> <http://v/q> \"{n}\" .\n"


@_query("q_turtle_permissive", "SELECT '<http://w/' || n_nationkey || '>' AS s, '<http://v/p>' AS p, '<http://w/' || n_regionkey || '>' AS o FROM nation UNION ALL SELECT '<http://w/' || n_nationkey || '>', '<http://v/q>', '\"' || n_name || '\"' FROM nation")
def q_turtle_permissive(spark, d):
    """Statements that cannot be read are left out, those around them are kept."""
    path = place(spark, "turtle")
    _turtle_texts(spark, d, _BROKEN).coalesce(2).write.text(path)
    return read_turtle(spark, path, "PERMISSIVE")


@_query(
    "q_ntriples_roundtrip",
    "SELECT '<cust/' || c_custkey || '>' AS s, '<v/name>' AS p, '\"' || c_name || ' \\\"of\\\" \\\\ \\n\"@en' AS o FROM customer UNION ALL SELECT '_:c' || c_custkey, '<v/in>', '<nation/' || c_nationkey || '>' FROM customer",
)
def q_ntriples_roundtrip(spark, d):
    """Literals that need escapes, blank subjects, and blank predicates, which are not written."""
    key, c = F.col("c_custkey").cast("string"), spark.read.parquet(f"{d}/customer.parquet")
    text = F.concat(F.lit('"'), F.col("c_name"), F.lit(r' \"of\" \\ \n"@en'))
    named = c.select(F.concat(F.lit("<cust/"), key, F.lit(">")).alias("s"), F.lit("<v/name>").alias("p"), text.alias("o"))
    placed = c.select(F.concat(F.lit("_:c"), key).alias("s"), F.lit("<v/in>").alias("p"), F.concat(F.lit("<nation/"), F.col("c_nationkey").cast("string"), F.lit(">")).alias("o"))
    path = place(spark, "ntriples")
    N.write_ntriples(named.unionByName(placed).unionByName(placed.withColumn("p", F.lit("_:q"))), path)
    return N.read_ntriples(spark, path, "FAILFAST")


@_query("q_term_kinds", _with("SELECT 'iri' AS kind, count(*) AS n FROM plain WHERE o LIKE '<%' UNION ALL SELECT 'literal', count(*) FROM plain WHERE o LIKE '\"%'"))
def q_term_kinds(spark, d):
    """What a term is, by its first character."""
    kind = F.when(T.is_literal("o"), "literal").when(T.is_blank("o"), "blank").otherwise("iri")
    return M.plain_triples(spark, d).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@_query("q_dictionary_size", _with("SELECT count(*) AS terms FROM (SELECT s AS t FROM ty UNION SELECT p FROM ty UNION SELECT o FROM ty)"))
def q_dictionary_size(spark, d):
    return D.dictionary(M.type_triples(spark, d)).agg(F.count(F.lit(1)).alias("terms"))


@_query("q_rhodf_closure", _with("SELECT s, p, o, count(*) FILTER (WHERE NOT entailed) = 0 AS entailed FROM (SELECT *, FALSE AS entailed FROM given UNION ALL SELECT *, TRUE FROM rho) GROUP BY s, p, o"))
def q_rhodf_closure(spark, d):
    return Reasoner(spark).closure(M.all_triples(spark, d))


@_query("q_rdfs_closure", _with("SELECT s, p, o, count(*) FILTER (WHERE NOT entailed) = 0 AS entailed FROM (SELECT *, FALSE AS entailed FROM given UNION ALL SELECT *, TRUE FROM rdfs) GROUP BY s, p, o"))
def q_rdfs_closure(spark, d):
    return Reasoner(spark, ruleset="rdfs").closure(M.all_triples(spark, d))


@_query("q_class_counts", _with("SELECT o AS class, count(DISTINCT s) AS n FROM ty3 GROUP BY o"))
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Instances of each class after the rho-df closure."""
    every = Reasoner(spark).closure(M.all_triples(spark, d))
    return every.filter(F.col("p") == V.TYPE).groupBy(F.col("o").alias("class")).agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
