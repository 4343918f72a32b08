import pytest

from graphloom.functions.vocab import RDF, XSD
from graphloom.sources.ntriples import read_ntriples, write_ntriples
from graphloom.sources.turtle import Parser, TurtleError, TurtleSource, read_turtle

P = "@prefix : <http://x/> .\n@prefix e: <http://e/> .\n"


def parse(text, **kw):
    return list(Parser(P + text, "f", **kw))


def test_names_lists_and_a():
    got = parse(":a a :B ; :p :c , e:d ; .\n<http://y> e: a .")
    assert got == [
        ("<http://x/a>", f"<{RDF}type>", "<http://x/B>"),
        ("<http://x/a>", "<http://x/p>", "<http://x/c>"),
        ("<http://x/a>", "<http://x/p>", "<http://e/d>"),
        ("<http://y>", "<http://e/>", f"<{RDF}type>"),
    ]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('"a b"', '"a b"'),
        ("'a'", '"a"'),
        ('"""x "y"\nz"""', '"x \\"y\\"\\nz"'),
        ('"two\nlines"', '"two\\nlines"'),
        ('"\\t\\u00e9\\U0001F600\\\\"', '"\\té😀\\\\"'),
        ('"x"@en-GB', '"x"@en-GB'),
        ('"1"^^e:int', '"1"^^<http://e/int>'),
        ('"1"^^<http://e/int>', '"1"^^<http://e/int>'),
        ("12", f'"12"^^<{XSD}integer>'),
        ("-1.25", f'"-1.25"^^<{XSD}decimal>'),
        ("1.5e-3", f'"1.5e-3"^^<{XSD}double>'),
        ("true", f'"true"^^<{XSD}boolean>'),
        ("_:b1", "_:fb1"),
        (":a.b", "<http://x/a.b>"),
        (":7", "<http://x/7>"),
    ],
)
def test_objects(text, want):
    assert parse(f":s :p {text} .") == [("<http://x/s>", "<http://x/p>", want)]


def test_base_and_sparql_forms():
    got = list(Parser("@base <http://h/a/b> .\nPREFIX q: <c#>\nBASE <http://k/>\n<> q:x <../y> ."))
    assert got == [("<http://k/>", "<http://h/a/c#x>", "<http://k/y>")]


def test_blank_nodes_and_collections():
    got = parse(":s :p [ :q :o ; :r [] ] .\n[ :q :z ] .\n() :p (1 :a) .")
    assert ("_:f-1", "<http://x/q>", "<http://x/o>") in got
    assert ("_:f-1", "<http://x/r>", "_:f-2") in got
    assert ("<http://x/s>", "<http://x/p>", "_:f-1") in got
    assert ("_:f-3", "<http://x/q>", "<http://x/z>") in got
    assert ("_:f-4", f"<{RDF}rest>", "_:f-5") in got and ("_:f-5", f"<{RDF}rest>", f"<{RDF}nil>") in got
    assert (f"<{RDF}nil>", "<http://x/p>", "_:f-4") in got


def test_errors():
    bad = ":a :p nope:x .\n:b :p :c .\n:d _:x :e .\n:f :p 'open .\n"
    with pytest.raises(TurtleError, match="line 3"):
        parse(bad)
    p = Parser(P + ":a :p nope:x .\n:b :p :c . \"l\" :p :x .\n:d _:x :e .\n:g :p :h .", permissive=True)
    assert [s for s, _, _ in p] == ["<http://x/b>", "<http://x/g>"]
    assert len(p.errors) == 3
    assert list(Parser("")) == [] and list(Parser("# nothing\n")) == []


def test_files(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(P + ':s :p "é\\n" , _:b .', encoding="utf-8")
    (tmp_path / "b.ttl").write_text(P + ":s :p _:b .\nbroken", encoding="utf-8")
    got = read_turtle(spark, str(tmp_path / "*.ttl"), "PERMISSIVE").collect()
    assert len(got) == 3 and len({r["o"] for r in got}) == 3  # blank labels of two files differ
    with pytest.raises(Exception, match="TurtleError"):
        read_turtle(spark, str(tmp_path / "b.ttl")).collect()
    spark.dataSource.register(TurtleSource)
    assert spark.read.format("turtle").load(str(tmp_path / "a.ttl")).count() == 2
    df = read_turtle(spark, str(tmp_path / "a.ttl"))
    write_ntriples(df, str(tmp_path / "out.nt"))
    assert sorted(read_ntriples(spark, str(tmp_path / "out.nt")).collect()) == sorted(df.collect())


def test_ntriples_modes(spark, tmp_path):
    (tmp_path / "x.nt").write_text('<a> <b> "c\\"d"@en . # note\n\n# c\n<a> <b> .\n_:x <b> <c> .\n')
    assert read_ntriples(spark, str(tmp_path / "x.nt")).count() == 2
    with pytest.raises(Exception, match="not a triple"):
        read_ntriples(spark, str(tmp_path / "x.nt"), "FAILFAST").collect()
