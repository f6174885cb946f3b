import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.functions import terms as T
from graphloom.sources.ntriples import export_names, parse_line, parse_lines, read_ntriples, write_ntriples
from graphloom.sources.turtle import TurtleError, parse_turtle, read_turtle

A, B, P = (T.iri("http://e/" + x) for x in "abp")


@pytest.mark.parametrize(
    "line, out",
    [
        ("<http://e/a> <http://e/p> <http://e/b> .", (A, P, B)),
        ("  _:x <http://e/p> \"a\\tb\\u00e9\\U0001F600\\\\\" .\t", (T.blank("x"), P, T.literal("a\tbé😀\\"))),
        ('<http://e/a> <http://e/p> "x"@en-GB .', (A, P, T.literal("x", lang="en-GB"))),
        ('<http://e/a> <http://e/p> "x"^^<http://www.w3.org/2001/XMLSchema#string> .', (A, P, T.literal("x"))),
        ('"s" <http://e/p> "1"^^<http://t> .', (T.literal("s"), P, T.literal("1", "http://t"))),
        ("<http://e/a\\u0020b> <http://e/p> _:y .", (T.iri("http://e/a b"), P, T.blank("y"))),
        ("# comment", None), ("", None), ("<a> <b> <c>", None), ("<a> <b> <c> . # later", None), ('<a> <b> "x"@en.', None), ("<a> <b> _:b.", None),
        ("<a> <b> 'x' .", None), ('<a> <b> "x\\q" .', None), ('<a> <b> "\\uD800" .', None), ("<a> <b> <c> <d> .", None), ("<a> <b> <c> ..", None),
    ],
)
def test_ntriples_lines(line, out):
    assert parse_line(line) == out


TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=12)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("IBLGD"), TEXT), min_size=1, max_size=30))
def test_serialised_terms_parse_back(spark, parts):
    keys = []
    for kind, text in parts:
        if kind == "B":
            text = "b" + "".join(c for c in text if c.isalnum())
        keys.append({"I": T.iri(text.replace(">", "")), "B": T.blank(text), "L": T.literal(text), "G": T.literal(text, lang="en-x"), "D": T.literal(text, "http://t#a b")}[kind])
    from graphloom.sources.ntriples import lines_of

    rows = [(A, P, k) for k in keys]
    lines = [r[0] for r in lines_of(spark.createDataFrame(rows, "s string, p string, o string")).collect()]
    assert all("\n" not in x for x in lines)
    assert [parse_line(x) for x in lines] == rows


def test_files_round_trip(spark, tmp_path):
    rows = [(A, P, T.literal("x\n\"y\"")), (B, P, T.literal("z", lang="de"))]
    write_ntriples(spark.createDataFrame(rows, "s string, p string, o string"), str(tmp_path / "out"))
    (tmp_path / "in.nt").write_text("<http://e/a> <http://e/p> <http://e/b> .\nrubbish\n<http://e/a> <http://e/p> <http://e/b> .\n")
    assert sorted(map(tuple, read_ntriples(spark, str(tmp_path / "out")).collect())) == sorted(rows)
    assert [tuple(r) for r in read_ntriples(spark, str(tmp_path / "in.nt")).collect()] == [(A, P, B)]
    export_names(spark.createDataFrame([("a", "p", "b")], "s string, p string, o string"), str(tmp_path / "names"), "http://e/")
    assert [tuple(r) for r in read_ntriples(spark, str(tmp_path / "names")).collect()] == [(A, P, B)]
    assert parse_lines("x\n") == []


def test_turtle_shorthand():
    got = parse_turtle("""﻿@prefix : <http://e/> . PREFIX e: <http://e/> @base <http://base/x/> .
        :a a :C ; :p 1, -2.5, 3e1, true, false ; ; :q "x"@en, 'y'^^e:t, \"\"\"long "q" \"\"\", '''it's''' .  # comment
        <#f> :p <../y>, <z>, <> . e:prefixed :p _:x, _:_y . [ :p () ] . :s :p ( 1 [ :q 2 ] ) .""")
    objects = [o for _, _, o in got]
    for k in (
        T.literal("1", T.XSD + "integer"), T.literal("-2.5", T.XSD + "decimal"), T.literal("3e1", T.XSD + "double"), T.literal("true", T.XSD + "boolean"), T.literal("x", lang="en"),
        T.literal("y", "http://e/t"), T.literal('long "q" '), T.literal("it's"), T.iri("http://base/y"), T.iri("http://base/x/z"), T.iri("http://base/x/"), T.blank("x"), T.blank("__y"), T.iri(T.RDF + "nil"),
    ):
        assert k in objects, k
    assert (T.iri("http://base/x/#f"), P, T.iri("http://base/x/z")) in got
    assert sum(p == T.iri(T.RDF + "first") for _, p, _ in got) == 2


@pytest.mark.parametrize("text, line", [("@prefix : <http://e/> .\n:a :b \n", 3), (":a :b :c .", 1), ('<a> <b> "x .', 1), ("<a> <b> <c>\n<d>", 2), ("\n\n<a> <b> '\\q' .", 3), ("[" * 200, 1)])
def test_turtle_errors_name_the_line(text, line):
    with pytest.raises(TurtleError, match=f"line {line}:"):
        parse_turtle(text)


def test_turtle_files(spark, tmp_path):
    (tmp_path / "x.TTL").write_text("<http://e/a> <http://e/p> <http://e/b>, <http://e/b> .")
    from graphloom.sources.graph import Graph

    assert [tuple(r) for r in Graph.load(spark, str(tmp_path / "x.TTL")).triples.collect()] == [(A, P, B)]
    assert read_turtle(spark, str(tmp_path)).count() == 1


def test_lines_are_read_as_the_parser_reads_them(spark):
    """The scan, whichever way a line takes, gives the triples of the line parser."""
    import random

    from graphloom.sources.ntriples import read_lines

    rnd = random.Random(11)
    tokens = ["<http://e/a>", "<>", "<a b>", "<http://e/\\u00e9>", "_:b", "_:", "_:b.", '"x y"', '""', '"x"@en', '"x"@', '"é"@de-AT.', '"1"^^<http://www.w3.org/2001/XMLSchema#integer>', '"s"^^<http://www.w3.org/2001/XMLSchema#string>',
              '"t"^^<>', '"u"^^', '"q\\"r"', '"n\\n"', '"bad\\x"', "<open", '"open', "word", "#", "."]
    gaps = ["", " ", "  ", "\t", " \u00a0", "\x0b", " \u3000 "]
    lines = ["", "# comment", " <a> <b> <c> . ", "<a><b><c>.", "<a> <b> <c> . # no", "<a> <b> <c>", "_:a<b> <c> <d> ."]
    for _ in range(4000):
        n = rnd.choice([2, 3, 3, 3, 3, 4])
        body = "".join(rnd.choice(gaps[:4] if rnd.random() < 0.8 else gaps) + (rnd.choice(tokens[:15]) if rnd.random() < 0.9 else rnd.choice(tokens)) for _ in range(n))
        lines.append(body + rnd.choice([" .", ".", " . ", "", " ..", "\t.\t"]))
    want = sorted(t for t in map(parse_line, lines) if t)
    got = sorted(map(tuple, read_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()))
    assert got == want and len(want) > 500
