import pytest

from graphloom.functions import terms as T
from graphloom.plans import algebra as A
from graphloom.plans.parser import SyntaxError_, parse_query, parse_update


def body(text):
    return parse_query("PREFIX : <http://e/> " + text).select.pattern


def test_predicates_and_objects_share_subjects():
    p = body("SELECT * { ?s a :C ; :p 1, 2.5, 1e0, true, 'x'@en, \"y\"^^:t . }")
    assert [t.o.key for t in p.triples] == [
        T.iri("http://e/C"), T.literal("1", T.XSD + "integer"), T.literal("2.5", T.XSD + "decimal"), T.literal("1e0", T.XSD + "double"),
        T.literal("true", T.XSD + "boolean"), T.literal("x", lang="en"), T.literal("y", "http://e/t"),
    ]


def test_filter_in_optional_is_its_condition_and_group_filters_come_last():
    p = body("SELECT * { FILTER(?x > 1) ?s :p ?x OPTIONAL { ?s :q ?y FILTER(?y < 3) } }")
    assert isinstance(p, A.Filter) and isinstance(p.pattern, A.LeftJoin) and isinstance(p.pattern.condition, A.Compare)


def test_top_level_sequence_becomes_triples_nested_ones_stay_paths():
    assert len(body("SELECT * { ?s :a/^:b/:c ?o }").triples) == 3
    assert isinstance(body("SELECT * { ?s (:a/:b)* ?o }"), A.PathPattern)
    assert body("SELECT * { ?s !(:a|^:b) ?o }").path == A.Negated(("http://e/a",), ("http://e/b",))


def test_collections_and_blank_nodes():
    p = body("SELECT * { ?s :list (1 ?x) . [ :p _:b ] :q _:b }")
    assert len(p.triples) == 7
    assert all(v.startswith("__") or v in "sx" for v in A.variables(p))


def test_aggregates_having_and_values():
    q = parse_query("SELECT ?a (COUNT(DISTINCT ?b) AS ?n) { ?a <p> ?b } GROUP BY ?a HAVING (COUNT(DISTINCT ?b) > 1 && SUM(?b) < 9) ORDER BY DESC(?n) LIMIT 3 OFFSET 1")
    group = q.select.pattern.pattern.pattern
    assert isinstance(group, A.Group) and len(group.aggregates) == 2
    assert (q.select.limit, q.select.offset) == (3, 1) and q.select.order[0][1]
    assert isinstance(body("SELECT * { ?s ?p ?o } VALUES (?s ?o) { (:a UNDEF) }"), A.Join)


@pytest.mark.parametrize(
    "text, named",
    [
        ("CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }", "CONSTRUCT"), ("DESCRIBE <x>", "DESCRIBE"), ("SELECT * { GRAPH <g> { ?s ?p ?o } }", "GRAPH"),
        ("SELECT * { SERVICE <g> { ?s ?p ?o } }", "SERVICE"), ("SELECT * { ?s ?p ?o FILTER(langMatches(?o, 'en')) }", "LANGMATCHES"),
        ("SELECT (NOW() AS ?x) { }", "NOW"), ("SELECT * { ?s ?p ?o FILTER(<http://f>(?o)) }", "http://f"), ("SELECT * { ?s ?p ?o FILTER(STRBEFORE(?o, 'a') = 'b') }", "STRBEFORE"),
        ("SELECT (MIN(?x + 1) AS ?m) { ?s ?p ?x }", "MIN"), ("SELECT ?y (COUNT(*) AS ?n) { ?s ?p ?x } GROUP BY ?x", "?y"), ("SELECT * { ?s x:p ?o }", "x:"), ("SELECT * { ?s ?p }", "term"),
        ("SELECT * { ?s ?p ?o . BIND(1 AS ?o) }", "?o"),
    ],
)
def test_what_is_not_supported_is_named(text, named):
    with pytest.raises(SyntaxError_) as e:
        parse_query(text)
    assert named in str(e.value)


def test_updates():
    changes = parse_update("PREFIX : <http://e/> INSERT DATA { :a :p 1 ; :q 'x' } ; DELETE DATA { :a :p 1 }")
    assert [c.insert for c in changes] == [True, False] and len(changes[0].triples) == 2
    for bad in ("INSERT DATA { _:b <p> 1 }", "DELETE WHERE { ?s ?p ?o }", "LOAD <x>", "INSERT DATA { ?s <p> 1 }"):
        with pytest.raises(SyntaxError_):
            parse_update(bad)
