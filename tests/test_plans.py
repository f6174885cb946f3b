"""Plans that must not fall back: join order of cycles, seeded closures, inference without idle rules."""

from graphloom import tables
from graphloom.engine import Engine
from graphloom.operators import paths
from graphloom.sources.graph import Graph, Store

SF = "/root/testdata/sf0.001"


def nodes(plan):
    yield plan
    kids = plan.children()
    for i in range(kids.size()):
        yield from nodes(kids.apply(i))


def columns(plan):
    return {c.split("#")[0] for n in nodes(plan) if not n.children().size() for c in n.output().mkString(",").split(",")}


def test_a_cycle_is_not_closed_by_a_product(spark):
    plan = tables.QUERIES["bgp_cycle"](spark, SF)._jdf.queryExecution().optimizedPlan()
    joins = [columns(n) for n in nodes(plan) if n.nodeName().startswith("Join")]
    assert len(joins) == 3 and all("l_suppkey" in c for c in joins if {"c_custkey", "s_suppkey"} <= c)


def test_counted_graphs_start_with_the_rare_predicate(spark, tmp_path):
    triples = [(f"s{i}", "often", f"o{i % 7}") for i in range(400)] + [(f"s{i}", "type", "t") for i in range(400)] + [("s5", "rare", "x")]
    store = Store.create(Graph.of_names(spark, triples, "http://e/"), str(tmp_path / "store"))
    store.update("INSERT DATA { <http://e/s5> <http://e/more> <http://e/y> }")
    store.checkpoint()
    graph = store.graph()
    assert graph.counts["I\u0001http://e/rare"] == 1 and "pb" in graph.triples.columns
    text = "SELECT ?s ?o WHERE { ?s <http://e/often> ?o ; <http://e/type> ?t ; <http://e/rare> ?x }"
    from graphloom.plans.parser import parse_query
    from graphloom.sources.base import in_order

    units = [graph.scan(t) for t in parse_query(text).select.pattern.triples]
    assert in_order(units)[0] is units[2]
    assert len(Engine(graph).query(text).rows()) == 1
    store.update("DELETE DATA { <http://e/s5> <http://e/more> <http://e/y> }")
    changed = store.graph()
    assert "pb" in changed.triples.columns and Engine(changed).query("SELECT ?o WHERE { ?s <http://e/more> ?o }").count() == 0


def test_a_closure_beside_a_pattern_is_seeded(spark, monkeypatch):
    edges = [(f"n{i}", "next", f"n{i + 1}") for i in range(30)] + [("n7", "mark", "here"), ("n20", "mark", "here")]
    engine = Engine(Graph.of_names(spark, edges, "http://e/"))
    seen = []
    real = paths.Paths.closure
    monkeypatch.setattr(paths.Paths, "closure", lambda self, e, seeds: (seen.append(seeds), real(self, e, seeds))[1])
    monkeypatch.setattr(paths, "LOCAL_EDGES", -1)  # by joins, not on the driver
    for text, starts, count in (
        ("SELECT ?a ?b WHERE { ?a <http://e/mark> ?m . ?a <http://e/next>+ ?b }", 2, 23 + 10),
        ("SELECT ?a ?b WHERE { ?a <http://e/next>* ?b . ?b <http://e/mark> ?m }", 2, 8 + 21),
    ):
        seen.clear()
        assert engine.query(text).count() == count
        assert len(seen) == 1 and seen[0] is not None and seen[0].df.count() == starts
    seen.clear()
    assert engine.query("SELECT ?a ?b WHERE { ?a <http://e/next>+ ?b }").count() == 30 * 31 // 2 and seen == [None]


def test_inference_has_no_idle_branches(spark):
    import re

    df = tables.QUERIES["infer_subclass"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"LogicalRDD|Relation \[", plan)) <= 12
    plain = Engine(Graph.of_names(spark, [("a", "p", "b")], "http://e/")).query("SELECT ?x WHERE { ?x <http://e/p> ?y }", infer="rdfs")
    assert "Union" not in plain.df()._jdf.queryExecution().optimizedPlan().toString()


def test_exists_in_an_optional_filter_and_in_a_sum(spark):
    triples = [(f"a{i}", "p", f"b{i % 3}") for i in range(6)] + [("b0", "ok", "x"), ("b2", "ok", "x"), ("a1", "q", "z")]
    engine = Engine(Graph.of_names(spark, triples, "http://e/"))
    rows = engine.query("SELECT ?a ?b WHERE { ?a <http://e/p> ?any OPTIONAL { ?a <http://e/p> ?b FILTER(EXISTS { ?b <http://e/ok> ?x }) } }").rows()
    assert sorted((r["a"][-2:], r.get("b", "--")[-2:]) for r in rows) == [("a0", "b0"), ("a1", "--"), ("a2", "b2"), ("a3", "b0"), ("a4", "--"), ("a5", "b2")]
    total = engine.query("SELECT (SUM(IF(EXISTS { ?b <http://e/ok> ?x }, 10, 1)) AS ?n) WHERE { ?a <http://e/p> ?b }").df({"n": "double"}).first().n
    assert total == 42
