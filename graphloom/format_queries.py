"""Registered queries of what no table query shows: files and formats, results, accessors, limits, refused constructs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .engine import Engine
from .functions import terms as T
from .operators.frame import shared_dir
from .plans.parser import parse_update
from .sources import results
from .sources.graph import Graph
from .sources.ntriples import export_names, parse_lines, read_ntriples, write_ntriples
from .sources.synthetic import synthetic
from .tables import BASE, PREFIXES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/graphloom/{uuid.uuid4().hex}/{name}"


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet")


# -- N-Triples


@registered(f"select n_nationkey::bigint n, n_name x from nation union all select n_nationkey::bigint, '{BASE}region/' || n_regionkey from nation")
def ntriples_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small file's lines parsed to a list of triples on the driver."""
    path = _path(spark, "nations.nt")
    n = _nation(spark, sf_dir)
    s = F.concat(F.lit(f"I{T.SEP}{BASE}nation/"), F.col("n_nationkey").cast("string")).alias("s")
    rows = n.select(s, F.lit(T.iri(BASE + "name")).alias("p"), F.concat(F.lit("L" + T.SEP), "n_name").alias("o"))
    rows = rows.union(n.select(s, F.lit(T.iri(BASE + "in")), F.concat(F.lit(f"I{T.SEP}{BASE}region/"), F.col("n_regionkey").cast("string"))))
    write_ntriples(rows, path)
    text = "\n".join(r[0] for r in spark.read.text(path).collect())
    graph = Graph.of(spark, parse_lines("# a comment\n\nnot a triple .\n" + text))
    return Engine(graph).select("SELECT ?n ?x WHERE { ?n ?p ?x }", {"n": "local", "x": "string"})


@registered(f"select '{BASE}' || n_name s, '{BASE}in' p, '{BASE}' || replace(r_name, ' ', '_') o from nation join region on n_regionkey = r_regionkey")
def export_bare_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three bare names written as N-Triples and read again."""
    path = _path(spark, "names.nt")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    names = _nation(spark, sf_dir).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.lit("in").alias("p"), F.regexp_replace("r_name", " ", "_"))
    export_names(names, path, BASE)
    return Engine(Graph(spark, read_ntriples(spark, path))).select("SELECT ?s ?p ?o WHERE { ?s ?p ?o }", {v: "string" for v in "spo"})


# -- Turtle: each nation is a document


def _documents(spark: SparkSession, sf_dir: str, *parts: str, whole: bool = False) -> str:
    """A folder of Turtle files, one for each nation or (whole) one for all: parts with {k}, {name} and {r} filled in."""
    path = _path(spark, "nations.TTL")
    text: Column = F.lit("".join(parts))
    for mark, value in (("{k}", F.col("n_nationkey").cast("string")), ("{r}", F.col("n_regionkey").cast("string")), ("{name}", F.col("n_name"))):
        text = F.replace(text, F.lit(mark), value)
    rows = _nation(spark, sf_dir).select(text.alias("value"))
    (rows.coalesce(1).write if whole else rows.write.option("maxRecordsPerFile", 1)).text(path)
    return path


def _turtle(spark: SparkSession, sf_dir: str, sparql: str, types: dict[str, str], *parts: str, whole: bool = False) -> DataFrame:
    return Engine(Graph.load(spark, _documents(spark, sf_dir, *parts, whole=whole))).select(PREFIXES + sparql, types)


@registered("select n_nationkey::bigint n, n_name as name, n_regionkey::bigint r from nation")
def turtle_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turtle(
        spark, sf_dir, "SELECT ?n ?name ?r WHERE { ?n <http://a.example/p#name> ?name ; <http://b.example/in> ?r }", {"n": "local", "r": "local"},
        "@prefix a: <http://a.example/p#> .\n@base <http://b.example/> .\npReFiX n: <http://c.example/nation/>\n",
        'n:{k} a:name "{name}" .\nBASE <http://d.example/>\nPREFIX a: <http://b.example/>\n<region> a:same <region> . n:{k} a:in <{r}> .\n',
    )


@registered("select n_nationkey::bigint n, x from nation, lateral (select unnest([n_name, n_name || '!', 'nation']) x)")
def turtle_lists_of_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turtle(
        spark, sf_dir, "SELECT ?n ?x WHERE { ?n ?p ?y BIND(REPLACE(STR(?y), \"^.*/\", \"\") AS ?x) }", {"n": "local", "x": "string"},
        f'@prefix : <{BASE}> .\n<{BASE}nation/{{k}}> a :nation ; # a comment\n :name "{{name}}" , "{{name}}!" ;\n ; .\n',
    )


@registered("select n_nationkey::bigint n, n_regionkey::bigint r, n_name || '-a' one, n_name || '-b' two, true ends from nation")
def turtle_blank_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turtle(
        spark, sf_dir,
        "SELECT ?n ?r ?one ?two ?ends WHERE { ?n :is ?b . ?b :in ?r ; :items ?l . ?l rdf:first ?one ; rdf:rest ?m . ?m rdf:first ?two ; rdf:rest ?e BIND(isBlank(?b) && isBlank(?l) && ?e = rdf:nil AS ?ends) }",
        {"n": "local", "r": "local", "ends": "boolean"},
        f'@prefix : <{BASE}> .\n<{BASE}nation/{{k}}> :is [ :in <{BASE}region/{{r}}> ; :items ( "{{name}}-a" "{{name}}-b" ) ] .\n[] :other () . [ :alone true ] .\n',
        whole=True,  # nodes without labels are told apart inside a document
    )


@registered(
    "select n_nationkey::bigint n, x, t from nation, lateral (select unnest([n_name || ' ''one''', 'two' || chr(10) || n_name, 'tab' || chr(9) || 'é', n_nationkey::varchar, n_nationkey || '.5', '2.5e1', 'true', n_name, '2020-01-01']) x, "
    "unnest(['string', 'string', 'string', 'integer', 'decimal', 'double', 'boolean', 'en', 'date']) t)"
)
def turtle_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = Graph.load(spark, _documents(
        spark, sf_dir, f"@prefix : <{BASE}> . @prefix xsd: <{T.XSD}> .\n<{BASE}nation/{{k}}> :v '{{name}} \\'one\\'' , \"\"\"two\n{{name}}\"\"\" , \"tab\\t\\u00e9\" , {{k}} , {{k}}.5 , 2.5e1 , true , \"{{name}}\"@en , \"2020-01-01\"^^xsd:date .\n",
    ))
    tag = F.substring("o", F.lit(2), F.locate(T.SEP, F.col("o")) - 2)
    of = F.when(F.substring("o", 1, 1) == "L", "string").otherwise(F.regexp_replace(tag, "^.*#", ""))
    return graph.triples.select(F.regexp_extract("s", "([^/]*)$", 1).cast("bigint").alias("n"), T.lexical(F.col("o"), T.KEY).alias("x"), of.alias("t"))


@registered("select n_nationkey::bigint n, x from nation, lateral (select unnest(['http://h.example/a/b/c' || n_nationkey, 'http://h.example/a/up', 'http://h.example/root', 'http://h.example/a/b/doc?q=1', 'http://h.example/a/b/doc#part', 'http://other.example/z', 'http://full.example/x']) x)")
def turtle_relative_iris(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turtle(
        spark, sf_dir, "SELECT ?n ?x WHERE { ?s ?n0 ?y BIND(REPLACE(STR(?s), \"^.*/\", \"\") AS ?n) BIND(STR(?y) AS ?x) }", {"n": "long", "x": "string"},
        f"@base <http://h.example/a/b/doc> .\n<{BASE}nation/{{k}}> <{BASE}p> <c{{k}}> , <../up> , </root> , <?q=1> , <#part> , <//other.example/z> , <http://full.example/x> .\n",
    )


@registered("select n_nationkey::bigint n, n_name as name, n_regionkey::bigint r from nation")
def load_mixed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turtle and N-Triples files loaded as one graph, told apart by their names."""
    ttl = _documents(spark, sf_dir, f'@prefix : <{BASE}> .\n<{BASE}nation/{{k}}> :name "{{name}}" .\n')
    nt = _path(spark, "regions.nt")
    n = _nation(spark, sf_dir)
    node = lambda kind, c: F.concat(F.lit(f"I{T.SEP}{BASE}{kind}/"), F.col(c).cast("string"))
    write_ntriples(n.select(node("nation", "n_nationkey").alias("s"), F.lit(T.iri(BASE + "in")).alias("p"), node("region", "n_regionkey").alias("o")), nt)
    return Engine(Graph.load(spark, [ttl, nt])).select(PREFIXES + "SELECT ?n ?name ?r WHERE { ?n :name ?name ; :in ?r }", {"n": "local", "r": "local"})


# -- accessors


@registered(
    f"""select 'objects_of' what, '{BASE}nation/' || c_nationkey x from customer where c_custkey = 3
    union all select 'subjects_of', '{BASE}customer/' || c_custkey from customer where c_nationkey = 3
    union all select 'subjects_with_predicate', '{BASE}customer/' || c_custkey from customer
    union all select 'objects_with_predicate', '{BASE}nation/' || c_nationkey from customer group by c_nationkey
    union all select 'po_pairs_of', '{BASE}nation/' || c_nationkey from customer, range(2) where c_custkey = 4
    union all select 'sp_pairs_of', '{BASE}customer/' || c_custkey from customer, range(2) where c_nationkey = 2
    union all select 'distinct_subjects', '{BASE}customer/' || c_custkey from customer
    union all select 'distinct_objects', '{BASE}region/' || n_regionkey from nation group by n_regionkey
    union all select 'has_predicate', x from (values ('true'), ('false')) v(x)
    union all select 'intersect_objects', '{BASE}nation/' || a.c_nationkey from customer a join customer b using (c_nationkey) where a.c_custkey = 5 and b.c_custkey = 5
    union all select 'join_chain', '{BASE}customer/' || c_custkey from customer join nation on c_nationkey = n_nationkey where n_regionkey = 2"""
)
def accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each accessor of a graph gives for one shape."""
    g = tables._nations(spark, sf_dir)
    lives, kind, sub = T.iri(BASE + "livesIn"), T.iri(T.RDF + "type"), T.iri(T.RDFS + "subClassOf")
    one = lambda name, k: T.iri(f"{BASE}{name}/{k}")
    found = {
        "objects_of": g.objects_of(one("customer", 3), lives),
        "subjects_of": g.subjects_of(lives, one("nation", 3)),
        "subjects_with_predicate": g.subjects_with_predicate(lives),
        "objects_with_predicate": g.objects_with_predicate(lives),
        "po_pairs_of": g.po_pairs_of(one("customer", 4)).select("o"),
        "sp_pairs_of": g.sp_pairs_of(one("nation", 2)).where(F.col("p").isin(lives, kind)).select("s"),
        "distinct_subjects": g.distinct_subjects().where(F.contains("s", F.lit("/customer/"))),
        "distinct_objects": g.distinct_objects().where(F.contains("o", F.lit("/region/"))),
        "has_predicate": spark.createDataFrame([(f"L{T.SEP}{str(g.has_predicate(p)).lower()}",) for p in (lives, T.iri(BASE + "none"))], "x string"),
        "intersect_objects": g.intersect_objects(one("customer", 5), lives, one("customer", 5), kind),
        "join_chain": g.join_chain(lives, sub, one("region", 2)).select("x"),
    }
    out = None
    for what, df in found.items():
        part = df.select(F.lit(what).alias("what"), T.lexical(F.col(df.columns[0]), T.KEY).alias("x"))
        out = part if out is None else out.union(part)
    return out


@registered("select 40::bigint predicates, true triangles, true chains, true same")
def synthetic_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic graph has the predicates asked for, closes at least the planted triangles and chains, and is the same each time."""
    size = dict(entities=3000, predicates=40, triples=8000, triangles=150, chains=250)
    g, again = synthetic(spark, **size), synthetic(spark, **size)
    p = [f"<{BASE}predicate_{i}>" for i in range(3)]
    triangles = Engine(g).select(f"SELECT (COUNT(*) AS ?n) WHERE {{ ?a {p[0]} ?b . ?b {p[0]} ?c . ?c {p[0]} ?a }}", {"n": "long"})
    chains = Engine(g).select(f"SELECT (COUNT(*) AS ?n) WHERE {{ ?a {p[0]} ?b . ?b {p[1]} ?c . ?c {p[2]} ?d }}", {"n": "long"})
    counts = g.triples.agg(F.count_distinct("p").alias("predicates"))
    apart = g.triples.join(again.triples, ["s", "p", "o"], "left_anti").agg((F.count("*") == 0).alias("same"))
    # a planted triangle is found from each of its three corners
    return counts.crossJoin(triangles.select((F.col("n") >= 3 * 140).alias("triangles"))).crossJoin(chains.select((F.col("n") >= 240).alias("chains"))).crossJoin(apart)


# -- results

_RESULT = "SELECT ?n ?name ?k WHERE { ?n nation:n_name ?name OPTIONAL { ?n nation:n_nationkey ?k FILTER(?k < 10) } }"
_RESULT_SQL = f"select '{BASE}nation/' || n_nationkey n, n_name as name, case when n_nationkey < 10 then n_nationkey::varchar end k, case when n_nationkey < 10 then '{T.XSD}integer' end kind from nation"
_ROW = "struct<n:struct<type:string,value:string>,name:struct<type:string,value:string>,k:struct<type:string,value:string,datatype:string>>"


@registered(_RESULT_SQL)
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPARQL-JSON, read back."""
    d = json.loads(tables.engine(spark, sf_dir).query(PREFIXES + _RESULT).json())
    assert d["head"]["vars"] == ["n", "name", "k"]
    rows = [(b["n"]["value"], b["name"]["value"], b.get("k", {}).get("value"), b.get("k", {}).get("datatype")) for b in d["results"]["bindings"]]
    return spark.createDataFrame(rows, "n string, name string, k string, kind string")


@registered(_RESULT_SQL)
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newline-delimited JSON written by the executors, read back."""
    r = tables.engine(spark, sf_dir).query(PREFIXES + _RESULT)
    path = _path(spark, "rows")
    results.write_ndjson(r.frame, r.vars, path)
    d = spark.read.text(path).select(F.from_json("value", _ROW).alias("d"))
    return d.select("d.n.value", "d.name.value", "d.k.value", "d.k.datatype").toDF("n", "name", "k", "kind")


@registered("select (select count(*) from orders) n, (select count(*) > 0 from customer where c_acctbal > 9990) ask")
def result_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count of a result without its rows; ASK as a truth value."""
    e = tables.engine(spark, sf_dir)
    n = json.loads(e.query(PREFIXES + "SELECT ?o WHERE { ?o orders:o_custkey ?c }").count_json())["count"]
    ask = json.loads(e.query(PREFIXES + "ASK { ?c customer:c_acctbal ?b FILTER(?b > 9990) }").count_json())["boolean"]
    return spark.createDataFrame([(n, ask)], "n long, ask boolean")


@registered("select * from (values (1::bigint, 25::bigint, 1::bigint), (2, 25, 1), (3, 5, 2), (4, 5, 2), (5, 25, 2)) v(step, n_rows, kept)")
def response_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of two texts: repeated queries add none, the oldest goes."""
    e = Engine(tables.source(spark, sf_dir), cache=2)
    texts = ["SELECT ?n WHERE { ?n nation:n_name ?x }", "SELECT ?n WHERE { ?n nation:n_name ?x }", "SELECT ?r WHERE { ?r region:r_name ?x }", "SELECT ?r WHERE { ?r region:r_name ?x }", "SELECT ?x WHERE { ?n nation:n_name ?x }"]
    rows = [(i, len(json.loads(e.json(PREFIXES + t))["results"]["bindings"]), len(e._cache)) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "step long, n_rows long, kept long")


@registered("select 25::bigint cap, count(*) n, false refused from nation union all select 24, null, true")
def row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result longer than the cap is an error, not a shorter result."""
    rows = []
    for cap in (25, 24):
        try:
            rows.append((cap, Engine(tables.source(spark, sf_dir), cap=cap).query(PREFIXES + "SELECT ?n WHERE { ?n nation:n_name ?x }").count(), False))
        except ValueError:
            rows.append((cap, None, True))
    return spark.createDataFrame(rows, "cap long, n long, refused boolean")


#: Construct -> (text, word of the message that names it); all are refused before any row.
REFUSED = {
    "custom aggregate": ("SELECT (<http://e/agg>(?x) AS ?y) WHERE { ?s ?p ?x }", ""),
    "expression in MIN": ("SELECT (MIN(?x + 1) AS ?y) WHERE { ?s ?p ?x }", "MIN"),
    "expression in COUNT": ("SELECT (COUNT(?x + 1) AS ?y) WHERE { ?s ?p ?x }", "COUNT"),
    "expression in SAMPLE": ("SELECT (SAMPLE(STR(?x)) AS ?y) WHERE { ?s ?p ?x }", "SAMPLE"),
    "function": ("SELECT ?s WHERE { ?s ?p ?x FILTER(NOW() > ?x) }", "NOW"),
    "CONSTRUCT": ("CONSTRUCT { ?s ?p ?x } WHERE { ?s ?p ?x }", "CONSTRUCT"),
    "DESCRIBE": ("DESCRIBE <http://e/x>", "DESCRIBE"),
    "SERVICE": ("SELECT ?s WHERE { SERVICE <http://e/x> { ?s ?p ?x } }", "SERVICE"),
    "GRAPH": ("SELECT ?s WHERE { GRAPH ?g { ?s ?p ?x } }", "GRAPH"),
    "unknown variable": ("SELECT ?z WHERE { ?s ?p ?x }", "z"),
}
REFUSED_UPDATES = {"CLEAR": "CLEAR ALL", "LOAD": "LOAD <http://e/x>", "DELETE WHERE": "DELETE WHERE { ?s ?p ?o }", "INSERT with a pattern": "INSERT { ?s ?p 1 } WHERE { ?s ?p 2 }"}


@registered("select * from (values " + ", ".join(f"('{k}', true)" for k in [*REFUSED, *REFUSED_UPDATES]) + ") v(construct, refused)")
def refused_constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constructs that are not supported are errors that name them, whatever the data."""
    g = Graph.of_names(spark, [("a", "b", "c")], BASE)
    rows = []
    for name, (text, word) in REFUSED.items():
        try:
            Engine(g).query(text)
            rows.append((name, False))
        except ValueError as e:
            rows.append((name, word in str(e)))
    for name, text in REFUSED_UPDATES.items():
        try:
            parse_update(text)
            rows.append((name, False))
        except ValueError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "construct string, refused boolean")
