"""The driver's tables as a graph, and one query for each operator family, as SPARQL and as SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .functions import terms as T
from .sources.graph import Graph
from .sources.mapped import Mapped, Property, Table, Unopened, auto_table

BASE = "http://example.org/"
PREFIXES = (
    "".join(f"PREFIX {n}: <{BASE}{n}#> PREFIX {n}s: <{BASE}{n}/> " for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "event", "doc", "page", "item", "turn", "vec"))
    + f"PREFIX : <{BASE}> PREFIX xsd: <{T.XSD}> PREFIX rdf: <{T.RDF}> PREFIX rdfs: <{T.RDFS}> "
)


def source(spark: SparkSession, sf_dir: str) -> Mapped:
    """The tables of a directory; each is opened when a query reads it."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def table(name: str, key: str, foreign: dict[str, str] | None = None, as_: str | None = None) -> Unopened:
        own = as_ or name
        return Unopened(f"{BASE}{own}#", (f"{BASE}{own}",), lambda: auto_table(read(name), own, key, BASE, foreign))

    def lineitem() -> Table:
        # rows of lineitem have no key: its subject is a digest of the row, computed only if a query shows it
        df = read("lineitem")
        whole_row = "md5(concat_ws('\u0002', " + ", ".join(f"cast(`{c}` as string)" for c in df.columns) + "))"
        return auto_table(df, "lineitem", "l_orderkey", BASE, {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}, subject=Property(whole_row, T.Shape("iri", f"{BASE}lineitem/")))

    this_turn = Property("concat(cast(conv_id as string), '/', cast(turn as string))", T.Shape("iri", f"{BASE}turn/"))

    def labels() -> Table:
        out = auto_table(read("labels"), "doc", "doc_id", BASE, skip=("doc_id",))
        out.types = ()
        return out

    def edges() -> Table:
        # the edge to the next turn exists where that turn does
        turns = read("conversations")
        following = Property("concat(cast(conv_id as string), '/', cast(turn + 1 as string))", T.Shape("iri", f"{BASE}turn/"))
        last = turns.groupBy("conv_id").agg({"turn": "max"}).withColumnRenamed("max(turn)", "last_turn").withColumnRenamed("conv_id", "c")
        steps = turns.join(last, turns["conv_id"] == last["c"]).where("turn < last_turn").select("conv_id", "turn")
        return Table(steps, this_turn, {f"{BASE}turn#next": following}, (), 1e7, {"unique": True})

    return Mapped(
        spark,
        [
            table("region", "r_regionkey"),
            table("nation", "n_nationkey", {"n_regionkey": "region"}),
            table("customer", "c_custkey", {"c_nationkey": "nation"}),
            table("supplier", "s_suppkey", {"s_nationkey": "nation"}),
            table("part", "p_partkey"),
            table("orders", "o_orderkey", {"o_custkey": "customer"}),
            Unopened(f"{BASE}lineitem#", (f"{BASE}lineitem",), lineitem),
            table("events", "event_id", as_="event"),
            table("documents", "doc_id", as_="doc"),
            Unopened(f"{BASE}doc#", (), labels),
            table("pages", "page_id", as_="page"),
            table("benchmark", "item_id", as_="item"),
            table("embeddings", "vec_id", as_="vec"),
            Unopened(f"{BASE}turn#", (f"{BASE}turn",), lambda: auto_table(read("conversations"), "turn", "conv_id", BASE, subject=this_turn)),
            Unopened(f"{BASE}turn#next", (), edges),
        ],
    )


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(source(spark, sf_dir))


#: Name -> (SPARQL, types of the result's columns, SQL).
FAMILIES: dict[str, tuple[str, dict[str, str], str]] = {}


def family(name: str, sparql: str, types: dict[str, str], sql: str) -> None:
    FAMILIES[name] = (sparql, types, sql)


family(
    "flagship_orders_of_nation",
    'SELECT ?c ?o ?total WHERE { ?n nation:n_name "NATION_3" . ?c customer:c_nationkey ?n . ?o orders:o_custkey ?c ; orders:o_totalprice ?total FILTER(?total > 150000) }',
    {"c": "local", "o": "local", "total": "double"},
    "select c_custkey c, o_orderkey o, o_totalprice total from nation join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey where n_name = 'NATION_3' and o_totalprice > 150000",
)
family("bgp_single", "SELECT ?c ?seg WHERE { ?c customer:c_mktsegment ?seg }", {"c": "local", "seg": "string"}, "select c_custkey c, c_mktsegment seg from customer where c_mktsegment is not null")
family(
    "bgp_star", "SELECT ?c ?name ?bal ?seg WHERE { ?c customer:c_name ?name ; customer:c_acctbal ?bal ; customer:c_mktsegment ?seg ; a :customer }", {"c": "local"},
    "select c_custkey c, c_name name, c_acctbal bal, c_mktsegment seg from customer",
)
family(
    "bgp_chain", "SELECT ?r ?name ?o WHERE { ?n nation:n_regionkey ?r ; nation:n_name ?name . ?c customer:c_nationkey ?n . ?o orders:o_custkey ?c }", {"r": "local", "o": "local"},
    "select n_regionkey::bigint r, n_name name, o_orderkey o from nation join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey",
)
family(
    "bgp_cycle",
    "SELECT ?c ?n ?s ?o WHERE { ?c customer:c_nationkey ?n . ?s supplier:s_nationkey ?n . ?l lineitem:l_suppkey ?s ; lineitem:l_orderkey ?o . ?o orders:o_custkey ?c }",
    {v: "local" for v in "cnso"},
    "select c_custkey c, n_nationkey::bigint n, s_suppkey s, o_orderkey o from customer join nation on c_nationkey = n_nationkey join supplier on s_nationkey = n_nationkey join lineitem on l_suppkey = s_suppkey join orders on o_orderkey = l_orderkey and o_custkey = c_custkey",
)
family("bgp_constant_subject", "SELECT ?name ?seg WHERE { customers:7 customer:c_name ?name ; customer:c_mktsegment ?seg }", {}, "select c_name name, c_mktsegment seg from customer where c_custkey = 7")
family("bgp_any_predicate", "SELECT ?p ?v WHERE { nations:3 ?p ?v }", {"p": "string", "v": "string"}, f"select * from (select '{BASE}nation#n_nationkey' p, '3' v union all select '{BASE}nation#n_name', n_name from nation where n_nationkey = 3 union all select '{BASE}nation#n_regionkey', '{BASE}region/' || n_regionkey from nation where n_nationkey = 3 union all select '{T.RDF}type', '{BASE}nation')")
family("filter_num", "SELECT ?o ?t WHERE { ?o orders:o_totalprice ?t FILTER(?t >= 100000 && ?t < 200000.5 || ?t = 0) }", {"o": "local"}, "select o_orderkey o, o_totalprice t from orders where o_totalprice >= 100000 and o_totalprice < 200000.5 or o_totalprice = 0")
family("filter_str", 'SELECT ?p ?n WHERE { ?p part:p_name ?n FILTER(STRSTARTS(?n, "p") || CONTAINS(?n, "1") && STRENDS(?n, "5")) }', {"p": "local"}, "select p_partkey p, p_name n from part where starts_with(p_name, 'p') or contains(p_name, '1') and ends_with(p_name, '5')")
family("filter_regex", 'SELECT ?p ?t WHERE { ?p part:p_type ?t FILTER REGEX(?t, "^s.*[aeiou]", "i") }', {"p": "local"}, "select p_partkey p, p_type t from part where regexp_matches(p_type, '^s.*[aeiou]', 'i')")
family(
    "filter_three_valued", 'SELECT ?d ?q WHERE { ?d doc:lang "en" OPTIONAL { ?d doc:quality ?q } FILTER(?q = 1 || ?q > 5 || !BOUND(?q)) }', {"d": "local", "q": "long"},
    "select d.doc_id d, quality::bigint q from documents d left join labels l using (doc_id) where lang = 'en' and (quality = 1 or quality > 5 or quality is null)",
)
family("filter_in", 'SELECT ?c WHERE { ?c customer:c_mktsegment ?s ; customer:c_nationkey ?n FILTER(?s IN ("BUILDING", "MACHINERY", 3)) FILTER(?n NOT IN (nations:1, nations:2)) }', {"c": "local"}, "select c_custkey c from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_nationkey not in (1, 2)")
family("filter_same_term", "SELECT ?c ?s WHERE { ?c customer:c_nationkey ?n . ?s supplier:s_nationkey ?m FILTER(sameTerm(?n, ?m)) FILTER(?n = nations:5) }", {"c": "local", "s": "local"}, "select c_custkey c, s_suppkey s from customer, supplier where c_nationkey = s_nationkey and c_nationkey = 5")
family("optional", "SELECT ?d ?lang ?q ?t WHERE { ?d doc:lang ?lang OPTIONAL { ?d doc:quality ?q . ?d doc:toxic ?t } }", {"d": "local", "q": "long", "t": "long"}, "select doc_id d, lang, quality::bigint q, toxic::bigint t from documents left join labels using (doc_id) where lang is not null")
family("optional_column", "SELECT ?d ?lang ?src WHERE { ?d doc:doc_id ?i OPTIONAL { ?d doc:lang ?lang } OPTIONAL { ?d doc:source ?src } }", {"d": "local"}, "select doc_id d, lang, source src from documents")
family("optional_condition", "SELECT ?c ?o WHERE { ?c customer:c_name ?n OPTIONAL { ?o orders:o_custkey ?c ; orders:o_totalprice ?t FILTER(?t > 300000) } }", {"c": "local", "o": "local"}, "select c_custkey c, o_orderkey o from customer left join orders on o_custkey = c_custkey and o_totalprice > 300000")
family("optional_theta", "SELECT ?a ?b WHERE { ?a nation:n_nationkey ?x OPTIONAL { ?b nation:n_nationkey ?y FILTER(?y > ?x + 20) } }", {"a": "local", "b": "local"}, "select a.n_nationkey::bigint a, b.n_nationkey::bigint b from nation a left join nation b on b.n_nationkey > a.n_nationkey + 20")
family(
    "optional_then_join", "SELECT ?d ?q ?c WHERE { ?d doc:doc_id ?i OPTIONAL { ?d doc:quality ?q } ?e event:event_id ?i2 . OPTIONAL { ?e event:value ?c FILTER(?c > 1000000) } FILTER(?i = ?i2) }", {"d": "local", "q": "long", "c": "double"},
    "select d.doc_id d, quality::bigint q, case when value > 1000000 then value end c from documents d join events e on e.event_id = d.doc_id left join labels l on l.doc_id = d.doc_id",
)
family(
    "union_align", "SELECT ?x ?name ?bal WHERE { { ?x customer:c_name ?name ; customer:c_acctbal ?bal } UNION { ?x nation:n_name ?name } }", {"x": "string", "bal": "double"},
    f"select '{BASE}customer/' || c_custkey x, c_name name, c_acctbal bal from customer union all select '{BASE}nation/' || n_nationkey, n_name, null from nation",
)
family("minus_shared", "SELECT ?d WHERE { ?d doc:lang ?l MINUS { ?d doc:toxic 1 } }", {"d": "local"}, "select doc_id d from documents where doc_id not in (select doc_id from labels where toxic = 1)")
family("minus_disjoint", "SELECT ?n WHERE { ?n nation:n_name ?x MINUS { ?r region:r_name ?y } }", {"n": "local"}, "select n_nationkey::bigint n from nation")
family("minus_partly_bound", "SELECT ?d ?q WHERE { ?d doc:lang ?l OPTIONAL { ?d doc:quality ?q } MINUS { ?e doc:quality ?q . ?e doc:toxic 1 } }", {"d": "local", "q": "long"}, "select d.doc_id d, quality::bigint q from documents d left join labels l using (doc_id) where quality is null or quality not in (select quality from labels where toxic = 1)")
family("exists", "SELECT ?c WHERE { ?c customer:c_name ?n FILTER EXISTS { ?o orders:o_custkey ?c ; orders:o_totalprice ?t FILTER(?t > 400000) } }", {"c": "local"}, "select c_custkey c from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
family("not_exists", "SELECT ?c WHERE { ?c customer:c_name ?n FILTER NOT EXISTS { ?o orders:o_custkey ?c ; orders:o_totalprice ?t FILTER(?t > 100000) } }", {"c": "local"}, "select c_custkey c from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 100000)")
family("exists_in_or", "SELECT ?c WHERE { ?c customer:c_acctbal ?b FILTER(?b > 9000 || EXISTS { ?o orders:o_custkey ?c ; orders:o_totalprice ?t FILTER(?t > 400000) }) }", {"c": "local"}, "select c_custkey c from customer where c_acctbal > 9000 or exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
family("exists_correlated", "SELECT ?c WHERE { ?c customer:c_acctbal ?b FILTER EXISTS { ?o orders:o_custkey ?c ; orders:o_totalprice ?t FILTER(?t > ?b * 50) } }", {"c": "local"}, "select c_custkey c from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > c_acctbal * 50)")
family("values_join", 'SELECT ?n ?name WHERE { VALUES ?n { nations:1 nations:4 nations:4 nations:99 } ?n nation:n_name ?name }', {"n": "local"}, "select n_nationkey::bigint n, n_name name from nation join (values (1), (4), (4), (99)) v(k) on k = n_nationkey")
family(
    "values_undef", 'SELECT ?n ?r WHERE { ?n nation:n_regionkey ?r } VALUES (?n ?r) { (nations:1 UNDEF) (UNDEF regions:2) (nations:3 regions:0) (UNDEF UNDEF) }', {"n": "local", "r": "local"},
    "select n_nationkey::bigint n, n_regionkey::bigint r from nation join (values (1, null), (null, 2), (3, 0), (null, null)) v(a, b) on (a is null or a = n_nationkey) and (b is null or b = n_regionkey)",
)
family("bind_arith", "SELECT ?p ?x WHERE { ?p part:p_size ?s ; part:p_retailprice ?r BIND(?r * 2 - ?s / 4 + 1 AS ?x) }", {"p": "local", "x": "double"}, "select p_partkey p, p_retailprice * 2 - p_size / 4.0::double + 1 x from part")
family("bind_error_keeps_row", "SELECT ?p ?x WHERE { ?p part:p_size ?s ; part:p_name ?n BIND(?n + 1 AS ?x) FILTER(?s < 10) }", {"p": "local", "x": "double"}, "select p_partkey p, null::double x from part where p_size < 10")
family("divide_by_zero", "SELECT ?n ?x WHERE { ?n nation:n_nationkey ?k BIND(100 / (?k - 3) AS ?x) }", {"n": "local", "x": "double"}, "select n_nationkey::bigint n, case when n_nationkey <> 3 then 100.0::double / (n_nationkey - 3) end x from nation")
family("coalesce_if", 'SELECT ?d ?q ?w WHERE { ?d doc:n_chars ?n OPTIONAL { ?d doc:quality ?x } BIND(COALESCE(?x, ?n / 0, -1) AS ?q) BIND(IF(?n > 1000, "long", "short") AS ?w) }', {"d": "local", "q": "long", "w": "string"}, "select d.doc_id d, coalesce(quality, -1)::bigint q, case when n_chars > 1000 then 'long' else 'short' end w from documents d left join labels l using (doc_id)")
family("rounding", "SELECT ?c ?a ?u ?l ?r WHERE { ?c customer:c_acctbal ?b BIND(ABS(?b) AS ?a) BIND(CEIL(?b) AS ?u) BIND(FLOOR(?b) AS ?l) BIND(ROUND(?b) AS ?r) }", {"c": "local"}, "select c_custkey c, abs(c_acctbal) a, ceil(c_acctbal) u, floor(c_acctbal) l, round(c_acctbal) r from customer")
family(
    "dates", "SELECT ?o ?y ?m ?d ?h ?mi ?s WHERE { ?o orders:o_orderdate ?t BIND(YEAR(?t) AS ?y) BIND(MONTH(?t) AS ?m) BIND(DAY(?t) AS ?d) BIND(HOURS(?t) AS ?h) BIND(MINUTES(?t) AS ?mi) BIND(SECONDS(?t) AS ?s) }",
    {"o": "local", **{v: "long" for v in ("y", "m", "d", "h", "mi", "s")}},
    "select o_orderkey o, year(o_orderdate)::bigint y, month(o_orderdate)::bigint m, day(o_orderdate)::bigint d, hour(o_orderdate)::bigint h, minute(o_orderdate)::bigint mi, second(o_orderdate)::bigint s from orders",
)
family("date_range", 'SELECT ?o WHERE { ?o orders:o_orderdate ?t FILTER(?t >= "1995-01-01T00:00:00"^^xsd:dateTime && ?t < "1996-01-01T00:00:00"^^xsd:dateTime) }', {"o": "local"}, "select o_orderkey o from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1996-01-01'")
family("hashes", "SELECT ?n ?a ?b ?c WHERE { ?n nation:n_name ?x BIND(MD5(?x) AS ?a) BIND(SHA1(?x) AS ?b) BIND(SHA256(?x) AS ?c) }", {"n": "local"}, "select n_nationkey::bigint n, md5(n_name) a, sha1(n_name) b, sha256(n_name) c from nation")
family("hashes_long", "SELECT ?n ?a ?b WHERE { ?n nation:n_name ?x BIND(STRLEN(SHA384(?x)) AS ?a) BIND(STRLEN(SHA512(?x)) AS ?b) }", {"n": "local", "a": "long", "b": "long"}, "select n_nationkey::bigint n, 96::bigint a, 128::bigint b from nation")
family(
    "strings", 'SELECT ?p ?u ?l ?n ?s ?c ?r WHERE { ?p part:p_name ?x BIND(UCASE(?x) AS ?u) BIND(LCASE(?x) AS ?l) BIND(STRLEN(?x) AS ?n) BIND(SUBSTR(?x, 2, 3) AS ?s) BIND(CONCAT(?x, "-", STR(?n)) AS ?c) BIND(REPLACE(?x, "([aeiou])", "<$1>") AS ?r) }',
    {"p": "local", "n": "long"},
    r"select p_partkey p, upper(p_name) u, lower(p_name) l, length(p_name)::bigint n, substring(p_name, 2, 3) s, p_name || '-' || length(p_name) c, regexp_replace(p_name, '([aeiou])', '<\1>', 'g') r from part",
)
family("term_tests", 'SELECT ?p ?k WHERE { parts:5 ?p ?v BIND(CONCAT(STR(isIRI(?v)), STR(isLiteral(?v)), STR(isNumeric(?v)), STR(isBlank(?v)), LANG(?p)) AS ?k) FILTER(?p != rdf:type) }', {"p": "string"}, f"select '{BASE}part#' || c p, 'falsetrue' || n || 'false' k from (values ('p_partkey', 'true'), ('p_name', 'false'), ('p_brand', 'false'), ('p_type', 'false'), ('p_size', 'true'), ('p_retailprice', 'true')) v(c, n)")
family("datatypes", "SELECT ?p ?t WHERE { parts:5 ?p ?v BIND(DATATYPE(?v) AS ?t) FILTER(BOUND(?t)) }", {"p": "string", "t": "string"}, f"select '{BASE}part#' || c p, '{T.XSD}' || n t from (values ('p_partkey', 'double'), ('p_name', 'string'), ('p_brand', 'string'), ('p_type', 'string'), ('p_size', 'double'), ('p_retailprice', 'double')) v(c, n)")
family("group_count", "SELECT ?s (COUNT(*) AS ?n) WHERE { ?c customer:c_mktsegment ?s } GROUP BY ?s", {"n": "long"}, "select c_mktsegment s, count(*) n from customer group by 1")
family(
    "group_sum_avg", "SELECT ?f ?st (SUM(?q) AS ?sum_qty) (ROUND(AVG(?p) * 100) / 100 AS ?avg_price) (COUNT(?q) AS ?n) WHERE { ?l lineitem:l_returnflag ?f ; lineitem:l_linestatus ?st ; lineitem:l_quantity ?q ; lineitem:l_extendedprice ?p } GROUP BY ?f ?st", {"sum_qty": "double", "avg_price": "double", "n": "long"},
    "select l_returnflag f, l_linestatus st, sum(l_quantity) sum_qty, round(avg(l_extendedprice) * 100) / 100 avg_price, count(*) n from lineitem group by 1, 2",
)
family(
    "group_expression", "SELECT ?y (ROUND(SUM(?p * (1 - ?d))) AS ?revenue) WHERE { ?l lineitem:l_shipdate ?t ; lineitem:l_extendedprice ?p ; lineitem:l_discount ?d } GROUP BY (YEAR(?t) AS ?y)", {"y": "long", "revenue": "double"},
    "select year(l_shipdate)::bigint y, round(sum(l_extendedprice * (1 - l_discount))) revenue from lineitem group by 1",
)
family("group_minmax", "SELECT ?s (MIN(?b) AS ?lo) (MAX(?b) AS ?hi) (MAX(?n) AS ?last) WHERE { ?c customer:c_mktsegment ?s ; customer:c_acctbal ?b ; customer:c_name ?n } GROUP BY ?s", {"lo": "double", "hi": "double"}, "select c_mktsegment s, min(c_acctbal) lo, max(c_acctbal) hi, max(c_name) last from customer group by 1")
family("group_concat", 'SELECT ?r (GROUP_CONCAT(?x; SEPARATOR=", ") AS ?names) WHERE { ?n nation:n_regionkey ?r ; nation:n_name ?x } GROUP BY ?r', {"r": "local"}, "select n_regionkey::bigint r, string_agg(n_name, ', ' order by n_name) names from nation group by 1")
family("group_sample", "SELECT ?r (SAMPLE(?x) AS ?one) WHERE { ?n nation:n_regionkey ?r ; nation:n_name ?x } GROUP BY ?r", {"r": "local"}, "select n_regionkey::bigint r, min(n_name) one from nation group by 1")
family("having", "SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o orders:o_custkey ?c } GROUP BY ?c HAVING (COUNT(?o) > 15)", {"c": "local", "n": "long"}, "select o_custkey c, count(*) n from orders group by 1 having count(*) > 15")
family("count_distinct", "SELECT (COUNT(DISTINCT ?c) AS ?a) (COUNT(DISTINCT *) AS ?b) (SUM(DISTINCT ?q) AS ?s) WHERE { ?l lineitem:l_suppkey ?c ; lineitem:l_quantity ?q }", {"a": "long", "b": "long", "s": "double"}, "select count(distinct l_suppkey) a, (select count(*) from lineitem) b, sum(distinct l_quantity) s from lineitem")
family("agg_empty", 'SELECT (COUNT(*) AS ?n) (SUM(?b) AS ?s) (AVG(?b) AS ?a) (MIN(?b) AS ?m) (GROUP_CONCAT(?x) AS ?g) WHERE { ?c customer:c_mktsegment "NONE" ; customer:c_acctbal ?b ; customer:c_name ?x }', {"n": "long", "s": "double", "a": "double", "m": "double", "g": "string"}, "select 0::bigint n, 0::double s, 0::double a, null::double m, '' g")
family("agg_non_numeric", "SELECT ?r (SUM(?x) AS ?s) (COUNT(?x) AS ?n) WHERE { ?k nation:n_regionkey ?r ; nation:n_name ?x } GROUP BY ?r", {"r": "local", "s": "double", "n": "long"}, "select n_regionkey::bigint r, null::double s, count(*) n from nation group by 1")
family("distinct", "SELECT DISTINCT ?b ?t WHERE { ?p part:p_brand ?b ; part:p_type ?t }", {}, "select distinct p_brand b, p_type t from part")
family("order_limit", "SELECT ?c ?b WHERE { ?c customer:c_acctbal ?b } ORDER BY DESC(?b) ?c LIMIT 20", {"c": "local"}, "select c_custkey c, c_acctbal b from customer order by c_acctbal desc, 'customer/' || c_custkey limit 20")
family("distinct_order_offset", "SELECT DISTINCT ?b WHERE { ?p part:p_brand ?b ; part:p_size ?s } ORDER BY ?b OFFSET 3 LIMIT 10", {}, "select distinct p_brand b from part order by 1 limit 10 offset 3")
family("order_before_projection", "SELECT ?name WHERE { ?p part:p_name ?name ; part:p_retailprice ?r ; part:p_partkey ?k } ORDER BY DESC(?r) ?k LIMIT 15", {}, "select p_name as name from part order by p_retailprice desc, p_partkey limit 15")
family("subselect_agg_join", "SELECT ?name ?n WHERE { ?c customer:c_name ?name { SELECT ?c (COUNT(*) AS ?n) WHERE { ?o orders:o_custkey ?c } GROUP BY ?c } FILTER(?n > 14) }", {"n": "long"}, "select c_name as name, n from customer join (select o_custkey, count(*) n from orders group by 1) on o_custkey = c_custkey where n > 14")
family("subselect_limit", "SELECT ?o ?t WHERE { { SELECT ?c WHERE { ?c customer:c_acctbal ?b } ORDER BY DESC(?b) ?c LIMIT 5 } ?o orders:o_custkey ?c ; orders:o_totalprice ?t }", {"o": "local"}, "select o_orderkey o, o_totalprice t from orders join (select c_custkey from customer order by c_acctbal desc, 'customer/' || c_custkey limit 5) on c_custkey = o_custkey")
family("ask", "ASK { ?c customer:c_acctbal ?b FILTER(?b > 9990) }", {}, 'select count(*) > 0 as "boolean" from customer where c_acctbal > 9990')
family("path_sequence", "SELECT ?o ?rn WHERE { ?o orders:o_custkey/customer:c_nationkey/nation:n_regionkey/region:r_name ?rn }", {"o": "local"}, "select o_orderkey o, r_name rn from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey")
family("path_inverse", "SELECT ?n ?s WHERE { ?n ^supplier:s_nationkey ?s }", {"n": "local", "s": "local"}, "select s_nationkey::bigint n, s_suppkey s from supplier")
family("path_alternative", "SELECT ?x ?n WHERE { ?x customer:c_nationkey|supplier:s_nationkey ?n }", {"x": "string", "n": "local"}, f"select '{BASE}customer/' || c_custkey x, c_nationkey::bigint n from customer union select '{BASE}supplier/' || s_suppkey, s_nationkey::bigint from supplier")
_CONV = "select conv_id, turn from conversations"
family("path_plus", "SELECT ?a ?b WHERE { ?a turn:next+ ?b }", {"a": "string", "b": "string"}, f"select '{BASE}turn/' || a.conv_id || '/' || a.turn a, '{BASE}turn/' || b.conv_id || '/' || b.turn b from conversations a join conversations b on a.conv_id = b.conv_id and a.turn < b.turn")
family("path_plus_from", "SELECT ?b WHERE { turns:3\\/0 turn:next+ ?b }", {"b": "string"}, f"select '{BASE}turn/3/' || turn b from conversations where conv_id = 3 and turn > 0")
family("path_plus_to", "SELECT ?a WHERE { ?a turn:next+ turns:3\\/4 }", {"a": "string"}, f"select '{BASE}turn/3/' || turn a from conversations where conv_id = 3 and turn < 4 and exists (select 1 from conversations where conv_id = 3 and turn = 4)")
family("path_star", "SELECT ?b WHERE { turns:3\\/1 turn:next* ?b }", {"b": "string"}, f"select '{BASE}turn/3/' || turn b from conversations where conv_id = 3 and turn >= 1")
family("path_optional", "SELECT ?b WHERE { turns:3\\/0 turn:next? ?b }", {"b": "string"}, f"select '{BASE}turn/3/' || turn b from conversations where conv_id = 3 and turn <= 1")
family("path_negated", "SELECT ?b WHERE { nations:3 !(nation:n_name|rdf:type) ?b }", {"b": "string"}, f"select '3' b union all select '{BASE}region/' || n_regionkey from nation where n_nationkey = 3")
family("path_joined", "SELECT ?a ?role (COUNT(?b) AS ?n) WHERE { ?a turn:role ?role ; turn:turn 0 ; turn:next+ ?b } GROUP BY ?a ?role", {"a": "string", "n": "long"}, f"select '{BASE}turn/' || a.conv_id || '/0' a, a.role, count(*) n from conversations a join conversations b on a.conv_id = b.conv_id and b.turn > 0 where a.turn = 0 group by 1, 2")

family("path_both_ends", "SELECT (COUNT(*) AS ?n) WHERE { turns:3\\/0 turn:next+ turns:3\\/1 }", {"n": "long"}, "select count(*) n from conversations where conv_id = 3 and turn = 1")
family("path_itself", "SELECT ?c WHERE { ?c (customer:c_nationkey/^customer:c_nationkey) ?c }", {"c": "local"}, "select c_custkey c from customer")
family("path_unknown_end", "SELECT ?a ?b WHERE { { BIND(1 AS ?a) turns:none turn:next* ?b } UNION { BIND(2 AS ?a) turns:none turn:next+ ?b } UNION { BIND(3 AS ?a) turns:3\\/1 turn:next* ?b } }", {"a": "long", "b": "string"}, f"select 3::bigint a, '{BASE}turn/3/' || turn b from conversations where conv_id = 3 and turn >= 1")
family("path_negated_inverse", "SELECT ?b WHERE { nations:3 !(^customer:c_nationkey) ?b }", {"b": "local"}, "select s_suppkey b from supplier where s_nationkey = 3")
family("select_star", "SELECT * WHERE { ?n nation:n_name ?name ; nation:n_regionkey ?r OPTIONAL { ?n nation:n_nationkey ?k FILTER(?k > 20) } }", {"n": "local", "r": "local", "k": "long"}, "select n_nationkey::bigint n, n_name as name, n_regionkey::bigint r, case when n_nationkey > 20 then n_nationkey end::bigint k from nation")
family("empty_group", 'SELECT ?n ?x WHERE { { } { ?n nation:n_name ?name } BIND("here" AS ?x) }', {"n": "local", "x": "string"}, "select n_nationkey::bigint n, 'here' x from nation")
family("join_multiplicity", "SELECT ?n ?r WHERE { { ?n nation:n_regionkey ?r } UNION { ?n nation:n_regionkey ?r } VALUES ?r { regions:1 regions:1 regions:2 } }", {"n": "local", "r": "local"}, "select n_nationkey::bigint n, n_regionkey::bigint r from nation, range(2) a(x), (values (1), (1), (2)) v(k) where k = n_regionkey")
family("join_empty_left", "SELECT ?k ?c WHERE { { SELECT ?k (COUNT(?o) AS ?c) WHERE { VALUES ?k { 1 2 } OPTIONAL { ?n nation:n_name \"NONE\" . ?o orders:o_custkey ?n } } GROUP BY ?k } }", {"k": "long", "c": "long"}, "select k::bigint k, 0::bigint c from (values (1), (2)) v(k)")
family("unary", "SELECT ?c ?x ?y WHERE { ?c customer:c_acctbal ?b BIND(-?b AS ?x) BIND(+?b - -1 AS ?y) }", {"c": "local", "x": "double", "y": "double"}, "select c_custkey c, -c_acctbal x, c_acctbal + 1 y from customer")
family("string_tests", 'SELECT ?p ?a ?b ?c WHERE { ?p part:p_name ?n BIND(CONTAINS(?n, "e w") AS ?a) BIND(STRSTARTS(?n, "small") AS ?b) BIND(STRENDS(?n, "ring") AS ?c) FILTER(?a || ?b || ?c) }', {"p": "local", "a": "boolean", "b": "boolean", "c": "boolean"}, "select p_partkey p, contains(p_name, 'e w') a, starts_with(p_name, 'small') b, ends_with(p_name, 'ring') c from part where a or b or c")


def _digests(name: str) -> str:
    """SQL rows (name, digest) of the names that nations have; DuckDB has no such digests itself."""
    return ", ".join(f"('NATION_{i}', '{hashlib.new(name, f'NATION_{i}'.encode()).hexdigest()}')" for i in range(25))


family("hashes_sha384", "SELECT ?n ?h WHERE { ?n nation:n_name ?x BIND(SHA384(?x) AS ?h) }", {"n": "local"}, f"select n_nationkey::bigint n, h from nation join (values {_digests('sha384')}) v(x, h) on x = n_name")
family("hashes_sha512", "SELECT ?n ?h WHERE { ?n nation:n_name ?x BIND(SHA512(?x) AS ?h) }", {"n": "local"}, f"select n_nationkey::bigint n, h from nation join (values {_digests('sha512')}) v(x, h) on x = n_name")


def _queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def one(sparql: str, types: dict[str, str]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: engine(spark, sf_dir).select(PREFIXES + sparql, types)

    return {name: one(sparql, types) for name, (sparql, types, _) in FAMILIES.items()}


# -- queries over graphs that are materialised: inference, updates, files


def _nations(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions as classes over nations as classes, customers as their members; c_nationkey under a broader property."""
    nation, customer = spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    from pyspark.sql import functions as F

    def iri(prefix: str, *columns) -> F.Column:
        return F.concat(F.lit(f"I{T.SEP}{BASE}{prefix}/"), *(F.col(c).cast("string") if isinstance(c, str) else c for c in columns))

    def fixed(value: str):
        return F.lit(T.iri(value))

    rows = [
        nation.select(iri("nation", "n_nationkey"), fixed(T.RDFS + "subClassOf"), iri("region", "n_regionkey")),
        nation.select(iri("region", "n_regionkey"), fixed(T.RDFS + "subClassOf"), fixed(BASE + "World")),
        customer.select(iri("customer", "c_custkey"), fixed(T.RDF + "type"), iri("nation", "c_nationkey")),
        customer.select(iri("customer", "c_custkey"), fixed(BASE + "livesIn"), iri("nation", "c_nationkey")),
    ]
    schema = [(BASE + "livesIn", T.RDFS + "subPropertyOf", BASE + "knows"), (BASE + "knows", T.RDFS + "subPropertyOf", BASE + "relatedTo"), (BASE + "livesIn", T.RDFS + "range", BASE + "Place"), (BASE + "relatedTo", T.RDFS + "domain", BASE + "Agent"), (BASE + "Agent", T.RDFS + "subClassOf", BASE + "Thing")]
    df = spark.createDataFrame([tuple(map(T.iri, t)) for t in schema], "s string, p string, o string")
    for r in rows:
        df = df.union(r)
    return Graph.of_frame(df)


def _inferred(text: str, types: dict[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(_nations(spark, sf_dir)).select(PREFIXES + text, types, infer="rdfs")


def _updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _nations(spark, sf_dir).update(
        f"PREFIX : <{BASE}> INSERT DATA {{ :new :livesIn <{BASE}nation/1> }} ; DELETE DATA {{ <{BASE}customer/1> :livesIn <{BASE}nation/0> . <{BASE}nowhere> :livesIn :x }} ; INSERT DATA {{ :gone :livesIn :x }} ; DELETE DATA {{ :gone :livesIn :x }}"
    )
    return Engine(graph).select(PREFIXES + "SELECT ?n (COUNT(?c) AS ?k) WHERE { ?c :livesIn ?n } GROUP BY ?n", {"n": "string", "k": "long"})


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as N-Triples and read again."""
    import uuid

    from .operators.frame import shared_dir
    from .sources.ntriples import read_ntriples, write_ntriples

    f = source(spark, sf_dir).scan(*_pattern("?s", f"{BASE}page#html"))
    path = f"{shared_dir(spark)}/graphloom/nt-{uuid.uuid4().hex}"
    from pyspark.sql import functions as F

    triples = f.df.select(f.key("s").alias("s"), F.lit(T.iri(f"{BASE}page#html")).alias("p"), f.key("o").alias("o"))
    write_ntriples(triples, path)
    graph = Graph(spark, read_ntriples(spark, path))
    return Engine(graph).select("SELECT ?s ?h WHERE { ?s ?p ?x BIND(MD5(?x) AS ?h) }", {"s": "local", "h": "string"})


def _pattern(s: str, p: str):
    from .plans import algebra as A

    return (A.Triple(A.Var("s"), A.Const(T.iri(p)), A.Var("o")),)


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store on disk: created, changed, folded, opened again."""
    import uuid

    from .operators.frame import shared_dir
    from .sources.graph import Store

    store = Store.create(_nations(spark, sf_dir), f"{shared_dir(spark)}/graphloom/store-{uuid.uuid4().hex}")
    store.update(f"INSERT DATA {{ <{BASE}new> <{BASE}livesIn> <{BASE}nation/1> }} ; DELETE DATA {{ <{BASE}new> <{BASE}livesIn> <{BASE}nation/1> }} ; INSERT DATA {{ <{BASE}new> <{BASE}livesIn> <{BASE}nation/2> }}")
    store.checkpoint()
    return Engine(store.graph()).select(PREFIXES + "SELECT ?n (COUNT(?c) AS ?k) WHERE { ?c :livesIn ?n } GROUP BY ?n", {"n": "string", "k": "long"})


def _typed_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership by a property below rdf:type, and above the class it names."""
    graph = _nations(spark, sf_dir)
    rows = [(BASE + "isPartOf", T.RDFS + "subPropertyOf", BASE + "isA"), (BASE + "isA", T.RDFS + "subPropertyOf", T.RDF + "type"), (BASE + "desk", BASE + "isPartOf", BASE + "nation/7"), (BASE + "lamp", BASE + "isA", BASE + "World")]
    more = Graph.of(spark, [tuple(map(T.iri, r)) for r in rows])
    return Engine(graph.append(more)).select(PREFIXES + "SELECT ?x ?k WHERE { ?x a ?k FILTER(?x = :desk || ?x = :lamp) }", {"x": "string", "k": "string"}, infer="rdfs")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **_queries(),
    "infer_subclass": _inferred("SELECT ?c WHERE { ?c a <http://example.org/region/1> }", {"c": "local"}),
    "infer_all_classes": _inferred("SELECT ?k (COUNT(?c) AS ?n) WHERE { ?c a ?k } GROUP BY ?k", {"k": "string", "n": "long"}),
    "infer_subproperty": _inferred("SELECT ?c ?n WHERE { ?c :relatedTo ?n }", {"c": "local", "n": "local"}),
    "infer_domain_range": _inferred("SELECT ?c ?p WHERE { ?c a :Thing . ?c :knows ?p . ?p a :Place }", {"c": "local", "p": "local"}),
    "update_insert_delete": _updated,
    "ntriples_round_trip": _round_trip,
    "store_checkpoint": _saved,
    "infer_type_property": _typed_below,
    "infer_path": _inferred("SELECT ?c ?up WHERE { ?c :knows/rdfs:subClassOf ?up }", {"c": "local", "up": "local"}),
}

ORACLE_SQL: dict[str, str] = {
    **{name: sql for name, (_, _, sql) in FAMILIES.items()},
    "infer_subclass": "select c_custkey c from customer join nation on n_nationkey = c_nationkey where n_regionkey = 1",
    "infer_all_classes": f"""with t as (select c_custkey c, c_nationkey n, n_regionkey r from customer join nation on n_nationkey = c_nationkey)
        select '{BASE}nation/' || n k, count(*) n from t group by 1 union all select '{BASE}region/' || r, count(*) from t group by 1 union all select '{BASE}World', count(*) from t
        union all select '{BASE}Place', count(distinct n) from t union all select '{BASE}Agent', count(*) from t union all select '{BASE}Thing', count(*) from t""",
    "infer_subproperty": "select c_custkey c, c_nationkey::bigint n from customer",
    "infer_domain_range": "select c_custkey c, c_nationkey::bigint p from customer",
    "update_insert_delete": f"select '{BASE}nation/' || c_nationkey n, count(*) k from (select c_nationkey from customer where not (c_custkey = 1 and c_nationkey = 0) union all select 1) group by 1",
    "ntriples_round_trip": "select page_id s, md5(html) h from pages where html is not null",
    "infer_type_property": f"""select '{BASE}lamp' x, '{BASE}World' k union all select '{BASE}desk', '{BASE}World' union all select '{BASE}desk', '{BASE}nation/7'
        union all select '{BASE}desk', '{BASE}region/' || n_regionkey from nation where n_nationkey = 7""",
    "infer_path": "select c_custkey c, n_regionkey::bigint up from customer join nation on n_nationkey = c_nationkey",
    "store_checkpoint": f"select '{BASE}nation/' || c_nationkey n, count(*) k from (select c_nationkey from customer union all select 2) group by 1",
}
