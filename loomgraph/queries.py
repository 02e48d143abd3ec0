"""Named queries over the star schema's graph, and SQL over the base tables for the same answers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .catalog import CLASSES, NAMESPACE, PROPERTIES, Catalog
from .functions import text as T
from .nlq import batch, mock, pipeline, report
from .operators.closure import checkpoint_dir
from .plans.compiler import query
from .sources.graph import Graph, campus
from .streaming.events import fold, fold_stream, format_events, parse_events

NS = NAMESPACE
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Distinct edges to books, and the chain up from them.
HB = "(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)"
CHAIN = f"{HB} hb JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"
COURSE = "(SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders)"


def sparql(name: str, text: str, oracle: str | None = None, as_text: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(campus(spark, sf_dir), text, as_text=as_text)
    if oracle:
        ORACLES[name] = oracle


def built(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def _iri(cls: str, key: str) -> str:
    return f"'{NS}{cls.lower()}_' || CAST({key} AS VARCHAR)"


CHAIN_PATTERN = """?u a :University ; :name ?un ; :hasDepartment ?d . ?d a :Department ; :name ?dn ; :hasCourse ?c .
  ?c a :Course ; :hasModule ?m . ?m a :Module ; :hasBook ?b . ?b a :Book ; :hasCode ?code ."""

# the book usage queries
sparql(
    "book_usage_chain",
    f'SELECT (?un AS ?University) (?dn AS ?Department) (?mt AS ?Module) WHERE {{ VALUES ?code {{ "42" }} {CHAIN_PATTERN} ?m :title ?mt . ?c :year 1998 . }}',
    f"SELECT n_name AS University, c_name AS Department, o_orderpriority AS Module FROM {CHAIN} WHERE CAST(l_partkey AS VARCHAR) IN ('42') AND year(o_orderdate) = 1998",
)
sparql(
    "book_usage_concat",
    f"""SELECT (?un AS ?University) (?dn AS ?Department) (COUNT(?m) AS ?n) (GROUP_CONCAT(?mt; separator=", ") AS ?Modules) WHERE {{ ?m :title ?mt .
      {{ SELECT DISTINCT ?un ?dn ?m WHERE {{ VALUES ?code {{ "42" "43" "44" }} {CHAIN_PATTERN} ?c :year 1998 . }} }} }} GROUP BY ?un ?dn""",
    f"SELECT n_name AS University, c_name AS Department, count(*) AS n, string_agg(o_orderpriority, ', ' ORDER BY o_orderpriority) AS Modules FROM (SELECT DISTINCT n_name, c_name, o_orderkey, o_orderpriority FROM {CHAIN} WHERE CAST(l_partkey AS VARCHAR) IN ('42', '43', '44') AND year(o_orderdate) = 1998) GROUP BY 1, 2",
)
sparql(
    "book_usage_counts",
    f'SELECT (COUNT(DISTINCT ?u) AS ?universities) (COUNT(DISTINCT ?d) AS ?departments) (COUNT(DISTINCT ?m) AS ?modules) WHERE {{ VALUES ?code {{ "42" "43" }} {CHAIN_PATTERN} ?c :year 1998 . }}',
    f"SELECT count(DISTINCT n_nationkey) AS universities, count(DISTINCT c_custkey) AS departments, count(DISTINCT o_orderkey) AS modules FROM {CHAIN} WHERE CAST(l_partkey AS VARCHAR) IN ('42', '43') AND year(o_orderdate) = 1998",
)
sparql(
    "book_usage_by_year",
    f'SELECT ?year (COUNT(DISTINCT ?u) AS ?universities) (COUNT(DISTINCT ?d) AS ?departments) (COUNT(DISTINCT ?m) AS ?modules) WHERE {{ VALUES ?code {{ "42" "43" }} {CHAIN_PATTERN} ?c :year ?year . FILTER((?year>=1996) && (?year<2000)) }} GROUP BY ?year ORDER BY ?year',
    f"SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(DISTINCT n_nationkey) AS universities, count(DISTINCT c_custkey) AS departments, count(DISTINCT o_orderkey) AS modules FROM {CHAIN} WHERE CAST(l_partkey AS VARCHAR) IN ('42', '43') AND year(o_orderdate) >= 1996 AND year(o_orderdate) < 2000 GROUP BY 1 ORDER BY 1",
)

# scans and counts over the whole graph
_ROWS = {"University": "nation", "Department": "customer", "Course": COURSE, "Module": "orders", "Book": "part"}
_CLASS_ROWS = " UNION ALL ".join(f"SELECT '{t}' AS class, count(*) AS n FROM {_ROWS[c]} {'k' if c == 'Course' else ''}" for c in CLASSES for t in Catalog().types_of(c))
_CLASS_COUNTS = f"SELECT class, CAST(sum(n) AS BIGINT) AS count FROM ({_CLASS_ROWS}) GROUP BY class"
_PROPERTY_ROWS = [
    ("hasDepartment", "SELECT count(*) FROM customer WHERE c_nationkey IS NOT NULL"), ("hasCourse", f"SELECT count(*) FROM {COURSE}"), ("hasModule", "SELECT count(*) FROM orders"), ("hasBook", f"SELECT count(*) FROM {HB}"),
    ("title", f"SELECT (SELECT count(o_orderpriority) FROM orders) + (SELECT count(p_name) FROM part) + (SELECT count(*) FROM {COURSE})"), ("name", "SELECT (SELECT count(c_name) FROM customer) + (SELECT count(n_name) FROM nation)"),
    ("semester", "SELECT count(*) FROM orders"), ("year", f"SELECT count(*) FROM {COURSE}"), ("hasCode", "SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM part) + (SELECT count(*) FROM customer)"), ("hasURL", f"SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM {COURSE})"),
]
_PROPERTY_COUNTS = " UNION ALL ".join(f"SELECT '{NS}{p}' AS p, ({q}) AS count" for p, q in _PROPERTY_ROWS)
sparql("triple_count", "SELECT (COUNT(*) AS ?triples) WHERE { ?s ?p ?o }", f"SELECT CAST((SELECT sum(count) FROM ({_CLASS_COUNTS})) + (SELECT sum(count) FROM ({_PROPERTY_COUNTS})) AS BIGINT) AS triples")
sparql("top_classes", "SELECT ?class (COUNT(?s) AS ?count) WHERE { ?s a ?class } GROUP BY ?class ORDER BY DESC(?count) ?class LIMIT 20", f"{_CLASS_COUNTS} ORDER BY count DESC, class LIMIT 20")
built("class_counts_filtered", f"{_CLASS_COUNTS} ORDER BY count DESC, class LIMIT 50")(lambda s, d: report.class_counts(campus(s, d), 50))
built("property_counts", f"{_PROPERTY_COUNTS} ORDER BY count DESC, p LIMIT 100")(lambda s, d: report.property_counts(campus(s, d), 100))
_IRIS = " UNION ".join([f"SELECT '{t}' AS iri" for c in CLASSES for t in Catalog().types_of(c)] + [f"SELECT '{NS}{p.name}'" for p in PROPERTIES] + ["SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type'"])
built("namespace_list", f"SELECT DISTINCT regexp_replace(iri, '(.*[/#])[^/#]*$', '\\1') AS ns FROM ({_IRIS}) ORDER BY ns LIMIT 50")(lambda s, d: report.namespaces(campus(s, d)))
_LABELS = " UNION ALL ".join(
    f"SELECT '{NS}{c}' AS class, {_iri(c, k)} AS s, {label} AS label FROM {table}"
    for c, k, label, table in (("University", "n_nationkey", "n_name", "nation"), ("Department", "c_custkey", "c_name", "customer"), ("Course", "o_custkey * 10000 + y", "c_mktsegment || ' ' || CAST(y AS VARCHAR)", f"{COURSE} k JOIN customer ON c_custkey = o_custkey"), ("Module", "o_orderkey", "o_orderpriority", "orders"), ("Book", "p_partkey", "p_name", "part"))
)
built("sample_labels", f"SELECT class, s, label FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY s) AS n FROM ({_LABELS})) WHERE n <= 5")(lambda s, d: report.sample_labels(campus(s, d)))
sparql("book_count", "SELECT (COUNT(*) AS ?n) WHERE { ?s a :Book } LIMIT 1", "SELECT count(*) AS n FROM part")
sparql("alias_class_count", "SELECT (COUNT(?s) AS ?n) WHERE { ?s a teach:Course }", "SELECT count(*) AS n FROM orders")
sparql("superclass_titles", "SELECT (COUNT(?t) AS ?n) (COUNT(DISTINCT ?t) AS ?distinct) WHERE { ?s a :LearningEntity ; :title ?t }", f"SELECT count(*) AS n, count(DISTINCT t) AS \"distinct\" FROM (SELECT p_name AS t FROM part UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT c_mktsegment || ' ' || CAST(y AS VARCHAR) FROM {COURSE} k JOIN customer ON c_custkey = o_custkey)")
sparql("describe_instance", f"DESCRIBE <{NS}book_7>", " UNION ALL ".join([f"SELECT '{NS}book_7' AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, '{t}' AS o" for t in Catalog().types_of("Book")] + [f"SELECT '{NS}book_7', '{NS}title', p_name FROM part WHERE p_partkey = 7", f"SELECT '{NS}book_7', '{NS}hasCode', '7'", f"SELECT '{NS}book_7', '{NS}hasURL', 'http://example.org/book/7'"]))

# joins
sparql("star_join", "SELECT ?b ?t ?c ?u WHERE { ?b :title ?t ; :hasCode ?c ; :hasURL ?u . ?b a bibo:Book }", f"SELECT {_iri('Book', 'p_partkey')} AS b, p_name AS t, CAST(p_partkey AS VARCHAR) AS c, 'http://example.org/book/' || CAST(p_partkey AS VARCHAR) AS u FROM part")
sparql("optional_book", "SELECT ?m ?b WHERE { ?m a :Module OPTIONAL { ?m :hasBook ?b . ?b :hasCode ?code FILTER(?code < \"2\") } }", f"SELECT {_iri('Module', 'o_orderkey')} AS m, CASE WHEN l_partkey IS NOT NULL THEN {_iri('Book', 'l_partkey')} END AS b FROM orders LEFT JOIN (SELECT * FROM {HB} WHERE CAST(l_partkey AS VARCHAR) < '2') h ON o_orderkey = l_orderkey")
sparql("values_join", 'SELECT ?code ?title WHERE { VALUES ?code { "1" "2" "none" } ?b a :Book ; :hasCode ?code ; :title ?title }', "SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS title FROM part WHERE p_partkey IN (1, 2)")
sparql("values_undef", 'SELECT ?code ?year ?n WHERE { VALUES (?year ?code) { (1998 UNDEF) (UNDEF "5") (1997 "7") } ?d :hasCode ?code ; :hasCourse ?c ; :name ?n . ?c :year ?year }', f"SELECT CAST(c_custkey AS VARCHAR) AS code, CAST(y AS BIGINT) AS year, c_name AS n FROM {COURSE} k JOIN customer ON c_custkey = o_custkey JOIN (VALUES (1998, NULL), (NULL, '5'), (1997, '7')) v(vy, vc) ON (vy IS NULL OR vy = y) AND (vc IS NULL OR vc = CAST(c_custkey AS VARCHAR))")
sparql("subselect_join", "SELECT ?n ?k WHERE { ?d :name ?n { SELECT ?d (COUNT(?c) AS ?k) WHERE { ?d :hasCourse ?c } GROUP BY ?d HAVING (COUNT(?c) >= 7) } }", f"SELECT c_name AS n, k FROM (SELECT o_custkey, count(*) AS k FROM {COURSE} x GROUP BY 1 HAVING count(*) >= 7) JOIN customer ON c_custkey = o_custkey")
sparql("minus_unused", "SELECT ?m WHERE { ?m a :Module MINUS { ?m :hasBook ?b } }", f"SELECT {_iri('Module', 'o_orderkey')} AS m FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
sparql("minus_disjoint", "SELECT (COUNT(*) AS ?n) WHERE { ?u a :University MINUS { ?x :hasBook ?y } }", "SELECT count(*) AS n FROM nation")
sparql("not_exists", "SELECT ?m WHERE { ?m a :Module FILTER NOT EXISTS { ?m :hasBook ?b } }", f"SELECT {_iri('Module', 'o_orderkey')} AS m FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
sparql("exists", "SELECT (COUNT(?d) AS ?n) WHERE { ?d a :Department FILTER EXISTS { ?d :hasCourse ?c . ?c :year 1995 } }", "SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1995)")
sparql("exists_in_expression", "SELECT (COUNT(?d) AS ?n) WHERE { ?d :hasCode ?k ; a :Department FILTER(?k < \"3\" || EXISTS { ?d :hasCourse ?c . ?c :year 1995 }) }", "SELECT count(*) AS n FROM customer WHERE CAST(c_custkey AS VARCHAR) < '3' OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1995)")
sparql("cross_theta", "SELECT ?a ?b WHERE { ?x a :University ; :name ?a . ?y a :University ; :name ?b FILTER(?a < ?b) }", "SELECT x.n_name AS a, y.n_name AS b FROM nation x, nation y WHERE x.n_name < y.n_name")
sparql("optional_then_join", "SELECT ?m ?t WHERE { ?m a :Module OPTIONAL { ?m :hasBook ?b FILTER(?b = <" + NS + "book_3>) } ?b a :Book ; :title ?t } ORDER BY ?m ?t LIMIT 40", f"SELECT {_iri('Module', 'o_orderkey')} AS m, p_name AS t FROM orders LEFT JOIN (SELECT * FROM {HB} WHERE l_partkey = 3) h ON l_orderkey = o_orderkey JOIN part ON l_partkey IS NULL OR l_partkey = p_partkey ORDER BY 1, 2 LIMIT 40")

sparql("open_join", "SELECT ?m ?t WHERE { ?m a :Module ; :hasCode ?k FILTER(?k < \"2\") OPTIONAL { ?m :hasBook ?b FILTER(?b != <" + NS + "book_1>) } OPTIONAL { ?b a :Book ; :title ?t } }", f"SELECT {_iri('Module', 'o_orderkey')} AS m, p_name AS t FROM orders LEFT JOIN (SELECT * FROM {HB} WHERE l_partkey <> 1) h ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey IS NULL OR l_partkey = p_partkey WHERE CAST(o_orderkey AS VARCHAR) < '2'")

_OPEN = "?m a :Module ; :hasCode ?k OPTIONAL { ?m :hasBook ?b FILTER(?b != <" + NS + "book_1>) }"
_OPEN_ROWS = f"SELECT CAST(o_orderkey AS VARCHAR) AS k, CASE WHEN l_partkey IS NOT NULL THEN {_iri('Book', 'l_partkey')} END AS b FROM orders LEFT JOIN (SELECT * FROM {HB} WHERE l_partkey <> 1) h ON l_orderkey = o_orderkey"
sparql("open_minus", f'SELECT ?k ?b WHERE {{ {_OPEN} MINUS {{ ?b a :Book ; :hasCode ?c FILTER(?c < "2") }} }}', f"{_OPEN_ROWS} WHERE l_partkey IS NULL OR CAST(l_partkey AS VARCHAR) >= '2'")
sparql("open_exists", f'SELECT ?k ?b WHERE {{ {_OPEN} FILTER EXISTS {{ ?b a :Book ; :hasCode ?c FILTER(?c < "2") }} }}', f"{_OPEN_ROWS} WHERE l_partkey IS NULL OR CAST(l_partkey AS VARCHAR) < '2'")
sparql("open_not_exists", f'SELECT ?k ?b WHERE {{ {_OPEN} FILTER NOT EXISTS {{ ?b a :Book ; :hasCode ?c FILTER(?c < "2" && ?c < ?k) }} }}', f"{_OPEN_ROWS} WHERE CASE WHEN l_partkey IS NULL THEN CAST(o_orderkey AS VARCHAR) <= '1' ELSE NOT (CAST(l_partkey AS VARCHAR) < '2' AND CAST(l_partkey AS VARCHAR) < CAST(o_orderkey AS VARCHAR)) END")

# paths
sparql("path_sequence", "SELECT (COUNT(*) AS ?n) (COUNT(DISTINCT ?b) AS ?books) WHERE { ?u :hasDepartment/:hasCourse/:hasModule/:hasBook ?b }", f"SELECT count(*) AS n, count(DISTINCT l_partkey) AS books FROM {CHAIN}")
_LINKS = f"(SELECT {_iri('University', 'c_nationkey')} AS s, {_iri('Department', 'c_custkey')} AS o FROM customer UNION ALL SELECT {_iri('Department', 'o_custkey')}, {_iri('Course', 'o_custkey * 10000 + y')} FROM {COURSE} k)"
sparql("path_closure", f"SELECT ?x WHERE {{ <{NS}university_3> (:hasDepartment|:hasCourse)* ?x }}", f"WITH RECURSIVE r(x) AS (SELECT '{NS}university_3' UNION SELECT o FROM r JOIN {_LINKS} e ON e.s = r.x) SELECT x FROM r")
sparql("path_plus", f"SELECT ?x ?d WHERE {{ ?x (:hasDepartment|:hasCourse|:hasModule)+ <{NS}module_33> . ?d :hasCourse|^:hasDepartment ?x }}", f"WITH up AS (SELECT n_nationkey, c_custkey, o_custkey * 10000 + year(o_orderdate) AS k FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey = 33), x AS (SELECT {_iri('University', 'n_nationkey')} AS x FROM up UNION SELECT {_iri('Department', 'c_custkey')} FROM up UNION SELECT {_iri('Course', 'k')} FROM up) SELECT x, {_iri('Department', 'o_custkey')} AS d FROM x JOIN {COURSE} c ON {_iri('Course', 'o_custkey * 10000 + y')} = x UNION ALL SELECT x, {_iri('Department', 'c_custkey')} FROM x JOIN customer ON {_iri('University', 'c_nationkey')} = x")
sparql("path_alternative", "SELECT (COUNT(*) AS ?n) WHERE { ?x (:hasCode|:hasURL) ?v }", f"SELECT (SELECT count(*) FROM orders) + 2 * (SELECT count(*) FROM part) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM {COURSE}) AS n")
sparql("path_inverse", "SELECT ?d (COUNT(?u) AS ?n) WHERE { ?d ^:hasDepartment ?u . ?d a :Department } GROUP BY ?d", f"SELECT {_iri('Department', 'c_custkey')} AS d, count(*) AS n FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1")
sparql("path_optional", f"SELECT ?x WHERE {{ <{NS}department_10> :hasCourse? ?x }}", f"SELECT {_iri('Department', '10')} AS x UNION SELECT {_iri('Course', 'o_custkey * 10000 + y')} FROM {COURSE} k WHERE o_custkey = 10")
sparql("path_negated", f"SELECT ?o WHERE {{ <{NS}book_5> !(a|:title) ?o }}", "SELECT '5' AS o UNION ALL SELECT 'http://example.org/book/5'")

sparql("path_literals", f"SELECT ?x ?y (isLiteral(?y) AS ?lit) (DATATYPE(?y) AS ?type) WHERE {{ VALUES ?x {{ <{NS}book_5> }} <{NS}book_5> (:title|:hasCode)? ?y }}", f"SELECT '{NS}book_5' AS x, y, lit, CASE WHEN lit THEN 'http://www.w3.org/2001/XMLSchema#string' END AS type FROM (SELECT '{NS}book_5' AS y, false AS lit UNION SELECT p_name, true FROM part WHERE p_partkey = 5 UNION SELECT '5', true)")
sparql("path_to_literals", f"SELECT ?y WHERE {{ <{NS}module_33> (:hasBook|:title)+ ?y FILTER(isLiteral(?y)) }}", f"SELECT o_orderpriority AS y FROM orders WHERE o_orderkey = 33 UNION SELECT p_name FROM part JOIN {HB} h ON l_partkey = p_partkey WHERE l_orderkey = 33")
_UP = "SELECT c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = 33"
sparql("path_between", f"SELECT ?n ?hit WHERE {{ ?u a :University ; :name ?n {{ SELECT (COUNT(*) AS ?hit) WHERE {{ {{ <{NS}university_3> (:hasDepartment|:hasCourse|:hasModule|:hasBook)+ <{NS}module_33> }} UNION {{ <{NS}module_33> ^:hasModule/(^:hasCourse|^:hasDepartment)* ?up FILTER(?up = <{NS}university_3>) }} UNION {{ <{NS}university_3> :hasCourse* <{NS}university_3> }} }} }} }}", f"SELECT n_name AS n, 1 + 2 * (SELECT count(*) FROM ({_UP}) WHERE c_nationkey = 3) AS hit FROM nation")

# forms and graphs
sparql("select_star", "SELECT * WHERE { ?u a :University ; :name ?n }", f"SELECT {_iri('University', 'n_nationkey')} AS u, n_name AS n FROM nation")
sparql("reduced_titles", "SELECT REDUCED ?t WHERE { ?m a :Module ; :title ?t }", "SELECT DISTINCT o_orderpriority AS t FROM orders")


@built("named_graphs", "SELECT 'http://g/all' AS g, CAST((SELECT count(*) FROM customer) AS BIGINT) AS n UNION ALL SELECT 'http://g/few', count(*) FROM customer WHERE c_nationkey < 5")
def named_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = campus(spark, sf_dir)
    few = Graph(spark, whole.tables, whole.edges | {"hasDepartment": whole.edges["hasDepartment"].filter("s < 5")}, whole.catalog, unique=True, codes=whole.codes)
    both = Graph(spark, whole.tables, whole.edges, whole.catalog, {"http://g/all": whole, "http://g/few": few}, unique=True, codes=whole.codes)
    return query(both, "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?u :hasDepartment ?d } } GROUP BY ?g")


@built("merged_graphs", "SELECT count(*) AS n FROM customer WHERE c_nationkey < 10")
def merged_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two default graphs that overlap."""
    whole = campus(spark, sf_dir)
    part = lambda test: Graph(spark, whole.tables, whole.edges | {"hasDepartment": whole.edges["hasDepartment"].filter(test)}, whole.catalog, unique=True)
    both = Graph(spark, whole.tables, whole.edges, whole.catalog, {"http://g/a": part("s < 7"), "http://g/b": part("s BETWEEN 3 AND 9")}, unique=True)
    return query(both, "SELECT (COUNT(*) AS ?n) FROM <http://g/a> FROM <http://g/b> WHERE { ?u :hasDepartment ?d }")


@built("named_only", "SELECT CAST(0 AS BIGINT) AS n, count(*) AS named FROM customer WHERE c_nationkey < 4")
def named_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a default graph in the query, patterns outside GRAPH find nothing."""
    whole = campus(spark, sf_dir)
    few = Graph(spark, whole.tables, whole.edges | {"hasDepartment": whole.edges["hasDepartment"].filter("s < 4")}, whole.catalog, unique=True, codes=whole.codes)
    both = Graph(spark, whole.tables, whole.edges, whole.catalog, {"http://g/few": few}, unique=True, codes=whole.codes)
    return query(both, "SELECT ?n ?named FROM NAMED <http://g/few> WHERE { { SELECT (COUNT(*) AS ?n) WHERE { ?u a :University } } { SELECT (COUNT(*) AS ?named) WHERE { GRAPH <http://g/few> { ?u :hasDepartment ?d } } } }")


# sets, order, limits
sparql("union_terms", "SELECT ?name ?title WHERE { { ?x a :University ; :name ?name } UNION { ?y a :Book ; :title ?title } }", "SELECT n_name AS name, NULL AS title FROM nation UNION ALL SELECT NULL, p_name FROM part")
sparql("distinct_titles", "SELECT DISTINCT ?title WHERE { ?b a :Book ; :title ?title } ORDER BY ?title LIMIT 10", "SELECT DISTINCT p_name AS title FROM part ORDER BY 1 LIMIT 10")
sparql("order_limit_topk", "SELECT ?d (COUNT(?m) AS ?n) WHERE { ?d :hasCourse ?c . ?c :hasModule ?m } GROUP BY ?d ORDER BY DESC(?n) ?d LIMIT 15", f"SELECT {_iri('Department', 'o_custkey')} AS d, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, d LIMIT 15")
sparql("offset_page", "SELECT ?t ?c WHERE { ?m a :Module ; :title ?t ; :hasCode ?c } ORDER BY ?t DESC(?c) LIMIT 25 OFFSET 100", "SELECT o_orderpriority AS t, CAST(o_orderkey AS VARCHAR) AS c FROM orders ORDER BY 1, 2 DESC LIMIT 25 OFFSET 100")
sparql("deep_page", "SELECT ?m ?b WHERE { ?m :hasBook ?b } ORDER BY ?b DESC(?m) LIMIT 40 OFFSET 50000", f"SELECT {_iri('Module', 'l_orderkey')} AS m, {_iri('Book', 'l_partkey')} AS b FROM {HB} h ORDER BY 2, 1 DESC LIMIT 40 OFFSET 50000")
sparql("order_by_expression", "SELECT ?n WHERE { ?u a :University ; :name ?n } ORDER BY DESC(STRLEN(?n)) ?n LIMIT 5", "SELECT n_name AS n FROM nation ORDER BY length(n_name) DESC, n_name LIMIT 5")
sparql("unbound_first", "SELECT ?c ?b WHERE { ?m :hasCode ?c ; a :Module OPTIONAL { ?m :hasBook ?b } } ORDER BY ?b ?c LIMIT 20", f"SELECT CAST(o_orderkey AS VARCHAR) AS c, CASE WHEN l_partkey IS NOT NULL THEN {_iri('Book', 'l_partkey')} END AS b FROM orders LEFT JOIN {HB} h ON o_orderkey = l_orderkey ORDER BY l_partkey NULLS FIRST, c LIMIT 20")

_MIXED = '{ ?x a :University ; :name ?t BIND(STRLEN(?t) AS ?g) BIND(?x AS ?v) } UNION { ?x a :University ; :name ?v BIND(STRLEN(?v) AS ?g) } UNION { ?x a :University ; :name ?t BIND(STRLEN(?t) AS ?g) BIND(?g AS ?v) } UNION { ?x a :University ; :name ?t BIND(STRLEN(?t) AS ?g) BIND(?g + 0.5 AS ?v) } UNION { ?x a :University ; :name ?t BIND(STRLEN(?t) AS ?g) }'
_MIXED_ROWS = f"SELECT length(n_name) AS g, 1 AS r, NULL AS n, {_iri('University', 'n_nationkey')} AS v FROM nation UNION ALL SELECT length(n_name), 3, NULL, n_name FROM nation UNION ALL SELECT length(n_name), 2, length(n_name), CAST(length(n_name) AS VARCHAR) FROM nation UNION ALL SELECT length(n_name), 2, length(n_name) + 0.5, CAST(length(n_name) AS VARCHAR) || '.5' FROM nation UNION ALL SELECT length(n_name), 0, NULL, NULL FROM nation"
sparql("mixed_order", f"SELECT ?v (isIRI(?v) AS ?iri) WHERE {{ {_MIXED} }} ORDER BY ?v LIMIT 30 OFFSET 40", f"SELECT v, r = 1 AS iri FROM (SELECT * FROM ({_MIXED_ROWS}) ORDER BY r, n, v LIMIT 30 OFFSET 40)", as_text=False)
sparql("mixed_extremes", f"SELECT ?g (MIN(?v) AS ?lo) (MAX(?v) AS ?hi) WHERE {{ {_MIXED} FILTER(BOUND(?v)) }} GROUP BY ?g", f"SELECT g, arg_min(v, (r, n, v)) AS lo, arg_max(v, (r, n, v)) AS hi FROM ({_MIXED_ROWS}) WHERE r > 0 GROUP BY g")


_PLAIN_CITY = "strip_accents(lower(city))"


@built("accent_insensitive", f"SELECT c, n, p IN ('dunes', 'gores') AS same FROM (SELECT DISTINCT CAST(client_id AS VARCHAR) AS c, city AS n, {_PLAIN_CITY} AS p FROM clients WHERE client_id IS NOT NULL) WHERE contains(p, 'gor') OR p = 'dunes' OR starts_with(p, 'port') OR ends_with(p, 'hav')")
def accent_insensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients' cities found however they are accented or capitalised, under a catalog with such a collation."""
    graph, clients = campus(spark, sf_dir), spark.read.parquet(f"{sf_dir}/clients.parquet")
    rows = clients.filter("client_id IS NOT NULL").select(F.col("client_id").alias("key"), F.col("city").alias("name"), F.col("client_id").cast("string").alias("hasCode"))
    own = Graph(spark, graph.tables | {"Department": rows}, graph.edges, Catalog(collation="UNICODE_CI_AI"))
    return query(own, 'SELECT ?c ?n (?n IN ("DUNÉS", "gores") AS ?same) WHERE { ?d a :Department ; :hasCode ?c ; :name ?n FILTER(CONTAINS(?n, "gÓR") || ?n = "dünes" || STRSTARTS(?n, "PÖRT") || STRENDS(?n, "háv")) }')


# filters and functions
sparql("filter_year_range", "SELECT ?year (COUNT(*) AS ?n) WHERE { ?c a :Course ; :year ?year FILTER((?year>=1996) && (?year<1999)) } GROUP BY ?year", f"SELECT CAST(y AS INTEGER) AS year, count(*) AS n FROM {COURSE} k WHERE y >= 1996 AND y < 1999 GROUP BY 1")
sparql("contains_ci", 'SELECT DISTINCT ?t WHERE { ?b a :Book ; :title ?t FILTER(CONTAINS(LCASE(?t), LCASE("RE"))) }', "SELECT DISTINCT p_name AS t FROM part WHERE contains(lower(p_name), 're')")
sparql("comparisons", 'SELECT ?y (COUNT(*) AS ?n) WHERE { ?c a :Course ; :year ?y FILTER(?y IN (1995, 1997) || !(?y <= 1999)) FILTER(?y NOT IN (2001) && ?y != 2000.0) } GROUP BY ?y', f"SELECT CAST(y AS INTEGER) AS y, count(*) AS n FROM {COURSE} k WHERE (y IN (1995, 1997) OR NOT (y <= 1999)) AND y NOT IN (2001) AND y <> 2000 GROUP BY 1")
sparql("bind_replace_ns", r'SELECT ?ns (COUNT(*) AS ?n) WHERE { ?s a ?class BIND(REPLACE(STR(?class), "(.*[/#])[^/#]*$", "$1") AS ?ns) } GROUP BY ?ns', f"SELECT regexp_replace(class, '(.*[/#])[^/#]*$', '\\1') AS ns, CAST(sum(n) AS BIGINT) AS n FROM ({_CLASS_ROWS}) GROUP BY 1")
sparql("group_concat_distinct", "SELECT ?u (GROUP_CONCAT(DISTINCT ?k) AS ?codes) WHERE { ?u :hasDepartment ?d . ?d :hasCode ?k } GROUP BY ?u", f"SELECT {_iri('University', 'c_nationkey')} AS u, string_agg(DISTINCT CAST(c_custkey AS VARCHAR), ' ' ORDER BY CAST(c_custkey AS VARCHAR)) AS codes FROM customer WHERE c_nationkey IS NOT NULL GROUP BY c_nationkey")
sparql("having_count", "SELECT ?t (COUNT(?b) AS ?n) WHERE { ?b a :Book ; :title ?t } GROUP BY ?t HAVING (COUNT(?b) > 30)", "SELECT p_name AS t, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 30")
sparql("aggregates", "SELECT ?d (SUM(?y) AS ?s) (MIN(?y) AS ?lo) (MAX(?y) AS ?hi) (SAMPLE(?y) AS ?one) WHERE { ?d :hasCourse ?c . ?c :year ?y } GROUP BY ?d", f"SELECT {_iri('Department', 'o_custkey')} AS d, CAST(sum(y) AS BIGINT) AS s, CAST(min(y) AS INTEGER) AS lo, CAST(max(y) AS INTEGER) AS hi, CAST(min(y) AS INTEGER) AS one FROM {COURSE} k GROUP BY o_custkey")
sparql("averages", "SELECT ?d (FLOOR(AVG(?y)) AS ?a) (AVG(DISTINCT ?z) AS ?one) WHERE { ?d :hasCourse ?c . ?c :year ?y BIND(2.5 AS ?z) } GROUP BY ?d", f"SELECT {_iri('Department', 'o_custkey')} AS d, CAST(floor(avg(y)) AS DECIMAL(38,18)) AS a, CAST(2.5 AS DECIMAL(38,18)) AS one FROM {COURSE} k GROUP BY o_custkey")
sparql("division", "SELECT ?c ((?y / 3) AS ?third) ((1.5 / 4) AS ?part) ((?y / 0) AS ?none) WHERE { ?c a :Course ; :year ?y }", f"SELECT {_iri('Course', 'o_custkey * 10000 + y')} AS c, CAST(CAST(q // 1000000000000000000 AS VARCHAR) || '.' || lpad(CAST(q % 1000000000000000000 AS VARCHAR), 18, '0') AS DECIMAL(38,18)) AS third, CAST(0.375 AS DECIMAL(38,18)) AS part, CAST(NULL AS DECIMAL(38,18)) AS none FROM (SELECT *, (CAST(y AS HUGEINT) * 1000000000000000000 + 1) // 3 AS q FROM {COURSE} x) k")
sparql("tagged_text", "SELECT ?n ((?n = 'ITALY'@en) AS ?eq) (sameTerm('a'@en, 'a') AS ?st) (DATATYPE('a'@en) AS ?dt) (LANG(STRLANG(?n, 'EL')) AS ?l) ((STRLANG(?n, 'el') = STRLANG(?n, 'EL')) AS ?same) ((STRDT(?n, <http://c>) = ?n) AS ?unknown) WHERE { ?u a :University ; :name ?n }", "SELECT n_name AS n, false AS eq, false AS st, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString' AS dt, 'el' AS l, true AS same, CAST(NULL AS BOOLEAN) AS unknown FROM nation")
sparql("offsets", 'SELECT ?u (HOURS(?d) AS ?h) (SECONDS(?d) AS ?s) (TZ(?d) AS ?tz) (TIMEZONE(?d) AS ?zone) ((?d = xsd:dateTime("2011-01-10T19:45:13.815Z")) AS ?same) (STR(?d) AS ?text) WHERE { ?u a :University BIND(xsd:dateTime("2011-01-10T14:45:13.815-05:00") AS ?d) }', f"SELECT {_iri('University', 'n_nationkey')} AS u, CAST(14 AS BIGINT) AS h, CAST(13.815 AS DECIMAL(38,18)) AS s, '-05:00' AS tz, '-PT5H' AS zone, true AS same, '2011-01-10T14:45:13.815-05:00' AS text FROM nation")
sparql("positions", "SELECT ?n (SUBSTR(?n, 0, 3) AS ?a) (SUBSTR(?n, -1) AS ?b) (SUBSTR(?n, 1.5, 2.6) AS ?c) (REPLACE(CONCAT(?n, '.A'), '.A', '$', 'q') AS ?q) WHERE { ?u a :University ; :name ?n }", "SELECT n_name AS n, substr(n_name, 1, 2) AS a, n_name AS b, substr(n_name, 2, 3) AS c, replace(n_name || '.A', '.A', '$') AS q FROM nation")
sparql("aggregates_empty", "SELECT (SUM(?y) AS ?s) (COUNT(?y) AS ?n) (GROUP_CONCAT(?y) AS ?g) WHERE { ?c a :Course ; :year ?y FILTER(?y > 3000) }", "SELECT CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS n, '' AS g")
sparql("group_by_expression", "SELECT ?decade (COUNT(*) AS ?n) WHERE { ?c a :Course ; :year ?y } GROUP BY (FLOOR(?y / 10) AS ?decade)", f"SELECT CAST(floor(y / 10) AS DECIMAL(38,18)) AS decade, count(*) AS n FROM {COURSE} k GROUP BY 1")
sparql("coalesce_if", 'SELECT ?m (COALESCE(?b, "none") AS ?x) (IF(BOUND(?b), "used", "unused") AS ?u) WHERE { ?m a :Module OPTIONAL { ?m :hasBook ?b . ?b :hasCode "9" } }', f"SELECT {_iri('Module', 'o_orderkey')} AS m, coalesce(CASE WHEN l_partkey IS NOT NULL THEN {_iri('Book', 'l_partkey')} END, 'none') AS x, CASE WHEN l_partkey IS NOT NULL THEN 'used' ELSE 'unused' END AS u FROM orders LEFT JOIN (SELECT * FROM {HB} WHERE l_partkey = 9) h ON o_orderkey = l_orderkey", as_text=True)
sparql("string_functions", 'SELECT ?n (UCASE(?n) AS ?up) (STRLEN(?n) AS ?len) (SUBSTR(?n, 2, 3) AS ?sub) (STRBEFORE(?n, "A") AS ?bef) (STRAFTER(?n, "A") AS ?aft) (CONCAT(?n, "-", ?n) AS ?cc) (ENCODE_FOR_URI(CONCAT(?n, " *~")) AS ?enc) (STRENDS(?n, "A") AS ?ends) (REGEX(?n, "^a", "i") AS ?rx) WHERE { ?u a :University ; :name ?n }', "SELECT n_name AS n, upper(n_name) AS up, length(n_name) AS len, substr(n_name, 2, 3) AS sub, CASE WHEN strpos(n_name, 'A') > 0 THEN substr(n_name, 1, strpos(n_name, 'A') - 1) ELSE '' END AS bef, CASE WHEN strpos(n_name, 'A') > 0 THEN substr(n_name, strpos(n_name, 'A') + 1) ELSE '' END AS aft, n_name || '-' || n_name AS cc, replace(n_name, ' ', '%20') || '%20%2A~' AS enc, ends_with(n_name, 'A') AS ends, regexp_matches(n_name, '^a', 'i') AS rx FROM nation")
sparql("numeric_functions", "SELECT ?y (ABS(0 - ?y) AS ?a) (?y + 1 AS ?p) (ROUND(0 - 2.5) AS ?r) (CEIL(2.1) AS ?c) (FLOOR(0 - 2.1) AS ?f) (?y * 2 AS ?t) (?y / 0 AS ?z) WHERE { ?k a :Course ; :year ?y } ORDER BY ?y LIMIT 3".replace("(?y + 1 AS ?p)", "((?y + 1) AS ?p)"), f"SELECT CAST(y AS INTEGER) AS y, y AS a, y + 1 AS p, CAST(-2 AS DECIMAL(38,18)) AS r, CAST(3 AS DECIMAL(38,18)) AS c, CAST(-3 AS DECIMAL(38,18)) AS f, y * 2 AS t, CAST(NULL AS DECIMAL(38,18)) AS z FROM {COURSE} k ORDER BY y LIMIT 3")
sparql("date_functions", 'SELECT ?u (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?dd) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?mi) (SECONDS(?d) AS ?s) WHERE { ?u a :University BIND(xsd:dateTime("2024-02-29T13:14:15") AS ?d) }', f"SELECT {_iri('University', 'n_nationkey')} AS u, 2024 AS y, 2 AS m, 29 AS dd, 13 AS h, 14 AS mi, CAST(15 AS DECIMAL(38,18)) AS s FROM nation")
sparql("hash_functions", "SELECT ?n (MD5(?n) AS ?m) (SHA1(?n) AS ?s1) (SHA256(?n) AS ?s2) WHERE { ?u a :University ; :name ?n }", "SELECT n_name AS n, md5(n_name) AS m, sha1(n_name) AS s1, sha256(n_name) AS s2 FROM nation")
sparql("cast_errors", 'SELECT ?k (xsd:integer(?k) AS ?i) (xsd:integer(CONCAT("x", ?k)) AS ?bad) (xsd:boolean("1") AS ?b) (xsd:string(?y) AS ?s) WHERE { ?d a :Department ; :hasCode ?k ; :hasCourse ?c . ?c :year ?y FILTER(xsd:integer(?k) < 20) }', f"SELECT CAST(c_custkey AS VARCHAR) AS k, c_custkey AS i, CAST(NULL AS BIGINT) AS bad, true AS b, CAST(y AS VARCHAR) AS s FROM {COURSE} k JOIN customer ON c_custkey = o_custkey WHERE c_custkey < 20")
sparql("term_tests", "SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o FILTER(isIRI(?s) && isLiteral(?o) && !isBlank(?o) && isNumeric(?o) && DATATYPE(?o) = xsd:integer && LANG(?o) = \"\") }", f"SELECT count(*) AS n FROM {COURSE} k")
sparql("ask_form", "ASK { ?m :hasBook ?b . ?b :hasCode \"1\" }", "SELECT count(*) > 0 AS ask FROM lineitem WHERE l_partkey = 1")
sparql("construct_form", "CONSTRUCT { ?b :usedIn ?m . ?m :uses ?b } WHERE { ?m :hasBook ?b . ?b :hasCode \"12\" }", f"SELECT {_iri('Book', 'l_partkey')} AS s, '{NS}usedIn' AS p, {_iri('Module', 'l_orderkey')} AS o FROM {HB} h WHERE l_partkey = 12 UNION SELECT {_iri('Module', 'l_orderkey')}, '{NS}uses', {_iri('Book', 'l_partkey')} FROM {HB} h WHERE l_partkey = 12")
sparql("result_stringify", "SELECT ?c ?y ?t WHERE { ?c a :Course ; :year ?y ; :title ?t }", f"SELECT {_iri('Course', 'o_custkey * 10000 + y')} AS c, CAST(y AS VARCHAR) AS y, c_mktsegment || ' ' || CAST(y AS VARCHAR) AS t FROM {COURSE} k JOIN customer ON c_custkey = o_custkey", as_text=True)


# the question pipeline, over the supplied conversations, documents and events
def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")


@built("clean_fences", "SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '^\\s+', ''), '\\s+$', '') AS cleaned FROM conversations")
def clean_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("```sparql\n"), F.coalesce("text", F.lit("")), F.lit("\n```"))
    return _turns(spark, sf_dir).select("conv_id", "turn", T.clean(fenced).alias("cleaned"))


@built("not_answerable_flag", "SELECT conv_id, turn, turn % 2 = 0 AS flagged FROM conversations")
def not_answerable_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" \n#  NOT_ANSWERABLE: "), F.coalesce("text", F.lit("")))).otherwise(F.concat(F.lit("SELECT "), F.coalesce("text", F.lit(""))))
    return _turns(spark, sf_dir).select("conv_id", "turn", T.not_answerable(marked).alias("flagged"))


@built("cache_key", "SELECT conv_id, turn, sha256(CAST(length(role) AS VARCHAR) || ':' || role || CAST(length(text) AS VARCHAR) || ':' || text) AS key FROM conversations")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", T.cache_key_column(F.col("role"), F.col("text")).alias("key"))


@built("cache_lookup", "SELECT a.conv_id, a.turn, b.text AS hit FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda turn: T.cache_key_column(F.col("conv_id").cast("string"), turn.cast("string"))
    cache = _turns(spark, sf_dir).select(key(F.col("turn")).alias("key"), F.col("text").alias("hit"))
    return _turns(spark, sf_dir).withColumn("key", key(F.col("turn") + 1)).join(cache, "key", "left").select("conv_id", "turn", "hit")


@built("token_estimate", r"SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '[^ \t\n\v\f\r]+')) AS BIGINT) AS tokens FROM conversations".replace(r"\v", r"\x0B"))
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", T.token_estimate(F.col("text")).alias("tokens"))


@built("token_accumulate", "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY 1")
def token_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).groupBy("conv_id").agg(T.joined(F.col("turn"), F.col("text")).alias("text"))


@built("retry_summary", "SELECT conv_id AS request_id, CAST(sum(length(text)) AS BIGINT) AS input_tokens, CAST(sum(turn) AS BIGINT) AS output_tokens, CAST(coalesce(min(CASE WHEN length(text) % 3 = 0 THEN turn END), max(turn)) AS INTEGER) AS retries, bool_or(length(text) % 3 = 0) AS ok, arg_max(text, turn) AS sparql FROM conversations GROUP BY 1")
def retry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("text").cast("bigint")
    attempts = _turns(spark, sf_dir).select(F.col("conv_id").alias("request_id"), F.col("turn").alias("attempt"), F.col("text").alias("sparql"), F.when(size % 3 != 0, "invalid").alias("error"), size.alias("input_tokens"), F.col("turn").alias("output_tokens"))
    return pipeline.summarize_attempts(attempts)


@built("retry_events", """SELECT conv_id AS request_id, CAST(turn AS INTEGER) AS seq, 'sparql_retry' AS event, '{"attempt":' || CAST(turn + 1 AS VARCHAR) || ',"error":"' || substr(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), 1, 120) || '"}' AS data FROM conversations WHERE turn < 2 AND length(text) % 3 <> 0""")
def retry_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = _turns(spark, sf_dir).select(F.col("conv_id").alias("request_id"), F.col("turn").cast("int").alias("attempt"), F.when(F.length("text") % 3 != 0, F.regexp_replace("text", "[^a-zA-Z ]", "")).alias("error"))
    return pipeline.retry_events(attempts)


@built("prompt_section", "SELECT n_nationkey, 'Ask about ' || n_name || '.' || chr(10) || chr(10) || '## Part' AS system FROM nation")
def prompt_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("---\nname: x\n---\n\n# System\n\nAsk about "), F.col("n_name"), F.lit(".\n\n## Part\n\n# User\n{question}"))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", T.system_column(text).alias("system"))


@built("template_fill", "SELECT n_nationkey, 'Hello ' || n_name || ', WHERE { ?s ?p ?o } {other} ' || CAST(n_nationkey AS VARCHAR) || n_name AS text FROM nation")
def template_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", T.fill_column("Hello {name}, WHERE { ?s ?p ?o } {other} {n}{name}", name=F.col("n_name"), n=F.col("n_nationkey")).alias("text"))


@built("local_labels", "SELECT page_id, regexp_extract(url, '[^/]*$') AS label FROM pages")
def local_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.local_label(F.col("url")).alias("label"))


@built("event_fold_results", """WITH e AS (SELECT user_id, event_type, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
d AS (SELECT *, max(CASE WHEN event_type = 'error' THEN i END) OVER (PARTITION BY user_id) AS gone, max(CASE WHEN event_type IN ('error', 'signup') THEN i END) OVER (PARTITION BY user_id) AS reset FROM e)
SELECT user_id, CASE WHEN min(reset) IS NULL OR min(reset) = min(gone) THEN 'idle' ELSE 'streaming' END AS status,
  CASE WHEN min(reset) IS NOT NULL AND (min(gone) IS NULL OR min(reset) > min(gone)) THEN arg_max(props, i) FILTER (WHERE event_type = 'view' AND i > reset) END AS results FROM d GROUP BY user_id""")
def event_fold_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States that meet results, dismissals and a user's own cancelling, which changes nothing."""
    names = F.create_map(*[F.lit(x) for kv in {"signup": "SUBMIT", "view": "RESULTS", "error": "DISMISS", "click": "ABORT", "purchase": "ABORT"}.items() for x in kv])
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", names[F.col("event_type")].alias("event"), F.col("props").alias("data"))
    return fold(events, "user_id", ["ts", "event_id"]).select("user_id", "status", "results")


@built("sse_parse", r"SELECT conv_id AS request_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq, role AS event, regexp_replace(text, '\s', ' ', 'g') || chr(10) || CAST(turn AS VARCHAR) AS data FROM conversations")
def sse_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    one_line = F.regexp_replace("text", r"[\s\x0B]", " ")
    events = turns.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), F.col("role").alias("event"), F.concat(one_line, F.lit("\n"), F.col("turn").cast("string")).alias("data"))
    return parse_events(format_events(events))


#: What stands for what when stored events play an answer's events.
PLAYED = {"signup": "SUBMIT", "view": "TOKEN", "click": "COMPLETE", "purchase": "DONE", "error": "ERROR"}
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PLAYED.items()) + " END"


@built(
    "event_fold",
    f"""WITH e AS (SELECT user_id, ts, event_id, {_CASE} AS event, props AS data FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM e),
s AS (SELECT *, max(CASE WHEN event = 'SUBMIT' THEN i END) OVER (PARTITION BY user_id) AS submit FROM n),
a AS (SELECT * FROM s WHERE submit IS NULL OR i >= submit),
k AS (SELECT *, min(CASE WHEN event IN ('DONE', 'ERROR') THEN i END) OVER (PARTITION BY user_id) AS stop FROM a),
t AS (SELECT *, max(CASE WHEN event = 'COMPLETE' AND (stop IS NULL OR i < stop) THEN i END) OVER (PARTITION BY user_id) AS complete FROM k)
SELECT user_id,
  CASE WHEN max(CASE WHEN event = 'ERROR' THEN i END) IS NOT NULL AND (min(submit) IS NULL OR min(CASE WHEN i = stop THEN event END) = 'ERROR' OR max(CASE WHEN event = 'ERROR' THEN i END) > min(stop)) THEN 'error'
       WHEN min(submit) IS NULL THEN 'idle' WHEN min(CASE WHEN i = stop THEN event END) = 'DONE' THEN 'done' ELSE 'streaming' END AS status,
  CASE WHEN min(submit) IS NOT NULL THEN coalesce(max(CASE WHEN i = complete THEN data END), '') || coalesce(string_agg(CASE WHEN event = 'TOKEN' AND (stop IS NULL OR i < stop) AND (complete IS NULL OR i > complete) THEN data END, '' ORDER BY i), '') END AS sparql,
  CAST(NULL AS VARCHAR) AS results,
  CASE WHEN min(submit) IS NOT NULL AND min(CASE WHEN i = stop THEN event END) = 'DONE' THEN max(CASE WHEN i = stop THEN data END) END AS done,
  arg_max(data, i) FILTER (WHERE event = 'ERROR') AS message
FROM t GROUP BY user_id""",
)
def event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    names = F.create_map(*[F.lit(x) for kv in PLAYED.items() for x in kv])
    return fold(events.select("user_id", "ts", "event_id", names[F.col("event_type")].alias("event"), F.col("props").alias("data")), "user_id", ["ts", "event_id"])


@built("event_fold_streamed", ORACLES["event_fold"])
def event_fold_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fold by a stream that keeps a state per user; the last row that it tells of each user is the state."""
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/fold-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    names = F.create_map(*[F.lit(x) for kv in PLAYED.items() for x in kv])
    at = F.concat(F.lpad(F.col("us").cast("string"), 20, "0"), F.lpad(F.col("event_id").cast("string"), 20, "0"))
    rows = events.select("us", "user_id", at.alias("at"), names[F.col("event_type")].alias("event"), F.col("props").alias("data"))
    cuts = rows.agg(F.percentile_approx("us", [0.3, 0.6])).first()[0] or []
    keep = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/n={n}")  # noqa: E731  a batch that comes again replaces itself
    part = sum((F.col("us") > c).cast("int") for c in cuts) if cuts else F.lit(0)
    for n in range(len(cuts) + 1):  # a start of the stream for each part, on one checkpoint
        rows.filter(part == n).drop("us").write.mode("append").parquet(f"{folder}/in")
        states = fold_stream(spark.readStream.schema(rows.drop("us").schema).parquet(f"{folder}/in"), "user_id", "bigint", "at")
        states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start().awaitTermination()
    every = spark.read.parquet(f"{folder}/out").drop("n")
    last = every.groupBy("user_id").agg(F.max("batch").alias("batch"))
    return every.join(last, ["user_id", "batch"]).drop("batch")


@built("providers_explode", "SELECT * FROM (VALUES ('templates', 'rules-1', 'rules-1'), ('canned', 'fixed-1', 'fixed-1'), ('canned', 'fixed-2', 'fixed-1')) v(id, model, \"default\")")
def providers_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.providers(spark).select("id", F.explode("models").alias("model"), F.col("models")[0].alias("default"))


_NAMESPACES = f"SELECT DISTINCT regexp_replace(iri, '(.*[/#])[^/#]*$', '\\1') AS ns FROM ({_IRIS}) ORDER BY ns LIMIT 50"
_SAMPLES = f"SELECT class, string_agg(label, ', ' ORDER BY s) AS samples FROM (SELECT class, s, coalesce(label, split_part(s, '/', -1)) AS label, row_number() OVER (PARTITION BY class ORDER BY s) AS i FROM ({_LABELS}) WHERE class IN (SELECT class FROM ({_CLASS_COUNTS}) ORDER BY count DESC, class LIMIT 10)) WHERE i <= 3 GROUP BY class"
_FIXED = ((0, ("# Summary of the graph", "", "Endpoint: `tables`", "", "## Namespaces", "")), (2, ("", "## Classes", "", "| Class | Count | Samples |", "|---|---:|---|")), (4, ("", "## Properties", "", "| Property | Count |", "|---|---:|")), (6, ("", "## Schema for a prompt", "", "```turtle", "# the most useful classes and properties", "```")))
_FIXED_ROWS = ", ".join(f"({part}, {i}, '', '{x}')" for part, lines in _FIXED for i, x in enumerate(lines))


@built(
    "report_lines",
    f"""WITH c AS (SELECT * FROM ({_CLASS_COUNTS}) ORDER BY count DESC, class LIMIT 50), p AS (SELECT * FROM ({_PROPERTY_COUNTS}) ORDER BY count DESC, p LIMIT 100)
SELECT row_number() OVER (ORDER BY part, rank, name) AS n, line FROM (
  SELECT * FROM (VALUES {_FIXED_ROWS}) f(part, rank, name, line)
  UNION ALL SELECT 1, 0, ns, '- `' || ns || '`' FROM ({_NAMESPACES})
  UNION ALL SELECT 3, -count, c.class, '| `' || c.class || '` | ' || format('{{:,}}', count) || ' | ' || coalesce(samples, '') || ' |' FROM c LEFT JOIN ({_SAMPLES}) s ON s.class = c.class
  UNION ALL SELECT 5, -count, p, '| `' || p || '` | ' || format('{{:,}}', count) || ' |' FROM p)""",
)
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_lines(campus(spark, sf_dir))


_ASKED = {0: ("How many books are there?", "SELECT (COUNT(*) AS ?n) WHERE { ?x a :Book }"), 1: ("List all modules", "SELECT DISTINCT ?label WHERE { ?x a :Module ; :title ?label } ORDER BY ?label"), 2: ("Which courses are there?", "SELECT DISTINCT ?label WHERE { ?x a :Course ; :title ?label } ORDER BY ?label LIMIT 50"), 3: ("Tell me about the weather", "# NOT_ANSWERABLE: no known class is named")}


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for every turn; each seventh conversation names a provider that isn't there."""
    asked = F.element_at(F.create_map(*[F.lit(x) for k, (q, _) in _ASKED.items() for x in (k, q)]), (F.col("turn") % 4).cast("int"))
    name = F.when(F.col("conv_id") % 7 == 0, "nobody").otherwise("templates")
    turns = _turns(spark, sf_dir).filter(F.length(F.trim("text")) > 0)
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), asked.alias("question"), name.alias("provider"), F.lit("rules-1").alias("model"))


@built("questions", "SELECT conv_id * 1000 + turn AS request_id, CAST(0 AS INTEGER) AS retries, conv_id % 7 <> 0 AS ok, CASE WHEN conv_id % 7 <> 0 THEN CASE turn % 4 " + " ".join(f"WHEN {k} THEN '{x}'" for k, (_, x) in _ASKED.items()) + " END END AS sparql FROM conversations WHERE length(trim(text)) > 0")
def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.summarize_attempts(pipeline.translate_batch(_requests(spark, sf_dir), campus(spark, sf_dir))).select("request_id", "retries", "ok", "sparql")


_SYSTEM_WORDS = len(T.fill(pipeline.SYSTEM, ontology_summary=pipeline.summary(Catalog())).split())
_ANSWERS = {
    0: ("['n']", "[map {'n': CAST((SELECT count(*) FROM part) AS VARCHAR)}]"),
    1: ("['label']", "(SELECT list(map {'label': t} ORDER BY t) FROM (SELECT DISTINCT o_orderpriority AS t FROM orders))"),
    2: ("['label']", f"(SELECT list(map {{'label': t}} ORDER BY t) FROM (SELECT DISTINCT c_mktsegment || ' ' || CAST(y AS VARCHAR) AS t FROM {COURSE} k JOIN customer ON c_custkey = o_custkey ORDER BY t LIMIT 50))"),
    3: ("CAST([] AS VARCHAR[])", "CAST([] AS MAP(VARCHAR, VARCHAR)[])"),
}
_ASKED_CASE = lambda f: "CASE turn % 4 " + " ".join(f"WHEN {k} THEN {f(k)}" for k in _ASKED) + " END"


@built("question_responses", f"""SELECT conv_id * 1000 + turn AS request_id, CASE WHEN conv_id % 7 <> 0 THEN CAST(to_json({{'sparql': {_ASKED_CASE(lambda k: f"'{_ASKED[k][1]}'")}, 'columns': {_ASKED_CASE(lambda k: _ANSWERS[k][0])}, 'rows': {_ASKED_CASE(lambda k: _ANSWERS[k][1])}, 'provider': 'templates', 'model': 'rules-1', 'input_tokens': {_ASKED_CASE(lambda k: _SYSTEM_WORDS + len(_ASKED[k][0].split()))}, 'output_tokens': {_ASKED_CASE(lambda k: len(_ASKED[k][1].split()))}, 'retries': 0}}) AS VARCHAR) END AS response,
  CASE WHEN conv_id % 7 = 0 THEN 'unknown provider nobody / rules-1' END AS error FROM conversations WHERE length(trim(text)) > 0""")
def question_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch with its results: each distinct query runs once, and every request gets its response."""
    answers = batch.answer_batch(_requests(spark, sf_dir), campus(spark, sf_dir))
    made = pipeline.to_responses(answers.filter("error IS NULL"))
    return answers.select("request_id", "error").join(made, "request_id", "left").select("request_id", "response", "error")


@built("cached_questions", "SELECT conv_id * 1000 + turn AS request_id, turn % 4 = 1 AS hit FROM conversations WHERE length(trim(text)) > 0 AND conv_id % 7 <> 0")
def cached_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch with a cache that holds one question's answer; hits cost no tokens."""
    graph = campus(spark, sf_dir)
    system = T.fill(pipeline.SYSTEM, ontology_summary=pipeline.summary(graph))
    cache = spark.createDataFrame([(T.cache_key("templates", "rules-1", system, _ASKED[1][0], "1024"), _ASKED[1][1])], "key string, value string")
    attempts = pipeline.translate_batch(_requests(spark, sf_dir), graph, cache=cache).filter("provider = 'templates'")
    return attempts.select("request_id", (F.col("output_tokens") == 0).alias("hit"))


@built("response_json", "SELECT CAST(n_nationkey AS BIGINT) AS request_id, to_json({'sparql': 'ASK { ?x a :Book }', 'columns': ['name', 'region'], 'rows': [{'name': n_name, 'region': CAST(n_regionkey AS VARCHAR)}], 'provider': 'templates', 'model': 'rules-1', 'input_tokens': n_nationkey, 'output_tokens': 5, 'retries': 0}) AS response FROM nation")
def response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    cells = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"))
    answers = nation.select(F.col("n_nationkey").cast("bigint").alias("request_id"), F.lit("ASK { ?x a :Book }").alias("sparql"), F.array(F.lit("name"), F.lit("region")).alias("columns"), F.array(cells).alias("rows"), F.lit("templates").alias("provider"), F.lit("rules-1").alias("model"), F.col("n_nationkey").cast("bigint").alias("input_tokens"), F.lit(5).cast("bigint").alias("output_tokens"), F.lit(0).alias("retries"))
    return pipeline.to_responses(pipeline.from_responses(pipeline.to_responses(answers)))


@built("table_cells", f"SELECT {_iri('Module', 'o_orderkey')} AS m, CASE WHEN l_partkey IS NOT NULL THEN {_iri('Book', 'l_partkey')} ELSE '' END AS b FROM orders LEFT JOIN (SELECT * FROM {HB} WHERE l_partkey < 9) h ON o_orderkey = l_orderkey")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = " ".join(f'"{i}"' for i in range(9))
    return T.cells(query(campus(spark, sf_dir), f"SELECT ?m ?b WHERE {{ ?m a :Module OPTIONAL {{ ?m :hasBook ?b . ?b :hasCode ?c VALUES ?c {{ {few} }} }} }}"))


@built("table_state", "SELECT CAST(0 AS BIGINT) AS n, 'no results' AS note UNION ALL SELECT count(*), '' FROM part")
def table_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = campus(spark, sf_dir)
    return T.table_state(query(graph, 'SELECT ?b WHERE { ?b a :Book ; :hasCode "none" }')).union(T.table_state(query(graph, "SELECT ?b WHERE { ?b a :Book }")))


_MOCK_END = len(mock.SPARQL) * mock.PER_CHARACTER


@built("mock_stream", f"""WITH r AS (SELECT CAST(n_nationkey AS BIGINT) AS request_id, n_name AS provider FROM nation), e AS (
  SELECT i - 1 AS seq, i * {mock.PER_CHARACTER} AS at_ms, 'sparql_token' AS event, substr('{mock.SPARQL}', i, 1) AS data FROM (SELECT unnest(range(1, {len(mock.SPARQL) + 1})) AS i)
  UNION ALL VALUES ({len(mock.SPARQL)}, {_MOCK_END}, 'sparql_complete', '{mock.SPARQL}'), ({len(mock.SPARQL) + 1}, {_MOCK_END + 300}, 'results', '{{"columns":["title"],"rows":[{{"title":"Αλγόριθμοι"}},{{"title":"Βάσεις δεδομένων"}}]}}'), ({len(mock.SPARQL) + 2}, {_MOCK_END + 350}, 'done', NULL))
SELECT request_id, CAST(seq AS INTEGER) AS seq, CAST(at_ms AS INTEGER) AS at_ms, event, coalesce(data, '{{"provider":"' || provider || '","model":"m","input_tokens":120,"output_tokens":45,"retries":0}}') AS data FROM r, e""")
def mock_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mock.mock_events(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("request_id"), F.col("n_name").alias("provider"), F.lit("m").alias("model")))


@built("accents", "SELECT n_nationkey, translate(lower('Άλγόριθμος ΰ ΐ ' || n_name), 'άέήίόύώϊϋΐΰς', 'αεηιουωιυιυσ') AS plain FROM nation")
def accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", T.plain_greek(F.concat(F.lit("Άλγόριθμος ΰ ΐ "), F.col("n_name"))).alias("plain"))


@built("multi_valued", "WITH v AS (SELECT DISTINCT l_orderkey AS k, l_returnflag AS f FROM lineitem) SELECT o_orderpriority AS t, count(*) AS n FROM orders JOIN v a ON a.k = o_orderkey JOIN v b ON b.k = o_orderkey GROUP BY 1")
def multi_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules whose titles come from one row and whose semesters from several rows each."""
    graph, read = campus(spark, sf_dir), lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    titles = read("orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").cast("string").alias("hasCode"))
    rows = titles.unionByName(read("lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("semester")), allowMissingColumns=True)
    return query(Graph(spark, graph.tables | {"Module": rows}, graph.edges, graph.catalog), "SELECT ?t (COUNT(*) AS ?n) WHERE { ?m a :Module ; :title ?t ; :semester ?a ; :semester ?b } GROUP BY ?t")


@built("formatting", "SELECT n_nationkey, CASE WHEN length(n_name) >= 12 THEN n_name ELSE lpad(n_name, 12, ' ') END AS name, format('{:,}', CAST(n_nationkey * 123456 AS BIGINT)) AS n, n_name || ' / m · 1 + ' || CAST(n_nationkey AS VARCHAR) || ' tokens' || CASE WHEN n_nationkey % 3 > 0 THEN ' · ' || CAST(n_nationkey % 3 AS VARCHAR) || ' retries' ELSE '' END AS footer FROM nation")
def formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    key = F.col("n_nationkey")
    return nation.select("n_nationkey", T.right_aligned(F.col("n_name"), 12).alias("name"), T.thousands(key.cast("long") * 123456).alias("n"), T.footer(F.col("n_name"), F.lit("m"), F.lit(1), key, key % 3).alias("footer"))


@built("characters", "SELECT n_nationkey, CAST(i - 1 AS INTEGER) AS seq, substr(n_name, i, 1) AS token FROM (SELECT n_nationkey, n_name, unnest(range(1, length(n_name) + 1)) AS i FROM nation)")
def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.posexplode(T.characters(F.col("n_name"))).alias("seq", "token"))
