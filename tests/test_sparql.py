"""Parsing, and the semantics of small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.catalog import NAMESPACE, PREFIXES, Catalog
from loomgraph.plans.compiler import query
from loomgraph.sources.graph import Graph
from loomgraph.sparql.parser import validate

VALID = [
    "PREFIX x: <http://x/> SELECT DISTINCT ?title WHERE { ?book a x:Book ; x:title ?title . } LIMIT 10",
    "SELECT ?a (COUNT(*) AS ?n) WHERE { ?a ?b ?c . FILTER(?c >= -2 && !CONTAINS(LCASE(STR(?c)), 'x')) } GROUP BY ?a HAVING (COUNT(*) > 1) ORDER BY DESC(?n) OFFSET 2",
    "SELECT ?x WHERE { ?x (<a>|^<b>)+/<c>? [ <d> 1.5, 'x'@en, true ] . ?x !(<a>|^<b>) ?z MINUS { ?x <e> ( 1 2 ) } }",
    "CONSTRUCT WHERE { ?s ?p ?o }",
    "ASK { ?s ?p ?o }",
    "DESCRIBE <http://x>",
    "SELECT * WHERE { VALUES (?a ?b) { (1 UNDEF) } { ?a <p> ?b } UNION { SELECT ?a WHERE { ?a <q> ?b } } OPTIONAL { ?a <r> ?c } # note\n }",
]
INVALID = ["SELECT WHERE { broken syntax !!!", "NOT VALID SPARQL !!!", "SELECT ?x WHERE { ?x a nope:Thing }", "SELECT ?x WHERE { ?x <p> }", "DELETE WHERE { ?s ?p ?o }", "SELECT ?y (COUNT(?x) AS ?n) WHERE { ?x <p> ?y }", "SELECT ?x { ?x <p> ?y } LIMIT ten", "SELECT ?x { SERVICE <http://x> { ?x <p> ?y } }"]


#: Queries that parse and mean nothing.
MEANINGLESS = [
    "SELECT ?x WHERE { ?x <p> ?y FILTER(nosuch(?y)) }", "SELECT ?x WHERE { ?x <p> ?y FILTER(<http://f>(?y)) }", "SELECT ?x WHERE { ?x <p> ?y FILTER(STRLEN(?y, 1) > 2) }", "SELECT ?x WHERE { ?x <p> ?y FILTER(REPLACE(?y, 'a')) }",
    "SELECT ?x WHERE { ?x <p> ?y BIND(1 AS ?y) }", "SELECT ?x WHERE { ?x <p> ?y FILTER(COUNT(?y) > 1) }", "SELECT (SUM(COUNT(?y)) AS ?n) WHERE { ?x <p> ?y }", "SELECT (STR(?y) AS ?y) WHERE { ?x <p> ?y }", "SELECT ?x WHERE { { SELECT ?x WHERE { ?x <p> ?y FILTER(nosuch()) } } }",
    "SELECT (1 AS ?a) (2 AS ?a) WHERE { }", "SELECT ?x WHERE { ?x <p> ?y FILTER EXISTS { ?x <q> ?z FILTER(BOUND(1)) } }",
]


@pytest.mark.parametrize("text", MEANINGLESS)
def test_meaningless(text):
    assert validate(text)


@pytest.mark.parametrize("text", VALID)
def test_valid(text):
    assert validate(text) is None


@pytest.mark.parametrize("text", INVALID)
def test_invalid(text):
    assert validate(text)


@pytest.fixture(scope="module")
def graph(spark):
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    tables = {
        "University": rows([(1, "ΑΛΓΟΡΙΘΜΟΣ"), (2, "Ω")], "key long, name string"),
        "Department": rows([(1, "d1", "1"), (2, "d2", "2"), (3, None, "3")], "key long, name string, hasCode string"),
        "Course": rows([(10, "c", 2020, "u10"), (11, "c", 2021, None)], "key long, title string, year int, hasURL string"),
        "Module": rows([(100, "m", "1", "100"), (101, "m", "1", "101"), (101, "m", "2", "101"), (102, "n", "1", "102")], "key long, title string, semester string, hasCode string"),
        "Book": rows([(5, "b5", "5", "u5"), (6, "b6", "6", "u6")], "key long, title string, hasCode string, hasURL string"),
    }
    edges = {
        "hasDepartment": rows([(1, 1), (1, 2)], "s long, o long"),
        "hasCourse": rows([(1, 10), (2, 11)], "s long, o long"),
        "hasModule": rows([(10, 100), (10, 101), (11, 102)], "s long, o long"),
        "hasBook": rows([(100, 5), (101, 5), (101, 6)], "s long, o long"),
    }
    return Graph(spark, tables, edges)


def ask(graph, text):
    return sorted((tuple(r) for r in query(graph, text, as_text=True).collect()), key=lambda r: tuple((c is None, c or "") for c in r))


def test_multivalued_property_fans_out(graph):
    assert ask(graph, "SELECT ?s WHERE { ?m :hasCode '101' ; :semester ?s }") == [("1",), ("2",)]


def test_values_of_a_property_are_dealt_over_a_fixed_number_of_tasks(graph):
    pairs = graph.literals("Module", "semester")
    assert pairs.rdd.getNumPartitions() == int(graph.spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(tuple, pairs.collect())) == [(100, "1"), (101, "1"), (101, "2"), (102, "1")]


def test_a_graph_is_a_set(graph):
    """Module 101 has two rows: one module with two semesters, each other property once."""
    assert ask(graph, "SELECT ?t WHERE { ?m :title ?t ; :hasCode '101' }") == [("m",)]
    assert ask(graph, "SELECT (COUNT(*) AS ?n) WHERE { ?m a :Module }") == [("3",)]
    assert ask(graph, "SELECT ?a ?b WHERE { ?m :hasCode '101' ; :semester ?a ; :semester ?b }") == [("1", "1"), ("1", "2"), ("2", "1"), ("2", "2")]
    assert ask(graph, "SELECT (COUNT(*) AS ?n) WHERE { ?m ?p ?o ; :hasCode '101' }") == [(str(len(Catalog().types_of("Module")) + 6),)]  # title, code, two semesters, two books
    twice = Graph(graph.spark, graph.tables, graph.edges | {"hasBook": graph.edges["hasBook"].union(graph.edges["hasBook"])}, graph.catalog)
    assert ask(twice, "SELECT (COUNT(*) AS ?n) WHERE { ?m :hasBook ?b }") == [("3",)]


@pytest.mark.parametrize(
    "expression, wanted",
    [
        ("1/3", "0.333333333333333333"), ("2.5/4", "0.625"), ("1.25*4", "5"), ("xsd:string(1.50)", "1.5"), ("0.0", "0"), ("'a'@en = 'a'", "false"), ("sameTerm('a'@en, 'a')", "false"), ("'a'@en = 'a'@EN", "true"), ("'1'^^<http://c> = '1'", None), ("'1'^^<http://c> = '1'^^<http://c>", "true"),
        ("DATATYPE('a'@en)", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"), ("DATATYPE('1'^^<http://c>)", "http://c"), ("LANG('a'@en)", "en"), ("LANG('a')", ""), ("LANGMATCHES(LANG('a'@en-GB), 'en')", "true"),
        ("HOURS('2011-01-10T14:45:13.815-05:00'^^xsd:dateTime)", "14"), ("SECONDS('2011-01-10T14:45:13.815-05:00'^^xsd:dateTime)", "13.815"), ("TZ('2011-01-10T14:45:13.815-05:00'^^xsd:dateTime)", "-05:00"), ("TZ(xsd:dateTime('2011-01-10T14:45:13'))", ""), ("TIMEZONE('2011-01-10T14:45:13.815-05:00'^^xsd:dateTime)", "-PT5H"),
        ("TIMEZONE('2011-01-10T14:45:13+05:30'^^xsd:dateTime)", "PT5H30M"), ("TIMEZONE('2011-01-10T14:45:13Z'^^xsd:dateTime)", "PT0S"), ("TIMEZONE('2011-01-10T14:45:13'^^xsd:dateTime)", None), ("'2011-01-10T14:45:13-05:00'^^xsd:dateTime = '2011-01-10T19:45:13Z'^^xsd:dateTime", "true"), ("xsd:dateTime('nonsense')", None), ("STR('2011-01-10T14:45:13.815-05:00'^^xsd:dateTime)", "2011-01-10T14:45:13.815-05:00"),
        ("SUBSTR('abcdef', 0, 3)", "ab"), ("SUBSTR('abcdef', 2.4, 1.6)", "bc"), ("SUBSTR('abcdef', -5)", "abcdef"), ("SUBSTR('abcdef', 4)", "def"), ("SUBSTR('abcdef', -3, 2)", ""), ("REPLACE('a.b', '.', 'x', 'q')", "axb"), ("REPLACE('a.b', '.', '$1', 'q')", "a$1b"), ("REGEX('a+B', 'A+b', 'qi')", "true"), ("REGEX('aaB', 'A+b', 'i')", "true"), ("ROUND(-2.5)", "-2"),
    ],
)
def test_values(graph, expression, wanted):
    assert ask(graph, f"SELECT ({expression} AS ?x) WHERE {{ ?u a :University ; :name 'Ω' }}") == [(wanted,)]


def test_exists_inside_an_or(graph):
    assert ask(graph, "SELECT ?k WHERE { ?d a :Department ; :hasCode ?k FILTER(?k = '3' || EXISTS { ?d :hasCourse ?c . ?c :year 2020 }) }") == [("1",), ("3",)]
    assert ask(graph, "SELECT ?k WHERE { ?d a :Department ; :hasCode ?k FILTER(?k = '3' || EXISTS { ?x :hasBook ?y . ?y :hasCode '9' }) }") == [("3",)]
    assert ask(graph, "SELECT ?k WHERE { ?d a :Department ; :hasCode ?k OPTIONAL { ?d :hasCourse ?c } FILTER(?k = '9' || EXISTS { ?c :year ?y FILTER(?y > 2020 && ?k != '1') }) }") == [("2",), ("3",)]
    plan = query(graph, "SELECT ?k WHERE { ?d a :Department ; :hasCode ?k FILTER(?k = '3' || EXISTS { ?d :hasCourse ?c }) }")._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically" not in plan


def test_values_reach_the_scan(spark):
    from loomgraph.sources.graph import campus

    campus_ = campus(spark, "/root/testdata/sf0.001")
    df = query(campus_, 'SELECT ?m ?t WHERE { VALUES ?code { "42" "43" } ?m :hasBook ?b . ?b :hasCode ?code . ?m :title ?t }')
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "In(l_partkey, [42,43])" in plan.replace("[43,42]", "[42,43]") and "In(p_partkey, [42,43])" in plan.replace("[43,42]", "[42,43]") and "Generate" not in plan
    assert ask(campus_, 'SELECT (COUNT(*) AS ?n) WHERE { VALUES ?code { "42" "42" "042" "x" } ?b :hasCode ?code ; a :Book }') == [("2",)]
    assert ask(campus_, "SELECT (COUNT(*) AS ?n) WHERE { VALUES ?y { 1998 1998.0 } ?c :year ?y ; a :Course }") == ask(campus_, "SELECT (COUNT(*) AS ?n) WHERE { ?c :year 1998 ; a :Course }")


def test_unbound_joins_compare_no_pairs(spark):
    from loomgraph.sources.graph import campus

    text = "SELECT ?m ?t WHERE { ?m a :Module OPTIONAL { ?m :hasBook ?b } ?b :title ?t . ?m :hasCode ?t2 }"
    plan = query(campus(spark, "/root/testdata/sf0.001"), text)._jdf.queryExecution().optimizedPlan().toString()
    assert "isnull" not in plan.split("Join Inner")[1].split("\n")[0]


def test_open_joins_give_what_one_condition_gives(graph, monkeypatch):
    from loomgraph.plans.compiler import Compiler

    texts = ["SELECT ?m ?b ?t WHERE { ?m a :Module OPTIONAL { ?m :hasBook ?b . ?b :hasCode '5' } ?b :title ?t }", "SELECT * WHERE { VALUES (?a ?b) { (1 UNDEF) (UNDEF 2) (4 5) } VALUES (?a ?b) { (1 3) (4 UNDEF) (UNDEF 2) } }", "SELECT ?c ?d WHERE { ?u :hasDepartment ?d OPTIONAL { ?d :hasCourse ?c FILTER(?c = <" + NAMESPACE + "course_10>) } { ?x a :Course OPTIONAL { ?d2 :hasCourse ?c . ?c :year 2021 } } }"]
    split = [ask(graph, t) for t in texts]
    monkeypatch.setattr(Compiler, "_open", lambda self, a, b: [])
    assert split == [ask(graph, t) for t in texts]


OPEN_RNG = random.Random(5)


def _solution_tables(rng):
    kind = rng.choice(["join", "optional", "exists", "notexists", "minus"])
    left, right = ["a", "b", "c", "e", "f"][: rng.randint(1, 5)], rng.choice([["a", "b", "d"], ["b", "c", "d", "e", "f"], ["d"], ["a", "d"], ["a", "b", "c", "d", "e", "f"]])
    rows = lambda names: [{n: v for n in names if (v := rng.choice([None, None, 1, 2, 3]))} for _ in range(rng.randint(1, 6))]
    return kind, left, right, rows(left), rows(right), rng.random() < 0.4 and kind not in ("join", "minus") and "a" in left


@pytest.mark.parametrize("case", [_solution_tables(OPEN_RNG) for _ in range(14)], ids=lambda c: c[0])
def test_open_variables_by_the_letter(graph, case):
    """Joins, OPTIONAL, EXISTS and MINUS over tables with unbound cells against the definition over pairs of solutions."""
    kind, left, right, a, b, less = case
    values = lambda names, rows: f"VALUES ({' '.join('?' + n for n in names)}) {{ {' '.join('(' + ' '.join(str(r.get(n, 'UNDEF')) for n in names) + ')' for r in rows)} }}"
    inner = f"{{ {values(right, b)}{' FILTER(?a < ?d)' if less else ''} }}"
    body = {"join": f"{{ {values(left, a)} }} {inner}", "optional": f"{values(left, a)} OPTIONAL {inner}", "exists": f"{values(left, a)} FILTER EXISTS {inner}", "notexists": f"{values(left, a)} FILTER NOT EXISTS {inner}", "minus": f"{values(left, a)} MINUS {inner}"}[kind]
    shown, wanted = sorted({*left, *right}) if kind in ("join", "optional") else left, []
    for x in a:
        agreeing = [{**x, **y} for y in b if all(x[n] == y[n] for n in x if n in y) and (kind != "minus" or set(x) & set(y))]
        agreeing = [z for z in agreeing if not less or ("a" in z and "d" in z and z["a"] < z["d"])]
        wanted += agreeing if kind == "join" else (agreeing or [x]) if kind == "optional" else [x] if bool(agreeing) == (kind == "exists") else []
    wanted = [tuple(str(z[n]) if n in z else None for n in shown) for z in wanted]
    assert sorted(ask(graph, f"SELECT {' '.join('?' + n for n in shown)} WHERE {{ {body} }}"), key=str) == sorted(wanted, key=str)


@pytest.mark.parametrize("name", ["open_join", "open_minus", "open_exists", "open_not_exists"])
def test_open_variables_need_no_nested_loop(spark, name):
    from loomgraph.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_all_pairs_are_dealt_over_all_tasks_however_little_the_sides_hold(spark):
    """Small sides would be broadcast or their partitions joined, and a few tasks would make all pairs."""
    from loomgraph.queries import QUERIES

    plan = QUERIES["open_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    n = spark.conf.get("spark.sql.shuffle.partitions")
    assert plan.count("REPARTITION_BY_NUM") == 2 and any("SortMergeJoin [w_" in line for line in plan.split("\n"))
    assert all(f", {n})" in line for line in plan.split("\n") if "REPARTITION_BY_NUM" in line)


def test_iris_are_built_before_all_pairs_not_for_each(spark):
    from loomgraph.queries import QUERIES

    plan = QUERIES["open_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "Join Inner, (w_" in line)
    assert "concat(" not in plan[at - 1] and any("concat(" in line and "module_" in line for line in plan[at + 1 :])


@pytest.mark.parametrize("text", ["SELECT ?m ?b ?t WHERE { ?m a :Module OPTIONAL { ?m :hasBook ?b FILTER(?b = <" + NAMESPACE + "book_6>) } OPTIONAL { ?b a :Book ; :title ?t } }", "SELECT ?m ?b WHERE { ?m a :Module OPTIONAL { ?m :hasBook ?b . ?b :hasCode '5' } ?b a :Book }", "SELECT ?m ?u WHERE { ?m a :Module { ?u a :University } }", "SELECT * WHERE { ?m a :Module OPTIONAL { ?u a :University } }"])
def test_iris_of_all_pairs(graph, monkeypatch, text):
    from loomgraph.plans.compiler import Compiler

    found = ask(graph, text)
    monkeypatch.setattr(Compiler, "_written", staticmethod(lambda current, q, items: current))
    assert found == ask(graph, text) and any("module_" in str(r) for r in found)


PAIRED = ["{ VALUES (?a ?b) { (1 UNDEF) (UNDEF 2) (3 4) (1 UNDEF) (5 UNDEF) } VALUES (?b ?c) { (2 7) (4 8) (UNDEF 9) (2 6) } }", "{ VALUES ?a { 3 1 2 1 } { VALUES (?b ?c) { (2 1) (2 0) (0 UNDEF) } } }", "{ VALUES (?a ?b) { (1 UNDEF) (UNDEF 2) (3 4) (9 UNDEF) } OPTIONAL { VALUES (?b ?c) { (2 7) (5 8) (5 6) } } }", "{ ?m a :Module ; :hasCode ?a OPTIONAL { ?m :hasBook ?b FILTER(?b = <" + NAMESPACE + "book_6>) } ?b :title ?c }"]


@pytest.mark.parametrize("order", ["?a ?b ?c", "DESC(?c) ?b ?a"])
@pytest.mark.parametrize("body", PAIRED)
def test_first_rows_of_all_pairs_need_the_first_of_each_side(graph, monkeypatch, body, order):
    from loomgraph.plans.compiler import Compiler

    text = f"SELECT ?a ?b ?c WHERE {body} ORDER BY {order}"
    whole = [tuple(r) for r in query(graph, text, as_text=True).collect()]
    assert [tuple(r) for r in query(graph, f"{text} LIMIT 3 OFFSET 2", as_text=True).collect()] == whole[2:5]
    limits = lambda: query(graph, f"{text} LIMIT 3", as_text=True)._jdf.queryExecution().analyzed().toString().count("GlobalLimit")
    made = limits()
    monkeypatch.setattr(Compiler, "_foremost", staticmethod(lambda current, q: current))
    assert made >= 3 > limits()


def test_a_limit_of_distinct_or_named_rows_reaches_no_side(graph):
    pairs = "{ VALUES ?a { 1 1 1 2 } { VALUES ?b { 5 6 } } }"
    assert ask(graph, f"SELECT DISTINCT ?a WHERE {pairs} ORDER BY ?a LIMIT 2") == [("1",), ("2",)]
    assert ask(graph, f"SELECT (-?a AS ?x) ?b WHERE {pairs} ORDER BY ?x ?b LIMIT 2") == [("-2", "5"), ("-2", "6")]
    assert ask(graph, f"SELECT ?a (COUNT(*) AS ?n) WHERE {pairs} GROUP BY ?a ORDER BY ?a LIMIT 2") == [("1", "6"), ("2", "2")]


@pytest.mark.parametrize("test", ["?a < ?d", "?d <= ?a && ?d > 1", "?a >= ?e + 1 && ?e < ?d && ?a > 1", "?a < ?d && ?a > ?e"])
def test_exists_by_an_order_asks_one_row(graph, monkeypatch, test):
    """Against all pairs, with unbound cells, in both senses; a pair of tests that one row can't decide keeps the ledger."""
    from loomgraph.plans.compiler import Compiler

    text = f"SELECT ?a ?n WHERE {{ VALUES (?a ?n) {{ (1 1) (2 2) (3 3) (4 4) (UNDEF 5) (2.5 6) }} FILTER %s {{ VALUES (?d ?e) {{ (2 1) (3 4) (UNDEF 0) (1 UNDEF) (2 2) }} FILTER({test}) }} }}"
    optional = f"SELECT ?a ?d WHERE {{ VALUES ?a {{ 1 2 3 4 }} OPTIONAL {{ VALUES (?d ?e) {{ (2 1) (3 4) (1 UNDEF) }} FILTER({test}) }} }}"
    found = [ask(graph, t) for t in (text % "EXISTS", text % "NOT EXISTS", optional)]
    plan = query(graph, text % "NOT EXISTS")._jdf.queryExecution().analyzed().toString()
    assert ("explode(sequence" not in plan) == (test != "?a < ?d && ?a > ?e")
    monkeypatch.setattr(Compiler, "_decisive", staticmethod(lambda *_: None))
    assert found == [ask(graph, t) for t in (text % "EXISTS", text % "NOT EXISTS", optional)]


def test_optional_and_unbound_join(graph):
    assert ask(graph, "SELECT ?c ?b WHERE { ?m a :Module ; :hasCode ?c ; :semester '1' OPTIONAL { ?m :hasBook ?x . ?x :hasCode ?b FILTER(?b = '6') } }") == [("100", None), ("101", "6"), ("102", None)]
    assert ask(graph, "SELECT ?a ?b WHERE { VALUES (?a ?b) { (1 UNDEF) (UNDEF 2) } VALUES (?a ?b) { (1 3) (4 2) } }") == [("1", "3"), ("4", "2")]


def test_minus_without_shared_variables_keeps_all(graph):
    assert ask(graph, "SELECT (COUNT(*) AS ?n) WHERE { ?d a :Department MINUS { ?x :hasBook ?y } }") == [("3",)]
    assert ask(graph, "SELECT ?k WHERE { ?m :hasCode ?k ; a :Module MINUS { ?m :hasBook ?b } }") == [("102",)]


def test_terms_of_several_kinds_have_one_order(graph):
    values = "VALUES ?x { 1 'b' <http://x> 0.5 'a'@en true '2020-01-01'^^xsd:date 10 9 1e1 UNDEF 'Z' }"
    found = [r[0] for r in query(graph, f"SELECT ?x WHERE {{ {values} }} ORDER BY ?x", as_text=True).collect()]
    assert found[:6] == [None, "http://x", "0.5", "1", "9", "10"] and found[7:] == ["true", "2020-01-01", "Z", "a", "b"] and float(found[6]) == 10
    assert [r[0] for r in query(graph, f"SELECT ?x WHERE {{ {values} }} ORDER BY DESC(?x)", as_text=True).collect()] == found[::-1]
    assert ask(graph, "SELECT (MIN(?x) AS ?a) (MAX(?x) AS ?b) WHERE { VALUES ?x { 10 9 'a' } }") == [("9", "a")]
    assert ask(graph, "SELECT (MIN(?m) AS ?a) (MAX(?m) AS ?b) WHERE { ?m a :Department }") == [(NAMESPACE + "department_1", NAMESPACE + "department_3")]
    assert ask(graph, "SELECT (STR(2.50) AS ?x) (STR(?y) AS ?z) WHERE { VALUES ?y { 2.50 } }") == [("2.50", "2.5")]


@pytest.mark.parametrize("down", [False, True])
def test_deep_pages_are_the_same_pages(spark, monkeypatch, down):
    """With ties and unbound keys, at every depth; no more rows are sorted than the ranges of the page hold."""
    from loomgraph.operators import paging

    rng = random.Random(4)
    rows = [(rng.choice([None, *range(40)]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, i int").repartition(3)
    k = F.col("k")
    order = [k.desc_nulls_last() if down else k.asc_nulls_first(), F.col("i")]
    whole = [tuple(r) for r in df.orderBy(*order).collect()]
    for offset, limit in ((0, 10), (7, 30), (300, 5), (595, 10), (600, 3), (250, None), (590, 0)):
        found = [tuple(r) for r in paging.deep_page(df, k, down, order, offset, limit).collect()]
        assert found == whole[offset:] if limit is None else found == whole[offset : offset + limit]
    page = paging.deep_page(df, k, down, order, 300, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Offset 300" not in page and "k#" in page.split("Filter")[1]


def test_pages_behind_the_end_and_over_text(graph, monkeypatch):
    from loomgraph.operators import paging

    text = "SELECT ?k WHERE {{ ?m a :Module ; :hasCode ?k }} ORDER BY DESC(?k) LIMIT 2 OFFSET {}"
    plain = [query(graph, text.format(i), as_text=True).collect() for i in (0, 1, 2, 5)]
    monkeypatch.setattr(paging, "DEEP", 0)
    assert [query(graph, text.format(i), as_text=True).collect() for i in (0, 1, 2, 5)] == plain


def test_joins_begin_where_constants_are(spark):
    """A chain bound in the middle: each edge is read once, the smallest pair first; two bound ends meet in the middle."""
    from loomgraph.sources.graph import campus
    from loomgraph.sources.statistics import Estimate, Statistics, join_order

    edge = lambda n, a, b, da, db: Estimate(n, {a: da, b: db})
    chain = [edge(1e6, "a", "b", 1e3, 1e6), edge(1e7, "b", "c", 1e6, 1e7), edge(1e8, "c", "d", 1e7, 1e6), Estimate(1, {"c": 1})]
    assert join_order(chain)[0] == (1, 3)
    ends = [Estimate(1, {"a": 1}), edge(1e6, "a", "b", 1e3, 1e6), edge(1e6, "b", "c", 1e6, 1e3), Estimate(1, {"c": 1})]
    assert set(join_order(ends)[:2]) == {(0, 1), (2, 3)}
    graph = campus(spark, "/root/testdata/sf0.001")
    known = graph.measure()
    assert known.measured and known.rows["Book"] == pytest.approx(200, rel=0.2) and known.edges["hasModule"][0] == 1500 and Statistics.from_json(known.to_json()) == known
    text = 'SELECT ?un ?b WHERE { ?m :hasBook ?b . ?c :hasModule ?m . ?u :hasDepartment ?d ; :name ?un . ?d :hasCourse ?c . ?d :hasCode "7" }'
    plan = query(graph, text)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") > 0 and plan.count("Relation [o_orderkey") == 2 and plan.count("Relation [l_orderkey") == 1 and plan.count("= 7)") >= 3
    deepest = max((line for line in plan.splitlines() if "Relation" in line), key=lambda line: line.index("Relation"))
    assert "c_custkey" in deepest  # what the constant bounds comes first


@pytest.mark.parametrize("distinct", [False, True])
def test_texts_of_a_large_group_are_joined_by_ranges(spark, distinct):
    """One group fills several tasks; each joins its part in order, repeats included."""
    from loomgraph.operators import concat

    rng = random.Random(6)
    rows = [("hot" if i % 4 else rng.choice([None, "a", "b"]), rng.choice([None, "", "é", "z;", f"t{rng.randrange(900)}"])) for i in range(3000)] + [("only null", None)]
    df = spark.createDataFrame(rows, "g string, t string").repartition(5)
    found = {r.g: r.joined for r in concat.concat_in_ranges(df, ["g"], "t", ";", distinct=distinct).collect()}
    texts = {}
    for g, t in rows:
        if t is not None:
            texts.setdefault(g, []).append(t)
    assert found == {g: ";".join(sorted(set(ts) if distinct else ts, key=str.encode)) for g, ts in texts.items()}
    assert concat.concat_in_ranges(df.filter("false"), ["g"], "t", ";").count() == 0
    plan = concat.concat_in_ranges(df, ["g"], "t", ";")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(g" in plan and plan.count("collect_list") >= 4  # a part each, then the parts


@pytest.mark.parametrize(
    "text",
    [
        "SELECT ?k (GROUP_CONCAT(?t) AS ?g) (COUNT(?m) AS ?n) WHERE { ?m a :Module ; :title ?t ; :hasCode ?k } GROUP BY ?k",
        "SELECT ?t (GROUP_CONCAT(DISTINCT ?k; separator='/') AS ?g) (GROUP_CONCAT(?m) AS ?h) WHERE { ?m a :Module ; :title ?t ; :hasCode ?k } GROUP BY ?t HAVING (GROUP_CONCAT(?k) != '') ORDER BY ?g",
        "SELECT ?x (GROUP_CONCAT(?n) AS ?g) WHERE { { ?d a :Department . OPTIONAL { ?d :name ?n } BIND(?d AS ?x) } UNION { ?u a :University . OPTIONAL { ?u :name ?x } } } GROUP BY ?x",
        "SELECT (GROUP_CONCAT(?n; separator=', ') AS ?g) WHERE { ?d :name ?n }",
        "SELECT (GROUP_CONCAT(?n) AS ?g) (COUNT(*) AS ?c) WHERE { ?d :name ?n FILTER(?n = 'nobody') }",
        "SELECT ?n (GROUP_CONCAT(?y) AS ?g) WHERE { ?d :name ?n FILTER(?n = 'nobody') OPTIONAL { ?d :year ?y } } GROUP BY ?n",
    ],
)
def test_both_ways_of_joining_texts_agree(graph, monkeypatch, text):
    from loomgraph.operators import concat

    plain = query(graph, text, as_text=True)
    monkeypatch.setattr(concat, "MANY", 0)
    ranged = query(graph, text, as_text=True)
    assert sorted(map(str, ranged.collect())) == sorted(map(str, plain.collect())) and ranged.columns == plain.columns
    assert "rangepartitioning" in ranged._jdf.queryExecution().executedPlan().toString() or "GROUP BY" not in text


def test_collations_compare_without_accents(graph):
    own = Graph(graph.spark, graph.tables, graph.edges, Catalog(collation="UNICODE_CI_AI"))
    for name in ("αλγόριθμος", "ΑΛΓΟΡΙΘΜΟΣ", "ἀλγόριθμοσ"):
        assert ask(own, f"SELECT (COUNT(*) AS ?n) WHERE {{ ?u :name ?x FILTER(?x = '{name}') }}") == [("1",)]
        assert ask(own, f"SELECT (COUNT(*) AS ?n) WHERE {{ ?u :name ?x FILTER(CONTAINS(?x, '{name[2:8]}') && STRENDS(?x, '{name[4:]}')) }}") == [("1",)]
    assert ask(graph, "SELECT (COUNT(*) AS ?n) WHERE { ?u :name ?x FILTER(?x = 'αλγόριθμος') }") == [("0",)]


def test_aggregates_over_nothing(graph):
    assert ask(graph, "SELECT (COUNT(?y) AS ?n) (SUM(?y) AS ?s) (GROUP_CONCAT(?y) AS ?g) WHERE { ?c :year ?y FILTER(?y > 9999) }") == [("0", "0", "")]
    assert ask(graph, "SELECT ?y (COUNT(?c) AS ?n) WHERE { ?c :year ?y FILTER(?y > 9999) } GROUP BY ?y") == []


def test_final_sigma(graph):
    assert ask(graph, "SELECT ?n WHERE { ?u :name ?n FILTER(CONTAINS(LCASE(CONCAT(?n, 'Α')), LCASE('ΑΛΓΟΡΙΘΜΟΣ'))) }") == [("ΑΛΓΟΡΙΘΜΟΣ",)]


def test_term_and_value_equality(graph):
    assert ask(graph, "SELECT ?c WHERE { ?c :year '2020' }") == []
    assert ask(graph, "SELECT ?y WHERE { ?c :year ?y FILTER(?y = 2020.0) }") == [("2020",)]


def test_errors_unbind(graph):
    assert ask(graph, "SELECT (xsd:integer('x') AS ?a) ((1 / 0) AS ?b) WHERE { ?u a :University ; :name 'Ω' }") == [(None, None)]
    assert ask(graph, "SELECT ?u WHERE { ?u a :University FILTER(xsd:integer('x') > 1) }") == []


def test_bag_and_set_paths(graph):
    assert ask(graph, "SELECT ?b WHERE { ?c a :Course ; :hasModule/:hasBook ?b }") == [(NAMESPACE + "book_5",), (NAMESPACE + "book_5",), (NAMESPACE + "book_6",)]
    reached = ask(graph, f"SELECT ?x WHERE {{ <{NAMESPACE}course_10> (:hasModule|:hasBook)* ?x }}")
    assert [r[0].rpartition("#")[2] for r in reached] == ["book_5", "book_6", "course_10", "module_100", "module_101"]


def test_closure_ends_on_cycles(spark):
    from loomgraph.operators.closure import closure

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")], "s string, o string")
    assert {tuple(r) for r in closure(edges).collect()} == {(x, y) for x in "abc" for y in "abc"} | {("d", "d")}
    assert closure(edges, spark.createDataFrame([("d",)], "s string")).count() == 1


def test_ends_of_paths_are_terms(graph):
    book = f"<{NAMESPACE}book_5>"
    assert ask(graph, f"SELECT ?y (isLiteral(?y) AS ?l) WHERE {{ {book} :title? ?y }}") == [("b5", "true"), (NAMESPACE + "book_5", "false")]
    assert ask(graph, "SELECT ?y (DATATYPE(?y) AS ?d) WHERE { <" + NAMESPACE + "course_10> (:year|:title)+ ?y }") == [("2020", "http://www.w3.org/2001/XMLSchema#integer"), ("c", "http://www.w3.org/2001/XMLSchema#string")]
    assert ask(graph, "SELECT ?x WHERE { ?x (:hasBook|:title)+ 'b6' }") == [(NAMESPACE + "book_6",), (NAMESPACE + "module_101",)]
    assert ask(graph, "SELECT (COUNT(*) AS ?n) WHERE { ?x (:title|:semester)+ ?y FILTER(isIRI(?x) && isLiteral(?y)) }") == [("11",)]
    assert ask(graph, "SELECT ?t WHERE { ?d :hasCourse+ ?c . ?c :title ?t ; :year 2021 }") == [("c",)]
    assert ask(graph, "SELECT (COUNT(*) AS ?n) WHERE { ?x :nothing ?y }") == [("0",)]


def test_paths_between_two_ends(graph):
    node = lambda x: f"<{NAMESPACE}{x}>"
    path = "(:hasDepartment|:hasCourse|:hasModule|:hasBook)"
    for a, op, b, wanted in [("university_1", "+", "book_6", "true"), ("university_2", "+", "book_6", "false"), ("university_1", "*", "university_1", "true"), ("university_1", "+", "university_1", "false"), ("course_10", "?", "module_100", "true"), ("course_10", "?", "book_5", "false"), ("course_10", "?", "course_10", "true")]:
        assert query(graph, f"ASK {{ {node(a)} {path}{op} {node(b)} }}").first()[0] == (wanted == "true"), (a, op, b)


def test_sequences_from_a_constant_count_every_way(graph):
    """Module 101 has two books, module 100 one; a repeated part is a set for each node it begins at."""
    course, book = f"<{NAMESPACE}course_10>", f"<{NAMESPACE}book_5>"
    assert ask(graph, f"SELECT ?b WHERE {{ {course} :hasModule/:hasBook+ ?b }}") == [(NAMESPACE + "book_5",), (NAMESPACE + "book_5",), (NAMESPACE + "book_6",)]
    assert ask(graph, f"SELECT ?x WHERE {{ {book} ^:hasBook/(^:hasModule|^:hasCourse)* ?x }}") == sorted([(NAMESPACE + x,) for x in ("module_100", "module_101", "course_10", "course_10", "department_1", "department_1")])
    assert ask(graph, f"SELECT ?x WHERE {{ ?x (:hasCourse|:hasModule)+/:hasBook {book} }}") == ask(graph, f"SELECT ?x WHERE {{ ?x (:hasCourse|:hasModule)+ ?m . ?m :hasBook {book} }}")
    assert ask(graph, f"SELECT ?t WHERE {{ {course} :hasModule/:hasBook?/:title ?t }}") == [("b5",), ("b5",), ("b6",), ("m",), ("m",)]
    assert query(graph, f"ASK {{ {course} :hasModule/^:hasModule {course} }}").first()[0]


def test_long_paths_with_large_frontiers(spark, monkeypatch):
    """The same nodes whether the newest are looked up by number or joined."""
    from loomgraph.operators import closure as C

    edges = spark.createDataFrame([(i, j) for i in range(40) for j in (2 * i + 1, 2 * i + 2, i // 2)], "s long, o long")
    node = lambda c: F.struct(F.lit("n").alias("c"), F.col(c).alias("k"), F.lit(None).cast(C.TERM).alias("t"))
    steps = [C.Step(edges.select(node("s").alias("s"), node("o").alias("o"), F.col("s").alias("key")), "n", F.col("key"))]
    start = spark.range(1).select(F.lit(3).cast("long").alias("k")).select(node("k").alias("node"))
    found = []
    for few in (1000, 2):
        monkeypatch.setattr(C, "FEW", few)
        found.append(sorted(r["node"]["k"] for r in C.reach(steps, start).collect()))
    assert found[0] == found[1] == list(range(81))


def test_paths_from_an_end_write_no_edges(spark):
    """The first round reads edges at the constant alone."""
    from loomgraph.plans.compiler import Compiler
    from loomgraph.sources.graph import campus

    made = Compiler(campus(spark, "/root/testdata/sf0.001"))
    part = made._parts(__import__("loomgraph.sparql.algebra", fromlist=["Iri"]).Iri(NAMESPACE + "hasModule"))[0]
    plan = part.df.filter(part.scope()[".o"].col == 33)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,33)" in plan


def test_from_named_alone_leaves_the_default_graph_empty(graph):
    named = Graph(graph.spark, graph.tables, graph.edges, graph.catalog, {"http://g": graph})
    assert ask(named, "SELECT (COUNT(*) AS ?n) FROM NAMED <http://g> WHERE { ?u a :University }") == [("0",)]
    assert ask(named, "SELECT (COUNT(*) AS ?n) FROM NAMED <http://g> WHERE { GRAPH <http://g> { ?u a :University } }") == [("2",)]


def test_open_predicates_and_types(graph):
    assert ask(graph, f"SELECT ?p ?o WHERE {{ <{NAMESPACE}book_5> ?p ?o FILTER(isLiteral(?o)) }}") == [(NAMESPACE + "hasCode", "5"), (NAMESPACE + "hasURL", "u5"), (NAMESPACE + "title", "b5")]
    assert len(ask(graph, f"SELECT ?t WHERE {{ <{NAMESPACE}book_5> a ?t }}")) == len(Catalog().types_of("Book"))


def test_named_graphs(graph):
    named = Graph(graph.spark, graph.tables, graph.edges, graph.catalog, {"http://g": graph})
    assert ask(named, "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?m :hasBook ?b } } GROUP BY ?g") == [("http://g", "3")]
    assert ask(named, "SELECT (COUNT(*) AS ?n) FROM <http://g> WHERE { ?m :hasBook ?b }") == [("3",)]


def test_several_default_graphs_are_one_set(graph):
    more = Graph(graph.spark, graph.tables, graph.edges | {"hasBook": graph.spark.createDataFrame([(100, 5), (102, 5)], "s long, o long")}, graph.catalog)
    named = Graph(graph.spark, graph.tables, graph.edges, graph.catalog, {"http://g": graph, "http://h": more})
    assert ask(named, "SELECT (COUNT(*) AS ?n) FROM <http://g> FROM <http://h> WHERE { ?m :hasBook ?b }") == [("4",)]
    assert ask(named, "SELECT (COUNT(*) AS ?n) FROM <http://g> FROM <http://h> WHERE { ?m a :Module }") == [("3",)]


def test_other_namespace(graph):
    own = Graph(graph.spark, graph.tables, graph.edges, Catalog("http://other/#", dict(PREFIXES)))
    assert ask(own, "PREFIX o: <http://other/#> SELECT (COUNT(?b) AS ?n) WHERE { ?b a o:Book }") == [("2",)]
    assert own.catalog.unknown_terms(["http://other/#Nope", "http://other/#Book"]) == ["http://other/#Nope"]


def test_filters_reach_the_scan(spark):
    from loomgraph.sources.graph import campus

    plan = query(campus(spark, "/root/testdata/sf0.001"), f"SELECT ?t WHERE {{ <{NAMESPACE}book_7> :title ?t }}")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p_partkey,7)" in plan and "ReadSchema: struct<p_partkey:bigint,p_name:string>" in plan


def test_no_cross_join_for_shared_variables(spark):
    from loomgraph.sources.graph import campus

    plan = query(campus(spark, "/root/testdata/sf0.001"), "SELECT ?u ?b WHERE { ?m :hasBook ?b . ?u :hasDepartment ?d . ?c :hasModule ?m . ?d :hasCourse ?c }")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_sorted_limit_is_topk(graph):
    assert query(graph, "SELECT ?k WHERE { ?m a :Module ; :hasCode ?k } ORDER BY DESC(?k) LIMIT 1").collect()[0][0] == "102"
    assert query(graph, "SELECT ?k WHERE { ?m a :Module ; :hasCode ?k }").filter(F.col("k") == "100").count() == 1
