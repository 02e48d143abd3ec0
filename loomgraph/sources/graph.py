"""A graph over ordinary tables: class tables, edges, and triples where nothing narrower will do."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..catalog import CLASSES, PROPERTIES, Catalog
from ..sparql.parser import TYPE
from .statistics import Statistics, guess, measure

TERM = "struct<kind:string,lex:string,datatype:string,lang:string>"


def term(kind: str, lex: Column, datatype: str | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), lex.cast("string").alias("lex"), F.lit(datatype).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))


class Graph:
    """Class tables have ``key`` and a column per literal property; edges have ``s`` and ``o``, both keys.

    Tables are read as they are, so filters and columns reach the scans, and joins are on numbers. A
    graph is a set: several rows of one key are several values of its properties, each counted once, and
    an edge that comes twice is one. Who knows that no key and no edge comes twice says so (``unique``)
    and saves the work of making sure. ``codes`` names properties (class, property) whose text is the
    key's own number, so that a text that is asked for becomes a key at the scan.
    """

    def __init__(
        self, spark: SparkSession, tables: dict[str, DataFrame], edges: dict[str, DataFrame], catalog: Catalog | None = None,
        named: dict[str, Graph] | None = None, *, unique: bool = False, codes: frozenset[tuple[str, str]] = frozenset(),
    ):
        self.spark, self.tables = spark, tables
        self.edges = edges if unique else {n: e.distinct() for n, e in edges.items()}
        self.catalog, self.named, self.unique, self.codes = catalog or Catalog(), named or {}, unique, codes
        self._statistics: Statistics | None = None

    @property
    def statistics(self) -> Statistics:
        """By which joins are ordered: guessed from sizes until :meth:`measure` is called or they are set."""
        if self._statistics is None:
            self._statistics = guess(self)
        return self._statistics

    @statistics.setter
    def statistics(self, known: Statistics) -> None:
        self._statistics = known

    def measure(self) -> Statistics:
        """Count rows and ends in one job; what it returns can be kept and set on another session's graph."""
        self.statistics = measure(self)
        return self.statistics

    def key_iri(self, cls: str, key: Column) -> Column:
        return F.concat(F.lit(self.catalog.key_prefix(cls)), key.cast("string"))

    def instances(self, cls: str) -> DataFrame:
        """``key`` of every instance."""
        keys = self.tables[cls].select("key")
        return keys if self.unique else keys.distinct()

    def literals(self, cls: str, name: str) -> DataFrame:
        """``key, value`` of a property, as a set."""
        pairs = self.tables[cls].select("key", F.col(name).alias("value")).filter("value IS NOT NULL")
        if self.unique:
            return pairs
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))  # a fixed number, as short rows shrink so much that one task would be given many millions
        return pairs.repartition(n, "key").distinct()

    @cached_property
    def types(self) -> DataFrame:
        """``s, o`` IRIs of every instance's every type; each table is read once."""
        parts = [self.instances(c).select(self.key_iri(c, F.col("key")).alias("s"), F.explode(F.array(*map(F.lit, self.catalog.types_of(c)))).alias("o")) for c in CLASSES]
        return self._union(parts)

    @cached_property
    def triples(self) -> DataFrame:
        """``s, p, o`` of the whole graph, ``o`` a term. Where keys are unique, a table's literals come from one read."""
        parts = [self.types.select("s", F.lit(TYPE.value).alias("p"), term("iri", F.col("o")).alias("o"))]
        for p in PROPERTIES:
            if p.to:
                parts.append(self.edges[p.name].select(self.key_iri(p.of[0], F.col("s")).alias("s"), F.lit(self.catalog.iri(p.name)).alias("p"), term("iri", self.key_iri(p.to, F.col("o"))).alias("o")))
        for cls in CLASSES:
            own = [p for p in PROPERTIES if not p.to and cls in p.of]
            made = lambda p, col: (F.lit(self.catalog.iri(p.name)).alias("p"), term("lit", col, "integer" if p.kind == "int" else "string").alias("o"))
            if not self.unique:
                parts += [self.literals(cls, p.name).select(self.key_iri(cls, F.col("key")).alias("s"), *made(p, F.col("value"))) for p in own]
                continue
            pairs = F.array(*[F.struct(*made(p, F.col(p.name))) for p in own])
            each = self.tables[cls].select(self.key_iri(cls, F.col("key")).alias("s"), F.explode(pairs).alias("po"))
            parts.append(each.select("s", "po.p", "po.o").filter(F.col("o.lex").isNotNull()))
        return self._union(parts)

    def _union(self, parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def merged(graphs: list[Graph]) -> Graph:
    """The graph that holds what any of several holds, each triple once."""
    first = graphs[0]
    if len(graphs) == 1:
        return first
    union = lambda frames: reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
    tables = {c: union([g.tables[c] for g in graphs]) for c in first.tables}
    edges = {n: union([g.edges[n] for g in graphs]) for n in first.edges}
    return Graph(first.spark, tables, edges, first.catalog, first.named)


def emptied(graph: Graph) -> Graph:
    """A graph without triples, as the default graph is where a query names graphs but none as default."""
    none = lambda frames: {n: df.filter(F.lit(False)) for n, df in frames.items()}
    return Graph(graph.spark, none(graph.tables), none(graph.edges), graph.catalog, unique=True, codes=graph.codes)


def campus(spark: SparkSession, sf_dir: str, catalog: Catalog | None = None) -> Graph:
    """The graph of the star schema: nations, customers, years of orders, orders, parts, and line items as edges."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    catalog = catalog or Catalog()
    nation, customer, orders, part, items = map(read, ("nation", "customer", "orders", "part", "lineitem"))
    year = F.year("o_orderdate")
    course = (F.col("o_custkey") * 10000 + year).cast("long")
    seen = orders.filter(F.col("o_custkey").isNotNull() & F.col("o_orderdate").isNotNull())
    terms = seen.select("o_custkey", year.alias("year")).distinct()
    titled = terms.join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "left")
    key = (F.col("o_custkey") * 10000 + F.col("year")).cast("long")
    url = lambda kind, k: F.concat(F.lit(f"http://example.org/{kind}/"), k.cast("string"))
    tables = {
        "University": nation.select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name")),
        "Department": customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("hasCode")),
        "Course": titled.select(key.alias("key"), F.concat_ws(" ", "c_mktsegment", F.col("year").cast("string")).alias("title"), F.col("year").cast("int").alias("year"), url("course", key).alias("hasURL")),
        "Module": orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("title"), F.when(F.month("o_orderdate") <= 6, "1").otherwise("2").alias("semester"), F.col("o_orderkey").cast("string").alias("hasCode")),
        "Book": part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("title"), F.col("p_partkey").cast("string").alias("hasCode"), url("book", F.col("p_partkey")).alias("hasURL")),
    }
    edges = {
        "hasDepartment": customer.select(F.col("c_nationkey").cast("long").alias("s"), F.col("c_custkey").alias("o")).dropna(),
        "hasCourse": terms.select(F.col("o_custkey").alias("s"), key.alias("o")),
        "hasModule": seen.select(course.alias("s"), F.col("o_orderkey").alias("o")),
        "hasBook": items.select(F.col("l_orderkey").alias("s"), F.col("l_partkey").alias("o")).dropna().distinct(),
    }
    codes = frozenset((cls, "hasCode") for cls in ("Department", "Module", "Book"))
    return Graph(spark, tables, edges, catalog, unique=True, codes=codes)  # keys of these tables, and edges, are unique
