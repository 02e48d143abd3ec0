"""What a graph holds, as tables and as a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..catalog import CLASSES, PROPERTIES
from ..functions.text import local_label, thousands
from ..sources.graph import Graph
from ..sparql.parser import TYPE

#: Vocabularies that describe the graph rather than what it is about.
META = ("rdf", "rdfs", "owl")


def _sum(graph: Graph, parts: list[DataFrame], name: str, count: str = "count") -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(name).agg(F.sum("n").alias(count)).filter(F.col(count) > 0)


def _types(graph: Graph) -> DataFrame:
    """``class, count`` of every type: instances are counted class by class, then handed to all its names."""
    parts = [graph.instances(c).agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*map(F.lit, graph.catalog.types_of(c)))).alias("class"), "n") for c in CLASSES]
    return _sum(graph, parts, "class")


def _predicates(graph: Graph) -> DataFrame:
    """``p, count`` of the graph's own properties; a table's literals are counted in one read of it."""
    parts = [graph.edges[p.name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(graph.catalog.iri(p.name)).alias("p"), "n") for p in PROPERTIES if p.to]
    for cls in CLASSES:
        own = [p.name for p in PROPERTIES if not p.to and cls in p.of]
        if not graph.unique:
            parts += [graph.literals(cls, x).agg(F.count(F.lit(1)).alias("n")).select(F.lit(graph.catalog.iri(x)).alias("p"), "n") for x in own]
            continue
        counted = graph.tables[cls].agg(*[F.count(x).alias(x) for x in own])
        pairs = F.array(*[F.struct(F.lit(graph.catalog.iri(x)).alias("p"), F.col(x).alias("n")) for x in own])
        parts.append(counted.select(F.explode(pairs).alias("x")).select("x.p", "x.n"))
    return _sum(graph, parts, "p")


def class_counts(graph: Graph, limit: int = 100) -> DataFrame:
    meta = F.lit(False)
    for prefix in META:
        meta = meta | F.startswith("class", F.lit(graph.catalog.prefixes[prefix]))
    return _types(graph).filter(~meta).orderBy(F.desc("count"), "class").limit(limit)


def property_counts(graph: Graph, limit: int = 200) -> DataFrame:
    return _predicates(graph).orderBy(F.desc("count"), "p").limit(limit)


def namespaces(graph: Graph, limit: int = 50) -> DataFrame:
    """What the terms in use have before their last slash or hash; terms are few, so this is cheap at any size."""
    terms = _types(graph).select(F.col("class").alias("iri")).union(_predicates(graph).select("p")).union(graph.spark.range(1).select(F.lit(TYPE.value)))
    last = lambda c: F.call_function("instr", F.reverse("iri"), F.lit(c))
    cut = F.greatest(*[F.when(last(c) > 0, F.length("iri") - last(c) + 1) for c in "/#"])
    return terms.select(F.substring(F.col("iri"), F.lit(1), cut).alias("ns")).distinct().orderBy("ns").limit(limit)


def sample_labels(graph: Graph, per_class: int = 5) -> DataFrame:
    """The first instances of each class by IRI, with a label where there is one: ``class, s, label``."""
    parts = []
    for cls, table in graph.tables.items():
        label = "title" if "title" in table.columns else "name"
        table = table if graph.unique else table.groupBy("key").agg(F.min(label).alias(label))
        parts.append(table.select(F.lit(graph.catalog.iri(cls)).alias("class"), graph.key_iri(cls, F.col("key")).alias("s"), F.col(label).alias("label")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # the least few of each part of a class, then of all, so no class has to fit a task
    few = every.withColumn("salt", F.pmod(F.xxhash64("s"), F.lit(64)))
    ranked = few.withColumn("n", F.row_number().over(Window.partitionBy("class", "salt").orderBy("s"))).filter(F.col("n") <= per_class)
    return ranked.withColumn("n", F.row_number().over(Window.partitionBy("class").orderBy("s"))).filter(F.col("n") <= per_class).select("class", "s", "label")


def report_lines(graph: Graph, endpoint: str = "tables", class_limit: int = 50, property_limit: int = 100, sampled: int = 10, shown: int = 3) -> DataFrame:
    """Lines of a Markdown report, by number: namespaces, classes with samples, properties, a block for a schema."""
    counts = class_counts(graph, class_limit)
    top = counts.orderBy(F.desc("count"), "class").limit(sampled).select("class")
    labels = sample_labels(graph).join(top, "class", "left_semi").withColumn("label", F.coalesce("label", local_label(F.col("s"))))
    samples = labels.groupBy("class").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("s", "label"))), lambda x: x["label"]), 1, shown), ", ").alias("samples"))
    line = lambda *cells: F.concat(F.lit("| "), *[x for c in cells for x in (c, F.lit(" | "))][:-1], F.lit(" |"))
    code = lambda c: F.concat(F.lit("`"), F.col(c), F.lit("`"))
    row = lambda df, part, rank, name, text: df.select(F.lit(part).alias("part"), rank.cast("bigint").alias("rank"), F.col(name).alias("name"), text.alias("line"))
    every = row(namespaces(graph), 1, F.lit(0), "ns", F.concat(F.lit("- "), code("ns")))
    every = every.unionByName(row(counts.join(samples, "class", "left"), 3, -F.col("count"), "class", line(code("class"), thousands(F.col("count")), F.coalesce("samples", F.lit("")))))
    every = every.unionByName(row(property_counts(graph, property_limit), 5, -F.col("count"), "p", line(code("p"), thousands(F.col("count")))))
    fixed = [(0, ["# Summary of the graph", "", f"Endpoint: `{endpoint}`", "", "## Namespaces", ""]), (2, ["", "## Classes", "", "| Class | Count | Samples |", "|---|---:|---|"]), (4, ["", "## Properties", "", "| Property | Count |", "|---|---:|"]), (6, ["", "## Schema for a prompt", "", "```turtle", "# the most useful classes and properties", "```"])]
    heads = graph.spark.createDataFrame([(part, i, "", x) for part, lines in fixed for i, x in enumerate(lines)], "part int, rank bigint, name string, line string")
    return every.unionByName(heads).select(F.row_number().over(Window.orderBy("part", "rank", "name")).cast("bigint").alias("n"), "line")


def write_report(graph: Graph, path: str, **limits) -> int:
    """The report as one text file; 0, or 1 where the graph holds nothing."""
    lines = report_lines(graph, **limits)
    lines.orderBy("n").select("line").coalesce(1).write.mode("overwrite").text(path)
    return 0 if not class_counts(graph, 1).isEmpty() else 1
