"""Many questions at once: translated on the executors, every distinct query run once, results attached."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import cache_key_column, fill
from ..operators.closure import checkpoint_dir
from ..plans.compiler import query
from ..sources.graph import Graph
from ..sparql.algebra import canonical, iris
from ..sparql.parser import parse
from .cache import CacheTable
from .pipeline import MOST_ROWS, SYSTEM, TIME_LIMIT, summarize_attempts, summary, translate_batch, with_timeout

#: Queries that run in one job; their common exchanges are computed once.
TOGETHER = 16
RESULT = "algebra string, n bigint, cells array<string>"


def first_key(graph: Graph, max_tokens: int = 1024):
    """The cache key of a request's first attempt, as a column over ``provider, model, question``."""
    first = fill(SYSTEM, ontology_summary=summary(graph))
    return cache_key_column(F.col("provider"), F.col("model"), F.lit(first), F.col("question"), F.lit(str(max_tokens)))


def by_algebra(graph: Graph, texts: DataFrame) -> DataFrame:
    """``request_id, sparql`` with ``algebra``, which is the same for queries that differ in spelling, prefixes and layout alone."""
    prefixes = graph.catalog.prefixes | {"": graph.catalog.namespace}

    def run(frames):
        for frame in frames:
            yield frame.assign(algebra=[canonical(parse(text, prefixes)) for text in frame["sparql"]])

    return texts.select("request_id", "sparql").mapInPandas(run, "request_id bigint, sparql string, algebra string")


def _rows(graph: Graph, key: str, text: str, most_rows: int) -> tuple[DataFrame, list[str]]:
    """The first rows of a query, one more than are shown, numbered in their order."""
    found = query(graph, text, as_text=True).limit(most_rows + 1)
    cells = F.array(*[F.col(f"`{c}`").cast("string") for c in found.columns]).cast("array<string>")
    return found.select(F.lit(key).alias("algebra"), F.monotonically_increasing_id().alias("n"), cells.alias("cells")), found.columns


def _chunks(spark: SparkSession, distinct: DataFrame) -> Iterator[list[tuple[str, str]]]:
    held = []
    for row in distinct.toLocalIterator():  # a query's text each; plans are made on the driver
        held.append((row["algebra"], row["sparql"]))
        if len(held) == TOGETHER:
            yield held
            held = []
    if held:
        yield held


def run_queries(graph: Graph, queries: DataFrame, *, most_rows: int = MOST_ROWS, seconds: float | None = TIME_LIMIT) -> DataFrame:
    """``algebra, columns, rows, complete, failed`` of distinct queries ``algebra, sparql``.

    :data:`TOGETHER` queries at a time are compiled and run as one job, in which Spark computes equal
    exchanges once, within ``seconds`` each; where that job fails they run one by one, so that a failure
    is that query's own. ``rows`` are the first ``most_rows``; ``complete`` says whether these are all.
    """
    spark, out = graph.spark, []
    checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir()
    folder = f"{root}/answers-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    limited = lambda action, n=1: action() if seconds is None else with_timeout(spark, seconds * n, action)

    def write(made: list[DataFrame]) -> None:
        every = made[0]
        for more in made[1:]:
            every = every.union(more)
        every.write.mode("append").parquet(folder)

    def attempt(some: list[tuple[str, str]]) -> bool:
        made, facts = [], []
        for key, text in some:
            try:
                rows, columns = limited(lambda text=text, key=key: _rows(graph, key, text, most_rows))
                made.append(rows)
                facts.append((key, columns, None))
            except Exception as failure:  # a query that doesn't compile, or whose paths take too long
                facts.append((key, [], f"execution failed: {failure}"[:500]))
        try:
            if made:
                limited(lambda: write(made), len(made))
        except Exception as failure:
            if len(some) > 1:
                return False
            facts = [(some[0][0], [], f"execution failed: {failure}"[:500])]
        out.extend(facts)
        return True

    for some in _chunks(spark, queries):
        if not attempt(some):
            for one in some:
                attempt([one])
    facts = spark.createDataFrame(out, "algebra string, columns array<string>, failed string")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    written = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    results = spark.read.schema(RESULT).parquet(folder) if written else spark.createDataFrame([], RESULT)
    ordered = F.array_sort(F.collect_list(F.struct("n", "cells")))
    each = results.groupBy("algebra").agg(F.count(F.lit(1)).alias("found"), F.transform(F.slice(ordered, 1, most_rows), lambda x: x["cells"]).alias("rows"))
    rows = F.transform(F.coalesce("rows", F.array().cast("array<array<string>>")), lambda x: F.map_from_arrays("columns", x))
    joined = facts.join(each, "algebra", "left")
    return joined.select("algebra", "columns", rows.alias("rows"), (F.coalesce("found", F.lit(0)) <= most_rows).alias("complete"), "failed")


def answer_batch(requests: DataFrame, graph: Graph, *, cache: CacheTable | None = None, most_rows: int = MOST_ROWS, seconds: float | None = TIME_LIMIT, max_tokens: int = 1024) -> DataFrame:
    """Answers to ``request_id, question, provider, model``: the fields of a response, and ``complete``, ``error`` and ``unknown``.

    Requests are translated and checked on the executors, the attempts written once. Queries with one
    algebra run once, however many requests ask for them (:func:`run_queries`). A request that can't be
    answered has no columns and no error; one whose translation or query failed has an error.
    ``unknown`` lists terms of its query that the graph doesn't have. With a cache, first attempts that
    it didn't hold are added to it in one write.
    """
    checkpoint_dir(graph.spark)
    held = cache.table() if cache else None
    attempts = translate_batch(requests, graph, cache=held, max_tokens=max_tokens).checkpoint()
    if cache:
        fresh = attempts.filter("attempt = 0 AND sparql IS NOT NULL AND input_tokens + output_tokens > 0").select("request_id", F.col("sparql").alias("value"))
        if not fresh.isEmpty():
            cache.append(fresh.join(requests, "request_id").select(first_key(graph, max_tokens).alias("key"), "value"))
    named = attempts.groupBy("request_id").agg(F.min("provider").alias("provider"), F.min("model").alias("model"), F.max_by("answerable", "attempt").alias("answerable"), F.max_by("error", "attempt").alias("error"))
    last = summarize_attempts(attempts).join(named, "request_id").checkpoint()
    runnable = by_algebra(graph, last.filter("answerable AND error IS NULL AND sparql IS NOT NULL")).checkpoint()
    found = run_queries(graph, runnable.groupBy("algebra").agg(F.min("sparql").alias("sparql")), most_rows=most_rows, seconds=seconds)
    known = unknown_terms(graph, runnable.groupBy("algebra").agg(F.min("sparql").alias("sparql")))
    joined = last.join(runnable.select("request_id", "algebra"), "request_id", "left").join(found, "algebra", "left").join(known, "algebra", "left")
    empty = lambda name, kind: F.coalesce(F.col(name), F.array().cast(f"array<{kind}>")).alias(name)
    return joined.select("request_id", "sparql", empty("columns", "string"), empty("rows", "map<string,string>"), "provider", "model", "input_tokens", "output_tokens", "retries", F.coalesce("complete", F.lit(True)).alias("complete"), F.coalesce("error", "failed").alias("error"), empty("unknown", "string"))


def unknown_terms(graph: Graph, queries: DataFrame) -> DataFrame:
    """``algebra, unknown``: terms in the graph's namespace that name nothing it has."""
    prefixes, catalog = graph.catalog.prefixes | {"": graph.catalog.namespace}, graph.catalog

    def run(frames):
        for frame in frames:
            yield frame[["algebra"]].assign(unknown=[catalog.unknown_terms(iris(parse(text, prefixes))) for text in frame["sparql"]])

    return queries.select("algebra", "sparql").mapInPandas(run, "algebra string, unknown array<string>")

