"""What paths of any length reach: from one end, between two ends, and between all nodes."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A node: an instance is its IRI's beginning and its number, anything else a term.
TERM = "struct<kind:string,lex:string,datatype:string,lang:string>"
NODE = f"struct<c:string,k:bigint,t:{TERM}>"
#: Newest nodes that are looked up by number at the scans; more are joined.
FEW = 1000


def checkpoint_dir(spark) -> None:
    """Use the cluster's shared folder; a temporary one only in local mode where none is set, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not shared and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="loomgraph-"))


def closure(edges: DataFrame, seeds: DataFrame | None = None, most_rounds: int = 1000) -> DataFrame:
    """Pairs ``s, o`` joined by one edge or more; with ``seeds`` (column ``s``) only from those.

    Each round joins the newest pairs with the edges and drops known pairs, so cycles end. The edges and
    each round's new pairs are checkpointed once, to the shared folder, and never rewritten; the number
    of rounds is the length of the longest shortest path. Without seeds the result holds every pair of
    nodes with a path between them, which no plan can make small: callers who can should give seeds.
    """
    checkpoint_dir(edges.sparkSession)
    edges = edges.select("s", "o").distinct().checkpoint()
    newest = edges if seeds is None else edges.join(seeds.select("s").distinct(), "s", "left_semi").checkpoint()
    known = newest
    step = edges.select(F.col("s").alias("o"), F.col("o").alias("next"))
    for _ in range(most_rounds):
        found = newest.join(step, "o").select("s", F.col("next").alias("o")).distinct()
        newest = found.join(known, ["s", "o"], "left_anti").checkpoint()
        if newest.isEmpty():
            return known
        known = known.union(newest)
    raise RuntimeError(f"paths are longer than {most_rounds} edges")


@dataclass(frozen=True)
class Step:
    """One kind of edge: ``df`` with ``s`` and ``o``, both nodes; where all begin at instances of one class, ``key`` is their number's column."""

    df: DataFrame
    prefix: str | None = None
    key: Column | None = None

    def among(self, frontier: Frontier) -> DataFrame | None:
        """What the edge reaches from the newest nodes; None where it can't begin at any of them."""
        made = self.edges(frontier)
        return made if made is None else made.select(F.col("o").alias("node"))

    def edges(self, frontier: Frontier) -> DataFrame | None:
        """``s, o`` of the edges that begin at the newest nodes."""
        if self.key is None:
            return self.df.join(frontier.frame().select(F.col("node").alias("s")), "s", "left_semi").select("s", "o")
        if frontier.few is not None:
            numbers = [n.k for n in frontier.few if n.c == self.prefix]
            if not numbers:
                return None
            return self.df.filter(self.key.isin(numbers) if len(numbers) > 1 else self.key == numbers[0]).select("s", "o")
        numbers = frontier.all.filter(F.col("node.c") == self.prefix).select(F.col("node.k").alias("k_"))
        return self.df.join(numbers, self.key == F.col("k_"), "left_semi").select("s", "o")


@dataclass
class Frontier:
    """The newest nodes: on the driver while there are at most :data:`FEW`, else a table."""

    spark: SparkSession
    few: list | None = None
    all: DataFrame | None = None
    size: int = 0

    def frame(self) -> DataFrame:
        return self.all if self.few is None else self.spark.createDataFrame([(n,) for n in self.few], f"node {NODE}")


@dataclass
class Search:
    """A search from one end, a round of edges at a time."""

    spark: SparkSession
    steps: Iterable[Step]
    newest: Frontier
    known: DataFrame | None = field(default=None)

    def round(self) -> bool:
        """Follow all edges from the newest nodes; whether there is anything new."""
        made = [m for s in self.steps if (m := s.among(self.newest)) is not None]
        if not made:
            self.newest = Frontier(self.spark, [])
            return False
        found = reduce(DataFrame.union, made).distinct()
        if self.known is not None:
            found = found.join(self.known, "node", "left_anti")
        checkpoint_dir(self.spark)
        few = found.limit(FEW + 1).collect()
        if len(few) <= FEW:
            self.newest = Frontier(self.spark, [r["node"] for r in few], size=len(few))
        else:
            found = found.checkpoint()
            self.newest = Frontier(self.spark, None, found, found.count())
        if self.newest.size:
            more = self.newest.frame()
            self.known = more if self.known is None else self.known.union(more)
        return self.newest.size > 0


def reach(steps: list[Step], start: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """``node``: all that one edge or more lead to from ``start`` (one row, ``node``).

    The newest nodes reach the scans of edges as a filter on numbers while they are few, else as a
    semi-join; edges that none of them can begin are not read, and no edge that isn't met is written.
    """
    spark = start.sparkSession
    search = Search(spark, steps, Frontier(spark, [r["node"] for r in start.collect()], size=1))
    for _ in range(most_rounds):
        if not search.round():
            return search.known if search.known is not None else spark.createDataFrame([], f"node {NODE}")
    raise RuntimeError(f"paths are longer than {most_rounds} edges")


def _frontier(nodes: DataFrame) -> Frontier:
    """Distinct nodes as a frontier, with no more than :data:`FEW` on the driver."""
    few = nodes.limit(FEW + 1).collect()
    if len(few) <= FEW:
        return Frontier(nodes.sparkSession, [r["node"] for r in few], size=len(few))
    return Frontier(nodes.sparkSession, None, nodes, FEW + 1)


def reach_pairs(steps: list[Step], seeds: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """``s, o``: what one edge or more lead to from each of the seeds (``node``, each once)."""
    checkpoint_dir(seeds.sparkSession)
    newest, known = seeds.select(F.col("node").alias("s"), F.col("node").alias("o")).checkpoint(), None
    for _ in range(most_rounds):
        front = _frontier(newest.select(F.col("o").alias("node")).distinct())
        made = [m for step in steps if (m := step.edges(front)) is not None]
        if not made:
            break
        edges = reduce(DataFrame.union, made).select(F.col("s").alias("o"), F.col("o").alias("next"))
        found = newest.join(edges, "o").select("s", F.col("next").alias("o")).distinct()
        newest = (found if known is None else found.join(known, ["s", "o"], "left_anti")).checkpoint()
        if newest.isEmpty():
            break
        known = newest if known is None else known.union(newest)
    else:
        raise RuntimeError(f"paths are longer than {most_rounds} edges")
    return known if known is not None else seeds.sparkSession.createDataFrame([], f"s {NODE}, o {NODE}")


def connected(ahead: list[Step], back: list[Step], start: DataFrame, end: DataFrame, most_rounds: int = 1000) -> bool:
    """Whether one edge or more lead from ``start`` to ``end``: searched from both, always from the smaller side."""
    spark = start.sparkSession
    sides = [Search(spark, steps, Frontier(spark, [r["node"] for r in at.collect()], size=1)) for steps, at in ((ahead, start), (back, end))]
    ends = [start, end]
    for _ in range(2 * most_rounds):
        i = 0 if sides[0].newest.size <= sides[1].newest.size else 1
        if not sides[i].round():
            return False
        other = ends[1 - i] if sides[1 - i].known is None else ends[1 - i].union(sides[1 - i].known)
        if not sides[i].newest.frame().join(other, "node", "left_semi").isEmpty():
            return True
    raise RuntimeError(f"paths are longer than {most_rounds} edges")
