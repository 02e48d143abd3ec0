"""How many rows a graph's tables have, and how many ends its edges: measured once, or guessed without a job."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, functions as F

from ..catalog import PROPERTIES

if TYPE_CHECKING:
    from .graph import Graph

#: Bytes of a row by which a size is taken for a number of rows where nothing better is known.
ROW_BYTES = 16


@dataclass(frozen=True)
class Statistics:
    """``rows`` by class; ``edges`` by property: how many, from how many subjects, to how many objects."""

    rows: dict[str, float]
    edges: dict[str, tuple[float, float, float]]
    measured: bool = False

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Statistics:
        found = json.loads(text)
        return cls(found["rows"], {k: tuple(v) for k, v in found["edges"].items()}, found["measured"])


def measure(graph: Graph) -> Statistics:
    """One read of every table and edge, as a few sums and sketches each; a dozen rows reach the driver."""
    one = lambda name, df, s, o: df.agg(F.count(F.lit(1)).alias("n"), s.alias("s"), o.alias("o")).withColumn("name", F.lit(name))
    near = lambda c: F.approx_count_distinct(c, 0.05)
    parts = [one(f"class {c}", t, near("key"), F.lit(0).cast("long")) for c, t in graph.tables.items()]
    parts += [one(f"edge {p}", e, near("s"), near("o")) for p, e in graph.edges.items()]
    found = {r["name"]: (float(r["n"]), float(max(1, r["s"])), float(max(1, r["o"]))) for r in reduce(DataFrame.unionByName, parts).collect()}
    rows = {c: found[f"class {c}"][1] for c in graph.tables}
    return Statistics(rows, {p: found[f"edge {p}"] for p in graph.edges}, True)


def guess(graph: Graph) -> Statistics:
    """From the sizes that Spark's optimizer tells of files and plans; runs nothing."""

    def rows(df: DataFrame) -> float:
        known = df._jdf.queryExecution().optimizedPlan().stats()
        count = known.rowCount()
        size = float(str(count.get())) if count.isDefined() else float(str(known.sizeInBytes())) / ROW_BYTES
        return max(1.0, min(size, 1e15))

    tables = {c: rows(t) for c, t in graph.tables.items()}
    ends = {p.name: (p.of[0], p.to) for p in PROPERTIES if p.to}
    edges = {}
    for p, e in graph.edges.items():
        n = rows(e)
        edges[p] = (n, *(min(n, tables.get(c, n)) for c in ends[p]))
    return Statistics(tables, edges)


@dataclass(frozen=True)
class Estimate:
    """Rows of a relation, and how many values each variable has in it."""

    rows: float
    values: dict[str, float]

    def joined(self, other: Estimate) -> Estimate:
        """As if values of a shared variable were spread evenly and the fewer were among the more."""
        rows = self.rows * other.rows
        for n in self.values.keys() & other.values.keys():
            rows /= max(1.0, self.values[n], other.values[n])
        rows = max(rows, 1e-9)
        both = {n: min(d.values[n] for d in (self, other) if n in d.values) for n in self.values | other.values}
        return Estimate(rows, {n: max(1.0, min(v, rows)) for n, v in both.items()})


def join_order(estimates: list[Estimate]) -> list[tuple[int, int]]:
    """Pairs to join, by number; a pair's result takes the place of its first and the second is gone.

    Always the pair with a common variable whose join is least, wherever it is, so that relations which
    constants make small are joined to their neighbours first and what they leave meets in the middle.
    Pairs without one come last.
    """
    left, out = dict(enumerate(estimates)), []
    while len(left) > 1:
        pairs = [(a, b) for a in left for b in left if a < b]
        shared = [(a, b) for a, b in pairs if left[a].values.keys() & left[b].values.keys()]
        made = {p: left[p[0]].joined(left[p[1]]) for p in shared or pairs}
        a, b = min(made, key=lambda p: (made[p].rows, left[p[0]].rows + left[p[1]].rows, p))
        left[a] = made[a, b]
        del left[b]
        out.append((a, b))
    return out
