"""Clusters of vectors by plain Lloyd rounds in exact integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch

#: Integers beyond this are set to it, so that squared distances of up to 256 components fit into 64 bits.
LARGEST = 1 << 26
#: Vectors whose differences to one centroid are in memory at once.
ROWS = 4096


def whole_numbers(vectors: pd.Series, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Of vectors with ``dims`` components: which are finite throughout, and those as ``floor(scale * x)``."""
    if not len(vectors):
        return np.zeros(0, bool), np.zeros((0, dims), np.int64)
    x = np.array([np.asarray(v, np.float64) for v in vectors])  # a null inside is NaN here
    good = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        return good, np.clip(np.floor(scale * x[good]), -LARGEST, LARGEST).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each row, of equally near ones the least, and its squared distance."""
    which, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), ROWS):
        part = x[at : at + ROWS]
        squares = np.stack([((part - c) ** 2).sum(axis=1) for c in centroids], axis=1)
        which[at : at + ROWS] = squares.argmin(axis=1)
        far[at : at + ROWS] = squares.min(axis=1)
    return which, far


def cluster(vectors: DataFrame, *, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Assign every vector to the nearest of ``k`` centroids after some Lloyd rounds.

    Returns ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``. Components become
    ``floor(scale * x)``. Centroids start as the ``k`` vectors whose ``seed:id`` has the least SHA-256, in
    that order. A round assigns each vector to the nearest centroid (squared distance; of equally near
    ones the one with the smaller number) and moves each centroid that has vectors to the floor of their mean,
    component by component. Only centroids, ``k`` by ``dims`` numbers, and their sums reach the driver; each
    pass reads the vectors from their source, so a lost executor costs its partitions alone.

    Vectors that are null, have another length, or have a null or non-finite component have no row. Null
    ids: assigned, never a first centroid. Repeated rows and ids: each row is a vector of its own; first centroids
    with one hash are ordered by their components. Fewer than ``k`` vectors: as many centroids. Empty table: no rows. Components beyond
    2^26 in size after scaling count as 2^26. Other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "clusters")
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x")).filter(F.size("x") == dims)

    number = F.col("x").getItem  # finite numbers only, tested before the few first ones are chosen
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    named = plain.filter(finite & F.col("vec_id").isNotNull()).withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    first = named.orderBy("h", *[number(i) for i in range(dims)]).limit(k).collect()  # k rows
    centroids = whole_numbers(pd.Series([r["x"] for r in first], dtype=object), dims, scale)[1]
    if not len(centroids):
        plain = plain.limit(0)

    for _ in range(rounds if len(centroids) else 0):
        sent = spark.sparkContext.broadcast(centroids)

        def sums(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            total, count = np.zeros((len(sent.value), dims), np.int64), np.zeros(len(sent.value), np.int64)
            for frame in frames:
                x = whole_numbers(frame["x"], dims, scale)[1]
                which = nearest(x, sent.value)[0]
                for c in np.unique(which).tolist():
                    mine = x[which == c]
                    total[c] += mine.sum(axis=0)
                    count[c] += len(mine)
            some = np.flatnonzero(count)
            yield pd.DataFrame({"cluster": some, "n": count[some], "sums": list(total[some])})

        parts = plain.select("x").mapInPandas(sums, "cluster int, n long, sums array<long>")
        each = parts.select("cluster", "n", F.posexplode("sums").alias("at", "s"))
        exact = lambda name: F.sum(F.col(name).cast("decimal(38,0)"))
        for r in each.groupBy("cluster", "at").agg(exact("s").alias("s"), exact("n").alias("n")).collect():  # k * dims rows
            centroids[r["cluster"], r["at"]] = int(r["s"]) // int(r["n"])
        sent.destroy()

    sent = spark.sparkContext.broadcast(centroids)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good, x = whole_numbers(frame["x"], dims, scale)
            which, far = nearest(x, sent.value)
            yield pd.DataFrame({"vec_id": frame["vec_id"][good].astype("Int64").array, "cluster": which, "distance": far})

    assigned = scratch.keep(plain.mapInPandas(assign, "vec_id long, cluster int, distance long"), "assigned")
    totals = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("s")).collect()  # k rows
    inertia = sum(r["s"] for r in totals)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = spark.createDataFrame([(r["cluster"], r["s"], inertia, hashes[r["cluster"]]) for r in totals], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
