"""A page far behind the beginning of an ordered result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Rows before a page from which on ranges are counted; below, the first rows are simply kept and dropped.
DEEP = 20_000


def deep_page(df: DataFrame, key: Column, down: bool, order: list[Column], offset: int, limit: int | None) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of ``df`` in an order that begins with ``key``; unbound ones come first, or last where ``down``.

    Values of the key are dealt into ranges, as many as a shuffle has, and counted. The counts, one
    number per range, tell which ranges the page lies in; only rows of those are read on, sorted, and
    counted off. All rows with one key are in one range, so ties need no more than the order has.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(key.alias("k"))
    ranged = keys.filter("k IS NOT NULL").repartitionByRange(n, "k").withColumn("p", F.spark_partition_id())
    facts = ranged.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("low"), F.max("k").alias("high")).collect()  # a row per range
    none = keys.filter("k IS NULL").count()
    ranges = [(r["n"], (key >= F.lit(r["low"])) & (key <= F.lit(r["high"]))) for r in sorted(facts, key=lambda r: r["p"], reverse=down)]
    unbound = (none, key.isNull())
    ranges = [*ranges, unbound] if down else [unbound, *ranges]
    at, before, wanted = 0, None, None
    for size, test in ranges:
        if size and at + size > offset and (limit is None or at < offset + limit):
            before = at if before is None else before
            wanted = test if wanted is None else wanted | test
        at += size
    if wanted is None:
        return df.limit(0)
    page = df.filter(wanted).orderBy(*order).offset(offset - before)
    return page if limit is None else page.limit(limit)
