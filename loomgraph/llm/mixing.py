"""Mixing sources to target weights, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import Scratch
from .textio import SEPARATORS, WORD

#: Parts into which a source's documents are cut by their keys; only the part at the budget's edge is sorted.
SLICES = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def text_quality(text: Column, size: Column) -> Column:
    """A document's weight in the draw: 1 for words of 3 to 10 characters on average, 0.25 otherwise."""
    chars = F.length(F.regexp_replace(text, SEPARATORS, ""))
    mean = chars / F.when(size > 0, size)
    return F.when(mean.between(3, 10), F.lit(1.0)).otherwise(F.lit(0.25))


def even_draw(key: Column) -> Column:
    """A number between 0 and 1 that depends on the key alone, of 52 bits of its MD5."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, *, cycle: tuple[int, ...], most_times: float) -> DataFrame:
    """Targets of ``source, source_size``: all words shared by weight, none above ``most_times`` its size.

    Sorted by cap over weight, the sources before some place are capped, and those from it on share the
    rest at one level; of all places, the right one gives the highest level. So two running sums replace
    the rounds of resharing. One row per source passes here, documents do not.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(cycle))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(most_times)
    by_need = Window.orderBy("need", F.asc_nulls_last("source"))
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = (
        sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("need", F.col("cap") / F.col("weight"))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(everything))
    )
    level = (F.col("total") - F.col("caps_before")) / F.col("weight_left")
    leveled = ranked.withColumn("level", F.max(level).over(everything))
    target = F.least("cap", F.col("level") * F.col("weight"))
    return leveled.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, *, cycle: tuple[int, ...] = (1, 2, 3), most_times: int = 3, quality=text_quality,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Decide how many words of each document a mix takes.

    Returns a row per document: ``doc_id, size, source, source_size, target, epochs, drawn, taken, text_key``.
    A source gives ``epochs`` complete passes; for the rest of its target its documents are taken in
    order of exponential keys, drawn by ``doc_id`` and scaled by quality, while that brings the sum
    nearer to the target. Keys are cut into slices; sums of slices find the slice in which the budget
    ends, and only that one is sorted, so no source has to fit a task.

    Null text: size 0, taken 0. Very long texts: taken or not as a whole. Null source: a source of its own, last. Null ``doc_id``: one key shared
    by all such rows. Equal keys: by ``doc_id``, then size, then a hash of the text. Repeated rows count each by itself. Empty
    table: no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    text, source = F.col(text_col), F.col(source_col)
    size = n_words(text)
    plain = docs.select(F.col(id_col).alias("doc_id"), source.cast("string").alias("source"), size.alias("size"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    plain = plain.select("doc_id", "source", "size", "text_key", quality(F.col("text"), F.col("size")).alias("quality"))
    key = -F.log(even_draw(F.col("doc_id"))) / F.col("quality")
    keyed = plain.withColumn("key", key).withColumn("slice", F.floor((1 - F.exp(-F.col("key"))) * SLICES).cast("int")).drop("quality")
    sized = scratch.keep(keyed, "sized")

    slices = scratch.keep(sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), "slices")
    sources = slices.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    targets = source_targets(sources, cycle=cycle, most_times=most_times)
    epochs = F.least(F.lit(most_times), F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0))).cast("long")
    plan = targets.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = scratch.keep(plan, "plan")

    same_source = F.col("source").eqNullSafe(F.col("plan_source"))
    renamed = plan.withColumnRenamed("source", "plan_source")
    running = Window.partitionBy("source").orderBy("slice")
    summed = slices.withColumn("slice_end", F.sum("slice_size").over(running)).join(renamed, same_source).filter(F.col("slice_end") >= F.col("budget"))
    edge = summed.groupBy("source").agg(F.min(F.struct("slice", (F.col("slice_end") - F.col("slice_size")).alias("before"))).alias("edge"))
    plan = scratch.keep(plan.join(edge.withColumnRenamed("source", "edge_source"), F.col("source").eqNullSafe(F.col("edge_source")), "left").drop("edge_source"), "edges")

    rows = sized.join(plan.withColumnRenamed("source", "plan_source"), same_source).drop("plan_source")
    at_edge = (F.col("slice") == F.col("edge.slice")) & (F.col("size") > 0)
    whole = rows.filter(~F.coalesce(at_edge, F.lit(False))).withColumn("drawn", F.coalesce(F.col("slice") < F.col("edge.slice"), F.lit(True)) & (F.col("budget") > 0))
    in_order = Window.partitionBy("source").orderBy("key", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("edge.before") + F.coalesce(F.sum("size").over(in_order), F.lit(0))
    cut = rows.filter(at_edge).withColumn("drawn", so_far + F.col("size") / 2 <= F.col("budget"))
    taken = F.col("size") * (F.col("epochs") + F.col("drawn").cast("long"))
    return whole.unionByName(cut).select("doc_id", "size", "source", "source_size", "target", "epochs", "drawn", taken.alias("taken"), "text_key")
