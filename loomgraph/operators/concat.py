"""Texts of a group joined to one, range by range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: Edges of one property from which groups are joined range by range; below, a group's texts are sorted in one task.
MANY = 10_000_000


def concat_in_ranges(df: DataFrame, keys: Sequence[str], text: str, separator: str, *, distinct: bool = False) -> DataFrame:
    """Per group the sorted texts of the column ``text``, joined by ``separator`` in the column ``joined``.

    Equal texts of a group are counted before the shuffle. Groups and texts together are dealt by range,
    so that a group of any size lies in as many tasks as it fills; each joins its part, and only those
    parts, one text per task, meet in a last one. Null texts are left out; a group of nothing else, and an
    empty table, give no row. Null keys are a group.
    """
    found = df.filter(F.col(text).isNotNull()).groupBy(*keys, text).agg(F.count(F.lit(1)).cast("int").alias("copies_"))
    copies = F.lit(1) if distinct else F.col("copies_")
    each = F.concat(F.repeat(F.concat(F.col(text), F.lit(separator)), copies - 1), F.col(text))
    joined = lambda order, part: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, part))), lambda x: x["part_"]), separator)
    dealt = found.repartitionByRange(*keys, text).select(*keys, text, each.alias("part_"), F.spark_partition_id().alias("range_"))
    parts = dealt.groupBy(*keys, "range_").agg(joined(text, "part_").alias("part_"))
    return parts.groupBy(*keys).agg(joined("range_", "part_").alias("joined"))
