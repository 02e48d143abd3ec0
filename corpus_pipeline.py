"""A corpus in five stages: language, near-duplicates, personal data, mix of sources, packing.

Each stage takes all that its predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.llm import langid, mixing, near_dedup, packing, pii
from loomgraph.llm.queries import LANGUAGES, tokenizer_path
from loomgraph.llm.scratch import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language. Labels that the model was fitted on are no evidence.

    Null, empty or wordless texts go; very long ones are read whole. Null ids, labels and sources: judged
    by the text. Repeated rows: kept or dropped alike. Empty table: no rows.
    """
    model = langid.train(docs, languages=LANGUAGES)
    declared = F.when(~model.fitted_on(F.col("doc_id")), F.col("lang"))
    found = langid.identify(docs, model, accept=LANGUAGES, declared=declared, host=F.col("source"))
    scratch = Scratch(spark, "rejected")
    found = scratch.keep(found.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "kept"), "judged")
    gone = scratch.keep(found.filter(~F.col("kept")).drop("kept").distinct(), "rejected")  # its size is known now, so a small one is broadcast
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    return _documents(docs.join(gone, same, "left_anti"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (five-word shingles, 0.8).

    A document is a ``doc_id`` with a text: of rows alike in both, one stays, and it goes if its group has
    a lesser document. A ``doc_id`` with several texts, or none, names no document; its texts stand for
    themselves, under numbers made from both, beyond 2^62, so that documents with an id of their own come first.
    """
    scratch = Scratch(spark, "duplicates")
    key = F.xxhash64("text")
    counts = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL")
    counts = scratch.keep(counts, "several")
    own = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("doc_id", key), 2)
    if counts.isEmpty():
        named = docs.withColumn("__id", F.col("doc_id"))
    else:
        several = counts.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("__several"))
        marked = docs.filter("doc_id IS NOT NULL").join(several.hint("merge"), F.col("doc_id") == F.col("__several"), "left")
        marked = marked.union(docs.filter("doc_id IS NULL").withColumn("__several", F.lit(0).cast("long")))
        hit = F.col("__several").isNotNull()
        marked = scratch.keep(marked.withColumn("__id", F.when(hit, own).otherwise(F.col("doc_id"))).withColumn("__hit", hit).drop("__several"), "marked")
        named = marked.filter("NOT __hit").union(marked.filter("__hit").dropDuplicates(["__id"])).drop("__hit")
        named = scratch.keep(named, "named")
    found = near_dedup.near_duplicates(named, near_dedup.Similarity(words=5, percent=80), id_col="__id")
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    gone = scratch.keep(gone, "gone")
    return _documents(named.join(gone.hint("merge"), F.col("__id") == F.col("__gone"), "left_anti"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and secrets by surrogates; ``n_chars`` follows the new text.

    Null text: stays null. Very long texts: whole. Null ids: as others. Repeated rows: replaced alike.
    Empty table: no rows.
    """
    new = pii.replace_entities(docs, key=pii.session_key(spark))
    return _documents(new.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix does; rows repeat, and documents not taken go.

    Of rows alike in ``doc_id``, source and text one comes as often as the mix takes all of them.
    Documents without words stay as they are.
    """
    mixed = mixing.mix(docs).withColumn("times", F.col("epochs") + F.col("drawn").cast("long")).filter("size > 0")
    times = mixed.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_key").alias("__key")).agg(F.sum("times").cast("int").alias("__times"), F.count(F.lit(1)).alias("__rows")).filter("__times <> 1 OR __rows > 1")
    times = Scratch(spark, "mixture").keep(times, "times")  # so that the join below can split a hot document
    empty = mixing.n_words(F.col("text")) == 0
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.xxhash64("text") == F.col("__key"))
    joined = docs.join(times.hint("merge"), same, "left").withColumn("__times", F.when(empty, 1).otherwise(F.coalesce("__times", F.lit(1))))
    alike = joined.filter("__rows > 1 AND __times > 0").filter(~empty).dropDuplicates(["__id", "__source", "__key"])
    taken = joined.filter("(__rows IS NULL OR __rows = 1) AND __times > 0").union(alike)
    return _documents(taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all that is left into sequences of 2048 tokens.

    Null or empty text: its end alone. Very long texts: cut into whole sequences. Null ids and repeated
    rows: each row is packed. Empty table: no rows.
    """
    return packing.pack_documents(docs, tokenizer_path(), capacity=2048, end_id=0)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("privacy", privacy), ("mixture", mixture), ("sequences", sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
