"""Prompts by name and version: a table read from Markdown files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import system_column


def read_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """``name, version, system`` of files ``<name>-v<version>.md``; ``system`` is their section of that name."""
    files = spark.read.text(f"{folder.rstrip('/')}/*.md", wholetext=True).withColumn("file", F.url_decode(F.regexp_replace(F.input_file_name(), r"^.*/", "")))
    named = r"^(.+)-v(\d+)\.md$"
    found = files.select(F.regexp_extract("file", named, 1).alias("name"), F.regexp_extract("file", named, 2).try_cast("int").alias("version"), system_column(F.col("value")).alias("system"))
    return found.filter(F.col("name") != "")


def load(prompts: DataFrame, name: str, version: int) -> str:
    """One prompt's text; a missing file or section is an error."""
    rows = prompts.filter((F.col("name") == name) & (F.col("version") == version)).select("system").take(1)
    if not rows:
        raise FileNotFoundError(f"no prompt {name} of version {version}")
    if rows[0][0] is None:
        raise ValueError(f"prompt {name} of version {version} has no '# System' section")
    return rows[0][0]
