"""Words, tables and Arrow batches that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

#: Fixed value: a word is a run of anything but space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8; ``bytes.split`` separates at exactly the six characters of :data:`SEPARATORS`."""
    return text.encode().split() if text else []


def lowered_words(text: str | None) -> list[bytes]:
    """Words with A-Z alone lower-cased (``bytes.lower`` leaves every other byte)."""
    return text.encode().lower().split() if text else []


def portions(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Split batches so that the texts of each hold about ``most_bytes``; a longer text comes alone."""
    for batch in batches:
        column_at = batch.schema.get_field_index(column)
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column_at)), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
