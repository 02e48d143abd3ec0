"""Token ids of a corpus in a compressed store that decodes block by block.

A store is a folder with two tables. ``codebook`` holds the length of each id's canonical code, which
fixes the codes. ``blocks`` holds, per block of whole documents: its file and place, the ids before it
in its file, its documents and their sizes, the bit stream, and a bit offset for every 128th id. The
blocks are rows of Parquet files, so any file system of Spark's holds them, writing commits as a whole,
and a lost task leaves nothing behind. A block needs the codebook alone to be read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .huffman import Code, limited_lengths
from .scratch import WRITING, Scratch
from .textio import portions, record
from .tokens import Encoder

IDS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])
IDS_SQL = "doc_id long, n_tokens long, ids binary, counts binary"
BLOCKS = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("lanes", pa.binary())])
BLOCKS_SQL = "file int, block int, start long, n_tokens long, doc_ids array<long>, sizes array<long>, bits binary, lanes binary"
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def token_ids(docs: DataFrame, tokenizer: str, *, end_id: int, most_words: int = 250_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, counts``: every document's ids, as little-endian 16-bit numbers where all fit.

    Each task ends with a row of its own that has ``counts`` alone: how often it met each id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(tokenizer, most_words), end_id.to_bytes(4, "little")
        size = max(encoder.tokenizer.get_vocab_size(), end_id + 1)
        kind, total = "<u2" if size <= 1 << 16 else "<u4", np.zeros(size, np.int64)
        for batch in portions(batches, "text"):
            ids = [i + end for i in encoder.encode(batch.column(1).to_pylist())]
            every = np.frombuffer(b"".join(ids), "<u4").astype(kind)
            total += np.bincount(every, minlength=size)
            stored, ends = every.tobytes(), np.cumsum([len(i) // 4 for i in ids]) * every.itemsize
            cuts = [0, *ends.tolist()]
            yield record(IDS, doc_id=batch.column(0), n_tokens=[len(i) // 4 for i in ids], ids=[stored[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], counts=[None] * len(ids))
        used = np.flatnonzero(total)
        if len(used):
            yield record(IDS, doc_id=[None], n_tokens=[0], ids=[None], counts=[np.stack((used, total[used])).astype("<i8").tobytes()])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, IDS_SQL)


def _wide(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


def id_counts(ids: DataFrame) -> DataFrame:
    """How often each id occurs in the whole corpus, from the tasks' rows of counts; nothing else is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                symbols, counts = np.frombuffer(raw, "<i8").reshape(2, -1)
                part = np.bincount(symbols, minlength=len(total))
                part[:] = 0
                part[symbols] = counts
                part[: len(total)] += total
                total = part
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    return ids.filter("counts IS NOT NULL").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_store(ids: DataFrame, path: str, *, longest_code: int = 18, block_tokens: int = 1 << 16, files: int | None = None) -> None:
    """Write what :func:`token_ids` returned as a store at ``path``, in ascending order of ``doc_id``, nulls first.

    The driver gets a row per id of the vocabulary, whatever the size of the corpus. Documents are
    dealt to files by ranges of ``doc_id`` (rows of one ``doc_id`` stay together, in order of their ids).
    A block closes at ``block_tokens`` and holds whole documents.
    """
    spark = ids.sparkSession
    counted = sorted(id_counts(ids).collect())
    symbols, counts = np.array([r[0] for r in counted], np.int64), np.array([r[1] for r in counted], np.int64)
    lengths = limited_lengths(counts, longest_code)
    book = spark.createDataFrame([(int(s), int(n)) for s, n in zip(symbols, lengths, strict=True)], "id long, length int")
    book.coalesce(1).write.mode("overwrite").parquet(f"{path}/codebook")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, file = Code(symbols, lengths), TaskContext.get().partitionId()
        block, before, held, docs = 0, 0, [], []

        def close() -> pa.RecordBatch:
            bits, lanes = code.encode(np.concatenate(held))
            n = sum(map(len, held))
            return record(BLOCKS, file=[file], block=[block], start=[before], n_tokens=[n], doc_ids=[docs], sizes=[list(map(len, held))], bits=[bits], lanes=[lanes.astype("<u4").tobytes()])

        for batch in batches:
            for doc, n, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(_wide(i, n))
                docs.append(doc)
                if sum(map(len, held[-1:])) >= block_tokens or len(held) % 16 == 0 and sum(map(len, held)) >= block_tokens:
                    yield close()
                    before += sum(map(len, held))
                    block, held, docs = block + 1, [], []
        if held:
            yield close()

    ordered = ids.filter("counts IS NULL").select("doc_id", "n_tokens", "ids").repartitionByRange(files, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "ids")
    ordered.mapInArrow(run, BLOCKS_SQL).write.mode("overwrite").options(**WRITING | {"compression": "none"}).parquet(f"{path}/blocks")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of a store (ids little-endian, 32 bits), any block on any executor.

    The driver gets the codebook and a row per file; neither grows with the documents.
    """
    book = spark.read.schema("id long, length int").parquet(f"{path}/codebook").collect()
    symbols, lengths = np.array([r[0] for r in book], np.int64), np.array([r[1] for r in book], np.int64)
    blocks = spark.read.schema(BLOCKS_SQL).parquet(f"{path}/blocks")
    bases, total = {}, 0
    for file, n in sorted(blocks.groupBy("file").agg(F.sum("n_tokens")).collect()):
        bases[file], total = total, total + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(symbols, lengths)
        for batch in batches:
            for row in batch.to_pylist():
                ids = code.decode(row["bits"], np.frombuffer(row["lanes"], "<u4"), row["n_tokens"]).astype("<u4")
                ends = np.cumsum(row["sizes"])
                starts = ends - row["sizes"]
                first = bases[row["file"]] + row["start"]
                yield record(DOCS, doc_id=row["doc_ids"], start=starts + first, n_tokens=row["sizes"], ids=[ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def checksums(stored: DataFrame) -> DataFrame:
    """A store's documents with the crc32 of their ids in place of the ids."""
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def store_documents(docs: DataFrame, tokenizer: str, path: str | None = None, *, end_id: int, most_words: int = 250_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all documents, write them as a store (in the shared folder by default) and read it back.

    Null or empty text: ``end_id`` alone. Very long texts: whole, in a block of their own. Null ``doc_id``: first. Repeated rows: stored as often as
    they come, one after the other. Empty table: an empty store. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    ids = scratch.keep(token_ids(docs, tokenizer, end_id=end_id, most_words=most_words, id_col=id_col, text_col=text_col), "ids")
    path = path or scratch.path("store")
    write_store(ids, path)
    scratch.drop("ids")
    return read_store(docs.sparkSession, path)
