"""Best-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch
from .textio import portions, record
from .tokens import Encoder

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """Bounded-space online best fit.

    Bins that still have room are stacked by their free space, and one integer holds a bit for every
    free space of which there is a bin. The tightest bin that takes a piece is the lowest set bit at
    or above the piece's length. Once a piece is placed, and more than ``most_open`` bins are open, the
    fullest closes.
    """

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.bits, self.stacks, self.open, self.made = 0, [[] for _ in range(capacity + 1)], 0, 0

    def _pop(self, free: int) -> int:
        stack = self.stacks[free]
        bin_id = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_id

    def put(self, length: int) -> tuple[int, int]:
        """The bin of a piece and the piece's offset in it."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._pop(free)
        else:
            free, bin_id = self.capacity, self.made
            self.made += 1
        rest = free - length
        if rest:
            self.stacks[rest].append(bin_id)
            self.bits |= 1 << rest
            self.open += 1
            if self.open > self.most_open:
                self._pop((self.bits & -self.bits).bit_length() - 1)
        return bin_id, self.capacity - free


def pieces_of(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, most_words: int = 250_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every document: its ids, then ``end_id``, cut only where longer than ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(tokenizer, most_words), end_id.to_bytes(4, "little")
        for batch in portions(batches, "text"):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield record(PIECES, **dict(zip(PIECES.names, zip(*rows, strict=True), strict=True)))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES_SQL)


def pack_documents(
    docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, most_open: int = 256, pieces_per_group: int = 65536,
    most_words: int = 250_000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns a row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Pieces
    are dealt by hash into groups of about ``pieces_per_group``, so groups grow in number, not in size;
    each arrives in the order of that hash and is packed online, with at most ``most_open`` bins open.
    Only lengths are shuffled.

    Null or empty text: one piece holding ``end_id`` alone. Very long text: encoded whole, then cut; only
    its last piece is short. Null ``doc_id``: kept as null. Repeated rows: each is packed on its own.
    Empty table: no rows. Equal hashes are taken in order of ``doc_id``, ``piece`` and checksum, so reruns
    agree. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = scratch.keep(pieces_of(docs, tokenizer, capacity=capacity, end_id=end_id, most_words=most_words, id_col=id_col, text_col=text_col), "pieces")
    groups = max(1, -(-pieces.count() // pieces_per_group))
    order = F.xxhash64("doc_id", "piece", "ids_crc32", F.lit("pack"))
    dealt = pieces.repartition(groups, order).sortWithinPartitions(order, "doc_id", "piece", "ids_crc32")
    schema = PIECES.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(capacity, most_open), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.put(n) for n in batch.column(3).to_pylist()]
            more = [pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema=schema)

    return dealt.mapInArrow(place, f"{PIECES_SQL}, sequence_id long, offset long")
