"""Threshold-scaled fingerprints of documents."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import even_keys, small_batches
from .textio import portions, record

#: A shingle is this many bytes; its 32-bit hash is retained if it lies below 2^32 / SCALE.
WIDTH, SCALE = 12, 32
_FIRST = -(1 << 63)


def shingle_hashes(data: bytes) -> np.ndarray:
    """Distinct 64-bit hashes of all shingles of a text's bytes; a shorter text is one shingle."""
    if not data:
        return np.zeros(0, np.uint64)
    x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    width = min(WIDTH, len(x))
    h, done = x * np.uint64(0x9E3779B97F4A7C15), 1
    while done < width:  # the hash of a run from those of its two overlapping halves
        step = min(done, width - done)
        h = h[:-step] * np.uint64(0xC2B2AE3D27D4EB4F) + (h[step:] ^ (h[step:] >> np.uint64(29)))
        done += step
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(32)))


class Sketch:
    """Retained hashes of a set of shingles, its size and a digest of the whole set."""

    def __init__(self, hashes: np.ndarray):
        self.size = len(hashes)
        self.digest = hashlib.blake2b(hashes.tobytes(), digest_size=8).hexdigest()
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        self.kept = np.unique(short[short < (1 << 32) // SCALE])

    def __str__(self) -> str:
        return f"f{SCALE}:{self.size}:{self.digest}:{base64.b64encode(self.kept.astype('<u4').tobytes()).decode()}"

    def merge(self, other: Sketch) -> np.ndarray:
        """What the sketch of both sets together retains."""
        return np.union1d(self.kept, other.kept)

    def shared(self, other: Sketch) -> int:
        return len(np.intersect1d(self.kept, other.kept, assume_unique=True))

    def containment(self, other: Sketch) -> float:
        """Estimated share of this set's shingles that the other has too."""
        return 1.0 if self.digest == other.digest else self.shared(other) / len(self.kept) if len(self.kept) else 0.0

    def likeness(self, other: Sketch) -> float:
        """Estimated size of the intersection over that of the smaller set; 1 for equal sets."""
        least = min(len(self.kept), len(other.kept))
        return 1.0 if self.digest == other.digest else self.shared(other) / least if least else 0.0


def parse(text: str) -> Sketch:
    _, size, digest, kept = text.split(":")
    out = Sketch.__new__(Sketch)
    out.size, out.digest, out.kept = int(size), digest, np.frombuffer(base64.b64decode(kept), "<u4")
    return out


def sketch(text: str) -> Sketch:
    return Sketch(shingle_hashes(text.encode()))


def edited(text: str, after: str) -> str:
    """The text with its last half replaced by the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


ROWS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def range_cuts(quantiles: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where ranges of ``id, hash`` begin; an id that fills several ranges is cut by hashes, evenly."""
    ids, times = np.unique(np.array(quantiles, np.int64), return_counts=True)
    hashes = [_FIRST + (i << 64) // int(n) for n in times for i in range(int(n))]
    return np.repeat(ids, times), np.array(hashes, np.int64)


def range_of(ids: np.ndarray, hashes: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each ``id, hash`` the number of ranges that begin at or before it, less one, by :func:`range_cuts`."""
    at = np.searchsorted(cuts[0], ids, side="left")
    until = np.searchsorted(cuts[0], ids, side="right")
    for lo in np.unique(at[until > at]).tolist():
        here = (at == lo) & (until > lo)
        own = cuts[1][lo : int(until[here][0])]
        at[here] = lo + np.searchsorted(own, hashes[here], side="right")
    return at


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """Texts dealt into ranges of ``id`` and hash, each range sorted and followed by the first text of the next.

    Ranges come from approximate quantiles of the ids, so no task sorts all; an id with many rows is
    dealt over several ranges by a hash of the text. The driver gets a few numbers per range, and so do
    the executors, with which ids and hashes alone are looked up. Columns ``part, late, id, doc_id,
    text``; ``late`` marks the text that follows.
    """
    keyed = docs.withColumn("id", F.coalesce("doc_id", F.lit(_FIRST))).withColumn("hash", F.xxhash64("text"))
    found = keyed.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], max(10_000, 20 * ranges))).first()[0] if ranges > 1 else []
    cuts = range_cuts(found or [])
    n = len(cuts[0]) + 1
    keys = np.array(even_keys(docs.sparkSession, n), np.int64)

    @F.pandas_udf("long")
    def part_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(range_of(ids.to_numpy(np.int64), hashes.to_numpy(np.int64), cuts))

    firsts = dict(keyed.select("id", "hash").withColumn("part", part_of("id", "hash")).groupBy("part").agg(F.min(F.struct("id", "hash"))).collect())
    order = sorted(firsts)
    first, before = np.full((n, 2), _FIRST, np.int64), np.full(n, -1, np.int64)
    for i, p in enumerate(order):
        first[p], before[p] = firsts[p], order[i - 1]  # the first range follows the last

    @F.pandas_udf("array<long>")
    def places(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        """For each place of a text its partition's key, its range, and whether it is the text that follows there."""
        i, h = ids.to_numpy(np.int64), hashes.to_numpy(np.int64)
        at = range_of(i, h, cuts)
        again = (i == first[at, 0]) & (h == first[at, 1]) & (before[at] >= 0)
        return pd.Series([[keys[p], p, 0, keys[before[p]], before[p], 1] if x else [keys[p], p, 0] for p, x in zip(at.tolist(), again.tolist(), strict=True)])

    spread = keyed.withColumn("places", places("id", "hash")).withColumn("at", F.explode(F.sequence(F.lit(0), (F.size("places") / 3 - 1).cast("int"))))
    of = lambda i: F.get("places", 3 * F.col("at") + i)
    spread = spread.select(of(1).cast("int").alias("part"), of(2).cast("int").alias("late"), "id", "hash", "doc_id", "text", of(0).cast("int").alias("key"))
    return spread.repartition(n, "key").sortWithinPartitions("part", "late", "id", "hash")


def fingerprint_edits(docs: DataFrame, *, ranges: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every whole text and its edited text, whose end comes from the next document.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    Null text: as empty; its set is empty and like nothing but an empty one. Very long texts: whole. Null ``doc_id``: before all
    others. Rows of one ``doc_id``: in order of a hash of their texts. A single row is its own next.
    Texts too short to retain a hash are like equal sets alone. Empty table: no rows. Each text is
    shuffled once. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, done = None, None, False
        for batch in portions(batches, "text"):
            out = []
            for at, late, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != part:
                    part, held, done = at, None, False
                if done:
                    continue
                own = sketch(text)
                if held is not None:
                    doc0, text0, own0 = held
                    new = edited(text0, text)
                    new_sketch = sketch(new)
                    out.append((doc0, len(text0), hashlib.sha256(new.encode()).hexdigest(), str(own0), str(new_sketch), own0.likeness(new_sketch), own0.likeness(own)))
                held, done = (doc, text, own), bool(late)
            if out:
                yield record(ROWS, **dict(zip(ROWS.names, zip(*out, strict=True), strict=True)))

    follow = with_next(plain, ranges).select("part", "late", "doc_id", "text")
    return follow.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
