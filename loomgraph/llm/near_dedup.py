"""Near-duplicates by MinHash bands, sequential Bayesian pruning and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .scratch import Scratch
from .textio import lowered_words, portions, record

#: Bands of rows: a pair with similarity s shares no band with a chance of (1 - s^ROWS)^BANDS, 4e-7 at 0.8.
BANDS, ROWS = 28, 4
HASHES = BANDS * ROWS
#: Hashes that are compared between two looks at the posterior, and the chance of losing a true link by it.
STEP, MISS = 16, 1e-6
#: Members of a block of loose and of all documents of one group, whose texts meet where signatures allow;
#: and how many such blocks are told apart by signatures in one go.
LOOSE_BLOCK, FULL_BLOCK = 64, 512
LOOSE_BLOCKS, FULL_BLOCKS = 4, 1

_SEEDS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, size=(2, HASHES, 1), dtype=np.uint64)
_XOR, _ODD = _SEEDS[0], _SEEDS[1] * np.uint64(2) + np.uint64(1)

SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])
SKETCH_SQL = "doc_id long, n long, h1 long, h2 long, bands array<long>, sig binary"


class Similarity:
    """What two texts must share: at least ``percent`` of their distinct shingles of ``words`` words."""

    def __init__(self, words: int = 5, percent: int = 80):
        self.words, self.percent = words, percent

    def shingles(self, text: str | None) -> set[tuple[bytes, ...]]:
        words = lowered_words(text)
        if len(words) < self.words:
            return {tuple(words)} if words else set()
        return set(zip(*(words[i:] for i in range(self.words)), strict=False))

    def linked(self, a: set, b: set) -> bool:
        if not a or not b or 100 * min(len(a), len(b)) < self.percent * max(len(a), len(b)):
            return False
        shared = len(a & b)
        return 100 * shared >= self.percent * (len(a) + len(b) - shared)

    @cache  # noqa: B019
    def needed(self) -> np.ndarray:
        """Matches without which, after each STEP hashes, a pair is given up.

        Under a uniform prior the similarity after m matches in n hashes has the posterior
        Beta(m + 1, n - m + 1). A pair goes on while its chance to reach the threshold is above MISS,
        split over the looks.
        """
        t, looks = self.percent / 100, HASHES // STEP
        least = []
        for n in range(STEP, HASHES + 1, STEP):
            m = 0
            # P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)
            while sum(math.comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(m + 1)) <= MISS / looks:
                m += 1
            least.append(m)
        return np.array(least)

    def survivors(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Row numbers of two arrays of signatures whose pairs may be similar, looked at in batches."""
        left, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
        for look, least in enumerate(self.needed()):
            part = slice(look * STEP, (look + 1) * STEP)
            matches += (a[left, part] == b[left, part]).sum(axis=1)
            on = matches >= least
            left, matches = left[on], matches[on]
        return left


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _shingle_hashes(words: list[bytes], width: int, known: _WordHashes) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    out = h[: len(h) - width + 1].copy()
    for i in range(1, width):
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out += h[i : len(h) - width + 1 + i]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return np.unique(out)


def _signature(hashes: np.ndarray) -> np.ndarray:
    least = np.full((HASHES, 1), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 2048):
        mixed = (hashes[at : at + 2048] ^ _XOR) * _ODD
        least = np.minimum(least, mixed.min(axis=1, keepdims=True))
    return least[:, 0]


def sketches(docs: DataFrame, how: Similarity) -> DataFrame:
    """Per document the size and hash of its set, a key for each band, and 16 bits of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in portions(batches, "text"):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = lowered_words(text)
                hashes = _shingle_hashes(words, how.words, known)
                if not len(hashes):
                    rows.append((doc, 0, None, None, None, None))
                    continue
                raw, sig = hashes.tobytes(), _signature(hashes)
                bands = [xxhash.xxh3_64_intdigest(sig[b * ROWS : (b + 1) * ROWS].tobytes(), b) - (1 << 63) for b in range(BANDS)]
                whole = xxhash.xxh3_128_intdigest(raw)
                rows.append((doc, len(hashes), (whole >> 64) - (1 << 63), (whole & (1 << 64) - 1) - (1 << 63), bands, (sig >> np.uint64(48)).astype("<u2").tobytes()))
            yield record(SKETCH, **dict(zip(SKETCH.names, zip(*rows, strict=True), strict=True)))

    return docs.mapInArrow(run, SKETCH_SQL)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, HASHES)


def _prune_pairs(pairs: DataFrame, how: Similarity) -> DataFrame:
    """Pairs ``a, b`` whose signatures leave a link likely enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left = pa.array(how.survivors(_signatures(batch.column(2)), _signatures(batch.column(3))), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(left), batch.column(1).take(left)], names=["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _verify_pairs(pairs: DataFrame, how: Similarity) -> DataFrame:
    """Links among pairs ``a, b`` with both texts, by their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        for batch in batches:
            out = []
            for one, other, text_a, text_b in zip(*batch.columns, strict=True):
                one, other = one.as_py(), other.as_py()
                if last[0] != one:
                    last = one, how.shingles(text_a.as_py())
                if how.linked(last[1], how.shingles(text_b.as_py())):
                    out.append((one, other))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


class _Sets:
    """Union-find over the components that meet in one block."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x


def _link_block(loose: list[tuple], full: list[tuple], how: Similarity) -> list[tuple[int, int]]:
    """Links that join different components among members ``(node, component, sig, text)`` of a block."""
    sets, out, made = _Sets(), [], {}
    sig = np.frombuffer(b"".join(m[2] for m in full), "<u2").reshape(-1, HASHES)

    def shingles(member: tuple) -> set:
        if member[0] not in made:
            made[member[0]] = how.shingles(member[3])
        return made[member[0]]

    comps = [m[1] for m in full]
    for one in loose:
        own = np.frombuffer(one[2], "<u2")
        for i in how.survivors(np.broadcast_to(own, sig.shape), sig).tolist():
            x, y = sets.root(one[1]), sets.root(comps[i])
            if x != y and how.linked(shingles(one), shingles(full[i])):
                sets.up[max(x, y)] = min(x, y)
                out.append((one[0], full[i][0]))
    return out


MEETING = pa.schema([("p", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("role", pa.int32()), ("node", pa.int64()), ("component", pa.int64())])
MEETING_SQL = "p long, i int, j int, role int, node long, component long"


def _meeting_blocks(loose: list[tuple], full: list[tuple], how: Similarity) -> Iterator[tuple]:
    """Members that must meet: ``i, j, role, node, component`` for every pair of blocks with a likely link.

    Members are ``(node, component, block, signature)``. A member is named once per pair of blocks,
    however many likely partners it has there.
    """
    sig = np.frombuffer(b"".join(m[3] for m in full), "<u2").reshape(-1, HASHES)
    comps, blocks = np.array([m[1] for m in full], np.int64), np.array([m[2] for m in full], np.int64)
    wanted: dict[int, np.ndarray] = {}
    for node, component, i, raw in loose:
        near = how.survivors(np.broadcast_to(np.frombuffer(raw, "<u2"), sig.shape), sig)
        near = near[comps[near] != component]
        if len(near):
            wanted.setdefault(i, np.zeros(len(full), bool))[near] = True
            for j in np.unique(blocks[near]).tolist():
                yield i, j, 0, node, component
    for i, on in wanted.items():
        for at in np.flatnonzero(on).tolist():
            yield i, int(blocks[at]), 1, full[at][0], full[at][1]


def _links_in_groups(groups: DataFrame, nodes: DataFrame, texts: DataFrame, how: Similarity, scratch: Scratch) -> DataFrame:
    """Links between components in groups ``p, node, component``, without a row for each pair.

    A group's most frequent component needs no comparison with itself. Its other members (loose) are
    dealt by hash into blocks, all members into larger ones. Signatures alone travel to where many
    blocks meet; they tell which members of which two blocks may be linked, and only those get their
    texts, for each such pair of blocks once. A pair of blocks returns no more links than join its
    components.
    """
    counts = scratch.keep(groups.groupBy("p", "component").count(), "group_sizes")
    main = counts.groupBy("p").agg(F.max(F.struct("count", "component")).alias("main"), F.sum("count").alias("n"), F.max("count").alias("most"))
    main = main.filter("n > most").select("p", F.col("main.component").alias("main"), F.ceil((F.col("n") - F.col("most")) / LOOSE_BLOCK).cast("int").alias("n_loose"), F.ceil(F.col("n") / FULL_BLOCK).cast("int").alias("n_full"))
    main = scratch.keep(main, "main")  # so that the join below deals both sides anew and can split a hot group
    members = groups.join(main, "p").join(nodes.select("node", "sig").hint("merge"), "node")
    spread = lambda n, tag: F.pmod(F.xxhash64("node", F.lit(tag)), F.col(n)).cast("int")
    members = scratch.keep(members.withColumn("i", spread("n_loose", "loose")).withColumn("j", spread("n_full", "full")), "members")
    every = lambda n, k: F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / k).cast("int")))
    at = lambda block, k: F.floor(F.col(block) / k).cast("int")
    full = members.select("p", every("n_loose", LOOSE_BLOCKS).alias("x"), at("j", FULL_BLOCKS).alias("y"), F.lit(1).alias("role"), "node", "component", F.col("j").alias("block"), "sig")
    loose = members.filter("component <> main").select("p", at("i", LOOSE_BLOCKS).alias("x"), every("n_full", FULL_BLOCKS).alias("y"), F.lit(0).alias("role"), "node", "component", F.col("i").alias("block"), "sig")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = full.union(loose).repartition(parts, "p", "x", "y").sortWithinPartitions("p", "x", "y", "role", "node")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])

        def close() -> Iterator[pa.RecordBatch]:
            if sides[0] and (found := list(_meeting_blocks(*sides, how))):
                yield record(MEETING, p=[key[0]] * len(found), **dict(zip(MEETING.names[1:], zip(*found, strict=True), strict=True)))

        for batch in batches:
            for p, x, y, role, *member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (p, x, y) != key:
                    yield from close()
                    key, sides = (p, x, y), ([], [])
                sides[role].append(tuple(member))
        yield from close()

    meeting = scratch.keep(dealt.mapInArrow(meet, MEETING_SQL), "meeting")
    work = meeting.join(texts.hint("merge"), "node").select("p", "i", "j", "role", "node", "component", "sig", "text")
    work = work.repartition(parts, "p", "i", "j").sortWithinPartitions("p", "i", "j", "role", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])

        def close() -> Iterator[pa.RecordBatch]:
            if sides[0] and (links := _link_block(*sides, how)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])

        for batch in batches:
            for p, i, j, role, *member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (p, i, j) != key:
                    yield from close()
                    key, sides = (p, i, j), ([], [])
                sides[role].append(tuple(member))
        yield from close()

    return work.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, how: Similarity | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents by links between texts that share enough shingles.

    Returns a row per document: ``doc_id, n_shingles, component_id, kept``; a component is named after
    its least ``doc_id``, which alone is kept. Texts with equal sets are one class first. Classes that
    meet in a band are compared with the band's least member; whatever that leaves in different
    components is compared within each such group block by block, so every pair that shares a band is
    tested unless already joined, and no step lists the pairs of a group. Posterior bounds prune pairs
    (:meth:`Similarity.needed`) by signatures alone, before texts are fetched; links are confirmed on
    the full sets of shingles.

    Null text or one without words: 0 shingles, linked with nothing. Very long texts: whole. Null ``doc_id``: never linked,
    ``component_id`` null, kept. Repeated rows are flagged alike. Rows of one ``doc_id`` with different
    texts belong each to the class of its text; classes with the same least ``doc_id`` are one vertex.
    Empty table: no rows. Other columns are not read.
    """
    how = how or Similarity()
    scratch = Scratch(docs.sparkSession, "near")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = scratch.keep(sketches(plain, how), "sketches")
    rows = sketched.select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2")
    usable = sketched.filter("n > 0 AND doc_id IS NOT NULL")
    classes = scratch.keep(usable.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")), "classes")
    nodes = usable.join(classes.drop("copies"), ["h1", "h2"]).filter("doc_id = node").dropDuplicates(["h1", "h2"]).select("node", "bands", "sig")
    nodes = scratch.keep(nodes, "nodes")

    keys = nodes.select("node", F.explode("bands").alias("band"))
    meeting = keys.groupBy("band").agg(F.min("node").alias("p"), F.max("node").alias("top")).filter("p < top").select("band", "p")
    stars = scratch.keep(keys.join(meeting, "band").filter("node <> p").select("p", "node").distinct(), "stars")
    wanted = stars.select("node").union(stars.select("p")).distinct()
    # merge joins whatever the size: texts are never broadcast, and the plan is one at every scale
    candidates = plain.select(F.col("doc_id").alias("node"), "text").join(wanted.hint("merge"), "node").join(nodes.select("node", "sig").hint("merge"), "node")
    texts = scratch.keep(candidates, "texts")
    sig = lambda at, name: nodes.select(F.col("node").alias(at), F.col("sig").alias(name)).hint("merge")
    text = lambda at, name: texts.select(F.col("node").alias(at), F.col("text").alias(name)).hint("merge")
    pairs = stars.select(F.col("p").alias("a"), F.col("node").alias("b"))
    pairs = scratch.keep(_prune_pairs(pairs.join(sig("b", "sig_b"), "b").join(sig("a", "sig_a"), "a"), how), "pairs")
    links = scratch.keep(_verify_pairs(pairs.join(text("b", "text_b"), "b").join(text("a", "text_a"), "a"), how), "links")

    first = connected_components(links, scratch, "first")
    members = stars.join(first, "node", "left").select("p", "node", F.coalesce("component", "node").alias("component"))
    more = scratch.keep(_links_in_groups(members, nodes, texts, how, scratch), "more")
    if more.isEmpty():
        found = first
    else:
        found = connected_components(links.union(more), scratch, "second")
    scratch.drop("texts", "members", "stars")

    # a class that belongs to a component takes its name from it, any other from its own least document
    named = classes.join(found, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component_id"))
    grouped = rows.join(named, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = grouped.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
