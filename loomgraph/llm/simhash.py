"""SimHash fingerprints and their self-join by binary tries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .components import connected_components
from .scratch import Scratch
from .textio import lowered_words, portions, record

BITS = 64
#: Shingles whose bits are counted at once.
SHINGLES = 8192
#: Fingerprints of a node that a task takes whole, and by how many bits a larger node is split.
WHOLE, SPLIT_BITS = 8192, 4
#: Node pairs of so few fingerprint pairs are compared outright; node pairs that a task looks at together.
OUTRIGHT, TOGETHER = 64, 1 << 15

SKETCH = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprint(words: list[bytes], width: int = 3, seed: int = 42) -> int:
    """The bits that are set in over half the XXH64 of all shingles, repeats included; 0 without words."""
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    total = np.zeros(BITS, np.int64)
    spans = zip(starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)
    left = n
    while left:
        part = min(left, SHINGLES)
        h = np.fromiter((digest(text[a:b], seed) for (a, b), _ in zip(spans, range(part))), "<u8", part)  # noqa: B905
        total += np.unpackbits(h.view(np.uint8).reshape(part, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        left -= part
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed number) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            made = np.fromiter((fingerprint(lowered_words(t), width) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], schema=SKETCH)

    return docs.mapInArrow(run, "doc_id long, fp long")


def turned(fp: Column, by: int) -> Column:
    """A fingerprint whose bit ``by`` (from the top) comes first."""
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by)) if by else fp


def _node() -> Column:
    """The first ``depth`` bits of ``x``."""
    return F.expr("shiftrightunsigned(x, 64 - depth)")


def node_pairs(a: np.ndarray, b: np.ndarray, budget: int, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions ``i, j`` of all pairs of two sorted arrays of unsigned numbers that differ in ``budget`` bits at most.

    A sorted array is a binary trie: a node is a run of equal leading bits, its children are where the
    next bit turns. Pairs of nodes go down together from the roots, whose first ``depth`` bits are the same within each array,
    and add up the bits in which they differ; a pair above ``budget`` ends there. Pairs of small nodes are
    compared outright. Pairs wait on a stack, the deepest first, so memory stays small.
    """
    alone = a is b  # then a pair of nodes, and a pair of numbers, is looked at one way round
    differ = int(np.bitwise_count((a[0] ^ b[0]) >> np.uint64(BITS - depth))) if depth else 0
    stack = [(depth, np.array([[0, len(a), 0, len(b), differ]]))] if differ <= budget else []
    while stack:
        depth, nodes = stack.pop()
        if len(nodes) > TOGETHER:
            stack.append((depth, nodes[TOGETHER:]))
            nodes = nodes[:TOGETHER]
        sizes = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
        small = sizes <= (OUTRIGHT if depth < BITS else np.inf)
        done, size = nodes[small], sizes[small]
        if len(done):
            which = np.repeat(np.arange(len(done)), size)
            at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            wide = done[which, 3] - done[which, 2]
            i, j = done[which, 0] + at // wide, done[which, 2] + at % wide
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if alone:
                near &= i < j
            yield i[near], j[near]
        nodes = nodes[~small]
        if not len(nodes):
            continue
        bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
        turns = [_turn(x, nodes[:, k], nodes[:, k + 1], bit) for k, x in ((0, a), (2, b))]
        children = []
        for p in (0, 1):
            for q in (0, 1):
                lo = [nodes[:, 0] if p == 0 else turns[0], turns[0] if p == 0 else nodes[:, 1]]
                hi = [nodes[:, 2] if q == 0 else turns[1], turns[1] if q == 0 else nodes[:, 3]]
                child = np.stack([*lo, *hi, nodes[:, 4] + (p != q)], axis=1)
                on = (child[:, 1] > child[:, 0]) & (child[:, 3] > child[:, 2]) & (child[:, 4] <= budget)
                if alone and p > q:
                    on &= nodes[:, 0] != nodes[:, 2]
                children.append(child[on])
        stack.append((depth + 1, np.concatenate(children)))


def _turn(x: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.uint64) -> np.ndarray:
    """In each run of a sorted array, in which all bits above ``bit`` are the same, where ``bit`` begins to be set."""
    first = (x[low] >> np.uint64(int(bit).bit_length()) << np.uint64(int(bit).bit_length()) if int(bit).bit_length() < BITS else np.zeros(len(low), np.uint64)) | bit
    return np.clip(np.searchsorted(x, first), low, high)


class _Forest:
    """Union-find that tells which links join something new."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _links(a: np.ndarray, b: np.ndarray, budget: int, depth: int) -> list[tuple[int, int]]:
    """Links within budget between two sorted arrays, as many as connect what they connect."""
    forest, out = _Forest(), []
    for i, j in node_pairs(a, b, budget, depth):
        for x, y in zip(a[i].tolist(), b[j].tolist(), strict=True):
            if x != y and forest.join(x, y):
                out.append((x, y))
    return out


def near_fingerprints(nodes: DataFrame, budget: int, scratch: Scratch) -> DataFrame:
    """Links ``a, b`` between fingerprints (column ``fp``, each once) that differ in at most ``budget`` bits.

    Two such fingerprints agree in one of ``budget + 1`` runs of bits at least. So there are as many
    tries, each with another run first, and pairs of nodes that differ there are pruned at once: what is
    left are tries of fingerprints that share the run. A trie, or pair of nodes, with more than
    :data:`WHOLE` fingerprints on a side is split by its next bits in a round over all of them at once;
    only pairs of children within the budget go on, each with its count of differing bits. Pairs small
    enough are traversed in one task each. Links within a task that join nothing new are left out.
    """
    edges = [BITS * r // (budget + 1) for r in range(budget + 2)]
    tries = F.array(*[F.struct(F.lit(at).alias("by"), turned(F.col("fp"), at).alias("x")) for at in edges[:-1]])
    members = nodes.select(F.explode(tries).alias("t")).select("t.*")
    shared = F.element_at(F.create_map(*[F.lit(v) for at, end in zip(edges, edges[1:], strict=False) for v in (at, end - at)]), F.col("by"))
    members = scratch.keep(members.withColumn("depth", shared).withColumn("node", _node()), "tries")
    roots = scratch.keep(members.groupBy("by", "depth", "node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "roots")
    pairs = roots.select("by", "depth", F.col("node").alias("p"), F.col("node").alias("q"), F.lit(0).alias("differ"), F.col("n").alias("n_p"), F.col("n").alias("n_q"))
    ready, round_ = pairs.filter(F.greatest("n_p", "n_q") <= WHOLE), 0
    large = scratch.keep(pairs.filter(F.greatest("n_p", "n_q") > WHOLE), "large0")
    below = members  # fingerprints under nodes that are split
    whole = [(ready, members)]
    while not large.isEmpty():
        round_ += 1
        either = large.select("by", "depth", F.col("p").alias("node")).union(large.select("by", "depth", F.col("q").alias("node"))).distinct()
        step = F.least(F.lit(SPLIT_BITS), F.lit(BITS) - F.col("depth"))
        deeper = below.join(either.hint("merge"), ["by", "depth", "node"], "left_semi")
        deeper = deeper.select("by", (F.col("depth") + step).alias("depth"), F.col("node").alias("up"), "x")
        below = scratch.keep(deeper.withColumn("node", _node()), f"below{round_}")
        counted = scratch.keep(below.groupBy("by", "depth", "up", "node").agg(F.count(F.lit(1)).alias("n")), f"sizes{round_}")
        child = lambda s: counted.select("by", "depth", F.col("up").alias(f"up_{s}"), F.col("node").alias(s), F.col("n").alias(f"n_{s}"))  # noqa: B023, E731
        up = large.select("by", (F.col("depth") + step).alias("depth"), step.alias("step"), F.col("p").alias("up_p"), F.col("q").alias("up_q"), "differ")
        made = up.join(child("p").hint("merge"), ["by", "depth", "up_p"]).join(child("q").hint("merge"), ["by", "depth", "up_q"])
        made = made.filter((F.col("up_p") != F.col("up_q")) | (F.col("p") <= F.col("q")))
        more = F.bit_count(F.col("p").bitwiseXOR(F.col("q")).bitwiseAND(F.expr("shiftleft(1L, step) - 1")))
        made = made.select("by", "depth", "p", "q", (F.col("differ") + more).alias("differ"), "n_p", "n_q").filter(F.col("differ") <= budget)
        made = scratch.keep(made, f"pairs{round_}")
        big = (F.greatest("n_p", "n_q") > WHOLE) & (F.col("depth") < BITS)
        whole.append((made.filter(~big), below))
        large = scratch.keep(made.filter(big), f"large{round_}")

    work = None
    for ready, under in whole:
        side = lambda s, role: ready.filter("p <> q" if role else "true").select("by", "depth", F.col(s).alias("node"), "p", "q").join(under.hint("merge"), ["by", "depth", "node"]).select("by", "depth", "p", "q", F.lit(role).alias("role"), "x")  # noqa: B023, E731
        part = side("p", 0).union(side("q", 1))
        work = part if work is None else work.union(part)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = work.repartition(parts, "by", "depth", "p", "q").sortWithinPartitions("by", "depth", "p", "q", "role", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])

        def close() -> list[tuple[int, int]]:
            arrays = [np.sort(np.array(s, np.int64).view(np.uint64)) for s in sides]
            if key[2] == key[3]:
                arrays[1] = arrays[0]
            back = np.uint64(key[0])
            links = np.array(_links(arrays[0], arrays[1], budget, key[1]), np.uint64).reshape(-1, 2)
            links = links >> back | links << np.uint64(BITS - key[0]) if key[0] else links
            return links.view(np.int64).tolist()

        for batch in batches:
            out = []
            for by, depth, p, q, role, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (by, depth, p, q) != key:
                    out += close() if key else []
                    key, sides = (by, depth, p, q), ([], [])
                sides[role].append(x)
            if out:
                yield record(LINKS, **dict(zip("ab", zip(*out, strict=True), strict=True)))
        if key and (out := close()):
            yield record(LINKS, **dict(zip("ab", zip(*out, strict=True), strict=True)))

    return work.mapInArrow(run, "a long, b long")


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def near_documents(docs: DataFrame, *, width: int = 3, budget: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose SimHash fingerprints differ in at most ``budget`` of 64 bits.

    Returns a row per document: ``doc_id, fingerprint`` (16 hexadecimal digits) and ``component_id``, the
    least ``doc_id`` that links lead to, and ``kept``, whether that is its own. Equal fingerprints are one node; nodes are joined by
    :func:`near_fingerprints`.

    Null text, an empty one or one without words: fingerprint 0, linked like any other. Fewer words than
    ``width``: the whole sequence is the one shingle. Very long texts: whole. Null ``doc_id``: linked like
    others, but it names no component; null if all in the component are, and kept then. Repeated rows: alike. Empty table: no
    rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = scratch.keep(fingerprints(plain, width), "rows")
    nodes = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = connected_components(near_fingerprints(nodes.select("fp"), budget, scratch), scratch, "links")
    named = nodes.join(found.select(F.col("node").alias("fp"), "component").hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = scratch.keep(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = scratch.keep(named.join(least.hint("merge"), "component").select("fp", "component_id"), "components")
    out = rows.join(named.hint("merge"), "fp")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", kept.alias("kept"))
