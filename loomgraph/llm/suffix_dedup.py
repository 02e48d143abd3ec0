"""Removal of passages that repeat from earlier documents, byte for byte."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch, even_keys
from .suffixes import least_owners
from .textio import portions, record

#: Bytes of the grams whose least hash names a window. All windows of one content get one name.
GRAM = 24
#: Bytes of text whose stretches travel together.
PARCEL = 8 << 20
#: Bytes of a text that are looked at in one go; a stretch that ends there for that reason alone counts as another.
CHUNK = 1 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray, by: int, shift: int = 32) -> np.ndarray:
    x = x ^ (x >> np.uint64(shift))
    x *= np.uint64(by)
    return x ^ (x >> np.uint64(shift))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the ``GRAM`` bytes from each position on, each run's from those of its halves."""
    h, done = _BYTES[data], 1
    while done < GRAM:  # the last time the halves overlap
        step = min(done, GRAM - done)
        h = h[:-step] * _MUL + (h[step:] ^ (h[step:] >> np.uint64(29)))
        done += step
    return _mixed(h, 0xD6E8FEB86659FD93)


def _chunk(data: np.ndarray, width: int, hashed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    grams = _gram_hashes(data)
    h, span, done = grams, width - GRAM + 1, 1
    while done < span:
        step = min(done, span - done)
        h = np.minimum(h[:-step], h[step:])
        done += step
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    ends = np.append(first[1:], len(h)) - 1 + width
    names = _mixed(h[first] * _MUL, 0xD6E8FEB86659FD93)  # least hashes are small numbers; this spreads them
    last, contents = ends - GRAM, np.zeros(len(first), np.uint64)
    on, at = (np.arange(len(first)), first) if hashed else (first[:0], first[:0])
    while len(on):  # grams side by side, the last one at the stretch's end
        contents[on] = _mixed(contents[on] + grams[np.minimum(at, last[on])], 0xBF58476D1CE4E5B9, 31)
        more = at < last[on]
        on, at = on[more], at[more] + GRAM
    return names, contents, first, ends


def stretches(data: np.ndarray, width: int, hashed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share their least gram hash: names, hashes of contents, first windows and ends.

    A window's name depends on its content alone, so equal windows, wherever they are, lie in stretches
    of one name. Names and hashes have 64 bits each. Long texts are taken in chunks, so memory beside
    the text is bounded. Without ``hashed``, hashes of contents are left out as 0.
    """
    parts = [_chunk(data[at : at + CHUNK + width - 1], width, hashed) + (at,) for at in range(0, max(1, len(data) - width + 1), CHUNK) if len(data) >= width]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate([p[i] + p[4] if i > 1 else p[i] for p in parts]) for i in range(4))


def _target(names: np.ndarray, n: int) -> np.ndarray:
    """A name's part of ``n``; parts follow the order of names."""
    return ((names >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _differs(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(x, first) != np.maximum.reduceat(x, first)


def _starts(*sorted_by: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins."""
    new = np.zeros(len(sorted_by[0]), bool)
    new[:1] = True
    for x in sorted_by:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


# Rows of a parcel for each target are many: as many as both numbers together, so none is made by itself.
# A column of all a parcel's rows is one array, cut by counts; so it is read.
def _packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column over values that lie side by side, so many of them in each row."""
    values = np.ascontiguousarray(values)
    ends = np.append(0, np.cumsum(counts)) * (values.itemsize * int(np.prod(values.shape[1:])))
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])


def _unpacked(column: pa.Array, kind: str, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, in rows of ``width`` where that is not 1, and how many are in each row. Null is as empty."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    values = np.frombuffer(data if data is not None and ends[-1] > ends[0] else b"", np.uint8)[ends[0] : ends[-1]].view(kind)
    return values.reshape(-1, width) if width > 1 else values, np.diff(ends) // (np.dtype(kind).itemsize * width)


def _batch(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    """``n`` rows; columns that aren't given are null."""
    made = {k: x if isinstance(x, pa.Array) else pa.array(x, type=schema.field(k).type) for k, x in columns.items()}
    return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.nulls(n, f.type) for f in schema], schema=schema)


#: ``names`` and ``contents`` of single stretches, ``counts`` of them per document (``ids``, and ``texts``:
#: 128 bits of a text's hash). ``often`` and ``often_contents``: pairs that several documents of the parcel
#: hold, sent once, with the least (``least``) and whether texts differ (``several``); their holders stay
#: in rows of their own (``pairs``: their names, ``held``: number of documents of each, ``holders``: these).
SENT = pa.schema([("key", pa.int32()), ("target", pa.int32()), ("parcel", pa.int64()), *[(n, pa.binary()) for n in ("names", "contents", "counts", "ids", "texts", "often", "often_contents", "least", "several", "pairs", "held", "holders")]])
SENT_SQL = "key int, target int, parcel long, names binary, contents binary, counts binary, ids binary, texts binary, often binary, often_contents binary, least binary, several binary, pairs binary, held binary, holders binary"


def _parcel(entries: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, texts: np.ndarray, keys: list[int], parcel: int) -> Iterator[pa.RecordBatch]:
    """What a parcel of documents sends to all targets, a row for each."""
    name, content = np.concatenate([e[0] for e in entries]), np.concatenate([e[1] for e in entries])
    who = np.repeat(np.arange(len(entries)), [len(e[0]) for e in entries])
    by = np.argsort(name, kind="stable")
    first = _starts(name[by])
    size = np.diff(np.append(first, len(by)))
    again = by[np.repeat(size > 1, size)]  # names found more than once; only these need a closer look
    again = again[np.lexsort((ids[who[again]], content[again], name[again]))]
    pair = _starts(name[again], content[again]) if len(again) else again
    held = np.diff(np.append(pair, len(again)))
    alone = np.ones(len(name), bool)
    w = who[again]
    if len(again):
        same = np.minimum.reduceat(w, pair) == np.maximum.reduceat(w, pair)
        alone[again] = False
        alone[again[pair[same]]] = True  # one document alone holds the pair, maybe more than once
        pair, held, kept = pair[~same], held[~same], np.repeat(~same, held)
        again, w = again[kept], w[kept]
        pair = np.cumsum(held) - held
    n, numbers = len(keys), np.array(keys, np.int32)
    one = np.flatnonzero(alone)
    to = _target(name[one], n)
    order = np.argsort(to.astype(np.int32), kind="stable")
    one, to = one[order], to[order]
    at = _starts(to, who[one])
    used = who[one][at]
    often, often_content = name[again[pair]], content[again[pair]]
    marks = _target(often, n)
    several = _differs(texts[w, 0], pair) | _differs(texts[w, 1], pair) if len(pair) else np.zeros(0, bool)
    least = np.concatenate((ids[w[pair]].view("<u8")[:, None], texts[w[pair]]), axis=1)
    per = lambda x, *weights: np.bincount(x, *weights, minlength=n).astype(np.int64)
    singles, shared = per(to), per(marks)
    some = np.flatnonzero(singles + shared)
    cut = lambda values, counts: _packed(values, counts[some])
    yield _batch(
        SENT, len(some), key=numbers[some], target=some, parcel=np.full(len(some), parcel), names=cut(name[one], singles), contents=cut(content[one], singles),
        counts=cut(np.diff(np.append(at, len(one))).astype("<u4"), per(to[at])), ids=cut(ids[used], per(to[at])), texts=cut(texts[used], per(to[at])),
        often=cut(often, shared), often_contents=cut(often_content, shared), least=cut(least, shared), several=cut(several.astype(np.uint8), shared),
    )
    if len(pair):  # holders go anywhere; the parcel's number deals them
        some = np.flatnonzero(shared)
        yield _batch(SENT, len(some), key=numbers[(parcel * 7919 % n + some) % n], target=some, parcel=np.full(len(some), parcel), pairs=cut(often, shared), held=cut(held.astype("<i8"), shared), holders=cut(ids[w], per(marks, held)))


def _send_stretches(docs: DataFrame, width: int, keys: list[int]) -> DataFrame:
    """All stretches of ``doc_id, sha, text`` by parcel and target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parcel = TaskContext.get().partitionId() << 32
        entries, ids, texts, size = [], [], [], 0
        for batch in portions(batches, "text"):
            for doc, sha, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = text.encode()
                name, content, _, _ = stretches(np.frombuffer(raw, np.uint8), width)
                if not len(name):
                    continue
                entries.append((name, content))
                ids.append(doc)
                texts.append(sha)
                size += len(raw)
                if size >= PARCEL:
                    yield from _parcel(entries, np.array(ids, np.int64), np.frombuffer(b"".join(texts), "<u8").reshape(-1, 2), keys, parcel)
                    parcel, entries, ids, texts, size = parcel + 1, [], [], [], 0
        if entries:
            yield from _parcel(entries, np.array(ids, np.int64), np.frombuffer(b"".join(texts), "<u8").reshape(-1, 2), keys, parcel)

    return docs.select("doc_id", "sha", "text").mapInArrow(run, SENT_SQL)


SETTLED = pa.schema([("parcel", pa.int64()), ("target", pa.int32()), ("doc_id", pa.int64()), *[(n, pa.binary()) for n in ("gone", "mixed", "pairs", "held", "holders", "answers")]])
SETTLED_SQL = "parcel long, target int, doc_id long, gone binary, mixed binary, pairs binary, held binary, holders binary, answers binary"
#: What an answer says of a pair that several documents hold.
NOTHING, MIXED, GONE, GONE_BUT_LEAST = range(4)


def _by_doc(docs: np.ndarray, names: np.ndarray, mixed: np.ndarray) -> dict:
    """Columns of a row per document: its names that are gone whole and those that are mixed."""
    order = np.argsort(docs, kind="stable")
    docs, names, mixed = docs[order], names[order], mixed[order]
    at = _starts(docs)
    need = np.add.reduceat(mixed.astype(np.int64), at)
    return {"doc_id": docs[at], "gone": _packed(names[~mixed], np.diff(np.append(at, len(docs))) - need), "mixed": _packed(names[mixed], need)}


def _settle_names(sent: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of a task's documents, and answers for pairs that several documents of a parcel hold."""
    read = lambda n, kind, width=1: np.concatenate([_unpacked(b.column(n), kind, width)[0] for b in sent])
    counts, ids, texts, least = read("counts", "<u4"), read("ids", "<i8"), read("texts", "<u8", 2), read("least", "<u8", 3)
    n_often = np.concatenate([_unpacked(b.column("often"), "<u8")[1] for b in sent])
    names = np.concatenate((read("names", "<u8"), read("often", "<u8")))
    contents = np.concatenate((read("contents", "<u8"), read("often_contents", "<u8")))
    docs = np.concatenate((np.repeat(ids, counts), least[:, 0].view("<i8")))
    high, low = (np.concatenate((np.repeat(texts[:, i], counts), least[:, i + 1])) for i in range(2))
    single = len(names) - len(least)
    many = np.zeros(len(names), bool)
    many[single:] = read("several", np.uint8)
    by = np.argsort(names, kind="stable")
    first = _starts(names[by])
    sizes = np.diff(np.append(first, len(by)))
    d = docs[by]
    apart = _differs(high[by], first) | _differs(low[by], first) | np.logical_or.reduceat(many[by], first)
    shared, mixed = np.repeat(apart, sizes), np.repeat(_differs(contents[by], first), sizes)
    later = d > np.repeat(np.minimum.reduceat(d, first), sizes)
    use = np.flatnonzero(shared & (mixed | later) & (by < single))
    if len(use):
        found = _by_doc(d[use], names[by[use]], mixed[use])
        yield _batch(SETTLED, len(found["doc_id"]), **found)
    said = np.zeros(len(names), np.uint8)
    said[by] = np.where(~shared, NOTHING, np.where(mixed, MIXED, np.where(later, GONE, GONE_BUT_LEAST)))
    said, row = said[single:], np.repeat(np.arange(len(n_often)), n_often)
    if said.any():
        some = np.unique(row[said != NOTHING])
        parcel, target = (np.concatenate([b.column(n).to_numpy() for b in sent]) for n in ("parcel", "target"))
        yield _batch(SETTLED, len(some), parcel=parcel[some], target=target[some], answers=_packed(said[np.isin(row, some)], n_often[some]))


def _settle_stretches(sent: DataFrame, n: int) -> DataFrame:
    """Per target: its documents' marks and its answers; holders pass through.

    Where all stretches of a name have one content, every later document loses all of it. Where
    contents differ, some windows may still be equal; their bytes decide.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of one target, as the keys deal each a task of its own
        for batch in batches:
            passing = batch.column("holders").is_valid()
            if (rest := batch.filter(pa.compute.invert(passing))).num_rows:
                held.append(rest)
            if (through := batch.filter(passing)).num_rows:
                yield _batch(SETTLED, through.num_rows, **{c: through.column(c) for c in ("parcel", "target", "pairs", "held", "holders")})
        if held:
            yield from _settle_names(held)

    return sent.repartition(n, "key").mapInArrow(run, SETTLED_SQL)


MARKS = pa.schema([("doc_id", pa.int64()), ("gone", pa.binary()), ("mixed", pa.binary())])


def _marks(settled: DataFrame) -> DataFrame:
    """Per document the names whose stretches it loses whole, and those that need bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (names, said, held, docs) = (_unpacked(batch.column(c), kind)[0] for c, kind in (("pairs", "<u8"), ("answers", np.uint8), ("held", "<i8"), ("holders", "<i8")))
            if not len(names):
                continue
            least = np.repeat(docs[np.cumsum(held) - held], held)  # holders come in order of doc_id
            names, said = np.repeat(names, held), np.repeat(said, held)
            use = (said == MIXED) | (said == GONE) | (said == GONE_BUT_LEAST) & (docs > least)
            if use.any():
                found = _by_doc(docs[use], names[use], said[use] == MIXED)
                yield _batch(MARKS, len(found["doc_id"]), **found)

    own = settled.filter("doc_id IS NOT NULL").select("doc_id", "gone", "mixed")
    holders = settled.filter("holders IS NOT NULL").select("parcel", "target", "pairs", "held", "holders")
    answers = settled.filter("answers IS NOT NULL").select("parcel", "target", "answers")
    more = holders.join(answers, ["parcel", "target"]).select("pairs", "held", "holders", "answers").mapInArrow(run, "doc_id long, gone binary, mixed binary")
    return own.union(more).groupBy("doc_id").agg(F.collect_list("gone").alias("gone"), F.collect_list("mixed").alias("mixed"))


#: Parts of a target, in the order of names. What has one name lies in one part, so parts are settled one by one.
PARTS = 16
#: Bytes of strings that get one suffix array.
ARRAY = 1 << 20

#: Of a parcel for a target: distinct ``strings`` side by side with the ``lengths``, the part and the least
#: document (``owners``) of each, and ``places``: document (of ``docs``, with the hashes of texts ``shas``),
#: start and string of each. In rows of their own, ``ranges`` that a document loses whole.
BYTES = pa.schema([("key", pa.int32()), ("target", pa.int32()), ("parcel", pa.int64()), *[(n, pa.binary()) for n in ("strings", "lengths", "parts", "owners", "docs", "shas", "places")], ("doc_id", pa.int64()), ("sha", pa.binary()), ("ranges", pa.binary())])
BYTES_SQL = "key int, target int, parcel long, strings binary, lengths binary, parts binary, owners binary, docs binary, shas binary, places binary, doc_id long, sha binary, ranges binary"


class _Held:
    """What a parcel holds: distinct strings with the least document of each, and where which string is."""

    def __init__(self, n: int):
        self.n, self.size = n, 0
        self.strings, self.parts, self.owners = {}, [], []
        self.docs, self.shas, self.places = [], [], []
        self.lost = []

    def add(self, doc: int, sha: bytes, raw: bytes, names: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        which = []
        for part, a, b in zip(_target(names, PARTS * self.n).tolist(), starts.tolist(), ends.tolist(), strict=True):
            piece = raw[a:b]
            i = self.strings.setdefault(piece, len(self.parts))
            if i == len(self.parts):
                self.parts.append(part)
                self.owners.append(doc)
            elif doc < self.owners[i]:
                self.owners[i] = doc
            which.append(i)
        self.places.append(np.stack((np.full(len(which), len(self.docs)), starts, np.array(which)), axis=1))
        self.docs.append(doc)
        self.shas.append(sha)
        self.size += int((ends - starts).sum())

    def lose(self, doc: int, sha: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        """Stretches, in the order of a text, that go whole."""
        at = np.flatnonzero(np.append(True, starts[1:] > ends[:-1]))
        self.lost.append((doc, sha, np.stack((starts[at], ends[np.append(at[1:], len(ends)) - 1]), axis=1).astype("<i8").tobytes()))
        self.size += len(self.lost[-1][-1])

    def rows(self, keys: list[int], parcel: int) -> Iterator[pa.RecordBatch]:
        if self.lost:
            yield _batch(BYTES, len(self.lost), **dict(zip(("doc_id", "sha", "ranges"), zip(*self.lost, strict=True), strict=True)))
        if not self.strings:
            return
        parts, lengths = np.array(self.parts), np.array([len(x) for x in self.strings])
        order = np.argsort(parts, kind="stable")
        strings, target = list(self.strings), parts // PARTS
        doc, start, which = np.concatenate(self.places).T
        by = np.lexsort((doc, target[which]))
        doc, start, which = doc[by], start[by], which[by]
        to = target[which]
        per = lambda x: np.bincount(x, minlength=self.n)
        before = lambda counts: np.cumsum(counts) - counts
        place = np.empty(len(order), np.int64)  # of each string among those of its target
        place[order] = np.arange(len(order)) - before(per(target))[target[order]]
        at = _starts(to, doc)
        ranks = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(doc)))) - before(per(to[at]))[to]
        some = np.flatnonzero(per(target))
        cut = lambda values, counts: _packed(values, counts[some])
        yield _batch(
            BYTES, len(some), key=np.array(keys, np.int32)[some], target=some, parcel=np.full(len(some), parcel),
            strings=cut(np.frombuffer(b"".join([strings[i] for i in order.tolist()]), np.uint8), np.bincount(target, lengths, minlength=self.n).astype(np.int64)),
            lengths=cut(lengths[order].astype("<u4"), per(target)), parts=cut((parts % PARTS)[order].astype(np.uint8), per(target)), owners=cut(np.array(self.owners, "<i8")[order], per(target)),
            docs=cut(np.array(self.docs, "<i8")[doc[at]], per(to[at])), shas=cut(np.frombuffer(b"".join(self.shas), "<u8").reshape(-1, 2)[doc[at]], per(to[at])),
            places=cut(np.stack((ranks, start, place[which]), axis=1).astype("<i8"), per(to)),
        )


def _send_bytes(marked: DataFrame, width: int, keys: list[int]) -> DataFrame:
    """Mixed stretches by parcel and target: distinct strings with their least document, and where each is.

    A string that many documents of a parcel share travels once; its places stay with the parcel.
    Stretches that a document loses whole are ranges already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parcel, held = TaskContext.get().partitionId() << 32, _Held(len(keys))
        for batch in portions(batches, "text"):
            for doc, sha, text, mixed, gone in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                raw = text.encode()
                name, _, start, end = stretches(np.frombuffer(raw, np.uint8), width, False)
                if len(on := _found(name, gone)):
                    held.lose(doc, sha, start[on], end[on])
                if len(on := _found(name, mixed)):
                    held.add(doc, sha, raw, name[on], start[on], end[on])
                if held.size >= PARCEL:
                    yield from held.rows(keys, parcel)
                    parcel, held = parcel + 1, _Held(len(keys))
        yield from held.rows(keys, parcel)

    return marked.select("doc_id", "sha", "text", "mixed", "gone").mapInArrow(run, BYTES_SQL)


def _found(names: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """Which of the names are among the marks of any target."""
    wanted = np.frombuffer(b"".join(marks or []), "<u8")
    return np.flatnonzero(np.isin(names, wanted)) if len(wanted) else np.zeros(0, np.int64)


ANSWERS = pa.schema([("parcel", pa.int64()), ("target", pa.int32()), ("least", pa.binary())])


def _settle_bytes(sent: DataFrame, n: int, width: int) -> DataFrame:
    """For each parcel and target, per string the least document that holds each of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings, lengths, parts, owners, counts, parcel, target = [], [], [], [], [], [], []
        for batch in batches:
            blob, (sizes, n_strings) = _unpacked(batch.column("strings"), np.uint8)[0].tobytes(), _unpacked(batch.column("lengths"), "<u4")
            to, (own, numbers) = np.cumsum(sizes, dtype=np.int64), (_unpacked(batch.column("owners"), "<i8")[0], batch.column("target").to_numpy())
            strings += [blob[a:b] for a, b in zip((to - sizes).tolist(), to.tolist(), strict=True)]
            parts.append(_unpacked(batch.column("parts"), np.uint8)[0] + np.repeat(numbers.astype(np.int64) * PARTS, n_strings))
            for found, x in ((lengths, sizes), (owners, own), (counts, n_strings), (parcel, batch.column("parcel").to_numpy()), (target, numbers)):
                found.append(x.copy())
        if not strings:
            return
        lengths, parts, owners, counts, parcel, target = (np.concatenate(x) for x in (lengths, parts, owners, counts, parcel, target))
        windows = lengths.astype(np.int64) - width + 1
        ends = np.cumsum(windows)
        least = np.empty(ends[-1], np.int64)
        group: dict[bytes, tuple[int, list[int]]] = {}

        def settle() -> None:
            for found, (_, where) in zip(least_owners(list(group), [o for o, _ in group.values()], width), group.values(), strict=True):
                for i in where:
                    least[ends[i] - windows[i] : ends[i]] = found

        size, order = 0, np.argsort(parts, kind="stable")
        for i, fresh in zip(order.tolist(), np.append(False, np.diff(parts[order]) > 0).tolist(), strict=True):
            if fresh and size >= ARRAY:
                settle()
                group, size = {}, 0
            s, own = strings[i], int(owners[i])
            if (held := group.get(s)) is None:
                group[s] = own, [i]
                size += len(s)
            else:
                held[1].append(i)
                if own < held[0]:
                    group[s] = own, held[1]
        settle()
        cuts = np.append(0, ends)[np.append(0, np.cumsum(counts))]  # windows before each row
        at = np.append(_starts(cuts[1:] >> 17), len(counts))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield _batch(ANSWERS, b - a, parcel=parcel[a:b], target=target[a:b], least=_packed(least[cuts[a] : cuts[b]], np.diff(cuts[a : b + 1])))

    dealt = sent.filter("strings IS NOT NULL").select("key", "parcel", "target", "strings", "lengths", "parts", "owners").repartition(n, "key")
    return dealt.mapInArrow(run, "parcel long, target int, least binary")


RANGES = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("ranges", pa.binary())])


def _ranges(sent: DataFrame, answers: DataFrame, width: int) -> DataFrame:
    """Per parcel and target, each text's byte ranges whose windows an earlier document holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, (lengths, n_strings) = _unpacked(batch.column("least"), "<i8")[0], _unpacked(batch.column("lengths"), "<u4")
            (docs, n_docs), shas = _unpacked(batch.column("docs"), "<i8"), _unpacked(batch.column("shas"), "<u8", 2)[0]
            places, n_places = _unpacked(batch.column("places"), "<i8", 3)
            if not len(places):
                continue
            before = lambda counts: np.repeat(np.cumsum(counts) - counts, n_places)
            doc, start, which = places[:, 0] + before(n_docs), places[:, 1], places[:, 2] + before(n_strings)
            windows = lengths.astype(np.int64) - width + 1
            first = np.cumsum(windows) - windows
            lows, highs = np.minimum.reduceat(least, first)[which], np.maximum.reduceat(least, first)[which]
            all_, some = np.flatnonzero(highs < docs[doc]), np.flatnonzero((lows < docs[doc]) & (highs >= docs[doc]))
            on, of = [np.stack((start[all_], start[all_] + lengths[which[all_]]), axis=1)], [doc[all_]]
            for at in np.array_split(some, max(1, int(windows[which[some]].sum()) >> 20)):  # windows one by one
                m = windows[which[at]] + 1  # and one beyond that ends a run
                shift = np.cumsum(m) - m
                step = np.arange(m.sum()) - np.repeat(shift, m)
                inside = step < np.repeat(m - 1, m)
                earlier = inside & (least[np.where(inside, step + np.repeat(first[which[at]], m), 0)] < np.repeat(docs[doc[at]], m))
                turns = np.flatnonzero(np.diff(np.concatenate(([0], earlier.view(np.int8))))).reshape(-1, 2)
                own = np.repeat(np.arange(len(at)), m)[turns[:, 0]]
                on.append(turns - shift[own][:, None] + [0, width - 1] + start[at[own]][:, None])
                of.append(doc[at[own]])
            on, of = np.concatenate(on), np.concatenate(of)
            if len(of):
                by = np.argsort(of, kind="stable")
                at = _starts(of[by])
                who = of[by[at]]
                yield _batch(RANGES, len(who), doc_id=docs[who], sha=_packed(shas[who], np.ones(len(who), np.int64)), ranges=_packed(on[by].astype("<i8"), np.diff(np.append(at, len(by)))))

    both = sent.filter("strings IS NOT NULL").select("parcel", "target", "lengths", "docs", "shas", "places").join(answers, ["parcel", "target"])
    found = both.select("lengths", "docs", "shas", "places", "least").mapInArrow(run, "doc_id long, sha binary, ranges binary")
    return found.union(sent.filter("ranges IS NOT NULL").select("doc_id", "sha", "ranges"))


def cover(n: int, ranges: np.ndarray) -> np.ndarray:
    """Maximal runs of bytes that any of the ranges covers."""
    if not len(ranges):
        return np.zeros((0, 2), np.int64)
    steps = np.bincount(ranges[:, 0], minlength=n + 1)[: n + 1] - np.bincount(ranges[:, 1], minlength=n + 1)[: n + 1]
    on = np.cumsum(steps) > 0
    return np.flatnonzero(np.diff(np.concatenate(([0], on.view(np.int8), [0])))).reshape(-1, 2)


OUT = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept_sha256", pa.string())])


def _apply(marked: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            rows = []
            for doc, sha, text, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                spans = cover(len(raw), np.frombuffer(b"".join(ranges), "<i8").reshape(-1, 2))
                digest, at = hashlib.sha256(), 0
                for a, b in spans.tolist():
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                if len(spans):
                    rows.append((doc, sha, int((spans[:, 1] - spans[:, 0]).sum()), spans.reshape(-1).tolist(), digest.hexdigest()))
            if rows:
                yield record(OUT, **dict(zip(OUT.names, zip(*rows, strict=True), strict=True)))

    return marked.mapInArrow(run, "doc_id long, sha binary, n_removed long, spans array<long>, kept_sha256 string")


def remove_repeats(docs: DataFrame, *, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find every byte covered by a string of ``width`` bytes that also starts in an earlier document.

    Returns a row per document: ``doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256`` (``spans``:
    start and end of each maximal removed run in the text's UTF-8 bytes).

    Windows are named by their least gram hash, so equal windows meet under one name. Names of one text
    only are done with; names with one content everywhere (64 bits of name and 64 of content) are
    settled by the least document; for the others the bytes are sent, shards get suffix arrays, and
    shards meet by binary search. Parcels of documents send each content once, whether many of them
    hold it or one, so a passage that most documents hold stays small wherever it meets.

    Null text: as empty, nothing removed. Texts under ``width`` bytes: nothing removed. Very long texts:
    whole, looked at a chunk at a time. Null ``doc_id``: neither earlier nor later than any, nothing
    removed. Repeated rows: alike. Rows of one ``doc_id``: none is earlier than another, and each loses
    what its own text shares with earlier documents. Empty table: no rows. Other columns are not read.
    """
    if width < GRAM + 1:
        raise ValueError(f"width must be above {GRAM}")
    spark = docs.sparkSession
    scratch, n = Scratch(spark, "repeats"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.substring(F.sha2(text, 256), 1, 32))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("sha"), text.alias("text"))
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    every = scratch.keep(every.withColumn("sha", F.unhex(F.substring("whole", 1, 32))), "every")
    first = every.filter("doc_id IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("first"))
    first = scratch.keep(first, "first")  # so that joins deal both sides anew and can split a hot text

    keys = even_keys(spark, n)
    sent = _send_stretches(plain.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= width)), width, keys)
    marks = scratch.keep(_marks(scratch.keep(_settle_stretches(sent, n), "settled")), "marks")
    scratch.drop("settled")
    owned = every.join(first, "sha").filter("doc_id = first").select("doc_id").distinct()
    chosen = plain.join(marks.join(owned, "doc_id", "left_semi"), "doc_id")
    marked = scratch.keep(chosen.select("doc_id", "sha", "text", "mixed", "gone"), "marked")
    sent = scratch.keep(_send_bytes(marked, width, keys), "bytes")
    answers = scratch.keep(_settle_bytes(sent, n, width), "answers")
    ranges = _ranges(sent, answers, width).groupBy("doc_id", "sha").agg(F.collect_set("ranges").alias("ranges"))
    ranges = scratch.keep(ranges, "ranges")
    scratch.drop("bytes", "answers")
    done = _apply(marked.join(ranges, ["doc_id", "sha"]).select("doc_id", "sha", "text", "ranges"))
    done = scratch.keep(done.dropDuplicates(["doc_id", "sha"]), "done")
    scratch.drop("marked", "ranges", "marks")

    # copies of an earlier text lose all of it
    rows = every.join(first, "sha", "left").join(done, ["doc_id", "sha"], "left")
    copy = F.coalesce((F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= width), F.lit(False))
    zero, none = F.lit(0).cast("long"), F.array().cast("array<long>")
    spans = F.when(copy, F.array(zero, "n_bytes")).otherwise(F.coalesce("spans", none))
    removed = F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero))
    kept = F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole"))
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), (F.size(spans) / 2).cast("long").alias("n_spans"), spans.alias("spans"), kept.alias("kept_sha256"))
