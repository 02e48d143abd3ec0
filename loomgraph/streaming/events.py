"""Event streams of answers: parsing, the fold to a state, and the same over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Events in the order in which a state can meet them; ABORT, a user's own cancelling, is no error and changes nothing.
KINDS = ("SUBMIT", "TOKEN", "COMPLETE", "RESULTS", "DONE", "ERROR", "DISMISS", "ABORT")
FIELDS = ("status", "sparql", "results", "done", "message")
#: Events that begin anew, with the status they begin with.
ANEW = {"SUBMIT": "streaming", "DISMISS": "idle"}
#: What other events do: whether only to an answer that is streaming, the status they lead to (none: as it is), the
#: field that takes their data, and whether it is added to what is there.
MOVES = {"ERROR": (False, "error", "message", False), "TOKEN": (True, None, "sparql", True), "COMPLETE": (True, None, "sparql", False), "RESULTS": (True, None, "results", False), "DONE": (True, "done", "done", False)}
STATE = "struct<status:string,sparql:string,results:string,done:string,message:string>"


def parse_events(raw: DataFrame, id_col: str = "request_id", text_col: str = "raw") -> DataFrame:
    """Server-sent events of each raw stream: ``request_id, seq, event, data``.

    Blocks end at blank lines. Several data lines join with line feeds, untrimmed. Blocks without an
    event or data go.
    """
    blocks = F.posexplode(F.split(F.regexp_replace(F.col(text_col), "\r\n", "\n"), "\n\n")).alias("seq", "block")
    lines = F.split("block", "\n")
    after = lambda prefix: F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(prefix))), lambda x: F.substring(x, len(prefix) + 1, 2**31 - 1))
    event = F.element_at(after("event: "), -1)
    out = raw.select(F.col(id_col).alias("request_id"), blocks)
    out = out.select("request_id", "seq", F.when(F.size(after("event: ")) > 0, event).alias("event"), F.array_join(after("data: "), "\n").alias("data"))
    return out.filter((F.coalesce("event", F.lit("")) != "") & (F.col("data") != ""))


def format_events(events: DataFrame) -> DataFrame:
    """The raw stream of each request: ``request_id, raw``."""
    data = F.regexp_replace("data", "\n", "\ndata: ")
    block = F.concat(F.lit("event: "), "event", F.lit("\ndata: "), data, F.lit("\n\n"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", block.alias("b"))))
    return events.groupBy("request_id").agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "").alias("raw"))


def _blank(status: str) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(status).alias("status"), F.when(F.lit(status == "streaming"), F.lit("")).otherwise(none).alias("sparql"), none.alias("results"), none.alias("done"), none.alias("message"))


def _step(state: Column, x: Column) -> Column:
    """The state after an event, by :data:`ANEW` and :data:`MOVES`."""
    out = F.when(F.lit(False), state)
    for kind, status in ANEW.items():
        out = out.when(x["event"] == kind, _blank(status))
    for kind, (live, status, name, added) in MOVES.items():
        data = F.concat(F.coalesce(state[name], F.lit("")), F.coalesce(x["data"], F.lit(""))) if added else x["data"]
        new = {name: data} | ({"status": F.lit(status)} if status else {})
        test = (x["event"] == kind) & (state["status"] == "streaming") if live else x["event"] == kind
        out = out.when(test, F.struct(*[new.get(n, state[n]).alias(n) for n in FIELDS]))
    return out.otherwise(state)


def fold(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The state of each key after its events, in order.

    What came before the last SUBMIT or DISMISS can't show, so it is dropped before events of a key
    are gathered.
    """
    at = F.struct(*order)
    reset = F.col("event").isin("SUBMIT", "DISMISS")
    last = events.groupBy(key).agg(F.max(F.when(reset, at)).alias("last"))
    recent = events.join(last, key).filter(F.col("last").isNull() | (at >= F.col("last")))
    ordered = F.array_sort(F.collect_list(F.struct(*order, "event", "data")))
    states = recent.groupBy(key).agg(F.aggregate(ordered, _blank("idle").cast(STATE), lambda s, x: _step(s, x).cast(STATE)).alias("state"))
    return states.select(key, "state.*")


class Folding:
    """The same fold event by event, for streams."""

    def __init__(self, state: tuple | None = None):
        self.now = dict(zip(FIELDS, state or ("idle", None, None, None, None), strict=True))

    def take(self, event: str, data: str | None) -> None:
        if event in ANEW:
            self.now = dict.fromkeys(FIELDS) | {"status": ANEW[event]} | ({"sparql": ""} if event == "SUBMIT" else {})
        elif event in MOVES:
            live, status, name, added = MOVES[event]
            if not live or self.now["status"] == "streaming":
                self.now[name] = (self.now[name] or "") + (data or "") if added else data
                self.now["status"] = status or self.now["status"]

    def state(self) -> tuple:
        return tuple(self.now[n] for n in FIELDS)


def fold_stream(events: DataFrame, key: str, key_type: str, order: str, *, buckets: int = 256) -> DataFrame:
    """The fold over a stream: a row per key and micro-batch, the state so far.

    Events of a batch are put in order; a later batch comes after. Keys are dealt over ``buckets`` by hash,
    and a bucket's state holds a small row per key, so that a call costs once for many keys.
    """
    names = "status string, sparql string, results string, done string, message string"
    columns = [key, *FIELDS]

    def run(_, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        old = held.get if held.exists else None
        known = {k: Folding(state) for k, *state in zip(*old, strict=True)} if old else {}
        rows = pd.concat(list(frames)).sort_values(order)
        touched: dict = {}
        for k, event, data in zip(rows["key"], rows["event"], rows["data"], strict=True):
            k = None if k is None or k != k else k
            if k not in touched:
                touched[k] = known[k] = known.get(k) or Folding()
            touched[k].take(event, None if data is None or data != data else data)
        states = [(k, *x.state()) for k, x in known.items()]
        held.update(tuple(list(x) for x in zip(*states, strict=True)))
        yield pd.DataFrame([(k, *x.state()) for k, x in touched.items()], columns=columns)

    text = F.col(key).cast("string")  # as text, for numbers with nulls among them would come as floating ones
    dealt = events.select(F.pmod(F.xxhash64(text), F.lit(buckets)).alias("bucket"), text.alias("key"), order, "event", "data").groupBy("bucket")
    state = ", ".join(f"{n} array<string>" for n in ("keys", *FIELDS))
    folded = dealt.applyInPandasWithState(run, f"{key} string, {names}", state, "update", "NoTimeout")
    return folded.select(F.col(key).cast(key_type).alias(key), *FIELDS)


#: State of :class:`Ordered`: the fold so far, and when its last event was.
FOLDED = "status string, sparql string, results string, done string, message string, at bigint"
WAITING = "at bigint, n bigint, event string, data string"


class Ordered(StatefulProcessor):
    """Folds a key's events in the order of their times, however late they come within the watermark.

    Events wait, by their time, until the watermark has passed them: a timer at the earliest of those
    times folds what is due. A key without events for ``idle`` seconds of event time goes, with its state.
    """

    def __init__(self, idle: float):
        self.idle = int(idle * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", FOLDED)
        self.waiting = handle.getMapState("waiting", "at bigint, n bigint", "event string, data string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        first = None
        for frame in rows:
            for at, n, event, data in frame[["at_ms", "n", "event", "data"]].itertuples(index=False):
                at = max(int(at), passed + 1)  # what the watermark let through although it has passed it comes next
                self.waiting.updateValue((at, int(n)), (event, None if data is None or data != data else data))
                first = at if first is None else min(first, at)
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.waiting.keys())
        due = [k for k in held if k[0] <= passed]
        old = self.folded.get() if self.folded.exists() else None
        if not held:
            if old is not None and old[5] + self.idle <= passed:
                self.folded.clear()
            return iter(())
        folding = Folding(tuple(old[:5]) if old else None)
        for k in due:
            folding.take(*self.waiting.getValue(k))
            self.waiting.removeKey(k)
        if len(due) < len(held):
            self.handle.registerTimer(held[len(due)][0])
        if not due:
            return iter(())
        self.folded.update((*folding.state(), due[-1][0]))
        self.handle.registerTimer(due[-1][0] + self.idle)
        return iter([pd.DataFrame([(key[0], *folding.state())], columns=["key", "status", "sparql", "results", "done", "message"])])

    def close(self) -> None:
        pass


def fold_ordered(events: DataFrame, key: str, key_type: str, at: str, order: str, *, delay: str = "1 minute", idle: float = 3600) -> DataFrame:
    """The fold over a stream whose events come late and out of order: a row per key whenever its state has changed.

    ``at`` is the events' time and ``order`` a number that orders events of one time. Events up to
    ``delay`` late are put in their place. Keys without events for ``idle`` seconds are forgotten; what
    comes later begins anew. Needs the state store on RocksDB
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    late = events.withWatermark(at, delay)
    rows = late.select(F.col(key).alias("key"), F.col(at), F.unix_millis(F.col(at).cast("timestamp")).alias("at_ms"), F.col(order).cast("bigint").alias("n"), "event", "data")
    names = "status string, sparql string, results string, done string, message string"
    return rows.groupBy("key").transformWithStateInPandas(Ordered(idle), f"key {key_type}, {names}", "append", "eventTime")


def relay(events: DataFrame, path: str, checkpoint: str):
    """Write a stream of events to a folder, each exactly once."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
