"""Numbered changes of clients, applied in order by a stream that waits for missing numbers only so long."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState

from .scratch import WRITING, Scratch

#: Numbers of one client that are ranked together; ranges before them are added up.
RANGE = 1024
#: Changes per bucket of clients, over all batches.
PER_BUCKET = 1500
#: Rows that go from a bucket to Spark at once.
ROWS_OUT = 20_000
TICK, FLUSH, CHANGE, AGAIN = 0, 1, 2, 3

INPUT = "batch int, kind int, today int, client string, n long, day int, change_id long, op string, city string, cents string"
OUTPUT = "change_id long, client string, n long, op string, status string, batch int, missed long, city string, cents string"
#: A bucket's state: the wheel, from the day on which waiting ends to the clients whose waiting ends then, and the clients.
STATE = "wheel array<struct<day:int,clients:array<string>>>, clients array<struct<client:string,next:bigint,city:string,cents:string,held:array<struct<n:bigint,day:int,change_id:bigint,op:string,city:string,cents:string>>>>"
NAMES = [c.split()[0] for c in OUTPUT.split(", ")]


class Client:
    """What is applied of one client, and the changes that wait: ``n -> (day, change_id, op, city, cents)``."""

    __slots__ = ("next", "city", "cents", "held", "due")

    def __init__(self, next_: int = 1, city: str | None = None, cents: str | None = None, held: dict | None = None):
        self.next, self.city, self.cents, self.held, self.due = next_, city, cents, held or {}, None

    def change(self, op: str | None, city: str | None, cents: str | None) -> None:
        if op == "I":
            self.city, self.cents = city, cents
        elif op == "U":
            self.city, self.cents = self.city if city is None else city, self.cents if cents is None else cents
        elif op == "D":
            self.city = self.cents = None


class Bucket:
    """Clients of one bucket and their timing wheel.

    ``wheel`` maps the day on which waiting ends to the clients that hold changes and whose earliest held
    day plus ``patience`` is that day. A tick looks at the days of the wheel alone, and visits only
    clients of days that have come.
    """

    def __init__(self, patience: int, wheel=(), clients=()):
        self.patience = patience
        self.wheel = {day: dict.fromkeys(names) for day, names in wheel}
        self.clients = {c: Client(n, city, cents, {h[0]: tuple(h)[1:] for h in held}) for c, n, city, cents, held in clients}
        for day, names in self.wheel.items():
            for name in names:
                self.clients[name].due = day
        self.out: list[tuple] = []

    def state(self) -> tuple:
        wheel = [(day, list(names)) for day, names in self.wheel.items()]
        return wheel, [(name, c.next, c.city, c.cents, [(n, *row) for n, row in c.held.items()]) for name, c in self.clients.items()]

    def schedule(self, name: str | None, client: Client) -> None:
        due = min(row[0] for row in client.held.values()) + self.patience if client.held else None
        if due == client.due:
            return
        if client.due is not None:
            slot = self.wheel[client.due]
            del slot[name]
            if not slot:
                del self.wheel[client.due]
        if due is not None:
            self.wheel.setdefault(due, {})[name] = None
        client.due = due

    def apply(self, name: str | None, client: Client, batch: int, missed: int = 0) -> None:
        """Apply held changes from the next number on, as far as there is no gap."""
        while (row := client.held.pop(client.next, None)) is not None:
            _, change_id, op, city, cents = row
            client.change(op, city, cents)
            self.out.append((change_id, name, client.next, op, "applied", batch, missed, client.city, client.cents))
            client.next, missed = client.next + 1, 0

    def tick(self, today: int | None, batch: int) -> bool:
        """End the waiting that is due on ``today``, all of it where that is None; whether there was any."""
        due = [name for day in sorted(self.wheel) if today is None or day <= today for name in self.wheel[day]]
        for name in due:
            client = self.clients[name]
            numbers = sorted(client.held)  # what is left after a jump is an end of this list
            earliest = [client.held[n][0] for n in numbers]
            for i in range(len(earliest) - 2, -1, -1):
                earliest[i] = min(earliest[i], earliest[i + 1])
            at = 0
            while at < len(numbers) and (today is None or earliest[at] + self.patience <= today):
                missed, client.next = numbers[at] - client.next, numbers[at]
                self.apply(name, client, batch, missed)
                at = bisect_left(numbers, client.next)
            self.schedule(name, client)
        return bool(due)

    def take(self, name: str | None, n: int, row: tuple, batch: int) -> None:
        client = self.clients.setdefault(name, Client())
        if n < client.next or n in client.held:
            self.out.append((row[1], name, n, row[2], "rejected", batch, 0, None, None))
        else:
            client.held[n] = row
            if n == client.next:
                self.apply(name, client, batch)


def bucket_step(patience: int):
    """What the stream does with a bucket's rows of one micro-batch: the tick, then changes in order."""

    def frame(rows: list[tuple]) -> pd.DataFrame:
        columns = zip(*rows, strict=True) if rows else [[]] * len(NAMES)
        return pd.DataFrame(dict(zip(NAMES, columns, strict=True)))

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        changes, tick = [], None
        for rows in frames:
            again = rows[rows["kind"] == AGAIN]
            if len(again):  # known to repeat a number; they need no state and are spread over all buckets
                yield again[["change_id", "client", "n", "op"]].assign(status="rejected", batch=again["batch"], missed=0, city=None, cents=None)
            for batch, kind, today in rows.loc[rows["kind"] <= FLUSH, ["batch", "kind", "today"]].itertuples(index=False):
                tick = (today if kind == TICK else None, batch)
            changes += rows.loc[rows["kind"] == CHANGE, ["day", "change_id", "n", "client", "op", "city", "cents", "batch"]].itertuples(index=False, name=None)
        if tick is None and not changes:
            return
        bucket = Bucket(patience, *(state.get if state.exists else ()))
        changed = tick is not None and bucket.tick(*tick)
        none = lambda v: None if v is None or v != v else v  # noqa: E731  a missing text may come as NaN
        changes = [(day, change, n, *map(none, texts), batch) for day, change, n, *texts, batch in changes]
        touched = {}
        for day, change, n, client, op, city, cents, batch in sorted(changes, key=lambda r: (*r[:3], *((v is not None, v or "") for v in r[3:7]))):
            bucket.take(client, n, (day, change, op, city, cents), batch)
            touched[client] = None
        for client in touched:
            bucket.schedule(client, bucket.clients[client])
        if changed or touched:
            state.update(bucket.state())
        for at in range(0, len(bucket.out), ROWS_OUT):
            yield frame(bucket.out[at : at + ROWS_OUT])

    return run


def dense_numbers(pairs: DataFrame) -> DataFrame:
    """``client_id, seq`` (each pair once) with ``n``, the rank of ``seq`` among its client's; null comes first.

    Ranked within ranges of :data:`RANGE` numbers, to which the sizes of earlier ranges are added, so a
    client with very many numbers is ranked by many tasks.
    """
    ranged = pairs.withColumn("range", F.floor(F.col("seq") / RANGE))
    sizes = ranged.groupBy("client_id", "range").agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.partitionBy("client_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("client_id").alias("c"), F.col("range").alias("r"), F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("client_id", "range").orderBy("seq"))
    same = F.col("client_id").eqNullSafe(F.col("c")) & F.col("range").eqNullSafe(F.col("r"))
    return ranged.withColumn("inside", inside).join(sizes.hint("merge"), same).withColumn("n", F.col("before") + F.col("inside")).drop("range", "inside", "before", "c", "r")


class Feed:
    """A folder from which a stream reads one batch after another."""

    def __init__(self, spark: SparkSession, scratch: Scratch):
        self.spark, self.scratch = spark, scratch
        self.folder, self.staged = scratch.path("feed"), scratch.path("cut")

    def stage(self, rows: DataFrame) -> None:
        """Write rows by ``batch``, to be shown to the stream later."""
        rows.withColumn("cut", F.col("batch")).write.mode("append").options(**WRITING).partitionBy("cut").parquet(self.staged)

    def show(self, batch: int) -> None:
        """Move a batch into the folder, in one step."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path(self.folder))
        if not files.rename(path(f"{self.staged}/cut={batch}"), path(f"{self.folder}/batch-{batch}")):
            raise RuntimeError(f"batch {batch} could not be moved to {self.folder}")

    def read(self) -> DataFrame:
        return self.spark.readStream.schema(INPUT).option("recursiveFileLookup", "true").parquet(self.folder)


def apply_changes(changes: DataFrame, *, batches: int, patience: int) -> DataFrame:
    """Apply each client's changes in the order of their numbers, fed to a stream batch by batch.

    ``changes`` has ``change_id, client_id, seq, day, batch, op, city, cents``. ``n`` is the dense rank of
    ``seq`` among all of a client's rows; rows without ``day`` count for that and are not returned. A row is rejected if its
    number is held or passed, else held, and applied once all numbers before it are applied or given up.
    At the start of each batch, a client whose earliest held day plus ``patience`` is no later than the
    latest day of earlier batches jumps to its least held number, again while that is so; after the last
    batch every client does, as batch ``batches + 1``. I sets city and cents, U those that are not null, D
    neither; other operations change nothing.

    Returns per row ``change_id, client_id, status, batch, missed, city, cents, current`` and ``n``: where
    it was applied or rejected, numbers jumped right before it, the client's values afterwards, and
    whether it is the client's last applied row and no D.

    The batches are written to the shared folder. One streaming query, started anew for each on one
    checkpoint, keeps per bucket of clients a timing wheel (:class:`Bucket`). Every bucket gets a tick per
    batch, so waiting ends in empty batches too. Of rows with one number of one client only the first is a
    change that needs state; the others are dealt out over all buckets to be rejected, so that a client with
    very many rows is one bucket's work only as far as its numbers differ.

    Null ``client_id``: a client of its own. Null ``change_id``: as the least. Ties of day and ``change_id``: by the other columns.
    Repeated rows: the later ones are rejected. Null ``batch``: the last. Very long texts are carried whole. Empty
    table: no rows. Other columns are not read.
    """
    spark = changes.sparkSession
    scratch = Scratch(spark, "sequence")
    rows = changes.select("change_id", "client_id", "seq", F.col("day").cast("int").alias("day"), F.coalesce(F.col("batch").cast("int"), F.lit(batches)).alias("batch"), "op", "city", F.col("cents").cast("string").alias("cents"))
    order = F.struct("batch", "day", "change_id", "op", "city", "cents")
    pairs = rows.groupBy("client_id", "seq").agg(F.min(F.when(F.col("day").isNotNull(), order)).alias("first"))
    pairs = scratch.keep(dense_numbers(pairs), "numbers").select(F.col("client_id").alias("c"), F.col("seq").alias("s"), "n", "first")
    same = F.col("client_id").eqNullSafe(F.col("c")) & F.col("seq").eqNullSafe(F.col("s"))
    kind = F.when(order == F.col("first"), CHANGE).otherwise(AGAIN)
    fed = rows.filter("day IS NOT NULL").join(pairs.hint("merge"), same)
    fed = fed.select("batch", kind.alias("kind"), F.lit(0).alias("today"), F.col("client_id").cast("string").alias("client"), "n", "day", F.coalesce("change_id", F.lit(NO_ID)).alias("change_id"), "op", "city", "cents")
    feed = Feed(spark, scratch)
    feed.stage(fed.hint("rebalance", "batch"))

    staged = spark.read.schema(INPUT).option("recursiveFileLookup", "true").parquet(feed.staged)
    facts = {r["batch"]: r for r in staged.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.max("day").alias("day")).collect()}  # a row per batch
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(r["n"] for r in facts.values()) // PER_BUCKET))
    ticks, today = [], NEVER
    for batch in range(1, batches + 1):
        ticks.append(F.struct(F.lit(batch).alias("batch"), F.lit(TICK).alias("kind"), F.lit(today).alias("today")))
        today = max(today, facts[batch]["day"] if batch in facts else NEVER)
    ticks.append(F.struct(F.lit(batches + 1).alias("batch"), F.lit(FLUSH).alias("kind"), F.lit(0).alias("today")))
    every = spark.range(0, n_buckets, 1, -(-n_buckets // 100_000)).select(F.col("id").cast("string").alias("client"), F.explode(F.array(*ticks)).alias("t"))
    none = F.lit(None).cast("string")
    feed.stage(every.select("t.*", "client", F.lit(0).cast("long").alias("n"), F.lit(0).alias("day"), F.lit(0).cast("long").alias("change_id"), none.alias("op"), none.alias("city"), none.alias("cents")))

    spread = lambda name: F.pmod(F.xxhash64(name), F.lit(n_buckets)).cast("int")
    bucket = F.when(F.col("kind") <= FLUSH, F.expr("try_cast(client AS int)")).when(F.col("kind") == AGAIN, spread("change_id")).otherwise(spread("client"))
    for batch in range(1, batches + 2):
        feed.show(batch)
        stepped = feed.read().withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(bucket_step(patience), OUTPUT, STATE, "append", "NoTimeout")
        started = stepped.writeStream.format("parquet").options(**WRITING).option("path", scratch.path("out")).option("checkpointLocation", scratch.path("stream")).outputMode("append").trigger(availableNow=True).start()
        started.awaitTermination()
    return _with_current(spark.read.schema(OUTPUT).parquet(scratch.path("out")))


NEVER, NO_ID = -(1 << 31), -(1 << 63)


def _with_current(done: DataFrame) -> DataFrame:
    applied: Column = F.col("status") == "applied"
    last = done.filter(applied).groupBy("client").agg(F.max("n").alias("top")).withColumnRenamed("client", "c")
    same = F.col("client").eqNullSafe(F.col("c")) & (F.col("n") == F.col("top")) & applied
    out = done.join(last.hint("merge"), same, "left")  # by client and number, so that a client with many rows is spread
    current = F.col("top").isNotNull() & ~F.col("op").eqNullSafe("D")
    change_id = F.when(F.col("change_id") != NO_ID, F.col("change_id"))
    return out.select(change_id.alias("change_id"), F.col("client").cast("long").alias("client_id"), "status", "batch", "missed", "city", F.col("cents").cast("long").alias("cents"), current.alias("current"), "n")
