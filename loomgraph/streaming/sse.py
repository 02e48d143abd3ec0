"""Folders of event streams as a streaming source and sink.

A file is the raw stream of one request, still growing or not. ``register(spark)`` makes the format
``sse_files`` known; ``readStream.format("sse_files").load(path)`` gives ``request_id, at, event, data``
and a stream of ``request_id, seq, event, data`` can be written with ``writeStream.format("sse_files")``.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

NAME = "sse_files"
SCHEMA = "request_id string, at bigint, event string, data string"
_END = re.compile(rb"\r?\n\r?\n")
#: Bytes before a range that are read to find where its first block begins; more where that isn't enough.
BACK = 1 << 14
#: What the files of streams are called; a name's first part is the request's.
SUFFIX = ".sse"


def _open(path: str):
    """A file system and the path in it; any that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def parse_block(block: bytes) -> tuple[str, str] | None:
    """Event and data of a block; data lines join with line feeds. None without an event or data."""
    event, data = None, []
    for line in block.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
        if line.startswith("event: "):
            event = line[7:]
        elif line.startswith("data: "):
            data.append(line[6:])
    text = "\n".join(data)
    return (event, text) if event and text else None


def blocks(files, path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Position and bytes of the blocks whose end lies behind ``start`` and not behind ``end``.

    Ranges of a file that follow each other so give every block once, wherever they are cut.
    """
    back = BACK
    with files.open_input_file(path) as f:
        while True:
            low = max(0, start - back)
            f.seek(low)
            raw = f.read(end - low)
            ends = [low + m.end() for m in _END.finditer(raw)]
            before = [e for e in ends if e <= start]
            if before or low == 0:
                break
            back *= 8
    begin = before[-1] if before else 0
    for e in ends:
        if start < e <= end:
            yield begin, raw[begin - low : e - low].rstrip(b"\r\n")
            begin = e


@dataclass
class Range(InputPartition):
    """Bytes of one file."""

    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        super().__init__(path)
        self.path, self.start, self.end = path, start, end


class Reader(DataSourceStreamReader):
    """Offsets are how many bytes of each file are read.

    With the option ``archive``, for a folder that one query reads, a file whose last block is ``done`` or
    ``error`` is moved to ``_read`` once a batch that holds it is committed, so that only live files are
    listed and have an offset.
    """

    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.archive = options.get("archive", "false").lower() == "true"

    def _sizes(self) -> dict[str, int]:
        from pyarrow import fs

        files, root = _open(self.root)
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return {f.base_name: f.size for f in sorted(found, key=lambda f: f.base_name) if f.is_file and f.base_name.endswith(SUFFIX) and not f.base_name.startswith(("_", "."))}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": {}}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": self._sizes()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(f"{self.root}/{name}", start["files"].get(name, 0), size) for name, size in end["files"].items() if size > start["files"].get(name, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        files, path = _open(partition.path)
        name = path.rsplit("/", 1)[-1].removesuffix(SUFFIX)
        for at, raw in blocks(files, path, partition.start, partition.end):
            if found := parse_block(raw):
                yield name.split(".")[0], at, *found

    def commit(self, end: dict) -> None:
        """Put aside the files that have ended and are read to their end."""
        if not self.archive:
            return
        files, root = _open(self.root)
        now = self._sizes()
        for name, size in end["files"].items():
            if now.get(name) == size and (last := self._last_block(files, f"{root}/{name}", size)) and last[0] in ("done", "error"):
                files.create_dir(f"{root}/_read", recursive=True)
                files.move(f"{root}/{name}", f"{root}/_read/{name}")

    @staticmethod
    def _last_block(files, path: str, size: int) -> tuple[str, str] | None:
        try:
            found = [b for _, b in blocks(files, path, max(0, size - BACK), size)]
        except FileNotFoundError:
            return None
        return parse_block(found[-1]) if found else None


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class Writer(DataSourceStreamWriter):
    """Every partition of a batch is one file, shown under the batch's number when all of them are written; a batch that comes again changes nothing."""

    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")

    def write(self, iterator: Iterator) -> Written:
        files, root = _open(self.root)
        rows: dict[str, list] = {}
        for r in iterator:
            rows.setdefault(str(r.request_id), []).append((r.seq, r.event, r.data))
        if not rows:
            return Written(None)
        path = f"{root}/_staged/{uuid.uuid4().hex}"
        files.create_dir(f"{root}/_staged", recursive=True)
        with files.open_output_stream(path) as f:
            for name, events in sorted(rows.items()):
                f.write(json.dumps([name, sorted(events)], ensure_ascii=False).encode() + b"\n")
        return Written(path)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        from pyarrow import fs

        files, root = _open(self.root)
        done = f"{root}/_batches/{batchId}"
        again = files.get_file_info(done).type != fs.FileType.NotFound
        for n, m in enumerate(m for m in messages if m and m.path):
            if not again:
                for name, events in self._staged(files, m.path):
                    with files.open_output_stream(f"{root}/{name}.{batchId:06}-{n}{SUFFIX}") as f:
                        f.write("".join(f"event: {event}\ndata: {data}\n\n" for event, data in ((e, (d or "").replace("\n", "\ndata: ")) for _, e, d in events)).encode())
            files.delete_file(m.path)
        files.create_dir(f"{root}/_batches", recursive=True)
        with files.open_output_stream(done) as f:
            f.write(b"done\n")

    @staticmethod
    def _staged(files, path: str) -> Iterator[tuple[str, list]]:
        with files.open_input_stream(path) as f:
            for line in f.read().decode().splitlines():
                name, events = json.loads(line)
                yield name, events

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        files, _ = _open(self.root)
        for m in messages:
            if m and m.path:
                files.delete_file(m.path)


class EventFiles(DataSource):
    """The format ``sse_files``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:  # noqa: N802
        return Reader(self.options)

    def streamWriter(self, schema, overwrite: bool) -> Writer:  # noqa: N802
        return Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventFiles)
