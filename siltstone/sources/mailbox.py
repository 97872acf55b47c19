"""Data source ``mailbox``: byte ranges of mailbox files, read by many tasks, messages streamed.

Lines that start with ``From `` separate messages and are dropped; what stands before the first one is a message too, and
empty messages vanish. A message belongs to the byte range in which its separator begins (the first one to the first
range), so a task that starts inside a file goes on to the next separator, and reads past the end of its range to finish
its last message. Memory holds one message and one read buffer.

``content=messages`` gives ``path, range_ix, at, offset, raw`` (``at`` counts a range's messages from 0), and
``content=digests`` one row per file: ``path, length, mailbox_ref, messages, starts``, from one streamed pass, as a
file's SHA-256 has no parts. ``starts`` has the number of messages before each range: a message's index is
``starts[range_ix] + at``, whatever the number of tasks. Files are told by their suffix in any case; no other file is opened.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SUFFIXES = ("mail", "mbox")
RANGE_BYTES = 64 << 20
_READ, _BATCH = 1 << 20, 8 << 20
_MARK = b"From "


def messages_in(read: Callable[[int], bytes], lo: int, hi: int) -> Iterator[tuple[int, bytes]]:
    """``offset, bytes`` of the messages whose separator begins in ``lo:hi``. ``read`` goes on from ``max(lo - 1, 0)``."""
    base = max(lo - 1, 0)  # file position of held[0]
    held, ended = bytearray(), False

    def more() -> bool:
        nonlocal ended
        part = b"" if ended else read(_READ)
        ended = ended or not part
        held.extend(part)
        return not ended

    def find(what: bytes, at: int) -> int:
        while True:
            found = held.find(what, at)
            if found >= 0:
                return found
            at = max(at, len(held) - len(what) + 1)
            if not more():
                return -1

    if lo:
        line = find(b"\n" + _MARK, 0)
        if line < 0:
            return
        at = line + 1
    else:
        while len(held) < len(_MARK) and more():
            pass
        at = 0
    while base + at < hi:
        start, body = at, at
        if held.startswith(_MARK, at):
            end = find(b"\n", at)
            if end < 0:
                return
            body = end + 1
        following = find(b"\n" + _MARK, max(body - 1, 0))
        end = len(held) if following < 0 else following + 1
        if end > body:
            yield base + start, bytes(held[body:end])
        if following < 0:
            return
        at = end
        if at > _BATCH:
            del held[:at]
            base, at = base + at, 0


@dataclass
class Range(InputPartition):
    path: str
    name: str
    length: int
    ix: int
    lo: int
    hi: int


def _file_system(uri: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system, the path in it, and what Spark writes before a path of it."""
    fs, path = pafs.FileSystem.from_uri(uri)
    prefix = "file:" if isinstance(fs, pafs.LocalFileSystem) else uri[: uri.index(path)] if path in uri else ""
    return fs, path, prefix


_MESSAGES = pa.schema([("path", pa.string()), ("range_ix", pa.int32()), ("at", pa.int64()), ("offset", pa.int64()), ("raw", pa.binary())])
_DIGESTS = pa.schema([("path", pa.string()), ("length", pa.int64()), ("mailbox_ref", pa.string()), ("messages", pa.int64()), ("starts", pa.list_(pa.int64()))])


class MailboxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.digests = options["path"], options.get("content", "messages") == "digests"
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.suffixes = tuple(f".{s}" for s in options.get("suffixes", ",".join(SUFFIXES)).lower().split(","))

    def partitions(self) -> list[InputPartition]:
        fs, root, prefix = _file_system(self.uri)
        found = fs.get_file_info(root)
        infos = [found] if found.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        mine = [i for i in infos if i.is_file and i.size and i.path.lower().endswith(self.suffixes)]
        step = max((i.size for i in mine), default=1) if self.digests else self.range_bytes
        return [Range(i.path, prefix + i.path, i.size, k, lo, min(lo + step, i.size)) for i in sorted(mine, key=lambda i: i.path) for k, lo in enumerate(range(0, i.size, step))]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, _, _ = _file_system(self.uri)
        with fs.open_input_file(partition.path) as f:
            yield from self._digest(f, partition) if self.digests else self._messages(f, partition)

    def _messages(self, f, part: Range) -> Iterator[pa.RecordBatch]:
        f.seek(max(part.lo - 1, 0))
        rows, size = [], 0
        for at, (offset, raw) in enumerate(messages_in(f.read, part.lo, part.hi)):
            rows.append((part.name, part.ix, at, offset, raw))
            size += len(raw)
            if size > _BATCH:
                yield _batch(rows, _MESSAGES)
                rows, size = [], 0
        if rows:
            yield _batch(rows, _MESSAGES)

    def _digest(self, f, part: Range) -> Iterator[pa.RecordBatch]:
        state = hashlib.sha256()

        def read(n: int) -> bytes:
            data = f.read(n)
            state.update(data)
            return data

        starts, count = [], 0
        for offset, _ in messages_in(read, 0, part.length):
            while len(starts) * self.range_bytes <= offset:
                starts.append(count)
            count += 1
        while read(_READ):  # a last separator without an end leaves nothing unread but this
            pass
        starts += [count] * (-(-part.length // self.range_bytes) - len(starts))
        yield _batch([(part.name, part.length, state.hexdigest(), count, starts)], _DIGESTS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


class Mailbox(DataSource):
    """``path`` (a URI, of a folder or a file), ``content``, ``rangeBytes``, ``suffixes``."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        if self.options.get("content", "messages") == "digests":
            return "path string, length long, mailbox_ref string, messages long, starts array<long>"
        return "path string, range_ix int, at long, offset long, raw binary"

    def reader(self, schema) -> DataSourceReader:
        return MailboxReader(dict(self.options))


def read_mailboxes(spark: SparkSession, path: str, content: str = "messages", range_bytes: int = RANGE_BYTES, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    spark.dataSource.register(Mailbox)
    uri = path if ":" in path else f"file://{path}"
    return spark.read.format("mailbox").options(path=uri, content=content, rangeBytes=range_bytes, suffixes=",".join(suffixes)).load()


def mailbox_messages(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, mailbox_ref, message_index, raw`` of all mailboxes below ``path``."""
    messages = read_mailboxes(spark, path, range_bytes=range_bytes)
    files = read_mailboxes(spark, path, "digests", range_bytes).select("path", "mailbox_ref", "starts")
    index = (F.get("starts", F.col("range_ix")) + F.col("at")).cast("int")
    return messages.join(files, "path").select("path", "mailbox_ref", index.alias("message_index"), "raw")
