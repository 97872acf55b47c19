"""Media columns: payloads in archive directories, read by a Spark data source.

``media_archive`` is a Python data source over a directory of uncompressed
``.zip`` archives. Writing: each task streams its Arrow batches into one
archive after another, each of about ``archiveBytes``, and a commit lists its
archives by name, so a retried task leaves nothing behind that is read, appends
add up and an overwrite replaces what was listed before. Reading: the plan lists archives and cuts each into byte ranges (a range
owns the members whose header starts in it), so planning costs a file listing,
never a member listing. A task reads the archive's own directory (bounded, as archives are), streams its
members as Arrow batches, and retries each member by itself from its offset.

The stored form of a text is an 8-bit grayscale PNG, 64 samples wide, one
sample per byte of the zero-padded UTF-8 payload.

Edge cases: null or empty text is one row of 64 zero bytes; repeated rows are
members of their own; null ids are kept; a member that cannot be read after
``retries`` attempts comes back with a null payload and an ``error``; an empty
table gives an empty archive directory and no rows.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import blocks, shared_dir, texts_of

WIDTH = 64
RANGE_BYTES = 16_000_000
#: An archive that has reached this size is closed, which bounds its directory.
ARCHIVE_BYTES = 64_000_000
BATCH_BYTES = 4_000_000
RETRIES = 3
_SCHEMA = "name string, offset long, payload binary, error string"
_LISTING = "_archives"
_PNG = b"\x89PNG\r\n\x1a\n"


# --- the stored form -------------------------------------------------------------------------------------


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(text: bytes) -> bytes:
    """The padded payload as grayscale rows; a private chunk keeps the unpadded length."""
    rows = max(1, -(-len(text) // WIDTH))
    samples = np.zeros((rows, WIDTH + 1), dtype=np.uint8)  # a zero before each row: no filter
    flat = np.zeros(rows * WIDTH, dtype=np.uint8)
    flat[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    samples[:, 1:] = flat.reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"leNg", struct.pack(">Q", len(text))) + _chunk(b"IDAT", zlib.compress(samples.tobytes(), 3)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> tuple[bytes, int]:
    """Payload and unpadded length; raises ``ValueError`` for anything that :func:`to_png` did not write."""
    if not data.startswith(_PNG):
        raise ValueError("not a PNG")
    at, found = len(_PNG), {}
    while at < len(data):
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged chunk {kind!r}")
        found[kind] = body
        at += 12 + size
    width, rows, depth, color, *_ = struct.unpack(">IIBBBBB", found[b"IHDR"])
    if (width, depth, color) != (WIDTH, 8, 0):
        raise ValueError("not 8-bit grayscale of the expected width")
    samples = np.frombuffer(zlib.decompress(found[b"IDAT"]), dtype=np.uint8).reshape(rows, WIDTH + 1)
    return samples[:, 1:].tobytes(), struct.unpack(">Q", found[b"leNg"])[0]


def features(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit average hash over 64 equal stretches."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    share = np.bincount(samples, minlength=256) / len(samples)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    edges = np.linspace(0, len(samples), 65).astype(np.int64)
    run = np.concatenate(([0], np.cumsum(samples, dtype=np.int64)))
    means = (run[edges[1:]] - run[edges[:-1]]) / np.diff(edges)
    bits = np.packbits(means > samples.mean()).tobytes().hex()
    return f"mean={samples.mean():.4f};std={samples.std():.4f};entropy={entropy:.4f};ahash={bits}"


# --- the data source -------------------------------------------------------------------------------------


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


@dataclass
class Range(InputPartition):
    """Members of one archive whose header starts in ``start:end``."""

    path: str
    size: int
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def _listings(fs: pafs.FileSystem, root: str) -> tuple[list[pafs.FileInfo], list[str], set[str]]:
    """All files of a directory, those of them that list archives, and the archives listed."""
    infos = fs.get_file_info(pafs.FileSelector(root))
    paths, names = [i.path for i in infos if i.base_name.startswith(_LISTING)], set()
    for path in paths:
        with fs.open_input_stream(path) as f:
            names |= set(f.read().decode().split())
    return infos, paths, names


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.retries = int(options.get("retries", RETRIES))

    def partitions(self) -> list[InputPartition]:
        fs, root = _open_fs(self.uri)
        infos, listings, names = _listings(fs, root)
        # A directory without a listing was not written by this data source: all its archives count.
        infos = [i for i in infos if (i.base_name in names if listings else i.base_name.endswith(".zip"))]
        found = [Range(i.path, i.size, a, min(a + self.range_bytes, i.size)) for i in infos for a in range(0, i.size, self.range_bytes)]
        return found or [Range("", 0, 0, 0)]

    def _member(self, fs: pafs.FileSystem, part: Range, info: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        """One stored member, checked by its CRC; each attempt opens the archive anew at the member's offset."""
        error = None
        for attempt in range(self.retries):
            try:
                with fs.open_input_file(part.path) as f:
                    f.seek(info.header_offset)
                    head = f.read(30)
                    signature, name_size, extra_size = struct.unpack("<4s22xHH", head)
                    if signature != b"PK\x03\x04" or info.compress_type != zipfile.ZIP_STORED:
                        raise ValueError("not a stored member")
                    f.seek(info.header_offset + 30 + name_size + extra_size)
                    payload = f.read(info.file_size)
                if zlib.crc32(payload) != info.CRC:
                    raise ValueError("CRC differs")
                return payload, None
            except (OSError, ValueError, struct.error) as e:
                error = f"{type(e).__name__}: {e}"
                time.sleep(0.05 * attempt)
        return None, error

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = _open_fs(self.uri)
        with fs.open_input_file(partition.path) as f, zipfile.ZipFile(f) as archive:
            members = [i for i in archive.infolist() if partition.start <= i.header_offset < partition.end]
        rows: list[tuple] = []
        held = 0
        for info in members:
            payload, error = self._member(fs, partition, info)
            rows.append((info.filename, info.header_offset, payload, error))
            held += info.file_size
            if held >= BATCH_BYTES:
                yield _rows_batch(rows)
                rows, held = [], 0
        if rows:
            yield _rows_batch(rows)


def _rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    name, offset, payload, error = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(name), pa.array(offset, pa.int64()), pa.array(payload, pa.binary()), pa.array(error, pa.string())], ["name", "offset", "payload", "error"])


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.uri, self.overwrite = options["path"], overwrite
        self.archive_bytes = int(options.get("archivebytes", ARCHIVE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _open_fs(self.uri)
        fs.create_dir(root, recursive=True)
        members = ((n.as_py(), p.as_buffer().to_pybytes()) for batch in iterator for n, p in zip(batch.column("name"), batch.column("payload")))
        names: list[str] = []
        member = next(members, None)
        while member:
            names.append(f"{uuid.uuid4().hex}.zip")  # of this attempt; only committed names are listed
            held = 0
            with fs.open_output_stream(f"{root}/{names[-1]}") as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True) as archive:
                while member and held < self.archive_bytes:
                    archive.writestr(zipfile.ZipInfo(member[0]), member[1])
                    held += len(member[1])
                    member = next(members, None)
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _open_fs(self.uri)
        fs.create_dir(root, recursive=True)
        _, before, replaced = _listings(fs, root)
        with fs.open_output_stream(f"{root}/{_LISTING}-{uuid.uuid4().hex}") as f:
            f.write("\n".join(sorted(n for m in messages if m for n in m.names)).encode())
        if self.overwrite:
            for path in [*before, *(f"{root}/{n}" for n in replaced)]:
                fs.delete_file(path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _open_fs(self.uri)
        for name in (n for m in messages if m for n in m.names):
            if fs.get_file_info(f"{root}/{name}").is_file:
                fs.delete_file(f"{root}/{name}")


class MediaArchive(DataSource):
    """``spark.read.format("media_archive")``; options ``path``, ``rangeBytes``, ``archiveBytes``, ``retries``; modes append and overwrite."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(dict(self.options), overwrite)


# --- the operator ----------------------------------------------------------------------------------------


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for block in blocks(batch.column(1)):
            own = ids[block.rows]
            names = [f"{'null' if k is None else k}.png" for k in own]
            payloads = [to_png(block.text(i)) for i in range(block.n)]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([None] * block.n, pa.int64()), pa.array(payloads, pa.binary()), pa.array([None] * block.n, pa.string())], ["name", "offset", "payload", "error"])


def store_media(docs: DataFrame, path: str | None = None, mode: str = "append", **options) -> str:
    """Write each text's stored form as a member ``<doc_id>.png``; returns the archive directory."""
    spark = docs.sparkSession
    spark.dataSource.register(MediaArchive)
    path = path or f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    texts_of(docs).mapInArrow(_store, _SCHEMA).write.format("media_archive").options(**options).mode(mode).save(path)
    return path


def read_media(spark: SparkSession, path: str, **options) -> DataFrame:
    """``name, offset, payload, error``: the members of all archives under ``path``."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(path)


_DESCRIBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for name, media in zip(batch.column("name").to_pylist(), batch.column("payload")):
            stem, data = name.split(".")[0], media.as_buffer().to_pybytes()
            payload, n_bytes = from_png(data)
            rows.append((None if stem == "null" else int(stem), n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), features(payload)))
        if rows:
            kinds = [pa.string() if c.endswith("string") else pa.int64() for c in _DESCRIBED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in _DESCRIBED.split(", ")])


def describe_media(media: DataFrame) -> DataFrame:
    """Digests and features of each readable member, from the bytes read back; unreadable members fail the job."""
    from pyspark.sql import functions as F

    checked = media.withColumn("payload", F.when(media["error"].isNull(), media["payload"]).otherwise(F.raise_error(F.concat_ws(": ", "name", "error")).cast("binary")))
    return checked.select("name", "payload").mapInArrow(_describe, _DESCRIBED)
