"""Payloads as lossless images inside archives, and a Spark data source that reads the archives back.

A payload is stored as one RGB PNG of 8-bit samples, 64 pixels (192 bytes) a row. Tasks write members
into zip archives of bounded size in a shared folder; the commit lists them in a manifest. Reading
plans byte ranges over the archives of the manifest. A range reads the archive's directory, takes the
members that start inside it, and fetches each by its offset, with its own retries, so one bad read
repeats one member and not the range. Payloads stream as Arrow batches of bounded bytes.

Defined results: a null text counts as empty; the payload of an empty text is 192 spaces; a null id
stays null; equal texts give equal media whatever row or archive they are in; rows may repeat; an
empty table gives archives without members. Extra columns are not stored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

ROW = 192
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
ATTEMPTS = 4
MANIFEST = "_manifest.json"
PNG = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """Rows of 64 RGB pixels without row filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    body = np.zeros((len(rows), ROW + 1), np.uint8)
    body[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body.tobytes(), 3)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that to_png() wrote; raises on any damage."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, data, height = 8, [], 0
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("bad chunk")
        if kind == b"IHDR":
            height = struct.unpack_from(">I", body, 4)[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, ROW + 1)
    return rows[:, 1:].tobytes()


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8")
    return raw + b" " * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw)), len(raw)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ArchiveDone(WriterCommitMessage):
    def __init__(self, archives: list[tuple[str, int]]):
        self.archives = archives


class ArchiveWriter(DataSourceArrowWriter):
    """Each task fills archives of its own; only those that the commit lists are ever read."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> ArchiveDone:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        done, out, archive, name = [], None, None, ""

        def close() -> None:
            archive.close()
            size = out.tell()
            out.close()
            done.append((name, size))

        for batch in iterator:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    out = store.open_output_stream(f"{root}/{name}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                payload, n = padded(text)
                member = f"{len(archive.filelist):08d}_{'null' if doc_id is None else doc_id}_{n}.png"
                archive.writestr(zipfile.ZipInfo(member), to_png(payload))
                if out.tell() >= ARCHIVE_BYTES:
                    close()
                    archive = None
        if archive is not None:
            close()
        return ArchiveDone(done)

    def commit(self, messages) -> None:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        listed = sorted(a for m in messages if m is not None for a in m.archives)
        with store.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages) -> None:
        """Archives that no manifest lists are never read."""


class Range(InputPartition):
    def __init__(self, archive: str, start: int, stop: int):
        self.archive, self.start, self.stop = archive, start, stop


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Range]:
        store, root = _open(self.path)
        with store.open_input_stream(f"{root}/{MANIFEST}") as listed:
            archives = json.loads(listed.read())
        step = self.range_bytes
        return [Range(name, at, at + step) for name, size in archives for at in range(0, size, step)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        store, root = _open(self.path)
        path = f"{root}/{partition.archive}"
        with store.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
            members = [m for m in archive.infolist() if partition.start <= m.header_offset < partition.stop]
        held, size = [], 0
        with store.open_input_file(path) as file:
            for member in sorted(members, key=lambda m: m.header_offset):
                held.append((member, media := self._member(store, path, file, member)))
                size += len(media)
                if size >= BATCH_BYTES:
                    yield self._batch(partition.archive, held)
                    held, size = [], 0
        if held:
            yield self._batch(partition.archive, held)

    @staticmethod
    def _member(store: fs.FileSystem, path: str, file, member: zipfile.ZipInfo) -> bytes:
        """One member by its offset; a failed read opens the archive anew for this member alone."""
        for attempt in range(ATTEMPTS):
            try:
                source = file if attempt == 0 else store.open_input_file(path)
                head = source.read_at(30, member.header_offset)
                if head[:4] != b"PK\x03\x04":
                    raise OSError(f"no member at {member.header_offset}")
                skip = sum(struct.unpack_from("<HH", head, 26))
                media = source.read_at(member.file_size, member.header_offset + 30 + skip)
                if len(media) != member.file_size or zlib.crc32(media) != member.CRC:
                    raise OSError(f"damaged member at {member.header_offset}")
                return media
            except (OSError, struct.error):
                if attempt == ATTEMPTS - 1:
                    raise
                time.sleep(0.1 * 2**attempt)
        raise AssertionError

    @staticmethod
    def _batch(archive: str, held: list[tuple[zipfile.ZipInfo, bytes]]) -> pa.RecordBatch:
        parts = [m.filename[:-4].split("_") for m, _ in held]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([None if p[1] == "null" else int(p[1]) for p in parts], pa.int64()),
                pa.array([int(p[2]) for p in parts], pa.int64()),
                pa.array([archive] * len(held), pa.string()),
                pa.array([m.header_offset for m, _ in held], pa.int64()),
                pa.array([media for _, media in held], pa.binary()),
            ],
            names=["doc_id", "n_bytes", "archive", "member_offset", "media"],
        )


class MediaArchive(DataSource):
    """Format "media_archive": write (doc_id, text) rows, read (doc_id, n_bytes, archive, member_offset, media)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, archive string, member_offset long, media binary"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def write_archives(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    df.sparkSession.dataSource.register(MediaArchive)
    df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).write.format("media_archive").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("rangeBytes", str(range_bytes)).load(path)


def features(payload: bytes) -> str:
    """Size, mean and spread of the three channels, and byte entropy, as one string."""
    samples = np.frombuffer(payload, np.uint8)
    share = np.bincount(samples, minlength=256) / len(samples)
    used = share[share > 0]
    pixels = samples.reshape(-1, 3)
    numbers = [*pixels.mean(0), *pixels.std(0), float(-(used * np.log2(used)).sum())]
    return f"{ROW // 3}x{len(samples) // ROW};" + ";".join(f"{x:.4f}" for x in numbers)


def media_features(media: DataFrame) -> DataFrame:
    """Decode each medium and describe its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            out = []
            for stored in batch.column(at["media"]).to_pylist():
                payload = from_png(stored)
                digest = hashlib.sha256(payload).hexdigest()
                out.append((len(payload), digest, zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), features(payload)))
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(at["doc_id"]), batch.column(at["n_bytes"]), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return media.mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
