"""WAV files as a Spark data source: ``spark.read.format("wav")`` and ``df.write.format("wav")``.

Reading lists ``*.wav`` below the path and gives one row per file: path, length, sampling_rate, channels, bits, num_samples (per
channel), error (null for good files), and with option ``content`` the samples' bytes. A task walks a file's chunks by seeking from one header to
the next, so it reads a few dozen bytes wherever the ``data`` chunk lies; metadata of any size before it is passed over. Files that
are no PCM or shorter than they say keep their path and get an error. Partitions hold ``filesPerPartition`` files (1024).

Writing takes columns id (the file's path below the root, without ``.wav``), sampling_rate, channels, bits, data (interleaved little-endian
samples) and perhaps comment (stored in front of the samples). A file is written under a hidden name and then moved, so a task that runs twice
leaves the same files; a ``_SUCCESS`` marker follows when all tasks are done. Repeated ids overwrite each other; null ids raise.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from typing import Any
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

HEADER = "path string, length long, sampling_rate int, channels int, bits int, num_samples long, error string"
PCM, EXTENSIBLE, RIFF_LIMIT = 1, 0xFFFE, (1 << 32) - 1
COLUMNS = ("id", "sampling_rate", "channels", "bits", "data")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(quote(path, safe="/:@%") if "://" in path else quote(path, safe="/:@"))


def chunks(f: Any, length: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, size) of each chunk behind the 12 bytes of the file's head."""
    at = 12
    while at + 8 <= length:
        f.seek(at)
        kind, size = struct.unpack("<4sI", f.read(8))
        yield kind, at + 8, size
        at += 8 + size + size % 2


def read_header(f: Any, length: int) -> tuple[int, int, int, int, int, int]:
    """(rate, channels, bits, samples per channel, start and size of the samples) of an open PCM file; ValueError says what is wrong.

    Files of over 4 GB (``RF64``) give the samples' size in their first chunk.
    """
    head = f.read(12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        raise ValueError("no WAVE file")
    form, long_size = None, None
    for kind, start, size in chunks(f, length):
        if kind == b"ds64":
            long_size = struct.unpack("<QQ", f.read(16))[1]
        elif kind == b"fmt ":
            body = f.read(min(size, 40))
            if len(body) < 16:
                raise ValueError("truncated")
            tag, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", body)
            tag = struct.unpack_from("<H", body, 24)[0] if tag == EXTENSIBLE and len(body) >= 26 else tag
            form = (tag, channels, rate, block, bits)
        elif kind == b"data":
            if form is None:
                raise ValueError("samples before their format")
            if form[0] != PCM or not form[1] or not form[2] or not form[3]:
                raise ValueError("no PCM")
            size = long_size if long_size is not None and size == RIFF_LIMIT else size
            if start + size > length:
                raise ValueError("truncated")
            return form[2], form[1], form[4], size // form[3], start, size
    raise ValueError("no samples")


def head_bytes(rate: int, channels: int, bits: int, size: int, comment: str | None = None) -> bytes:
    """What stands before the samples."""
    if size + 64 + 4 * len(comment or "") > RIFF_LIMIT:
        raise ValueError("samples of over 4 GB")
    block, extra = channels * bits // 8, b""
    if comment:
        text = comment.encode() + b"\0"
        text += b"\0" * (len(text) % 2)
        extra = struct.pack("<4sI4s4sI", b"LIST", 12 + len(text), b"INFO", b"ICMT", len(text)) + text
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, PCM, channels, rate, rate * block, block, bits)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + len(extra) + 8 + size + size % 2, b"WAVE") + form + extra + struct.pack("<4sI", b"data", size)


class Files(InputPartition):
    def __init__(self, paths: list[str], lengths: list[int]):
        super().__init__((paths, lengths))


class WavReader(DataSourceReader):
    def __init__(self, path: str, content: bool, per_partition: int):
        self.path, self.content, self.per_partition = path, content, per_partition

    def partitions(self) -> list[Files]:
        store, root = opened(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        files = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.endswith(".wav") and not any(p[:1] in "._" for p in x.path[len(root) :].split("/") if p))
        cuts = range(0, len(files), self.per_partition)
        return [Files(*map(list, zip(*files[i : i + self.per_partition]))) for i in cuts] or [Files([], [])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = opened(self.path)
        for path, length in zip(*partition.value):
            row: tuple = (None, None, None, None)
            error = data = None
            try:
                with store.open_input_file(path) as f:
                    *row, start, size = read_header(f, length)
                    if self.content:
                        f.seek(start)
                        data = f.read(size)
            except (ValueError, struct.error) as e:
                error = "truncated" if isinstance(e, struct.error) else str(e)
            yield (path, length, *row, error, data) if self.content else (path, length, *row, error)


class WavWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        missing = [c for c in COLUMNS if c not in schema.names]
        if missing:
            raise ValueError(f"a WAV file needs columns {', '.join(missing)}")
        self.path, self.comment = path.rstrip("/"), "comment" in schema.names
        store, root = opened(self.path)
        if overwrite and store.get_file_info(root).type == fs.FileType.Directory:
            store.delete_dir_contents(root)
        store.create_dir(root, recursive=True)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, root = opened(self.path)
        made = set()
        for row in iterator:
            if row["id"] is None:
                raise ValueError("a recording without an id")
            folder, _, name = f"{root}/{row['id']}".rpartition("/")
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            hidden = f"{folder}/._{uuid.uuid4().hex}"
            data = bytes(row["data"] or b"")
            with store.open_output_stream(hidden) as f:
                f.write(head_bytes(row["sampling_rate"], row["channels"], row["bits"], len(data), row["comment"] if self.comment else None))
                f.write(data + b"\0" * (len(data) % 2))
            store.move(hidden, f"{folder}/{name}.wav")
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = opened(self.path)
        with store.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files of finished tasks stay, without a marker; writing again replaces them."""


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return HEADER + ", data binary" * (self.options.get("content", "false").lower() == "true")

    def reader(self, schema: StructType) -> WavReader:
        return WavReader(self.options["path"], "data" in schema.names, int(self.options.get("filesPerPartition", 1024)))

    def writer(self, schema: StructType, overwrite: bool) -> WavWriter:
        return WavWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """``spark``, which now knows the format ``wav``."""
    spark.dataSource.register(WavSource)
    return spark
