"""Samples of WAV files as rows, and recordings written as WAV files.

``wav`` is a data source for ``spark.read.format`` and ``DataFrame.write.format``. A read is split by bytes: each file is cut into
ranges of ``splitBytes``, and the task of a range gives the frames that begin in it, so that one recording of any length
is read by many tasks. Headers are parsed by the tasks, of which each reads only the header and its own range, so the
driver lists files and opens none. Paths are opened by pyarrow's file systems (local, HDFS, S3 and others by their
scheme); where only Spark reaches a store, ``decoded`` takes the bytes of whole files, as ``binaryFile`` reads them.

Samples are scaled to [-1, 1): 8 bits unsigned, 16, 24 and 32 bits signed, 32 and 64 bits of floating point. Files that aren't
WAV, are compressed or break off inside their header fail the read; a data chunk that breaks off gives the whole frames that are
there, and an empty one gives no rows.
"""

from __future__ import annotations

import struct
import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# workers get these classes by value, so they needn't have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLIT_BYTES = 32 << 20
#: Frames that a task holds decoded at a time.
FRAMES = 1 << 16
SAMPLES = "file string, idx long, rate int, channel int, value float"
MONO = "file string, idx long, rate int, value float"
_PCM, _FLOAT, _EXTENSIBLE = 1, 3, 0xFFFE
_OPEN = 0xFFFFFFFF


@dataclass(frozen=True)
class Header:
    """What a recording's header says: ``start`` and ``end`` are the bytes of its frames."""

    kind: int
    channels: int
    rate: int
    bits: int
    start: int
    end: int

    @property
    def frame(self) -> int:
        """Bytes of a frame, one sample for each channel."""
        return self.channels * self.bits // 8

    @property
    def frames(self) -> int:
        return max(0, self.end - self.start) // self.frame


def header(read: Callable[[int, int], bytes], size: int) -> Header:
    """The header of a file of ``size`` bytes; ``read(at, n)`` gives up to n bytes from a place on."""
    top = read(0, 12)
    if len(top) < 12 or top[:4] not in (b"RIFF", b"RF64") or top[8:] != b"WAVE":
        raise ValueError("not a WAV file")
    at, found, large = 12, None, None
    while True:
        head = read(at, 8)
        if len(head) < 8:
            raise ValueError("a WAV file without data")
        name, length = head[:4], struct.unpack("<I", head[4:])[0]
        body = at + 8
        if name == b"ds64":
            large = struct.unpack("<Q", read(body + 8, 8))[0]
        elif name == b"fmt ":
            fields = read(body, min(length, 40))
            if len(fields) < 16:
                raise ValueError("a WAV file's format is cut short")
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", fields[:16])
            if kind == _EXTENSIBLE and len(fields) >= 26:
                kind = struct.unpack("<H", fields[24:26])[0]
            if (kind, bits) not in _DECODERS or not channels or not rate:
                raise ValueError(f"WAV format {kind} of {bits} bits and {channels} channels can't be read")
            found = kind, channels, rate, bits
        elif name == b"data":
            if found is None:
                raise ValueError("a WAV file's data come before its format")
            # recorders that were stopped leave the length open or too large
            length = large if length == _OPEN and large is not None else length
            return Header(*found, body, min(size, body + length))
        at = body + length + length % 2


def _unsigned(raw: bytes) -> np.ndarray:
    return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128


def _three_bytes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
    return ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / 2**23


_DECODERS = {
    (_PCM, 8): _unsigned,
    (_PCM, 16): lambda raw: np.frombuffer(raw, "<i2").astype(np.float32) / 2**15,
    (_PCM, 24): _three_bytes,
    (_PCM, 32): lambda raw: (np.frombuffer(raw, "<i4").astype(np.float64) / 2**31).astype(np.float32),
    (_FLOAT, 32): lambda raw: np.frombuffer(raw, "<f4").astype(np.float32),
    (_FLOAT, 64): lambda raw: np.frombuffer(raw, "<f8").astype(np.float32),
}


def frames_between(h: Header, first: int, last: int) -> tuple[int, int]:
    """The frames, from and to, that begin in the bytes [first, last) of a file."""
    place = lambda byte: min(h.frames, max(0, -(-(byte - h.start) // h.frame)))
    return place(first), place(last)


def batches(file: str, h: Header, read: Callable[[int, int], bytes], a: int, b: int, mono: bool) -> Iterator[pa.RecordBatch]:
    """The rows of the frames [a, b), some at a time."""
    for at in range(a, b, FRAMES):
        n = min(FRAMES, b - at)
        values = _DECODERS[h.kind, h.bits](read(h.start + at * h.frame, n * h.frame)).reshape(n, h.channels)
        idx = np.arange(at, at + n, dtype=np.int64)
        if mono:
            columns = {"idx": idx, "rate": np.full(n, h.rate, np.int32), "value": values.mean(axis=1, dtype=np.float64).astype(np.float32)}
        else:
            many = n * h.channels
            columns = {"idx": np.repeat(idx, h.channels), "rate": np.full(many, h.rate, np.int32), "channel": np.tile(np.arange(h.channels, dtype=np.int32), n), "value": values.reshape(-1)}
        yield pa.RecordBatch.from_arrays([pa.array([file] * len(columns["idx"]), pa.string()), *map(pa.array, columns.values())], names=["file", *columns])


def _true(options, name: str) -> bool:
    return str(options.get(name, "false")).lower() == "true"


def _file_system(path: str):
    from pyarrow import fs

    if path.startswith("file:"):  # Hadoop's form, with one slash or three
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _reader(f) -> Callable[[int, int], bytes]:
    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    return read


class Range(InputPartition):
    """Bytes [first, last) of a file of ``size`` bytes."""

    def __init__(self, path: str, size: int, first: int, last: int):
        super().__init__((path, size, first, last))


class WavReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.mono, self.split = options["path"], _true(options, "mono"), int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, path = _file_system(self.path)
        info = store.get_file_info(path)
        found = store.get_file_info(fs.FileSelector(path, recursive=True)) if info.type == fs.FileType.Directory else [info]
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(path) :].split("/"))
        files = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and (x.path == path or x.path.lower().endswith(".wav") and not hidden(x.path)))
        return [Range(p, size, a, min(size, a + self.split)) for p, size in files for a in range(0, size, self.split)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file
            return
        path, size, first, last = partition.value
        with _file_system(self.path)[0].open_input_file(path) as f:
            read = _reader(f)
            h = header(read, size)
            yield from batches(path.rsplit("/", 1)[-1], h, read, *frames_between(h, first, last), self.mono)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WavWriter(DataSourceArrowWriter):
    """Rows (file, value) that stand together by file and in order become 16-bit files of one channel each.

    Tasks write into a folder of their own run; only a job that ends well moves its files to their place, so that a failed or repeated task leaves nothing.
    """

    def __init__(self, options, overwrite: bool):
        self.path, self.rate, self.overwrite = options["path"], int(options.get("rate", 44_100)), overwrite
        self.run = f"_run-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = _file_system(self.path)
        folder, names = f"{path}/{self.run}/{uuid.uuid4().hex}", []
        store.create_dir(folder, recursive=True)
        name, held = None, []

        def close() -> None:
            if name is not None:
                data = b"".join(held)
                with store.open_output_stream(f"{folder}/{name}") as out:
                    out.write(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, _PCM, 1, self.rate, 2 * self.rate, 2, 16, b"data", len(data)))
                    out.write(data)
                names.append(f"{folder}/{name}")

        for batch in iterator:
            files = np.array(batch.column("file").to_pylist(), object)
            scaled = np.rint(np.nan_to_num(batch.column("value").to_numpy(zero_copy_only=False).astype(np.float64)) * 2**15)
            raw = np.clip(scaled, -(2**15), 2**15 - 1).astype("<i2")
            cuts = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(files)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b and files[a] != name:
                    close()
                    name, held = str(files[a]), []
                held.append(raw[a:b].tobytes())
        close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _file_system(self.path)
        if self.overwrite:
            from pyarrow import fs

            for old in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if old.type == fs.FileType.File and old.path.lower().endswith(".wav"):
                    store.delete_file(old.path)
        for m in messages:
            for name in m.names if m else ():
                store.move(name, f"{path}/{name.rsplit('/', 1)[-1]}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, path = _file_system(self.path)
        if store.get_file_info(f"{path}/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/{self.run}")


class WavSource(DataSource):
    """Options: ``path`` (a file or a folder), ``splitBytes``, ``mono`` (channels averaged, one row a frame); to write, ``rate``."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return MONO if _true(self.options, "mono") else SAMPLES

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)

    def writer(self, schema, overwrite: bool) -> WavWriter:
        return WavWriter(self.options, overwrite)


def samples(spark: SparkSession, path: str, mono: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, idx, rate, channel, value) of the WAV files at a path, with ``mono`` (file, idx, rate, value)."""
    spark.dataSource.register(WavSource)
    return spark.read.format("wav").option("mono", str(mono).lower()).option("splitBytes", split_bytes).load(path)


def decoded(files: DataFrame, mono: bool = False, path: str = "path", content: str = "content") -> DataFrame:
    """The same of rows that hold whole files, such as ``binaryFile`` gives; a task holds a file's bytes and some of its rows."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for file, raw in zip(table.column(0).to_pylist(), table.column(1), strict=True):
                raw = memoryview(raw.as_buffer())
                read = lambda at, n, raw=raw: bytes(raw[at : at + n])
                h = header(read, len(raw))
                yield from batches(file.rsplit("/", 1)[-1], h, read, 0, h.frames, mono)

    return files.where(F.col(content).isNotNull()).select(F.coalesce(path, F.lit("")), content).mapInArrow(run, MONO if mono else SAMPLES)


def write_recordings(values: DataFrame, path: str, rate: int, length: int = 1 << 20, key: str = "asset", idx: str = "idx", value: str = "value") -> None:
    """Series as 16-bit files named ``<key>-<number>.wav`` of ``length`` samples at most, so that a long series is written by many tasks. Values are in [-1, 1]; others are cut."""
    values.sparkSession.dataSource.register(WavSource)
    part = F.floor(F.col(idx) / length).cast("long")
    d = values.select(F.format_string("%s-%06d.wav", F.col(key).cast("string"), part).alias("file"), F.col(idx).cast("long").alias("idx"), F.col(value).cast("double").alias("value"))
    d = d.repartition("file").sortWithinPartitions("file", "idx").select("file", "value")
    d.write.format("wav").option("rate", rate).mode("append").save(path)


def continued(samples: DataFrame, length: int = 1 << 20) -> DataFrame:
    """(asset, idx, rate, value): files of ``write_recordings`` as the series they were cut from."""
    number = F.regexp_extract("file", r"-(\d+)\.wav$", 1).cast("long")
    return samples.select(F.regexp_extract("file", r"^(.*)-\d+\.wav$", 1).alias("asset"), (number * length + F.col("idx")).alias("idx"), "rate", "value")
