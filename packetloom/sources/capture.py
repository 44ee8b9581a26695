"""Spark data source `capture`: packets of capture files, decoded in batches.

    spark.dataSource.register(CaptureSource)
    spark.read.format("capture").load("/captures/202401011400.pcap.gz")

One task reads one file as a stream (compressed captures cannot be split). Options: `path` (a file, a folder or a
pattern, local or a URI that pyarrow opens), `batch` (records in an Arrow batch), and `onError`: `fail` (default) fails the query on a
damaged container, `row` gives a last row that has only chunk_id and error, so that other files still count.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.decode import FACTS, decode
from .containers import CaptureError, Record, records

SCHEMA = (
    "chunk_id string, packet_index long, timestamp double, captured_frame_length long, original_frame_length long, "
    "ip_version int, protocol int, src_addr binary, src_ip string, src_port int, dst_addr binary, dst_ip string, dst_port int, "
    "ip_total_length long, transport_payload_length long, tcp_flags int, skip_reason string, error string"
)
_RECORD = {"chunk_id": pa.string(), "packet_index": pa.int64(), "timestamp": pa.float64(), "captured_frame_length": pa.int64(), "original_frame_length": pa.int64()}
_ARROW = pa.schema([*_RECORD.items(), *FACTS.items(), ("error", pa.string())])
BATCH = 8192


def chunk_of(path: str) -> str:
    """Name of a capture: its file's name up to the first dot."""
    return os.path.basename(path).split(".")[0]


def capture_files(path: str) -> list[str]:
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.Directory:
            found = system.get_file_info(fs.FileSelector(inner))
            return sorted(f"{path.rstrip('/')}/{x.base_name}" for x in found if x.type == fs.FileType.File)
        return [path]
    local = path.removeprefix("file://")
    if os.path.isdir(local):
        return sorted(x.path for x in os.scandir(local) if x.is_file() and not x.name.startswith((".", "_")))
    return sorted(glob.glob(local)) or [local]


def open_capture(path: str):
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return open(path.removeprefix("file://"), "rb")


def batch_of(chunk: str, found: list[Record]) -> pa.RecordBatch:
    index, time, frames, captured, original = zip(*found, strict=True)
    captured, original = np.array(captured, np.int64), np.array(original, np.int64)
    facts = decode(pa.array(frames, pa.binary()), captured, original)
    n = len(found)
    known = {"chunk_id": pa.array([chunk] * n), "packet_index": pa.array(index, pa.int64()), "timestamp": pa.array(time, pa.float64())}
    known |= {"captured_frame_length": pa.array(captured), "original_frame_length": pa.array(original), "error": pa.nulls(n, pa.string())}
    return pa.RecordBatch.from_arrays([(known | facts)[name] for name in _ARROW.names], schema=_ARROW)


def read_capture(path: str, size: int = BATCH, on_error: str = "fail") -> Iterator[pa.RecordBatch]:
    """Batches of one file. Records before the damage are given out in either mode."""
    chunk = chunk_of(path)
    try:
        with open_capture(path) as stream:
            rest = records(stream)
            while found := list(islice(rest, size)):
                yield batch_of(chunk, found)
    except CaptureError as error:
        if on_error != "row":
            raise
        row = {name: [None] for name in _ARROW.names} | {"chunk_id": [chunk], "error": [f"CaptureError: {error}"]}
        yield pa.RecordBatch.from_pydict(row, schema=_ARROW)


class _File(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, given: dict[str, str]):
        self.path, self.size, self.on_error = given["path"], int(given.get("batch", BATCH)), given.get("onerror", "fail").lower()
        if self.on_error not in ("fail", "row"):
            raise ValueError("onError is fail or row")

    def partitions(self) -> list[InputPartition]:
        return [_File(x) for x in capture_files(self.path)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from read_capture(partition.value, self.size, self.on_error)


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    """Packets of captures, decoded or with a skip reason."""
    spark.dataSource.register(CaptureSource)
    return spark.read.format("capture").option("onError", on_error).load(path)


def decoded(packets: DataFrame) -> DataFrame:
    return packets.where("skip_reason is null and error is null").drop("skip_reason", "error")


def skip_counts(packets: DataFrame) -> DataFrame:
    """(chunk_id, skip_reason, n)"""
    return packets.where("skip_reason is not null").groupBy("chunk_id", "skip_reason").agg(F.count("*").alias("n"))
