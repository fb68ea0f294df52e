"""A topic without an outside connector: an append-only log of (value) in files, as a data source for batches and streams.

Tasks write segments (Parquet files of their own); a commit lists them in one log entry, which appears by one rename, so
that readers see all of a batch or nothing. Offsets of the stream are entry numbers; every row has a number of its own, as
well. An entry remembers the last batch of each named writer: a batch that a writer repeats after a failure is not
committed twice. Segments that no entry lists (of tasks that failed) are never read.

The folder must be one that driver and executors share, and that pyarrow can open. Writers on a local or mounted folder
may commit at once; elsewhere one driver at a time may.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from tallyhire.sources.shipping import ship

FORMAT = "portal_topic"
ROWS = pa.schema([("value", pa.string()), ("topic_offset", pa.int64())])


class Log:
    """The entries of a topic, numbered from 0. An entry: first row number, files with their rows, last batch by writer."""

    def __init__(self, path: str) -> None:
        self.fs, self.path = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))

    def file(self, number: int) -> str:
        return f"{self.path}/log/{number:020d}.json"

    def exists(self, number: int) -> bool:
        return self.fs.get_file_info(self.file(number)).type == fs.FileType.File

    def end(self) -> int:
        """The number of entries. Entries have no gaps, so doubling steps and halving find it without a listing."""
        if not self.exists(0):
            return 0
        low, high = 0, 1  # low exists
        while self.exists(high):
            low, high = high, 2 * high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.exists(middle) else (low, middle)
        return high

    def entry(self, number: int) -> dict[str, Any]:
        with self.fs.open_input_stream(self.file(number)) as f:
            return json.loads(f.read())

    def write_segment(self, batches: Iterator[pa.RecordBatch]) -> Segment:
        name, rows = f"{uuid.uuid4().hex}.parquet", 0
        self.fs.create_dir(f"{self.path}/segments", recursive=True)
        with pq.ParquetWriter(f"{self.path}/segments/{name}", ROWS.empty_table().select(["value"]).schema, filesystem=self.fs) as out:
            for batch in batches:
                out.write_batch(pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("value")).cast(pa.string())], ["value"]))
                rows += batch.num_rows
        return Segment(name, rows)

    def append(self, segments: Sequence[Segment], writer: str | None = None, batch: int | None = None) -> bool:
        """Adds an entry, unless the writer has committed this batch or a later one before."""
        self.fs.create_dir(f"{self.path}/log", recursive=True)
        while True:
            number = self.end()
            last = self.entry(number - 1) if number else {"first": 0, "files": [], "batches": {}}
            batches = dict(last["batches"])
            if writer is not None:
                if batches.get(writer, -1) >= batch:
                    return False
                batches[writer] = batch
            entry = {"first": last["first"] + sum(n for _, n in last["files"]), "files": [[s.name, s.rows] for s in segments if s.rows], "batches": batches}
            waiting = f"{self.path}/log/.{uuid.uuid4().hex}"
            with self.fs.open_output_stream(waiting) as f:
                f.write(json.dumps(entry).encode())
            try:
                if isinstance(self.fs, fs.LocalFileSystem):
                    os.link(waiting, self.file(number))  # fails where another writer was first
                    os.unlink(waiting)
                else:
                    self.fs.move(waiting, self.file(number))
                return True
            except FileExistsError:
                os.unlink(waiting)

    def partitions(self, start: int, end: int) -> list[Piece]:
        out = []
        for number in range(start, end):
            entry = self.entry(number)
            first = entry["first"]
            for name, rows in entry["files"]:
                out.append(Piece(name, first))
                first += rows
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        at = piece.first
        with self.fs.open_input_file(f"{self.path}/segments/{piece.name}") as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=10_000):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(range(at, at + batch.num_rows), pa.int64())], schema=ROWS)
                at += batch.num_rows


@dataclass
class Segment(WriterCommitMessage):
    name: str
    rows: int


class Piece(InputPartition):
    """A segment and the number of its first row."""

    def __init__(self, name: str, first: int) -> None:
        self.name, self.first = name, first


class TopicReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Piece]:
        log = Log(self.path)
        return log.partitions(0, log.end()) or [Piece("", 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return Log(self.path).read(partition) if partition.name else iter([])


class TopicStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, earliest: bool) -> None:
        self.path, self.earliest = path, earliest

    def initialOffset(self) -> dict:
        return {"entry": 0 if self.earliest else Log(self.path).end()}

    def latestOffset(self) -> dict:
        return {"entry": Log(self.path).end()}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return Log(self.path).partitions(start["entry"], end["entry"])

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return Log(self.path).read(partition)

    def commit(self, end: dict) -> None:
        pass  # entries stay; the checkpoint knows what was read

    def stop(self) -> None:
        pass


class TopicWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Segment:
        return Log(self.path).write_segment(iterator)

    def commit(self, messages: list[Segment | None]) -> None:
        Log(self.path).append([m for m in messages if m is not None])

    def abort(self, messages: list[Segment | None]) -> None:
        pass  # what no entry lists is never read


class TopicStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, writer: str) -> None:
        self.path, self.writer = path, writer

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Segment:
        return Log(self.path).write_segment(iterator)

    def commit(self, messages: list[Segment | None], batchId: int) -> None:
        Log(self.path).append([m for m in messages if m is not None], self.writer, batchId)

    def abort(self, messages: list[Segment | None], batchId: int) -> None:
        pass


class TopicSource(DataSource):
    """Options: path; startingOffsets 'latest' (default, as the portal's mail service begins) or 'earliest'; writer, the name of a stream that writes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string, topic_offset long"

    def reader(self, schema: StructType) -> TopicReader:
        return TopicReader(self.options["path"])

    def streamReader(self, schema: StructType) -> TopicStreamReader:
        starting = self.options.get("startingOffsets", "latest")
        if starting not in ("latest", "earliest"):
            raise ValueError(f"startingOffsets must be latest or earliest, not {starting}")
        return TopicStreamReader(self.options["path"], starting == "earliest")

    def writer(self, schema: StructType, overwrite: bool) -> TopicWriter:
        if overwrite:
            raise ValueError("a topic is only appended to")
        return TopicWriter(self.options["path"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> TopicStreamWriter:
        if not self.options.get("writer"):
            raise ValueError("a stream needs the option writer, by which batches that are repeated are known")
        return TopicStreamWriter(self.options["path"], self.options["writer"])


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(TopicSource)


def publish(events: DataFrame, path: str) -> None:
    """Appends events (value) to a topic, all of them or none."""
    register(events.sparkSession)
    events.select("value").write.format(FORMAT).mode("append").save(path)


def publish_stream(events: DataFrame, path: str, writer: str, checkpoint: str) -> DataStreamWriter:
    """Appends a stream's events; each batch once. writer: a name that the stream keeps over restarts."""
    register(events.sparkSession)
    return events.select("value").writeStream.format(FORMAT).option("writer", writer).option("checkpointLocation", checkpoint).option("path", path).outputMode("append")


def read_topic(spark: SparkSession, path: str) -> DataFrame:
    """(value, topic_offset) of all that a topic holds now."""
    register(spark)
    return spark.read.format(FORMAT).load(path)


def subscribe(spark: SparkSession, path: str, starting: str = "latest") -> DataFrame:
    """A stream of (value, topic_offset) from the topic's end or its beginning on."""
    register(spark)
    return spark.readStream.format(FORMAT).option("startingOffsets", starting).load(path)
