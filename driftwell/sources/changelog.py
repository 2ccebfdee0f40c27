"""A change log as a streaming source whose offsets are log positions.

A log is a folder with a sub-folder for each append, named by its first and last position, and Parquet files inside.
``append`` writes one elsewhere and renames it, so readers see all of it or nothing, and positions only rise. The
source reads what lies between two positions and nothing else: a batch opens only the segments that overlap it, one
partition for each of their files, and skips row groups by their statistics.

``until`` ends the stream at a position, ``step`` is the most positions that one batch of a running stream takes in, and
``at`` is where the stream stands (``position`` reads it from a checkpoint), for the first step after a restart. Rows are
(lsn, xid, op, pk): a change of a transaction, or its end (COMMIT, ABORT) at the position where that took effect. Executors open
the files through pyarrow, so the log stands where that library can read: a shared file system, HDFS or an object store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .shared import file_system

SCHEMA = "lsn long, xid long, op string, pk long"
_ARROW = pa.schema([("lsn", pa.int64()), ("xid", pa.int64()), ("op", pa.string()), ("pk", pa.int64())])
FORMAT = "changelog"


def segments(place: str) -> list[tuple[int, int, str]]:
    """First position, last position and path of each segment, in order."""
    system, path = pafs.FileSystem.from_uri(place)
    found = system.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    names = [x for x in found if x.type == pafs.FileType.Directory and not x.base_name.startswith(("_", "."))]
    return sorted((*map(int, x.base_name.split("-")), x.path) for x in names)


def head(place: str) -> int:
    """The last position of the log, 0 where it is empty."""
    return max((last for _, last, _ in segments(place)), default=0)


def append(df: DataFrame, place: str) -> int:
    """Add rows behind the head, as one segment in order of position; the new head."""
    spark, ends = df.sparkSession, df.agg(F.min("lsn").alias("a"), F.max("lsn").alias("b")).first()
    before = head(place)
    if ends["a"] is None:
        return before
    if ends["a"] <= before:
        raise ValueError(f"position {ends['a']} is not behind the log's head {before}")
    pending, fs = file_system(spark, f"{place}/_pending-{uuid.uuid4().hex}")
    rows = df.select(*[F.col(c).cast(kind) for c, kind in (x.split() for x in SCHEMA.split(", "))])
    rows.repartitionByRange("lsn").sortWithinPartitions("lsn").write.parquet(str(pending.toString()))
    made, _ = file_system(spark, f"{place}/{ends['a']:020d}-{ends['b']:020d}")
    if not fs.rename(pending, made):
        raise OSError(f"{made.toString()} could not be put in place")
    return ends["b"]


def position(spark: SparkSession, checkpoint: str, done: bool = False) -> int | None:
    """The position up to which the stream of a checkpoint has planned its batches, or has ``done`` them; None if there is none."""
    folder, fs = file_system(spark, f"{checkpoint}/{'commits' if done else 'offsets'}")
    batches = [int(x.getPath().getName()) for x in fs.listStatus(folder) if x.getPath().getName().isdigit()] if fs.exists(folder) else []
    if not batches:
        return None
    lines = [r["value"] for r in spark.read.text(f"{checkpoint}/offsets/{max(batches)}").collect()]  # three short lines
    return next(json.loads(x)["position"] for x in reversed(lines) if '"position"' in x)


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.place, self.until, self.step = options["path"], int(options.get("until", 2**62)), int(options.get("step", 2**62))
        self.known = int(options.get("at", 0))

    def initialOffset(self) -> dict:
        return {"position": 0}

    def latestOffset(self) -> dict:
        return {"position": max(self.known, min(head(self.place), self.until, self.known + self.step))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        a, b = start["position"], end["position"]
        self.known = max(self.known, b)
        system, _ = pafs.FileSystem.from_uri(self.place)
        out = []
        for first, last, path in segments(self.place):
            if first <= b and last > a:
                files = system.get_file_info(pafs.FileSelector(path))
                out += [InputPartition((self.place, x.path, a, b)) for x in files if x.base_name.endswith(".parquet")]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        place, path, a, b = partition.value
        system, _ = pafs.FileSystem.from_uri(place)
        within = (ds.field("lsn") > a) & (ds.field("lsn") <= b)
        for batch in ds.dataset(path, schema=_ARROW, format="parquet", filesystem=system).to_batches(filter=within):
            if len(batch):
                yield batch


class ChangeLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _Reader(self.options)


def stream(spark: SparkSession, place: str, **options: int | None) -> DataFrame:
    """The log as a stream; ``until``, ``step`` and ``at`` as above."""
    spark.dataSource.register(ChangeLog)
    given = {k: str(v) for k, v in options.items() if v is not None}
    return spark.readStream.format(FORMAT).option("path", place).options(**given).load()
