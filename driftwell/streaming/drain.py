"""Drains of a change log: bounded ones, which take in all up to a position and stop, and one that runs on.

Both are Structured Streaming queries over ``sources.changelog`` whose checkpoint holds the position and the open
transactions (``transactions``). A batch reads only what lies between two positions. It gives the changes of the transactions
that committed in it to a sink: ``kept`` writes them into a folder of the batch's own, ``into_tree`` brings a kept hash tree up to
them. A batch that is repeated after a failure gives the same rows again, and both sinks are exact then: the
folder is overwritten with the same, and the tree's version knows the batch it holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import changelog, trees
from ..sources.nodes import Table
from ..sources.shared import file_system
from .transactions import FIELDS, OVERDUE, committed

Sink = Callable[[DataFrame, int], None]


def kept(out: str) -> Sink:
    """Each batch in a folder of its own, written again when repeated."""
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")


def _read(spark: SparkSession, out: str) -> DataFrame:
    path, fs = file_system(spark, out)
    return spark.read.schema(f"{FIELDS}, batch long").parquet(out) if fs.exists(path) else spark.createDataFrame([], f"{FIELDS}, batch long")


def delivered(spark: SparkSession, out: str) -> DataFrame:
    """What ``kept`` has written: the changes with their commits and batches."""
    return _read(spark, out).where(F.col("op") != OVERDUE)


def overdue(spark: SparkSession, out: str) -> DataFrame:
    """xid and first position of the transactions that were reported as open for too long."""
    return _read(spark, out).where(F.col("op") == OVERDUE).groupBy("xid").agg(F.min("lsn").alias("lsn"))


def into_tree(place: str, frame: Callable[[], DataFrame], table: Table, rebalance: bool = False) -> Sink:
    """Brings the kept tree at ``place`` up to each batch: leaves with changes are hashed from ``frame``, the table as it is
    now, large ones are split. The version that this writes names the batch, so that a repeated one
    changes nothing. Rows may be newer than the batch: their own changes follow and hash the same rows again."""
    (key,) = table.key

    def sink(df: DataFrame, batch: int) -> None:
        tree = trees.open_tree(df.sparkSession, place)
        if tree.about.get("batch", -1) < batch:
            changes = df.where(F.col("op") != OVERDUE).select("op", F.col("pk").alias(key))
            trees.update(tree, frame(), table, changes, rebalance, batch=batch)

    return sink


def _started(spark: SparkSession, log: str, sink: Sink, checkpoint: str, late: int | None, trigger: dict, **options: int | None) -> StreamingQuery:
    rows = committed(changelog.stream(spark, log, at=changelog.position(spark, checkpoint), **options), late)
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def bounded(spark: SparkSession, log: str, sink: Sink, checkpoint: str, target: int | None = None, late: int | None = None) -> int:
    """Take in all up to ``target``, by default the head as it is now, and return it. Transactions that are open there stay in
    the checkpoint for the next drain. A target that the log has not reached, and a drain that fails, are
    errors, never a part of the result; one that has been passed before only finishes what had been begun."""
    head = changelog.head(log)
    target = head if target is None else target
    if target > head:
        raise ValueError(f"the log ends at {head}, before the target {target}")
    target = max(target, changelog.position(spark, checkpoint) or 0)
    done, before = changelog.position(spark, checkpoint, True) or 0, None
    while done != target:  # a run that finds a planned batch takes in that one only
        if done == before:
            raise RuntimeError(f"the drain stopped at {done}, before its target {target}")
        query = _started(spark, log, sink, checkpoint, late, {"availableNow": True}, until=target)
        try:
            query.awaitTermination()
        except StreamingQueryException as error:
            raise RuntimeError("the drain stopped before its target") from error
        before, done = done, changelog.position(spark, checkpoint, True) or 0
    return target


def listen(spark: SparkSession, log: str, sink: Sink, checkpoint: str, every: str = "10 seconds", step: int | None = None, late: int | None = None) -> StreamingQuery:
    """Run on; a batch takes in at most ``step`` positions."""
    return _started(spark, log, sink, checkpoint, late, {"processingTime": every}, step=step)


