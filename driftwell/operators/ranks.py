"""Order over a whole table without a task that sees all of it.

Rows are range-partitioned by their key and written with the number of their partition. What crosses
partitions is a few numbers for each, so only these are summed in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

PART = "__part"


def in_parts(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` by ranges of ``order``, with the number of each row's range; equal keys are in one range."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def _of_parts(rows: DataFrame, *numbers: Column) -> dict[int, tuple]:
    """Numbers for each partition; there are as many as partitions."""
    return {r[0]: tuple(r)[1:] for r in rows.groupBy(PART).agg(*numbers).collect()}


def _beside(rows: DataFrame, schema: str, parts: list[tuple]) -> DataFrame:
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(parts, f"{PART} int, {schema}")), PART)


def ranked(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` with ``rank``, from 1 on, in the order of its unique key; and the number of its rows."""
    rows = in_parts(df, order)
    counts, before, n = _of_parts(rows, F.count("*")), [], 0
    for part in sorted(counts):
        before.append((part, n))
        n += counts[part][0]
    own = F.row_number().over(Window.partitionBy(PART).orderBy(*order))
    made = _beside(rows.withColumn("__own", own), "__before long", before)
    return made.withColumn("rank", F.col("__own") + F.col("__before")).drop(PART, "__own", "__before"), n


def running(df: DataFrame, at: str, value: str) -> DataFrame:
    """``df`` (unique ``at``) with ``total``, the sum of ``value`` up to each row, and ``next``, the following ``at``."""
    rows = in_parts(df, [at])
    sums, edges, total = _of_parts(rows, F.sum(value), F.min(at)), [], 0
    order = sorted(sums)
    for k, part in enumerate(order):
        edges.append((part, total, sums[order[k + 1]][1] if k + 1 < len(order) else None))
        total += sums[part][0]
    by = Window.partitionBy(PART).orderBy(at)
    made = rows.withColumn("__own", F.sum(value).over(by)).withColumn("__lead", F.lead(at).over(by))
    kind = rows.schema[at].dataType.simpleString()
    return _beside(made, f"__before long, __next {kind}", edges).select(*df.columns, (F.col("__own") + F.col("__before")).alias("total"), F.coalesce("__lead", "__next").alias("next"))


def last_before(rows: DataFrame, marks: DataFrame, at: str, value: str) -> DataFrame:
    """``rows`` with ``value`` of the last of ``marks`` (at, value) at or before them; of the first mark if
    none is. For marks that are too many to be sent to each task."""
    both = in_parts(marks.select(at, value).withColumn("__mark", F.lit(0)).unionByName(rows.withColumn("__mark", F.lit(1)), True), [at])
    mine = both.where("__mark = 0").groupBy(PART).agg(F.max_by(value, at).alias("__last"), F.min_by(value, at).alias("__first"))
    mine = {r[PART]: (r["__last"], r["__first"]) for r in mine.collect()}  # one row a partition
    parts = [r[PART] for r in both.select(PART).distinct().orderBy(PART).collect()]
    carry, now = [], next((mine[p][1] for p in parts if p in mine), None)
    for part in parts:
        carry.append((part, now))
        now = mine[part][0] if part in mine else now
    upto = Window.partitionBy(PART).orderBy(at, "__mark").rowsBetween(Window.unboundedPreceding, 0)
    found: Column = F.last(value, True).over(upto)
    kind = marks.schema[value].dataType.simpleString()
    return _beside(both.withColumn("__found", found), f"__carry {kind}", carry).where("__mark = 1").withColumn(value, F.coalesce("__found", "__carry")).select(*rows.columns, value)
