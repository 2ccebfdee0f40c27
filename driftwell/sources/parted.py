"""Tables kept in key ranges, so that a repair reads and writes only the ranges that it changes.

Each row of a parted table is stored with the number of its key range (``PART``), in files that hold many ranges in order, so that
files follow the size of the table and not the number of its ranges. Writes find their range by their key; Spark then reads only
row groups near these ranges, and what the repair makes of them is a new version: a folder with their rows and with the numbers of
the ranges that it replaces, also of those that have lost their last row. All other ranges keep their files. Rows of a range that a
later version replaces stay in their files and are left out by a join with these numbers; ``create`` stores a table anew when they,
or its ranges, have become uneven.

A version is written whole, then a pointer file with the next number names it. So a reader meets the table before a repair or after it, a run
that dies leaves the table as it was, and of two repairs at once the second one to end fails, as its number is taken. A
run that is repeated gives the same table: writes are whole rows, deletes, or cells that are filled where they are null.

Keys below the first range belong to it, and the last range is open, so new keys always have a place.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, repair
from .nodes import Table
from .shared import file_system, written

#: The columns of a row's range and version, and most ranges that are named one by one in the filter of a scan.
PART, VERSION, MOST_NAMED = "key_part", "key_part_version", 10_000
#: Bytes of a row group: what a scan leaves out at once.
_GROUP = 1 << 23
_POINTER = "version-"
#: Number and folder of each version.
Versions = list[tuple[int, str]]


@dataclass(frozen=True)
class Parted:
    spark: SparkSession
    place: str
    table: Table

    @property
    def ranges(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.place}/ranges")

    @property
    def with_parts(self) -> DataFrame:
        return self._rows(self._versions())

    @property
    def frame(self) -> DataFrame:
        return self.with_parts.drop(PART)

    def _versions(self) -> Versions:
        path, fs = file_system(self.spark, self.place)
        names = [x.getPath().getName() for x in fs.listStatus(path) if x.getPath().getName().startswith(_POINTER)]
        lines = [r["value"].split() for r in self.spark.read.text([f"{self.place}/{n}" for n in names]).collect()]  # one short line each
        return sorted((int(number), folder) for number, folder in lines)

    def _rows(self, versions: Versions) -> DataFrame:
        rows = self.spark.read.parquet(*[f"{self.place}/{v}/rows" for _, v in versions])
        if len(versions) > 1:
            replaced = self.spark.read.parquet(*[f"{self.place}/{v}/parts" for _, v in versions[1:]])
            last = replaced.groupBy(F.col(PART).alias("__part")).agg(F.max(VERSION).alias("__last"))
            rows = rows.join(last, (F.col(PART) == F.col("__part")) & (F.col(VERSION) < F.col("__last")), "left_anti")
        return rows.drop(VERSION)

    def _save(self, number: int, rows: DataFrame, parts: DataFrame | None = None) -> None:
        """Write a version, of rows in order of their key, and point at it."""
        folder, by_part = uuid.uuid4().hex, lambda df: df.withColumn(VERSION, F.lit(number))
        by_part(rows).write.option("parquet.block.size", _GROUP).parquet(f"{self.place}/{folder}/rows")
        if parts is not None:
            by_part(parts).write.parquet(f"{self.place}/{folder}/parts")
        new, fs = file_system(self.spark, f"{self.place}/{folder}/pointer")
        out = fs.create(new, True)
        out.write(bytearray(f"{number} {folder}".encode()))
        out.close()
        named, _ = file_system(self.spark, f"{self.place}/{_POINTER}{number}")
        if fs.exists(named) or not fs.rename(new, named):
            raise OSError(f"{self.place} has been repaired meanwhile")

    def _touched(self, writes: DataFrame) -> tuple[DataFrame, list[int] | None]:
        """The writes with their parts, and the parts in order unless they are too many to be named."""
        placed = written(blocks.assign(writes, list(self.table.key), self.ranges).withColumnRenamed("block_id", PART), "placed")
        few = sorted(r[PART] for r in placed.select(PART).distinct().limit(MOST_NAMED + 1).collect())
        return placed, few if len(few) <= MOST_NAMED else None

    def _old(self, versions: Versions, placed: DataFrame, few: list[int] | None) -> DataFrame:
        rows, part = self._rows(versions), F.col(PART)
        if few is None:
            ends = placed.agg(F.min(PART).alias("a"), F.max(PART).alias("b")).first()
            return rows.where(part.between(ends["a"], ends["b"])).join(placed.select(PART).distinct(), PART, "left_semi")
        cuts = sorted(sorted(range(1, len(few)), key=lambda k: few[k - 1] - few[k])[: blocks.MOST_RUNS - 1])  # wide runs reach the row groups
        near = [part.between(few[a], few[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(few)], strict=True)]
        return rows.where(reduce(Column.__or__, near) & part.isin(few))

    def _replace(self, versions: Versions, placed: DataFrame, rows: DataFrame) -> int:
        """Put ``rows`` in the place of the parts of ``placed``; how many there were."""
        new, parts = written(rows, "repaired"), written(placed.select(PART).distinct(), "parts")
        self._save(versions[-1][0] + 1, new.repartitionByRange(*self.table.key).sortWithinPartitions(*self.table.key), parts)
        return parts.count()

    def apply(self, writes: DataFrame, node: str) -> int:
        """Apply repairs of ``node`` (node, key, op, row); the number of ranges that were rewritten."""
        versions, (placed, few) = self._versions(), self._touched(writes.where(F.col("node") == node))
        if few == []:
            return 0
        old = self._old(versions, placed, few)
        table = Table(self.table.name, (*self.table.key, PART), self.table.meta)  # a key has one part, so the join keeps to it
        return self._replace(versions, placed, repair.applied(old, placed, node, table))

    def fill(self, cells: DataFrame, node: str) -> int:
        """Fill cells (node, key, fill: a struct with a field for each column that may be filled) where they are null; the
        number of ranges that were rewritten. Other columns of the rows are not known and not written."""
        versions, (placed, few) = self._versions(), self._touched(cells.where(F.col("node") == node).select(*self.table.key, "fill"))
        if few == []:
            return 0
        names = [f.name for f in placed.schema["fill"].dataType.fields]
        old = self._old(versions, placed, few)
        both = old.join(placed, [*self.table.key, PART], "left")
        filled: list[Column] = [F.coalesce(c, F.col(f"fill.{c}")).alias(c) if c in names else F.col(c) for c in old.columns]
        return self._replace(versions, placed, both.select(*filled))


def create(df: DataFrame, table: Table, place: str, rows_per_part: int, sampled: bool = False) -> Parted:
    """Store ``df`` at ``place`` in ranges of about so many rows."""
    for name in (PART, VERSION):
        if name in df.columns:
            raise ValueError(f"a column is called {name}")
    spark, key = df.sparkSession, list(table.key)
    n = df.count()
    if not n:
        raise ValueError(f"{table.name} has no rows to be cut into ranges")
    blocks.boundaries(df, key, blocks.n_blocks(n, rows_per_part), sampled).write.parquet(f"{place}/ranges")
    made = Parted(spark, place, table)
    rows = df.repartitionByRange(*key).sortWithinPartitions(*key)  # and so in order of their ranges
    made._save(0, blocks.assign(rows, key, made.ranges).withColumnRenamed("block_id", PART))
    return made


def cells(diffs: DataFrame, table: Table, columns: list[str]) -> DataFrame:
    """The cells that ``repair.fill_nulls`` fills, without the rest of their rows: node, key, fill."""
    whole = repair.null_fills(diffs, table, columns)
    return whole.select("node", *table.key, F.struct(*[F.col(f"fill_{c}").alias(c) for c in columns]).alias("fill")).where(reduce(Column.__or__, [F.col(f"fill.{c}").isNotNull() for c in columns]))
