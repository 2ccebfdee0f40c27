"""Writes that make copies converge: upserts and deletes for each node, and their application.

All work on the rows of a diff (pair, key, n1, n2, diff_type; n1 and n2 being the pair's first and second
node) and give (node, key columns, op, row).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.nodes import Table
from .diff import CHANGED, HAS, ONLY_FIRST, ONLY_SECOND

UPSERT, INSERT, DELETE = "upsert", "insert", "delete"
MODES = ("default", "insert_only", "upsert_only")


def _first() -> Column:
    return F.substring_index("pair", "/", 1)


def _second() -> Column:
    return F.substring_index("pair", "/", -1)


def check_options(source: str | None, mode: str, bidirectional: bool = False, fix_nulls: bool = False) -> None:
    """Combinations that contradict each other."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if bidirectional and mode == "upsert_only" or fix_nulls and (bidirectional or mode != "default"):
        raise ValueError("these options cannot be combined")
    if not source and not fix_nulls and not (bidirectional and mode == "insert_only"):
        raise ValueError("a source of truth is required")


def from_source(diffs: DataFrame, table: Table, source: str, mode: str = "default") -> DataFrame:
    """Every differing row of the source goes to the other node of its pair; what the source lacks is
    deleted there. Pairs without the source are ignored."""
    check_options(source, mode)
    here = F.when(_first() == source, F.col("n1")).otherwise(F.col("n2"))
    other = F.when(_first() == source, _second()).otherwise(_first())
    rows = diffs.where((_first() == source) | (_second() == source)).select(other.alias("node"), *table.key, here.alias("row"), F.when(_first() == source, F.col("n2")).otherwise(F.col("n1")).alias("old"))
    op = F.when(F.col(f"row.{HAS}").isNull(), DELETE).otherwise(INSERT if mode == "insert_only" else UPSERT)
    made = rows.withColumn("op", op)
    if mode != "default":
        made = made.where(F.col("op") != DELETE)
    if mode == "insert_only":
        made = made.where(F.col(f"old.{HAS}").isNull())
    return made.select("node", *table.key, "op", "row").dropDuplicates(["node", *table.key])


def both_ways(diffs: DataFrame, table: Table) -> DataFrame:
    """Rows that one side lacks are inserted there; changed rows stay as they are. A node that lacks a row
    in several pairs gets the one of the first node that has it."""
    lacks = diffs.where(F.col("diff_type").isin(ONLY_FIRST, ONLY_SECOND))
    first = F.col("diff_type") == ONLY_FIRST
    rows = lacks.select(F.when(first, _second()).otherwise(_first()).alias("node"), F.when(first, _first()).otherwise(_second()).alias("from"), *table.key, F.when(first, F.col("n1")).otherwise(F.col("n2")).alias("row"))
    return rows.groupBy("node", *table.key).agg(F.min_by("row", "from").alias("row")).select("node", *table.key, F.lit(INSERT).alias("op"), "row")


def null_fills(diffs: DataFrame, table: Table, columns: list[str]) -> DataFrame:
    """For keys on both sides: node, key, old (the row there) and fill_<column>, the value of the other side where
    the own one is null; of several sources of one column the first by name that has a value."""
    both = diffs.where(F.col("diff_type") == CHANGED)

    def side(own: str, other: str, node: Column, source: Column) -> DataFrame:
        needs = reduce(Column.__or__, [F.col(f"{own}.{c}").isNull() & F.col(f"{other}.{c}").isNotNull() for c in columns])
        fills = F.struct(*[F.when(F.col(f"{own}.{c}").isNull(), F.col(f"{other}.{c}")).alias(c) for c in columns])
        return both.where(needs).select(node.alias("node"), source.alias("from"), *table.key, F.col(own).alias("old"), fills.alias("fill"))

    rows = side("n1", "n2", _first(), _second()).unionByName(side("n2", "n1", _second(), _first()))
    return rows.groupBy("node", *table.key).agg(F.first("old").alias("old"), *[F.min_by(F.col(f"fill.{c}"), F.when(F.col(f"fill.{c}").isNotNull(), F.col("from"))).alias(f"fill_{c}") for c in columns])


def fill_nulls(diffs: DataFrame, table: Table, columns: list[str]) -> DataFrame:
    """For keys on both sides, nulls of one side are filled from the other; the first pair wins. The rows
    written hold all columns, so that a fill is an ordinary upsert; ``sources.parted`` fills single cells."""
    picked = null_fills(diffs, table, columns)
    row = F.struct(F.lit(1).alias(HAS), *[F.coalesce(f"old.{c}", f"fill_{c}").alias(c) for c in columns])
    return picked.select("node", *table.key, F.lit(UPSERT).alias("op"), row.alias("row"))


def stale(repairs: DataFrame, current: DataFrame, table: Table, seen: str, column: str) -> DataFrame:
    """The repairs with a reason where their target row is newer than the diff's view of it (column
    ``seen`` of the repairs): 'newer', or 'unknown' where the diff has no time. Rows without a current
    time are not stale."""
    now = current.select(*table.key, F.col(column).alias("_now"))
    joined = repairs.join(now, list(table.key), "left")
    reason = F.when(F.col("_now").isNull(), F.lit(None).cast("string")).when(F.col(seen).isNull(), "unknown").when(F.col("_now") > F.col(seen), "newer")
    return joined.withColumn("stale", reason).drop("_now")


def applied(df: DataFrame, repairs: DataFrame, node: str, table: Table) -> DataFrame:
    """The node's table after its repairs: deletes before upserts, inserts only where the key is absent.
    Repairs that ``stale`` has marked are left out."""
    own = repairs.where(F.col("node") == node)
    if "stale" in repairs.columns:
        own = own.where("stale IS NULL")
    others = [c for c in df.columns if c not in table.key]
    rows = own.where(F.col("op") != DELETE).select(*table.key, *[F.col(f"row.{c}").alias(c) for c in others], F.lit(True).alias("_new"))
    replaced = own.where(F.col("op") != INSERT).select(*table.key)
    kept = df.join(replaced, list(table.key), "left_anti").withColumn("_new", F.lit(False))
    fresh = rows.join(kept.select(*table.key), list(table.key), "left_anti")
    return kept.unionByName(fresh).drop("_new").select(*df.columns)


def by_origin(repairs: DataFrame, origin: str, lsn: str, time: str) -> DataFrame:
    """How many rows each batch of one origin, position and time writes; rows without an origin make up
    the batch of the zero key."""
    return repairs.groupBy(F.coalesce(origin, F.lit("")).alias("origin"), F.when(F.col(origin).isNotNull(), F.col(lsn)).alias("lsn"), F.when(F.col(origin).isNotNull(), F.col(time)).alias("time")).agg(F.count("*").alias("n_rows"))


def counts(repairs: DataFrame) -> DataFrame:
    """What a dry run reports."""
    return repairs.groupBy("node", "op").agg(F.count("*").alias("n_rows"))


def guarded(diffs: DataFrame, table: Table, df: DataFrame, origin: str | None = None, recovering: bool = False) -> DataFrame:
    """The diff, if it belongs to the table: its keys and columns must be the table's. A diff of rows of one
    origin only may be repaired from in a recovery, as it says nothing about all other rows."""
    wanted, have = set(table.columns(df)), {f.name for f in diffs.schema["n1"].dataType.fields} - {HAS} - set(table.meta)
    if not set(table.key) <= set(diffs.columns) or wanted != have:
        raise ValueError(f"the diff is not one of table {table.name}")
    if origin is not None and not recovering:
        raise ValueError("a diff of one origin can only be repaired from in a recovery")
    return diffs
