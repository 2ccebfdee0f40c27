"""Kept hash trees: one folder for each node and table, with a folder for each version.

A version is written whole, then a pointer file with the next number names it; the one with the highest number is in
force. So a run that dies at any point leaves the old version or the new one, and of two updates at once the second one
to end fails, as its number is taken. Pointers before the last one are removed. Each version has the leaves (range, hash, counters since the last update) and the levels.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, merkle
from .nodes import Table
from .shared import file_system

#: Levels that a descent goes down with one job.
LEVELS_AT_ONCE = 6
#: Trees of a lower version have hashes of another kind, and are hashed anew at their next update.
HASH_VERSION = 3
_POINTER = "current-"


@dataclass
class Tree:
    """A kept tree. ``leaves`` has block_id, range_start, range_end, node_position, n_rows and the lanes."""

    spark: SparkSession
    place: str
    about: dict

    @property
    def leaves(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.place}/{self.about['version']}/leaves")

    @property
    def levels(self) -> DataFrame:
        return self.spark.read.schema(f"node_position long, {', '.join(f'{c} long' for c in merkle.HASH)}, node_level int").parquet(f"{self.place}/{self.about['version']}/levels")

    @property
    def ranges(self) -> DataFrame:
        return self.leaves.select("block_id", "range_start", "range_end")

    @property
    def n_leaves(self) -> int:
        return self.about["n_leaves"]


def _save(spark: SparkSession, place: str, ranges: DataFrame, leaf: DataFrame, block_size: int, number: int | None = None, **about: object) -> Tree:
    version = uuid.uuid4().hex
    leaf.join(ranges, F.col("node_position") == F.col("block_id")).select("block_id", "range_start", "range_end", "node_position", *merkle.HASH).write.parquet(f"{place}/{version}/leaves")
    kept = spark.read.parquet(f"{place}/{version}/leaves")
    n = kept.count()
    levels = merkle.build(kept, n)  # a level is a folder, in which files and row groups hold positions in a row
    levels.repartitionByRange("node_level", "node_position").sortWithinPartitions("node_level", "node_position").write.partitionBy("node_level").parquet(f"{place}/{version}/levels")
    about = {"version": version, "n_leaves": n, "block_size": block_size, "hash_version": HASH_VERSION, **about}
    about["number"] = 1 + (max(_pointers(spark, place), default=0) if number is None else number)
    new, fs = file_system(spark, f"{place}/{version}/pointer")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(about).encode()))
    out.close()
    named, _ = file_system(spark, f"{place}/{_POINTER}{about['number']}")
    if fs.exists(named) or not fs.rename(new, named):
        raise OSError(f"{place} has been pointed at another version meanwhile")
    for old in _pointers(spark, place):
        if old < about["number"] - 1:
            fs.delete(file_system(spark, f"{place}/{_POINTER}{old}")[0], False)
    return Tree(spark, place, about)


def _pointers(spark: SparkSession, place: str) -> list[int]:
    path, fs = file_system(spark, place)
    names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
    return [int(x.removeprefix(_POINTER)) for x in names if x.startswith(_POINTER) and x.removeprefix(_POINTER).isdigit()]


def open_tree(spark: SparkSession, place: str) -> Tree:
    """The current version; a missing tree is an error."""
    numbers = _pointers(spark, place)
    if not numbers:
        raise FileNotFoundError(f"no hash tree at {place}: build it first")
    return Tree(spark, place, json.loads("".join(r["value"] for r in spark.read.text(f"{place}/{_POINTER}{max(numbers)}").collect())))


def build_trees(tables: dict[str, DataFrame], table: Table, places: dict[str, str], block_size: int, sampled: bool = False) -> dict[str, Tree]:
    """A tree for each node, over the ranges of the node with most rows. No rows anywhere is an error."""
    counts = {n: df.count() for n, df in tables.items()}
    if not max(counts.values()):
        raise ValueError(f"{table.name} has 0 rows on all nodes")
    most = blocks.anchor(counts)
    spark = tables[most].sparkSession
    ranges = blocks.boundaries(tables[most], list(table.key), blocks.n_blocks(counts[most], block_size), sampled)
    from .shared import written

    ranges = written(ranges, "ranges")
    same = uuid.uuid4().hex
    return {n: _save(spark, places[n], ranges, merkle.leaves(df, table, ranges), block_size, key=list(table.key), cut=same) for n, df in tables.items()}


def update(tree: Tree, df: DataFrame, table: Table, changes: DataFrame, rebalance: bool = False, **about: object) -> Tree:
    """The tree after changes (op and key columns) that ``df`` already holds: leaves with changes are hashed
    anew, large ones split, with ``rebalance`` small ones merged; a TRUNCATE, very many updates or an old
    hash version hash all anew. Without changes the tree stays. ``about`` is kept with the version."""
    from .shared import written

    key, size = list(table.key), tree.about["block_size"]
    changes = written(changes.select("op", *key), "changes")
    old = tree.about["hash_version"] < HASH_VERSION
    if changes.isEmpty() and not (old or rebalance):
        return tree
    everything = old or merkle.escalates(changes, tree.leaves.agg(F.sum("n_rows").alias("n")).first()["n"] or 0)
    ranges = written(merkle.extended(tree.ranges, changes, key), "ranges")
    touched = blocks.assign(changes.where("op <> 'TRUNCATE'"), key, ranges)
    counted = written(touched.groupBy("block_id").agg(F.sum((F.col("op") == "INSERT").cast("long")).alias("inserts")), "counters")
    parts = written(merkle.split(df, key, ranges, counted, size), "ranges")
    dirty = parts if everything else parts.join(counted.select(F.col("block_id").alias("old")), "old", "left_semi").unionByName(parts.where("old IS NULL"))
    kept = parts.where("old IS NOT NULL").select("old", F.col("block_id").alias("to")).join(tree.leaves.select(F.col("block_id").alias("old"), *merkle.HASH), "old")
    moved = kept.select(F.lit(0).alias("node_level"), F.col("to").alias("node_position"), *merkle.HASH)
    leaf = written(merkle.refreshed(moved, df, table, parts, dirty.select(F.col("block_id").alias("node_position"))), "leaves")
    if rebalance:
        sized = leaf.join(parts, F.col("node_position") == F.col("block_id")).select("block_id", "range_start", "n_rows")
        joined = written(merkle.merged(sized, size), "ranges")
        leaf = written(_folded(leaf, parts, joined), "leaves")
        parts = joined
    return _save(tree.spark, tree.place, parts.select("block_id", "range_start", "range_end"), leaf, size, tree.about["number"], **({"batch": tree.about["batch"]} if "batch" in tree.about else {}) | about, key=key)


def _folded(leaf: DataFrame, parts: DataFrame, joined: DataFrame) -> DataFrame:
    """Leaves of merged ranges: the fold of the leaves that went into each, no row is read."""
    starts = leaf.join(parts.select("block_id", "range_start"), F.col("node_position") == F.col("block_id")).drop("block_id", "node_position").withColumn("at", F.col("range_start"))
    to = blocks.assign(starts, ["at"], joined.withColumn("range_start", F.struct(F.col("range_start").alias("at"))))
    return to.groupBy(F.col("block_id").alias("node_position")).agg(F.sum("n_rows").alias("n_rows"), *[F.bit_xor(x).alias(x) for x in merkle.LANES])


def compare(left: Tree, right: Tree, most: int = blocks.MOST_RANGES) -> DataFrame:
    """block_id of the leaves of ``left`` that hold a difference. Trees over the same ranges are compared
    from their roots; where ranges differ (one was split), a leaf without an equal one over the same range counts."""
    if left.n_leaves == right.n_leaves and _same_ranges(left, right):
        return _descent(left, right, most)
    a, b = left.leaves, right.leaves
    other = b.select(F.col("range_start").alias("s"), F.col("range_end").alias("e"), *[F.col(x).alias(f"o_{x}") for x in merkle.HASH])
    equal = a.join(other, F.expr("range_start = s AND range_end <=> e AND " + " AND ".join(f"{x} = o_{x}" for x in merkle.HASH))).select("block_id")
    return a.join(equal, "block_id", "left_anti").select("block_id")


def _descent(left: Tree, right: Tree, most: int) -> DataFrame:
    """From the root LEVELS_AT_ONCE levels at a time: only what stands below nodes that differ is read, by a filter on the
    level's folder and on positions, which row groups are skipped by. Beyond ``most`` such nodes all leaves are compared in one join."""
    level, bad = merkle.height(left.n_leaves) + 1, [0]
    while level > 0 and bad:
        below = max(0, level - LEVELS_AT_ONCE)
        at = reduce(Column.__or__, [F.col("node_position").between(p << (level - below), ((p + 1) << (level - below)) - 1) for p in bad])
        some = merkle.differing(*[t.levels.where((F.col("node_level") == below) & at) for t in (left, right)]).select("node_position")
        found = some.limit(most + 1).collect()
        if len(found) > most:
            leaves = [t.levels.where("node_level = 0") for t in (left, right)]
            return merkle.differing(*leaves).select(F.col("node_position").alias("block_id"))
        level, bad = below, [r["node_position"] for r in found]
    return left.spark.createDataFrame([(p,) for p in bad], "block_id long")


def _same_ranges(left: Tree, right: Tree) -> bool:
    if left.about.get("cut") and left.about.get("cut") == right.about.get("cut"):
        return True  # built together, or changed only in their hashes
    a, b = left.ranges.select("block_id", F.struct("range_start", "range_end").alias("a")), right.ranges.select("block_id", F.struct("range_start", "range_end").alias("b"))
    return a.join(b, "block_id", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()


def rows_of(tree: Tree, df: DataFrame, table: Table, chosen: DataFrame) -> DataFrame:
    """The rows of the chosen leaves; few leaves are a filter that reaches the scan."""
    return blocks.in_ranges(df, list(table.key), tree.ranges, chosen).drop("block_id")


def rows_near(tree: Tree, df: DataFrame, table: Table, chosen: DataFrame) -> DataFrame:
    """The rows of the chosen leaves and perhaps of some between them, by a filter of the scan alone: for a diff."""
    return blocks.near_ranges(df, list(table.key), tree.ranges, chosen)


def heal(tree: Tree, df: DataFrame, table: Table, chosen: DataFrame) -> tuple[Tree, int]:
    """Leaves that differ although no row does were stale: they are hashed anew. The tree and their number."""
    stale = chosen.select(F.col("block_id").alias("node_position"))
    n = stale.count()
    if not n:
        return tree, 0
    leaf = merkle.refreshed(tree.levels, df, table, tree.ranges, stale)
    return _save(tree.spark, tree.place, tree.ranges, leaf, tree.about["block_size"], tree.about["number"], **{k: v for k, v in tree.about.items() if k in ("batch", "cut")}, key=list(table.key)), n
