"""Row differences between copies of a table.

A diff is one null-safe full outer join on the key. Where both copies are large and mostly equal, block
digests, which are combined on the map side, first find the blocks that differ, and only their rows are
joined. Values are compared as typed columns; decimals of different scale compare as numbers.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normalize import check_identifier, row_text
from ..sources.nodes import Cluster, Table, by_keys, same_schema

ONLY_SECOND, ONLY_FIRST, CHANGED = "missing_on_n1", "missing_on_n2", "row_mismatch"
HAS = "__has"


def sides(left: DataFrame, right: DataFrame, table: Table) -> DataFrame:
    """Both rows of every key: the key, n1 and n2 as structs of all other columns, null where absent."""
    same_schema(left, right)

    def side(df: DataFrame, name: str) -> DataFrame:
        others = [c for c in df.columns if c not in table.key]
        return df.select(*table.key, F.struct(F.lit(1).alias(HAS), *others).alias(name))

    return side(left, "n1").join(side(right, "n2"), list(table.key), "full_outer")


def classified(both: DataFrame, columns: list[str]) -> DataFrame:
    """Only what differs, with diff_type and changed_columns."""
    differs = {c: ~F.col(f"n1.{c}").eqNullSafe(F.col(f"n2.{c}")) for c in columns}
    changed = F.concat_ws(",", *[F.when(x, F.lit(c)) for c, x in differs.items()])
    kind = F.when(F.col(f"n1.{HAS}").isNull(), ONLY_SECOND).when(F.col(f"n2.{HAS}").isNull(), ONLY_FIRST).when(reduce(Column.__or__, differs.values(), F.lit(False)), CHANGED)
    out = both.withColumn("diff_type", kind).where("diff_type IS NOT NULL")
    return out.withColumn("changed_columns", F.when(F.col("diff_type") == CHANGED, changed).otherwise(""))


def diff_pair(left: DataFrame, right: DataFrame, table: Table) -> DataFrame:
    return classified(sides(left, right, table), table.columns(left))


def digest_blocks(df: DataFrame, table: Table, n_blocks: int) -> DataFrame:
    """A digest of each block of keys that Spark combines on the map side: count, sum and xor of hashes."""
    columns = [*table.key, *table.columns(df)]
    h = F.xxhash64(row_text(df, columns))
    block = F.pmod(F.xxhash64(*table.key), F.lit(n_blocks))
    return df.select(block.alias("block"), h.alias("h")).groupBy("block").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).alias("total"), F.bit_xor("h").alias("mix"))


def differing(frames: list[DataFrame], table: Table, n_blocks: int) -> list[DataFrame]:
    """Of each copy the rows of blocks whose digests are not all equal. Digests are read once for each copy."""
    key, last = list(table.key), len(frames)
    each = [digest_blocks(df, table, n_blocks).select("block", F.struct("n", "total", "mix").alias("d")) for df in frames]
    every = reduce(DataFrame.unionByName, each)
    bad = every.groupBy("block").agg(F.count("*").alias("copies"), F.min("d").alias("d1"), F.max("d").alias("d2")).where((F.col("copies") < last) | (F.col("d1") != F.col("d2")))
    small = F.broadcast(bad.select(F.col("block").alias("bad")))  # at most n_blocks numbers
    return [df.join(small, F.pmod(F.xxhash64(*key), F.lit(n_blocks)) == F.col("bad"), "left_semi") for df in frames]


def diff_pruned(left: DataFrame, right: DataFrame, table: Table, n_blocks: int = 4096) -> DataFrame:
    """The same as ``diff_pair``, but only rows of blocks with different digests are joined. Blocks are
    chosen by the hash of the key, so both copies agree on them without looking at each other."""
    if same_schema(left, right):  # equal numbers of other types have other texts
        return diff_pair(left, right, table)
    return diff_pair(*differing([left, right], table, n_blocks), table)


def diff(cluster: Cluster, table: Table, nodes: list[str] | None = None, where: str | Column | None = None, pruned: bool = False, n_blocks: int = 4096) -> DataFrame:
    """All pairs of two or three nodes: pair, the key, n1, n2, diff_type, changed_columns. Each node is read
    once (with ``pruned`` twice) and all meet in one join by the key."""
    pairs = cluster.pairs(nodes)
    names = sorted({n for pair in pairs for n in pair})
    frames = {n: cluster.frame(n, table, where) for n in names}
    if any([same_schema(frames[names[0]], frames[n]) for n in names[1:]]):  # other types: pair by pair
        return reduce(DataFrame.unionByName, [diff_pair(frames[a], frames[b], table).withColumn("pair", F.lit(f"{a}/{b}")) for a, b in pairs])
    if pruned:
        frames = dict(zip(names, differing(list(frames.values()), table, n_blocks), strict=True))
    key, columns = list(table.key), table.columns(frames[names[0]])
    side = lambda n: frames[n].select(*key, F.struct(F.lit(1).alias(HAS), *[c for c in frames[n].columns if c not in key]).alias(f"__{n}"))
    together = reduce(lambda x, y: x.join(y, key, "full_outer"), map(side, names))
    each = F.array(*[F.struct(F.lit(f"{a}/{b}").alias("pair"), F.col(f"__{a}").alias("n1"), F.col(f"__{b}").alias("n2")) for a, b in pairs])
    rows = together.select(*key, F.inline(each)).where(F.col(f"n1.{HAS}").isNotNull() | F.col(f"n2.{HAS}").isNotNull())
    return classified(rows, columns)


def report(diffs: DataFrame, table: Table) -> DataFrame:
    return diffs.select("pair", "diff_type", *table.key, "changed_columns")


def capped(diffs: DataFrame, table: Table, most: int) -> DataFrame:
    """At most ``most`` rows of each pair, the first by key. Each task keeps no more than that of its own rows, and only these are
    moved; the diff itself is not written anywhere."""
    place = F.row_number().over(Window.partitionBy("pair").orderBy(*table.key))
    return diffs.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def effective_filter(where: str | None = None, origin: tuple[str, str] | None = None, until: tuple[str, str] | None = None) -> str | None:
    """The filter in force as SQL text: the table filter, the column and id of an origin, and the column and time of a fence,
    which rows without a commit time pass."""
    parts = [f"({where})"] if where else []
    if origin:
        column, name = origin
        if not name.isdigit():
            raise ValueError(f"origin must be numeric: {name!r}")
        parts.append(f"{check_identifier(column)} = '{name}'")
    if until:
        column, time = until
        parts.append(f"({check_identifier(column)} IS NULL OR {column} <= TIMESTAMP'{datetime.fromisoformat(time)}')")
    return " AND ".join(parts) or None


@dataclass
class Run:
    """A capped diff and, once its rows have been computed, its summary."""

    rows: DataFrame
    seen: Observation
    pairs: list[tuple[str, str]]
    most: int
    filter: str | None

    def summary(self) -> list[dict]:
        """By pair: how many rows differ in all, how many are kept, whether the limit was reached, and the filter in force."""
        found = self.seen.get
        return [{"pair": f"{a}/{b}", "n_rows": n, "n_kept": min(n, self.most), "limited": n > self.most, "effective_filter": self.filter} for a, b in self.pairs for n in [found[f"{a}/{b}"]]]


def run(cluster: Cluster, table: Table, most: int, where: str | None = None, origin: tuple[str, str] | None = None, until: tuple[str, str] | None = None, pruned: bool = False) -> Run:
    """A diff of all pairs with at most ``most`` rows each. The counts of the summary are observed while the rows are computed,
    so nothing is read twice for them."""
    text, pairs, seen = effective_filter(where, origin, until), cluster.pairs(), Observation(f"diff-{uuid.uuid4().hex}")
    every = diff(cluster, table, where=text, pruned=pruned)
    counted = every.observe(seen, *[F.count(F.when(F.col("pair") == f"{a}/{b}", 1)).alias(f"{a}/{b}") for a, b in pairs])
    return Run(capped(counted, table, most), seen, pairs, most, text)


def summary(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("pair", "diff_type").agg(F.count("*").alias("n_rows"))


def multiset(left: DataFrame, right: DataFrame) -> DataFrame:
    """For tables without a key: the surplus copies of each distinct row, and on which side."""
    columns = left.columns
    both = left.withColumn("_s", F.lit(1)).unionByName(right.withColumn("_s", F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("_s").alias("surplus")).where("surplus <> 0")


GONE = "missing_on_both"


def rerun(found: DataFrame, cluster: Cluster, table: Table, gone: str = "resolved") -> DataFrame:
    """Which reported keys differ still. A key that is absent on both sides now counts as resolved, or, with
    ``gone="different"``, is reported as missing on both."""
    parts = []
    for a, b in cluster.pairs():
        keys = found.where(F.col("pair") == f"{a}/{b}").select(*table.key).distinct()
        left, right = (by_keys(cluster.frame(n, table), keys, table.key) for n in (a, b))
        now = diff_pair(left, right, table)
        if gone == "different":
            neither = keys.join(left, list(table.key), "left_anti").join(right, list(table.key), "left_anti")
            now = now.unionByName(neither.withColumns({"diff_type": F.lit(GONE), "changed_columns": F.lit("")}), True)
        parts.append(now.withColumn("pair", F.lit(f"{a}/{b}")))
    return reduce(DataFrame.unionByName, parts)


def each_table(cluster: Cluster, tables: list[Table], skip: list[str] = (), pruned: bool = True) -> DataFrame:
    """A diff of every table: one row for each, with the number of differences, or why it failed. A table
    that fails, as one without a key does, does not stop the others. status: matched, differed, failed, skipped."""
    rows, spark = [], None
    for t in tables:
        if t.name in skip:
            rows.append((t.name, "skipped", None, None))
            continue
        try:
            counted = diff(cluster, t, pruned=pruned)
            spark, n = counted.sparkSession, counted.count()
            rows.append((t.name, "differed" if n else "matched", n, None))
        except Exception as error:  # noqa: BLE001 - reported in the row of its table
            rows.append((t.name, "failed", None, str(error).splitlines()[0][:200]))
    spark = spark or SparkSession.active()
    return spark.createDataFrame(rows, "name string, status string, n_diffs long, error string")


def each_member(cluster: Cluster, members: DataFrame, tables: dict[str, Table], skip: list[str] = (), pruned: bool = True) -> DataFrame:
    """A diff of the tables of a replication set, from its members (node, table_name): each table on the nodes that have it in
    the set, one row for each pair of these nodes with the number of differences, and for a table that only one of them has,
    status ``single``. Sets are lists of tables that people keep, and are gathered."""
    held: dict[str, list[str]] = {}
    for r in members.select("node", "table_name").distinct().collect():
        held.setdefault(r["table_name"], []).append(r["node"])
    rows = []
    for name, on in sorted(held.items()):
        if name in skip or name not in tables or len(on) < 2:
            status = "skipped" if name in skip else "failed" if name not in tables else "single"
            rows.append((name, ",".join(sorted(on)), status, None))
            continue
        for a, b in Cluster({n: cluster.nodes[n] for n in on}).pairs():
            found = each_table(Cluster({n: cluster.nodes[n] for n in (a, b)}), [tables[name]], pruned=pruned).first()
            rows.append((name, f"{a},{b}", found["status"], found["n_diffs"]))
    return members.sparkSession.createDataFrame(rows, "name string, nodes string, status string, n_diffs long")


def octets(df: DataFrame, columns: list[str]) -> DataFrame:
    """The largest value of each column in bytes."""
    return df.agg(*[F.max(F.octet_length(c)).cast("long").alias(c) for c in columns])


def too_large(df: DataFrame, columns: list[str], most: int = 1_000_000) -> list[str]:
    """The columns with a value beyond ``most`` bytes; such tables are refused."""
    sizes = octets(df, columns).first()
    return [c for c in columns if (sizes[c] or 0) > most]
