"""Comparison of what nodes hold: objects of a schema, tables of replication sets, subscriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def object_diff(inventory: DataFrame, nodes: list[str]) -> DataFrame:
    """kind, name, present (nodes that have it), missing: of (node, kind, name) what not all nodes have."""
    held = inventory.where(F.col("node").isin(nodes)).groupBy("kind", "name").agg(F.sort_array(F.collect_set("node")).alias("have"))
    missing = F.array_except(F.array(*[F.lit(n) for n in sorted(nodes)]), F.col("have"))
    return held.select("kind", "name", F.array_join("have", ",").alias("present"), F.array_join(missing, ",").alias("missing")).where("missing <> ''")


def table_plan(inventory: DataFrame, nodes: list[str], skip: list[str] = ()) -> DataFrame:
    """name and status of each table: common, partial (some nodes lack it), or skipped."""
    tables = inventory.where("kind = 'table'").groupBy("name").agg(F.countDistinct("node").alias("n"))
    status = F.when(F.col("name").isin(list(skip)), "skipped").when(F.col("n") < len(nodes), "partial").otherwise("common")
    return tables.select("name", status.alias("status"))


def set_members(members: DataFrame, nodes: list[str]) -> DataFrame:
    """Of (node, set_name, table_name): each table of a set on any node that has the set, and which of
    these nodes lack it there."""
    holders = members.groupBy("set_name").agg(F.collect_set("node").alias("holders"))
    tables = members.groupBy("set_name", "table_name").agg(F.collect_set("node").alias("have"))
    joined = tables.join(holders, "set_name")
    return joined.select("set_name", "table_name", F.array_join(F.sort_array(F.array_except("holders", "have")), ",").alias("missing_on"))


def subscription_diff(subs: DataFrame) -> DataFrame:
    """Of (node, provider, enabled, sets): each pair of nodes with what is wrong between them. Subscriptions
    match by provider; sets are compared without order."""
    a = subs.select(F.col("node").alias("n1"), F.col("provider").alias("n2"), F.col("enabled").alias("e1"), F.sort_array("sets").alias("s1"))
    b = subs.select(F.col("provider").alias("n1"), F.col("node").alias("n2"), F.col("enabled").alias("e2"), F.sort_array("sets").alias("s2"))
    both = a.join(b, ["n1", "n2"], "full_outer")
    wrong = F.when(F.col("e1").isNull(), "missing n1 from n2").when(F.col("e2").isNull(), "missing n2 from n1").when(~F.col("e1") | ~F.col("e2"), "disabled").when(~F.col("s1").eqNullSafe(F.col("s2")), "sets differ").otherwise("ok")
    return both.select("n1", "n2", wrong.alias("status")).where("n1 < n2")


def recovery_source(positions: DataFrame) -> tuple[str, int]:
    """Of (node, origin_lsn, slot_lsn) the survivor that is furthest; no position and ties are errors."""
    best = positions.select("node", F.coalesce("origin_lsn", "slot_lsn").alias("lsn")).where("lsn IS NOT NULL").orderBy(F.desc("lsn"), "node").limit(2).collect()
    if not best:
        raise ValueError("no survivor has a position")
    if len(best) > 1 and best[0]["lsn"] == best[1]["lsn"]:
        raise ValueError(f"survivors {best[0]['node']} and {best[1]['node']} are equally far")
    return best[0]["node"], best[0]["lsn"]
