"""Connected components by alternating large and small stars, as windows and aggregations.

Nodes are values of any type that can be ordered. Each round replaces every edge by one towards the
smallest neighbour, of the larger neighbours and of the smaller ones in turn, until stars alone remain; the
number of rounds grows with the logarithm of the graph. Edges that are stars from the start, as those of
most near copies are, need no round at all. The edges of a hub are dealt over many tasks once there are
many; no neighbourhood is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, salts, written

MAX_ROUNDS = 60
#: Edges from which on those of one node are dealt over many tasks; fewer fit one task whatever the hubs.
HUB_EDGES = 1_000_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))


def _with_least(edges: DataFrame, many: bool) -> DataFrame:
    """``edges`` with m, the least v of all edges with their u."""
    if many:
        return beside(edges, edges.groupBy("u").agg(F.min("v").alias("m"), salts(["v"])), ["u"], ["v"])
    return edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))


def _large_star(edges: DataFrame, many: bool) -> DataFrame:
    """Each larger neighbour of a node goes to the least one of the node and its neighbours. An edge may come twice."""
    return _with_least(_both(edges), many).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame, many: bool) -> DataFrame:
    """Each smaller neighbour of a node, and the node itself, goes to the least one of these."""
    near = _with_least(edges, many)
    moved = near.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
    return moved.where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple[int, bool]:
    """The number of edges, and whether they are stars: no node with a smaller neighbour has a second one."""
    of = _both(edges).groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    n, open_ = of.agg(F.sum("n"), F.max(F.expr("low < u AND high <> low"))).first()
    return (n or 0) // 2, not open_


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): the least node that each node of an edge reaches. Edges of a node to itself
    are ignored. No edges give no rows. ``edges`` is read more than once: it should be a table."""
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v")
    for _ in range(MAX_ROUNDS):
        n, stars = _state(now)
        if stars:
            break
        many = n > HUB_EDGES
        now = written(_small_star(_large_star(now, many), many), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    nodes = now.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))))
    return nodes.groupBy("node").agg(F.min("component").alias("component"))
