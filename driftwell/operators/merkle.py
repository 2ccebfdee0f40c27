"""A hash tree over key ranges: built from leaf hashes, compared level by level, updated from changes,
split and merged. ``sources.trees`` keeps trees as versioned tables.

A row's hash is SHA-256 of its text, as four lanes of 60 bits. A leaf folds the lanes of its rows and a
parent those of its two children by xor, so that each fold is a plain aggregate that Spark combines on the
map side; the number of rows goes with them. A leaf without rows has lanes of zero.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import canonical, row_text
from ..sources.nodes import Table
from ..sources.shared import written
from .blocks import assign, closed, in_ranges, pieces

LANES = ("l0", "l1", "l2", "l3")
HASH = ("n_rows", *LANES)
_DIGITS = 15
#: A leaf splits if its inserts reach this share of a block; slivers below it join their neighbours;
#: merged leaves stay below the last share (fixed values).
SPLIT_SHARE, SLIVER_SHARE, MERGE_SHARE = 0.5, 0.25, 1.5
#: Neighbouring leaves that one task looks at when leaves are merged.
LEAVES_IN_PART = 100_000
#: Tracking keys gives way to rehashing all leaves from this share of a table's rows, and this many changes.
ESCALATE_SHARE, ESCALATE_LEAST = 0.01, 1000


def lanes(digest: Column) -> list[Column]:
    return [F.conv(F.substring(digest, _DIGITS * i + 1, _DIGITS), 16, 10).cast("long").alias(lane) for i, lane in enumerate(LANES)]


def hashed(rows: DataFrame, table: Table) -> DataFrame:
    """block_id, n_rows and lanes of rows that have a block_id. Values become texts, texts a digest and the digest lanes in steps of
    their own: in one step Spark computes each again wherever it is used, in methods too long to be compiled."""
    columns = [*table.key, *table.columns(rows.drop("block_id"))]
    texts = rows.select("block_id", *[canonical(rows, c).alias(c) for c in columns])
    digests = texts.select("block_id", F.sha2(row_text(texts, columns), 256).alias("digest"))
    return digests.select("block_id", *lanes(F.col("digest"))).groupBy("block_id").agg(F.count("*").alias("n_rows"), *[F.bit_xor(x).alias(x) for x in LANES])


def _filled(blocks: DataFrame, found: DataFrame) -> DataFrame:
    joined = blocks.select("block_id").join(found, "block_id", "left")
    return joined.select(F.col("block_id").alias("node_position"), *[F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in HASH])


def leaves(df: DataFrame, table: Table, ranges: DataFrame) -> DataFrame:
    """node_position, n_rows and the lanes of each block."""
    return _filled(ranges, hashed(assign(df, list(table.key), ranges), table))


def height(n_leaves: int) -> int:
    """The level of the root."""
    return math.ceil(math.log2(max(n_leaves, 1)))


def build(leaf: DataFrame, n_leaves: int) -> DataFrame:
    """All levels, node_level 0 the leaves; a parent's position is half of its children's. Each leaf counts
    once at each of log2(n_leaves) levels, in one aggregate."""
    level = F.explode(F.sequence(F.lit(0), F.lit(height(n_leaves)))).alias("node_level")
    each = leaf.select(level, "node_position", *HASH)
    up = F.expr("shiftright(node_position, node_level)").alias("node_position")
    return each.groupBy("node_level", up).agg(F.sum("n_rows").alias("n_rows"), *[F.bit_xor(x).alias(x) for x in LANES])


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    key = ["node_level", "node_position"]
    side = lambda t, n: t.select(*key, F.struct(*HASH).alias(n))
    return side(left, "a").join(side(right, "b"), key, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(*key)


def mismatched(left: DataFrame, right: DataFrame, root_level: int | None = None) -> DataFrame:
    """The leaves whose hashes differ, or that one side lacks. With ``root_level`` the roots are compared
    first: equal ones read no leaf. Below them leaves are compared as such in one join, whose rows are
    leaves; a walk level by level would be a job for each level."""
    if root_level is not None:
        top = F.col("node_level") == root_level
        if differing(left.where(top), right.where(top)).isEmpty():
            return left.where("false").select("node_position")
    return differing(left.where("node_level = 0"), right.where("node_level = 0")).select("node_position")


def walk(tree: DataFrame, root_level: int) -> DataFrame:
    """node_level, node_position and path (positions from the root) in the order of a depth-first walk."""
    steps = F.expr(f"transform(sequence(0, {root_level} - node_level), i -> lpad(cast(shiftright(node_position, {root_level} - node_level - i) as string), 10, '0'))")
    return tree.select("node_level", "node_position", F.array_join(steps, "/").alias("path"))


def counters(changes: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """From changes (op, key): per block the inserts, deletes and updates."""
    at = assign(changes, [key], ranges)
    count = lambda op: F.sum((F.col("op") == op).cast("long"))
    return at.groupBy("block_id").agg(count("INSERT").alias("inserts"), count("DELETE").alias("deletes"), count("UPDATE").alias("updates"))


def extended(ranges: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The ranges, with the first one's start moved down to the least key of ``changes`` below it."""
    kind = ranges.schema["range_start"].dataType
    least = changes.where("op <> 'TRUNCATE'").agg(F.min(F.struct(*key)).cast(kind).alias("least"))
    start = F.when(F.col("block_id") == 0, F.least("range_start", F.coalesce("least", "range_start"))).otherwise(F.col("range_start"))
    return ranges.join(F.broadcast(least)).withColumn("range_start", start).drop("least")  # one row


def escalates(changes: DataFrame, total_rows: int) -> bool:
    """Whether so many rows were updated that all leaves are to be hashed again; a TRUNCATE always does."""
    n = changes.agg(F.sum((F.col("op") == "UPDATE").cast("long")).alias("u"), F.sum((F.col("op") == "TRUNCATE").cast("long")).alias("t")).first()
    return bool(n["t"]) or (n["u"] or 0) >= max(ESCALATE_LEAST, ESCALATE_SHARE * total_rows)


def mark(tree: DataFrame, counted: DataFrame, everything: bool = False) -> DataFrame:
    """Leaves with their counters added; those with changes, or all, become dirty."""
    c = counted.select(F.col("block_id").alias("b"), "inserts", "deletes")
    joined = tree.join(c, F.col("node_position") == F.col("b"), "left")
    return joined.withColumn("dirty", F.lit(True) if everything else F.col("b").isNotNull()).na.fill(0, ["inserts", "deletes"]).drop("b")


def split(df: DataFrame, key: list[str], ranges: DataFrame, counted: DataFrame, block_size: int) -> DataFrame:
    """The ranges after splitting: blocks with enough inserts and more rows than block_size are cut at each
    block_size-th row, but not so that a bounded block leaves a sliver at its end. ``old`` is the block
    that a range was, null where it is one of several parts now."""
    candidates = counted.where(F.col("inserts") >= SPLIT_SHARE * block_size).select("block_id")
    rows = in_ranges(df.select(*key), key, ranges, candidates)
    by = Window.partitionBy("block_id")
    ranked = rows.select("block_id", F.struct(*key).alias("k")).withColumn("i", F.row_number().over(by.orderBy("k"))).withColumn("n", F.count("*").over(by))
    cut = ranked.where((F.col("n") > block_size) & (F.col("i") > 1) & ((F.col("i") - 1) % block_size == 0))
    ends = cut.join(ranges.select("block_id", F.col("range_end").isNull().alias("open")), "block_id")
    kept = written(ends.where(F.col("open") | (F.col("n") - F.col("i") + 1 >= SLIVER_SHARE * block_size)).select("block_id", "k"), "cuts")
    whole = ranges.join(kept.select(F.col("block_id").alias("c")).distinct(), F.col("block_id") == F.col("c"), "left")
    old = F.when(F.col("c").isNull(), F.col("block_id"))
    return resequenced(whole.select("range_start", old.alias("old")).unionByName(kept.select(F.col("k").alias("range_start"), F.lit(None).cast("long").alias("old"))))


def resequenced(starts: DataFrame) -> DataFrame:
    """Blocks numbered by their starts, with what stands beside these."""
    from .ranks import ranked

    others = [c for c in starts.columns if c != "range_start"]
    numbered = ranked(starts, ["range_start"])[0].select((F.col("rank") - 1).cast("long").alias("block_id"), "range_start", *others)
    return closed(numbered).join(numbered.select("block_id", *others), "block_id") if others else closed(numbered)


def merge_once(sized: DataFrame, block_size: int) -> DataFrame:
    """One round over (part, block_id, range_start, n_rows): a small leaf takes in its successor if both stay below
    the limit. From the left, a leaf that was taken in takes in none.

    Whether a leaf is taken in is one bit that runs through all leaves. Each part is folded by itself: where all of
    its leaves could take in their successors, it flips the bit or passes it on, else it sets it, whatever came before.
    Only these folds, one row for each part, are put in order in one place; then each part knows its first bit."""
    inside, parts = Window.partitionBy("part").orderBy("block_id"), Window.orderBy("part")
    firsts = sized.groupBy("part").agg(F.min_by("n_rows", "block_id").alias("first"))
    border = firsts.select("part", F.lead("first").over(parts).alias("border"))
    rows = sized.join(border, "part").withColumn("follow", F.coalesce(F.lead("n_rows").over(inside), "border"))
    can = (F.col("n_rows") < SLIVER_SHARE * block_size) & (F.col("n_rows") + F.col("follow") < MERGE_SHARE * block_size)
    flagged = rows.withColumn("can", F.coalesce(can, F.lit(False)))
    runs = flagged.withColumn("run", F.coalesce(F.sum((~F.col("can")).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    odd = F.row_number().over(Window.partitionBy("part", "run").orderBy("block_id")) % 2 == 1
    turned = written(runs.withColumn("odd", odd), "runs")
    folds = turned.groupBy("part").agg(F.max((~F.col("can")).cast("int")).alias("sets"), F.max_by((F.col("can") & F.col("odd")).cast("int"), "block_id").alias("bit"))
    since = folds.withColumn("since", F.sum("sets").over(parts))
    out = since.withColumn("out", F.sum("bit").over(Window.partitionBy("since").orderBy("part")) % 2)
    known = turned.join(out.select("part", F.coalesce(F.lag("out").over(parts), F.lit(0)).alias("comes")), "part")
    take = F.col("can") & (F.col("odd") != ((F.col("comes") == 1) & (F.col("run") == 0)))
    taking = known.withColumn("take", take).withColumn("gone", F.coalesce(F.lag("take").over(inside), F.col("comes") == 1))
    return taking.where("NOT gone").select("part", "block_id", "range_start", (F.col("n_rows") + F.when(F.col("take"), F.col("follow")).otherwise(0)).alias("n_rows"))


def merged(sized: DataFrame, block_size: int, most_rounds: int = 64, per_part: int = LEAVES_IN_PART) -> DataFrame:
    """Rounds of merging until none changes anything. A leaf at least doubles with each merge it takes part
    in, so rounds are few; if they do not end, that is an error. Leaves are dealt over parts of ``per_part`` neighbours."""
    now = written(sized.select(F.expr(f"block_id div {int(per_part)}").alias("part"), "block_id", "range_start", "n_rows"), "leaves")
    n = now.count()
    for _ in range(most_rounds):
        now = written(merge_once(now, block_size), "leaves")
        m = now.count()
        if m == n:
            before = now.groupBy("part").agg(F.count("*").alias("m")).select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("before"))
            place = F.row_number().over(Window.partitionBy("part").orderBy("block_id")) - 1
            done = now.join(before, "part").select((F.col("before") + place).cast("long").alias("block_id"), "range_start", "n_rows")
            return closed(done.select("block_id", "range_start")).join(done.select("block_id", "n_rows"), "block_id")
        n = m
    raise RuntimeError(f"merging did not settle in {most_rounds} rounds")


def refreshed(tree: DataFrame, df: DataFrame, table: Table, ranges: DataFrame, dirty: DataFrame) -> DataFrame:
    """The leaves of a tree, with those of ``dirty`` (node_position) hashed again from the table; the rows
    of clean leaves are not hashed, and for few dirty ones not read."""
    stale = dirty.select(F.col("node_position").alias("block_id")).distinct()
    fresh = _filled(stale, hashed(in_ranges(df, list(table.key), ranges, stale), table))
    kept = tree.where("node_level = 0").join(stale, F.col("node_position") == F.col("block_id"), "left_anti").select("node_position", *HASH)
    return kept.unionByName(fresh)


def narrowed(left: DataFrame, right: DataFrame, table: Table, ranges: DataFrame, bad: DataFrame, unit: int) -> DataFrame:
    """The pieces of at most ``unit`` keys of the mismatched blocks that differ themselves: block_id,
    range_start, range_end. Only the rows of the mismatched blocks are looked at."""
    key = list(table.key)
    a, b = (written(in_ranges(df, key, ranges, bad).drop("block_id"), "mismatched") for df in (left, right))
    parts = pieces(a.select(*key).unionByName(b.select(*key)), key, ranges, bad, unit).drop("block_id")
    numbered = resequenced(parts.withColumnRenamed("range_end", "end"))
    now = written(numbered.select("block_id", "range_start", F.col("end").alias("range_end")), "parts")
    sides = [hashed(assign(x, key, now), table).select("block_id", F.struct(*HASH).alias(k)) for x, k in ((a, "a"), (b, "b"))]
    wrong = sides[0].join(sides[1], "block_id", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("block_id")
    return now.join(wrong, "block_id", "left_semi")


def within(df: DataFrame, key: list[str], ranges: DataFrame) -> DataFrame:
    """The rows that lie in one of the ranges, which may have gaps between them."""
    met = assign(df, key, ranges).join(ranges.select("block_id", F.col("range_end").alias("__end")), "block_id")
    return met.where(F.col("__end").isNull() | (F.struct(*key) < F.col("__end"))).drop("block_id", "__end")

