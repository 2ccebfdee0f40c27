"""Key ranges: boundaries from exact ranks, assignment of rows, hashes of blocks, cuts and unions.

Keys are of any type and number of columns that can be ordered. A range is [range_start, range_end), both
structs of the key; the last one is open, and keys before the first one belong to it.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import EMPTY_BLOCK, JOINER, row_text
from ..sources.shared import written
from .ranks import last_before, ranked, running

#: Share of rows that is sampled for boundaries, by the number of rows (fixed values).
SAMPLE_SHARES = ((100_000_000, 0.0001), (1_000_000, 0.001), (100_000, 0.01), (10_000, 0.1))
#: Most bounds that are sent to each task; with more, rows and bounds are sorted together.
MOST_BOUNDS = 100_000
#: Most ranges that make up one filter of a scan.
MOST_RANGES = 200
#: Most wide runs of blocks that a filter gives to the scan.
MOST_RUNS = 16


def sample_share(rows: int) -> float:
    return next((share for least, share in SAMPLE_SHARES if rows > least), 1.0)


def n_blocks(most_rows: int, block_size: int) -> int:
    return max(1, math.ceil(most_rows / block_size)) if most_rows else 0


def anchor(counts: dict[str, int]) -> str:
    """The node with most rows; by name where several have."""
    return min(counts, key=lambda x: (-counts[x], x))


def boundaries(df: DataFrame, key: list[str], blocks: int, sampled: bool = False, seed: int = 7) -> DataFrame:
    """block_id, range_start, range_end: ``blocks`` ranges of as equal numbers of rows as can be, the first
    ones larger by one. With ``sampled`` the ranks are those of a sample whose share follows the number
    of rows; the true first key is added to it."""
    keys = df.select(F.struct(*key).alias("range_start"))
    if sampled and (share := sample_share(df.count())) < 1:
        keys = keys.sample(share, seed).unionByName(keys.agg(F.min("range_start").alias("range_start"))).distinct()
    return _cut(keys, blocks)


def file_sample(df: DataFrame, share: float, seed: int = 7, least: int = 1) -> tuple[DataFrame, float]:
    """The rows of about ``share`` of the files that ``df`` reads, but of ``least`` files at least, and the share of files that this
    is. Files are picked by a hash of their path, and Spark leaves out all others when it lists them: they are never opened."""
    files = sorted(df.inputFiles(), key=lambda f: hashlib.sha256(f"{seed}/{f}".encode()).digest())
    some = files[: max(least, math.ceil(share * len(files)))]
    if len(some) == len(files):
        return df, 1.0
    names = [f.rsplit("/", 1)[-1] for f in some]
    return df.where(F.col("_metadata.file_name").isin(names)), len(some) / len(files)


def boundaries_by_files(df: DataFrame, key: list[str], block_size: int, share: float = 0.01, seed: int = 7, least: int = 16) -> DataFrame:
    """Ranges of about ``block_size`` rows from the keys of a share of the files (``file_sample``): the others are neither read
    nor counted. The number of rows is that of the sample by its share, so the files should be of like size and each a
    sample of the keys; where each file is a key range of its own, use ``boundaries``. Keys before the first range belong to it."""
    some, of = file_sample(df, share, seed, least)
    keys = written(some.select(F.struct(*key).alias("range_start")), "keys")
    return _cut(keys.distinct(), n_blocks(round(keys.count() / of), block_size))


def _cut(keys: DataFrame, blocks: int) -> DataFrame:
    rows, n = ranked(keys, ["range_start"])
    if not n:
        return rows.select(F.lit(0).cast("long").alias("block_id"), "range_start", F.col("range_start").alias("range_end"))
    size, more = divmod(n, max(1, min(blocks, n)))
    at, large = F.col("rank") - 1, more * (size + 1)  # so many rows are in the larger ranges
    inside = F.when(at < large, at % (size + 1)).otherwise((at - large) % size)
    number = F.when(at < large, F.floor(at / (size + 1))).otherwise(more + F.floor((at - large) / size))
    return closed(rows.where(inside == 0).select(number.cast("long").alias("block_id"), "range_start"))


def closed(starts: DataFrame) -> DataFrame:
    """Starts numbered without gaps as ranges: each ends where the next one starts."""
    after = starts.select((F.col("block_id") - 1).alias("block_id"), F.col("range_start").alias("range_end"))
    return starts.join(after, "block_id", "left").select("block_id", "range_start", "range_end")


def _bounds(ranges: DataFrame, n: int) -> Column:
    """All bounds in order, as one value of the plan: ``groups`` of about sqrt(n) neighbours, each with its starts and the blocks
    they open, and the first ``start`` of each group."""
    size = math.isqrt(n - 1) + 1
    every = ranges.agg(F.sort_array(F.collect_list(F.struct("range_start", "block_id"))).alias("t"))
    cut = lambda c, i: F.slice(F.col(f"t.{c}"), i * size + 1, F.lit(size))
    groups = F.transform(F.sequence(F.lit(0), F.lit((n - 1) // size)), lambda i: F.struct(cut("range_start", i).alias("start"), cut("block_id", i).alias("block")))
    return every.select(groups.alias("g")).select(F.struct(F.transform("g", lambda x: F.get(x["start"], F.lit(0))).alias("start"), F.col("g").alias("groups")).alias("t")).scalar()


def _last_upto(starts: Column, n: int, key: Column) -> Column:
    """The place of the last of at most n sorted ``starts`` that is not above ``key``, by binary search; 0 if none is."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    least = lambda p, s: F.coalesce(F.get(starts, p + s - 1) <= key, F.lit(False))
    upto = F.aggregate(steps, F.lit(0), lambda p, s: F.when(least(p, s), p + s).otherwise(p))
    return F.greatest(upto - 1, F.lit(0))


def assign(df: DataFrame, key: list[str], ranges: DataFrame, most_bounds: int | None = None) -> DataFrame:
    """Each row with its block_id. Up to MOST_BOUNDS ranges, which are counted, rows stay where they are and find their range
    by binary search, first the group of bounds and then the one in it: what Spark copies beside a row are these two lists of
    sqrt(n) bounds, never all. Beyond that rows and bounds meet in one order."""
    n, kind = ranges.count(), ranges.schema["range_start"].dataType
    if not n:
        return df.limit(0).withColumn("block_id", F.lit(None).cast("long"))
    own = F.struct(*key).cast(kind)
    if n <= (MOST_BOUNDS if most_bounds is None else most_bounds):
        bounds, most = _bounds(ranges, n), math.isqrt(n - 1) + 1
        first = df.withColumn("__starts", bounds["start"]).withColumn("__group", _last_upto(F.col("__starts"), most, own))
        near = first.withColumn("__near", F.get(bounds["groups"], F.col("__group"))).drop("__starts", "__group")
        found = F.get(F.col("__near")["block"], _last_upto(F.col("__near")["start"], most, own))
        return near.withColumn("block_id", F.coalesce(found, F.lit(0).cast("long"))).drop("__near")  # never null: joins by it need no filter, which would search again
    return last_before(df.withColumn("range_start", own), ranges, "range_start", "block_id").drop("range_start")


def in_ranges(df: DataFrame, key: list[str], ranges: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of the chosen blocks (block_id), with their block_id. Up to MOST_RANGES blocks are a filter
    on the first key column that reaches the scan; it may hold a few rows more, which are left out then."""
    picked = ranges.join(chosen.select("block_id").distinct(), "block_id", "left_semi")
    few = picked.orderBy("range_start").limit(MOST_RANGES + 1).collect()
    if len(few) > MOST_RANGES:
        return assign(df, key, ranges).join(picked.select("block_id"), "block_id", "left_semi")
    first = ranges.agg(F.min("range_start").alias("s")).first()["s"]
    c, kind = F.col(key[0]), df.schema[key[0]].dataType
    wanted, runs = [], []
    for r in few:  # neighbours make one condition
        if runs and runs[-1][1] == r["range_start"]:
            runs[-1][1] = r["range_end"]
        else:
            runs.append([None if r["range_start"] == first else r["range_start"], r["range_end"]])
    for start, end in runs:
        low = F.lit(True) if start is None else c >= F.lit(start[0]).cast(kind)
        wanted.append(low if end is None else low & (c <= F.lit(end[0]).cast(kind)))
    near = df.where(reduce(Column.__or__, wanted, F.lit(False)))
    return assign(near, key, ranges).where(F.col("block_id").isin([r["block_id"] for r in few]))


def near_ranges(df: DataFrame, key: list[str], ranges: DataFrame, chosen: DataFrame, most: int = MOST_RUNS, most_chosen: int = 10_000) -> DataFrame:
    """The rows of the chosen blocks, and some at their ends: for comparisons, in which rows that are equal vanish, so long as all
    sides are cut alike. It is a filter on the first key column alone: ``most`` wide runs of blocks that reach the scan, and inside
    them a binary search over the runs of neighbours, written as nested conditions. Beyond ``most_chosen`` blocks all rows stay."""
    picked = ranges.join(chosen.select("block_id").distinct(), "block_id", "left_semi")
    few = picked.orderBy("block_id").limit(most_chosen + 1).collect()
    if len(few) > most_chosen:
        return df
    if not few:
        return df.where("false")
    c, kind = F.col(key[0]), df.schema[key[0]].dataType
    cuts = [k for k in range(1, len(few)) if few[k]["block_id"] - few[k - 1]["block_id"] > 1]
    wide = sorted(sorted(cuts, key=lambda k: (few[k - 1]["block_id"] - few[k]["block_id"], k))[: most - 1])

    def bounds(at: list[int]) -> list[tuple[Column | None, Column | None]]:
        runs = [(few[a], few[b - 1]["range_end"]) for a, b in zip([0, *at], [*at, len(few)], strict=True)]
        return [(None if low["block_id"] == 0 else F.lit(low["range_start"][0]).cast(kind), None if high is None else F.lit(high[0]).cast(kind)) for low, high in runs]

    def inside(low: Column | None, high: Column | None) -> Column:
        above = F.lit(True) if low is None else c >= low
        return above if high is None else above & (c <= high)

    def search(runs: list[tuple[Column | None, Column | None]]) -> Column:
        if len(runs) == 1:
            return inside(*runs[0])
        half = len(runs) // 2
        return F.when(c < runs[half][0], search(runs[:half])).otherwise(search(runs[half:]))

    near = df.where(reduce(Column.__or__, [inside(*x) for x in bounds(wide)]))
    return near if wide == cuts else near.where(search(bounds(cuts)))


def block_hashes(df: DataFrame, key: list[str], columns: list[str], ranges: DataFrame, mode: str = "compat") -> DataFrame:
    """block_id and the hash of each block's rows in key order; blocks without rows have a hash, too. A
    block's rows are gathered, as their text is hashed in order: blocks are to be cut by a block size."""
    rows = assign(df, key, ranges)
    text = row_text(df, [*key, *columns], mode)
    gathered = rows.groupBy("block_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.struct(*key).alias("k"), text.alias("t")))), lambda x: x["t"]), JOINER).alias("t"))
    return ranges.select("block_id").join(gathered, "block_id", "left").select("block_id", F.sha2(F.coalesce("t", F.lit(EMPTY_BLOCK)), 256).alias("block_hash"))


def mismatched_blocks(hashes: dict[str, DataFrame]) -> DataFrame:
    """pair, block_id of all blocks whose hashes differ between two nodes: one pass over all nodes."""
    every = reduce(DataFrame.unionByName, [h.select("block_id", F.lit(n).alias("node"), "block_hash") for n, h in hashes.items()])
    pivoted = every.groupBy("block_id").pivot("node", sorted(hashes)).agg(F.first("block_hash"))
    names = sorted(hashes)
    pairs = [F.when(~F.col(a).eqNullSafe(F.col(b)), F.lit(f"{a}/{b}")) for i, a in enumerate(names) for b in names[i + 1 :]]
    return pivoted.select("block_id", F.explode(F.array_compact(F.array(*pairs))).alias("pair"))


def pieces(df: DataFrame, key: list[str], ranges: DataFrame, chosen: DataFrame, unit: int) -> DataFrame:
    """The chosen ranges cut at each ``unit``-th key of ``df``, in one pass instead of halving again and
    again: range_start, range_end, block_id of the range that each was part of. Ranks are within a block."""
    rows = in_ranges(df.select(*key).distinct(), key, ranges, chosen).select("block_id", F.struct(*key).alias("k"))
    by = Window.partitionBy("block_id").orderBy("k")
    starts = rows.withColumn("i", F.row_number().over(by)).where((F.col("i") > 1) & ((F.col("i") - 1) % unit == 0)).select("block_id", F.col("k").alias("start"))
    picked = ranges.join(chosen.select("block_id").distinct(), "block_id", "left_semi")
    every = starts.unionByName(picked.select("block_id", F.col("range_start").alias("start"))).join(picked.select("block_id", "range_end"), "block_id")
    after = F.lead("start").over(Window.partitionBy("block_id").orderBy("start"))
    return every.select(F.col("start").alias("range_start"), F.coalesce(after, F.col("range_end")).alias("range_end"), "block_id")


def split_points(df: DataFrame, key: str, every: int) -> DataFrame:
    """Each ``every``-th key in order."""
    return ranked(df.select(key), [key])[0].where((F.col("rank") > 1) & ((F.col("rank") - 1) % every == 0)).select(F.col(key).alias("split_key"))


def interval_union(ranges: DataFrame) -> DataFrame:
    """The elementary slices between all bounds of (range_start, range_end) that lie in any range: the
    running balance of starts and ends is positive inside one."""
    events = ranges.select(F.inline(F.array(F.struct(F.col("range_start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("range_end").alias("at"), F.lit(-1).alias("d"))))).where("at IS NOT NULL")
    depth = running(events.groupBy("at").agg(F.sum("d").alias("d")), "at", "d")
    return depth.where("total > 0").select(F.col("at").alias("slice_start"), F.col("next").alias("slice_end"))
