"""Near-duplicates by min-max hashing (operator 2).

A document's set is its distinct shingles. Each of the permutations gives the set's least and its largest
value: two sketch entries from one evaluation, each of which two sets share with a chance equal to their
Jaccard similarity. Two permutations, so four entries, make a band; documents that share a band are
candidates.

Exact copies (equal sets) are one class with one representative before anything is paired. Each
representative is paired with the least of its buckets' least members only; the pairs are confirmed on the
full sets, and links give components. Where a bucket still holds several components, its members are
written as their differences D from one reference, the first member of its largest component, which give
the similarity of any two. All are compared with that member and with the one closest to it. What is left
are pairs of different components. Two sets that are similar enough differ in few shingles, so

- if one of them is further from the reference than NEAR times what such a difference can be, both must share one of the
  rarest shingles of their D (prefix filtering): as many as a similar set may lack, and one more. Pairs that
  share one, with enough others behind it in both, are candidates, each once;
- if both are closer than that, the one that is not in the reference's component lies in a shell below the
  limit. They are compared with all close ones of the same reference, dealt over many tasks, in a join
  that emits links only.

No link between different components is lost, and m similar documents cost m pairs, not m * m; neither do
m unlike documents of one bucket, whose rarest shingles are their own. With 32 bands of four entries, a
pair at similarity 0.85 shares no band with a chance of 6e-11 (0.8: 5e-8). The rows of one bucket, class or
hub are dealt over many tasks wherever they meet.

A-Z are lowered; words are separated by blanks and ASCII controls. With fewer words than a shingle has,
the whole sequence is the one shingle; null, empty and blank texts have no set and are linked with
nothing. Rows of equal id are one node: in ``classes`` they share the component, and all of them are kept
or none. A null id is linked with nothing, has a null component and is kept. ``filtered`` keeps one row of
each group: of rows with the kept id the first by text, and of rows without an id one of each set. Extra
columns are not read. An empty table gives an empty result. A very long text is one row of one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, free_name, salts, written
from .components import components

PERMUTATIONS, PER_BAND = 64, 2
#: Shingles for which all permutations are evaluated at once; characters of texts that are hashed at once.
BLOCK, TEXT_BLOCK = 8192, 1 << 20
#: Rows of one key that a task compares with the minor ones of the key.
PART_ROWS = 2000
#: How often the difference that similar sets may have makes a set far from a reference; 1 at least.
NEAR = 6

_MUL = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """The words with A-Z lowered. Bytes are split at, and lowered in, just the ASCII characters meant."""
    return (text or "").encode().lower().split()


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Of many texts at once: the hashes of all words in order, where each word starts in the joined
    bytes, where each text starts in these, and the joined bytes, in which texts end with a line feed."""
    raw = [(t or "").encode().lower() for t in texts]
    whole = b"\n".join([*raw, b""])
    offsets = np.cumsum([0, *(len(r) + 1 for r in raw)])
    b = np.frombuffer(whole, np.uint8)
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, offsets, whole
    first = np.cumsum(lengths) - lengths
    at = np.arange(lengths.sum()) - np.repeat(first, lengths)
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(lengths.max()) - 1, _MUL, np.uint64)]), dtype=np.uint64)
    letters = b[inside].astype(np.uint64) + np.uint64(1)
    return mixed(np.add.reduceat(letters * powers[at], first) ^ lengths.astype(np.uint64)), starts, offsets, whole


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes."""
    with np.errstate(over="ignore"):
        h, starts, offsets, _ = word_hashes(texts)
        bounds = np.searchsorted(starts, offsets)
        every = np.full(max(len(h) - size + 1, 0), np.uint64(size))
        for k in range(size):
            every = every * _MUL + h[k : k + len(every)]
        every, out = mixed(every), []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi - lo >= size:
                out.append(np.unique(every[lo : hi - size + 1]))
            elif hi > lo:
                s = np.uint64(hi - lo)
                for k in range(lo, hi):
                    s = s * _MUL + h[k]
                out.append(mixed(np.array([s])))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def _constants(permutations: int) -> np.ndarray:
    rng = np.random.default_rng(20_240_229)
    return rng.integers(0, 2**63, (2, permutations), np.uint64) | np.uint64(1)


def bands(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The band hashes of each set (none is empty): sets by bands."""
    sizes = np.array([len(s) for s in sets])
    low, high = np.full((len(a), len(sets)), np.uint64(2**64 - 1)), np.zeros((len(a), len(sets)), np.uint64)
    whole, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    for k in range(0, len(whole), BLOCK):
        values = a[:, None] * whole[None, k : k + BLOCK] + b[:, None]
        here = owner[k : k + BLOCK]
        cuts = np.flatnonzero(np.diff(here, prepend=-1))
        first, last = here[0], here[-1] + 1
        low[:, first:last] = np.minimum(low[:, first:last], np.minimum.reduceat(values, cuts, 1))
        high[:, first:last] = np.maximum(high[:, first:last], np.maximum.reduceat(values, cuts, 1))
    both = np.stack([low, high], 1).reshape(-1, 2 * PER_BAND, len(sets))
    out = np.repeat(np.arange(1, len(both) + 1, dtype=np.uint64)[:, None], len(sets), 1)
    for k in range(2 * PER_BAND):
        out = mixed(out * _MUL + both[:, k])
    return out.T.copy().view(np.int64)


def blocks_of(frame: pd.DataFrame, columns: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of rows with about TEXT_BLOCK characters, so that arrays stay small."""
    at = frame[columns[0]].str.len().fillna(0)
    for c in columns[1:]:
        at = at + frame[c].str.len().fillna(0)
    for _, part in frame.groupby((at.cumsum() // TEXT_BLOCK).to_numpy(), sort=False):
        yield part.reset_index(drop=True)


def sketches(documents: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text", permutations: int = PERMUTATIONS) -> DataFrame:
    """doc_id, n (size of the set), h1 and h2 (hashes of the whole set), bands."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _constants(permutations)
        for part in (p for frame in frames for p in blocks_of(frame, ["text"])):
            sets = shingle_sets(part["text"].tolist(), size)
            full = [k for k, s in enumerate(sets) if len(s)]
            with np.errstate(over="ignore"):
                made = bands([sets[k] for k in full], a, b) if full else np.empty((0, 0))
                rank = np.arange(1, max(map(len, sets), default=0) + 1, dtype=np.uint64) * b[0]
                h1 = np.array([mixed(s ^ a[0]).sum(dtype=np.uint64) for s in sets], np.uint64)
                h2 = np.array([mixed(s + rank[: len(s)]).sum(dtype=np.uint64) for s in sets], np.uint64)
            of = dict(zip(full, list(made), strict=True))
            yield pd.DataFrame({"doc_id": part["doc_id"], "n": [len(s) for s in sets], "h1": h1.view(np.int64), "h2": h2.view(np.int64), "bands": [of.get(k, []) for k in range(len(sets))]})

    return docs.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, h1 long, h2 long, bands array<long>")


def compared(pairs: DataFrame, documents: DataFrame, size: int, percent: int, doc_id: str, text: str, differences: bool = False) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; or, with ``differences``, all pairs as a, x
    (which text of a), b, n_a, n_b, lost (what a has and b has not) and added. Texts travel once to each
    pair; the pairs of one node are dealt over many tasks."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()  # grows with the input: never broadcast
    docs = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    texts = docs.join(ids.hint("merge"), "id", "left_semi").withColumn("x", F.xxhash64("text")).dropDuplicates(["id", "x"])
    one = pairs.select("a", "b").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    dealt = pairs.groupBy("a").agg(salts(["b"])).hint("merge")  # from the pairs, which have no texts yet
    both = beside(one, texts.select(F.col("id").alias("a"), "x", F.col("text").alias("text_a")).join(dealt, "a"), ["a"], ["b"]).select("a", "x", "b", "text_a", "text_b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (p for frame in frames for p in blocks_of(frame, ["text_a", "text_b"])):
            rows = []
            firsts, index = np.unique(part["text_a"].fillna("").to_numpy(object), return_inverse=True)
            sets_a, sets_b = shingle_sets(firsts.tolist(), size), shingle_sets(part["text_b"].tolist(), size)
            for k, (a, x, b) in enumerate(part[["a", "x", "b"]].itertuples(index=False)):
                s, t = sets_a[index[k]], sets_b[k]
                if differences:
                    lost, added = np.setdiff1d(s, t, assume_unique=True), np.setdiff1d(t, s, assume_unique=True)
                    rows.append((a, x, b, len(s), len(t), lost.view(np.int64), added.view(np.int64)))
                else:
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * common >= percent * (len(s) + len(t) - common):
                        rows.append((a, b))
            yield pd.DataFrame(rows, columns=["a", "x", "b", "n_a", "n_b", "lost", "added"] if differences else ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    if differences:
        return both.mapInPandas(run, f"a {kind}, x long, b {kind}, n_a long, n_b long, lost array<long>, added array<long>")
    return both.mapInPandas(run, f"a {kind}, b {kind}").distinct()


def linked(members: DataFrame, documents: DataFrame, size: int, percent: int, doc_id: str, text: str, one_text: bool = False) -> DataFrame:
    """Confirmed links (a, b) that give the components of all pairs that share a bucket; ``members`` has
    key, id and n, once for each key and id. With ``one_text`` all rows of an id have the same text: each
    task keeps one of them before anything is moved."""
    # the texts of the members alone: the others are moved once and not again
    ids = members.select("id").distinct().hint("merge")
    texts = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    found = texts.dropDuplicates(["id"]).join(ids, "id") if one_text else texts.join(ids, "id", "left_semi").dropDuplicates(["id", "text"])
    documents, doc_id, text = written(found, "member-texts"), "id", "text"

    # first, each member with one pivot: the least of all members that are the least of a bucket of its
    firsts = members.groupBy("key").agg(F.min(F.struct("id", "n")).alias("p"), salts(["id"]))
    met = beside(members, firsts, ["key"], ["id"]).where(f"id <> p.id AND 100 * least(n, p.n) >= {int(percent)} * greatest(n, p.n)")
    pairs = written(met.groupBy(F.col("id").alias("b")).agg(F.min("p.id").alias("a")), "pairs")
    links = written(compared(pairs, documents, size, percent, doc_id, text), "links")

    # then what is left between components, as differences from the first member of the largest one of
    # each bucket; buckets of two that were compared are done
    held = written(members.join(components(links, "a", "b"), F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("c")), "held")
    open_ = held.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.min("id").alias("i1"), F.max("id").alias("i2"), F.count("*").alias("m"), salts(["id"])).where("c1 < c2")
    compared_ = pairs.select(F.col("a").alias("i1"), F.col("b").alias("i2"), F.lit(2).cast("long").alias("m"))
    undone = open_.join(compared_, ["i1", "i2", "m"], "left_anti").select("key", "_salts")
    largest = held.groupBy("key", "c").count().groupBy("key").agg(F.min(F.struct((-F.col("count")).alias("m"), "c")).alias("top"))
    refs = undone.join(largest, "key").select("key", F.col("top.c").alias("ref"), "_salts")
    placed = written(beside(held, refs, ["key"], ["id"]).select("ref", "id").distinct(), "placed")
    away = written(compared(placed.where("id <> ref").select(F.col("ref").alias("a"), F.col("id").alias("b")), documents, size, percent, doc_id, text, True), "differences")
    none = F.array().cast("array<long>")
    here = away.select("a", "x", F.col("a").alias("b"), "n_a", F.col("n_a").alias("n_b"), none.alias("lost"), none.alias("added")).dropDuplicates(["a", "x"])
    known = away.unionByName(here)
    side = lambda k: [F.col("b").alias(f"id_{k}"), F.col("n_b").alias(f"n_{k}"), F.col("lost").alias(f"lost_{k}"), F.col("added").alias(f"added_{k}")]
    # two sets that differ from a third one by known values have a known intersection
    common = "n_a - size(array_union(lost_1, lost_2)) + size(array_intersect(added_1, added_2))"
    near = f"100 * least(n_1, n_2) >= {int(percent)} * greatest(n_1, n_2) AND {100 + int(percent)} * ({common}) >= {int(percent)} * (n_1 + n_2)"
    pair = lambda j: j.select(F.least("id_1", "id_2").alias("a"), F.greatest("id_1", "id_2").alias("b"))

    # all with that one, and with the one that differs from it least, which links most of a group
    apart = F.size("lost") + F.size("added")
    closest = away.groupBy("a", "x").agg(F.min(F.struct(apart.alias("apart"), "b", "n_b", "lost", "added")).alias("p")).select("a", "x", "p.*")
    pivots = here.unionByName(closest.join(here.select("a", "x", "n_a"), ["a", "x"]).drop("apart"))
    dealt = away.groupBy("a", "x").agg(salts(["b", "n_b"])).hint("merge")
    met = beside(away.select("a", "x", *side(2)), pivots.select("a", "x", "n_a", *side(1)).join(dealt, ["a", "x"]), ["a", "x"], ["id_2", "n_2"])
    links = written(links.unionByName(pair(met.where(f"id_1 <> id_2 AND {near}")).distinct()), "links")

    # the rest between components
    joined = components(links, "a", "b").withColumnRenamed("component", "c")
    comp = placed.select(F.col("ref").alias("a"), F.col("id").alias("b")).join(joined.withColumnRenamed("node", "b"), "b", "left").join(joined.select(F.col("node").alias("a"), F.col("c").alias("top")), "a", "left")
    sorted_out = written(comp.select("a", "b", F.coalesce("c", "b").alias("c"), (F.coalesce("c", "b") != F.coalesce("top", "a")).alias("minor")), "sorted")
    lack = F.floor(F.lit(100 - int(percent)) * F.col("n_b") / int(percent))  # the most by which a similar set may differ
    if sorted_out.where("minor").isEmpty():
        return links
    which = {"v": F.xxhash64("lost", "added"), "lack": lack, "d": F.size("lost") + F.size("added")}  # v: which text of b
    some = sorted_out.groupBy("a").agg(F.max("minor").alias("some"), salts(["b"])).where("some").drop("some")  # nothing is left elsewhere
    undone = beside(sorted_out, some, ["a"], ["b"])
    held = written(away.join(undone, ["a", "b"]).withColumns(which), "left")
    member = ["a", "x", "b", "v"]
    ratio = f"c_1 <> c_2 AND 100 * least(n_1, n_2) >= {int(percent)} * greatest(n_1, n_2)"

    # far ones: candidates share one of the rarest shingles that tell them from the reference
    each = held.select(*member, "c", "minor", F.explode(F.concat("lost", "added")).alias("s"))
    counted = each.groupBy("a", "x", "s").agg(F.count("*").alias("m"), (F.max("minor") & (F.min("c") < F.max("c"))).alias("open"), salts(["b"]))
    told = beside(each, counted.where("m > 1"), ["a", "x", "s"], ["b"]).groupBy(*member).agg(F.sort_array(F.collect_list(F.struct("m", "s", "open"))).alias("ss"))
    # a shingle of one set alone is rarest and joins nothing: such ones only take their places
    alone = F.col("d") - F.size("ss")
    room = F.greatest(F.col("lack") + 1 - alone, F.lit(0)).cast("int")
    # rest: how many of its shingles come after this one
    ranked = F.transform(F.slice("ss", F.lit(1), room), lambda e, i: F.struct(e["s"].alias("s"), e["open"].alias("open"), (F.size("ss") - i - 1).alias("rest")))
    prefix = held.select(*member, "c", "minor", "n_b", "lack", "d").join(told, member).select(*member, "c", "minor", "n_b", "lack", "d", F.inline(F.filter(ranked, lambda e: e["open"]))).drop("open")
    prefix = written(prefix, "prefix")
    one, two = _sides(prefix, ["a", "x", "s"], ["c", "n_b", "v", "lack", "d", "rest"])
    # similar sets share so many of these shingles, and the first that they share has the others behind it
    enough = "2 * (1 + least(rest_1, rest_2)) >= d_1 + d_2 - least(lack_1, lack_2)"
    far_off = f"(d_1 > {NEAR} * lack_1 OR d_2 > {NEAR} * lack_2)"
    found = written(one.join(two, ["a", "x", "s", "part"]).where(f"{ratio} AND {far_off} AND {enough}").select("a", "x", "b_1", "v_1", "b_2", "v_2").distinct(), "candidates")
    arrays = lambda k: held.select("a", "x", F.col("b").alias(f"b_{k}"), F.col("v").alias(f"v_{k}"), *([F.col("n_a")] if k == 1 else []), *side(k))
    far = found.join(arrays(1), ["a", "x", "b_1", "v_1"]).join(arrays(2), ["a", "x", "b_2", "v_2"]).where(near)

    # close ones: in the shell below the limit, with all that are close
    one, two = _sides(held.where(f"d <= {NEAR} * lack").withColumnRenamed("n_b", "n"), ["a", "x"], ["c", "n_a", "n", "lost", "added"])
    shell = one.join(two, ["a", "x", "part"]).withColumnsRenamed({"b_1": "id_1", "b_2": "id_2"}).where(f"{ratio} AND {near.replace('n_a', 'n_a_1')}")
    return written(links.unionByName(pair(far).unionByName(pair(shell)).distinct()), "links")


def _sides(rows: DataFrame, key: list[str], carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of the rows of each key the minor ones, and all, to be joined on the key and ``part``: a key of many
    rows is cut into parts of about PART_ROWS, and the minor ones go to each of them."""
    some = rows.groupBy(*key).agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"), F.max("minor").alias("some"), salts(["b"])).where("some").drop("some")
    dealt = beside(rows, some, key, ["b"])
    named = lambda k: [F.col("b").alias(f"b_{k}"), *[F.col(c).alias(f"{c.removesuffix('_b')}_{k}") for c in carried]]
    one = dealt.where("minor").select(*key, *named(1), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return one, dealt.select(*key, *named(2), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))


def classes(documents: DataFrame, size: int, percent: int, doc_id: str = "doc_id", text: str = "text", permutations: int = PERMUTATIONS, one_text: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept. ``one_text``: all rows of an id have the same text."""
    drawn = written(sketches(documents, size, doc_id, text, permutations), "sketches")
    known = drawn.where("doc_id IS NOT NULL AND n > 0")
    copies = known.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), salts(["doc_id"]))
    # the bands of the least document of each set; equal sets have equal bands
    reps = known.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    rows = reps.select(F.explode("bands").alias("key"), "id", "n")
    shared = rows.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), salts(["id"])).where("first < last").select("key", "_salts")
    members = written(beside(rows, shared, ["key"], ["id"], once=True), "buckets")
    final = components(linked(members, documents, size, percent, doc_id, text, one_text), "a", "b")

    # a class goes where its representative goes; equal ids with different sets hang together too
    of_class = beside(known.drop("bands"), copies, ["h1", "h2", "n"], ["doc_id"])
    found = of_class.join(final, F.col("rep") == F.col("node"), "left").select("doc_id", "n", F.coalesce("component", "rep").alias("component_id"))
    alone = drawn.where("doc_id IS NULL OR n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def filtered(documents: DataFrame, size: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with its own columns: also of rows that repeat an id or have none."""
    row, one, mine = (free_name(documents.columns, n) for n in ("_row", "_one", "_mine"))
    kept = classes(documents, size, percent, doc_id, text).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(mine)).distinct().hint("merge")
    known = documents.where(F.col(doc_id).isNotNull())
    chosen = known.join(kept, F.col(doc_id) == F.col(mine), "left_semi")
    by = Window.partitionBy(doc_id).orderBy(F.col(text).asc_nulls_last())
    first = chosen.withColumn(row, F.row_number().over(by)).where(F.col(row) == 1).drop(row)
    # without an id: one of each set, and none where a row with an id has the set
    nameless = documents.where(F.col(doc_id).isNull()).withColumn(row, F.xxhash64(text))
    sets = sketches(nameless, size, row, text, PER_BAND).select(F.col("doc_id").alias(one), "n", "h1", "h2").distinct()
    with_id = sketches(known, size, doc_id, text, PER_BAND).where("n > 0").select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("n").alias("kn")).distinct().hint("merge")
    alone = sets.join(with_id, F.expr("h1 = k1 AND h2 = k2 AND n = kn"), "left_anti")
    best = alone.groupBy("h1", "h2", "n").agg(F.min(one).alias(one)).select(one).hint("merge")
    own = nameless.join(best, F.col(row).eqNullSafe(F.col(one)), "left_semi").dropDuplicates([row]).drop(row)
    return first.unionByName(own)


#: ``classes`` with three words and 85 percent in DuckDB SQL over ``documents``.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
dbl AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT DISTINCT doc_id AS id, doc_id AS c FROM documents UNION SELECT dbl.b, r.c FROM r JOIN dbl ON r.id = dbl.a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, k.c AS component_id, doc_id = k.c AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(c) AS c FROM r GROUP BY id) k USING (doc_id)
"""
