import itertools
import random

import pytest
from pyspark.sql import functions as F

from driftwell.llm import near_dedup
from driftwell.llm.common import beside, salts
from driftwell.llm.components import components


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = near_dedup.words(t)
        sets.setdefault(i, []).append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    best = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                best[a] = best[b] = min(best[a], best[b])
    return best


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_equals_brute_force(spark, size, percent):
    rng = random.Random(size)
    rows = []
    for g in range(6):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) + str(rng.randint(0, 99)) for _ in range(rng.choice([30, 60, 150]))]
        for _ in range(12):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = f"x{rng.randint(0, 5)}"
            base = text if rng.random() < 0.5 else base
            rows.append((len(rows), " ".join(text).upper() if rng.random() < 0.3 else "\n".join(text)))
    rows += [(200, ""), (201, "   "), (202, None), (203, "one two"), (204, "ONE\ttwo"), (3, rows[3][1]), (205, "é É"), (206, "é é"), (207, "w " * 5000)]
    best = brute(rows, size, percent)
    got = near_dedup.classes(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n long"), size, percent).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == best
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert {r.n_shingles for r in got if r.doc_id in (200, 201, 202)} == {0}


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup.classes(df, 3, 85).collect()) == [(0, 0, True), (1, 1, True), (2, 1, False)]
    assert sorted(r.doc_id or 0 for r in near_dedup.filtered(df, 3, 85).collect()) == [1]
    assert near_dedup.classes(df.limit(0), 3, 85).count() == 0


@pytest.mark.parametrize("edges_of_a_task", [10**6, 3])
def test_components_of_paths_and_stars(spark, edges_of_a_task, monkeypatch):
    monkeypatch.setattr("driftwell.llm.components.HUB_EDGES", edges_of_a_task)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 299)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long"), "u", "v").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}, 299: 299, 300: 299}


def test_filtered_keeps_one_row_of_each_group(spark):
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 1), (2, "A b c d e f", 2), (3, "q w e r t y", 3), (3, "other words stand here now then", 4)]
    rows += [(None, "a b c d e f", 5), (None, "x y z u v w", 6), (None, "x y z u v w", 7), (None, "X y z u v w", 8), (None, None, 9), (None, "", 9), (4, "", 10), (5, None, 11), (5, None, 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_id int").withColumn("_row", F.lit(1)).withColumn("h1", F.lit(2))
    got = near_dedup.filtered(df, 3, 85)
    assert got.columns == df.columns
    ids = sorted((r.doc_id or 0, (r.text or "").lower()) for r in got.collect())
    assert ids == [(0, ""), (0, "x y z u v w"), (1, "a b c d e f"), (3, "other words stand here now then"), (4, ""), (5, "")]
    assert near_dedup.filtered(df.limit(0), 3, 85).count() == 0


@pytest.mark.parametrize("shared,spread", [(40, 12), (75, 3)])
def test_buckets_of_unlike_and_almost_like_documents(spark, shared, spread, monkeypatch):
    """Many documents with the same core and own words, so with pairs below, at and above the limit; all in
    one bucket, so that nothing depends on the bands."""
    monkeypatch.setattr(near_dedup, "PART_ROWS", 7)
    rng = random.Random(shared)
    core = [f"c{k}" for k in range(shared)]
    rows = []
    for i in range(60):
        own = [f"w{rng.randint(0, 400) if rng.random() < 0.7 else rng.randint(0, 8)}" for _ in range(rng.randint(0, spread) * 2)]
        text = list(core)
        for _ in range(rng.randint(0, spread)):
            text[rng.randrange(len(text))] = f"e{rng.randint(0, 3)}"
        rows.append((i, " ".join(text + own)))
    rows += [(7, rows[9][1]), (70, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = near_dedup.sketches(docs, 3).select(F.lit(1).cast("long").alias("key"), F.col("doc_id").alias("id"), "n").dropDuplicates(["key", "id"])
    links = near_dedup.linked(sets, docs, 3, 85, "doc_id", "text")
    best = brute(rows, 3, 85)
    got = {r.node: r.component for r in components(links, "a", "b").collect()}
    assert {i: got.get(i, i) for i in best} == best


def test_stars_need_no_round(spark, monkeypatch):
    def never(df, what):
        raise AssertionError(what)

    monkeypatch.setattr("driftwell.llm.components.written", never)
    edges = spark.createDataFrame([(1, 5), (1, 6), (1, 6), (6, 1), (2, 7), (3, 3)], "u long, v long")
    assert sorted(components(edges, "u", "v").collect()) == [(1, 1), (2, 2), (5, 1), (6, 1), (7, 2)]
    assert components(edges.limit(0), "u", "v").count() == 0


def test_repeated_rows_come_once_without_another_shuffle(spark):
    rows = spark.range(40).selectExpr("id % 2 AS k", "id % 5 AS x")
    side = rows.groupBy("k").agg(F.max("x").alias("m"), salts(["x"]))
    all_, once = (beside(rows, side, ["k"], ["x"], once=o) for o in (False, True))
    assert all_.count() == 40 and sorted(once.select("k", "x", "m").collect()) == [(k, x, 4) for k in (0, 1) for x in range(5)]
    shuffles = [df._jdf.queryExecution().sparkPlan().toString().count("Join") + df._jdf.queryExecution().executedPlan().toString().count("Exchange") for df in (all_, once)]
    assert shuffles[0] == shuffles[1]
