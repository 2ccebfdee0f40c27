"""Edge cases of the operators on small tables."""

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from driftwell.functions import normalize
from driftwell.operators import blocks, diff, inventory, merkle, repair
from driftwell.plans import rules
from driftwell.sources import nodes

T = nodes.Table("t", ("id",))


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, name string, amount decimal(10,2)")


def canonical_case(spark):
    base = [(i, f"n{i}", None) for i in range(1, 6)]
    one = base + [(1001, "a", None), (1002, "b", None)]
    two = [(i, "changed" if i < 3 else n, a) for i, n, a in base] + [(2001, "c", None), (2002, "d", None)]
    return frame(spark, one), frame(spark, two)


def pair(left, right, pruned=False):
    return diff.diff(nodes.Cluster({"n1": lambda _: left, "n2": lambda _: right}), T, pruned=pruned)


@pytest.mark.parametrize("mode,sizes,residual", [("default", (7, 7), 0), ("insert_only", (7, 9), 4), ("upsert_only", (7, 9), 2)])
def test_repair_modes(spark, mode, sizes, residual):
    left, right = canonical_case(spark)
    made = repair.from_source(pair(left, right), T, "n1", mode)
    after = repair.applied(right, made, "n2", T)
    assert (left.count(), after.count()) == sizes
    assert pair(left, after).count() == residual


def test_bidirectional(spark):
    left, right = canonical_case(spark)
    made = repair.both_ways(pair(left, right), T)
    a, b = repair.applied(left, made, "n1", T), repair.applied(right, made, "n2", T)
    assert (a.count(), b.count(), pair(a, b).count()) == (9, 9, 2)


def test_nulls_scale_and_empty(spark):
    left = frame(spark, [(1, None, None), (2, "", None), (3, "x", Decimal(3))])
    right = spark.createDataFrame([(1, None, None), (2, None, None), (3, "x", Decimal(3))], "id long, name string, amount decimal(12,4)")
    got = pair(left, right).collect()
    assert [(r.id, r.changed_columns) for r in got] == [(2, "name")]
    assert pair(left.limit(0), right.limit(0)).count() == 0
    assert pair(left.limit(0), left).count() == 3
    assert pair(left, left, pruned=True).count() == 0


def test_hash_modes(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c")], "x string, y string")
    for mode, n in (("compat", 1), ("strict", 2)):
        assert df.select(normalize.row_hash(df, ["x", "y"], mode).alias("h")).distinct().count() == n


def test_refusals(spark):
    df = frame(spark, [(1, "a", None)])
    with pytest.raises(ValueError):
        nodes.Table("t", ())
    with pytest.raises(ValueError):
        normalize.check_identifier("a;b")
    with pytest.raises(ValueError):
        nodes.same_schema(df, df.drop("name"))
    with pytest.raises(ValueError):
        nodes.has_rows(df, "id > 5")
    with pytest.raises(ValueError):
        nodes.Cluster({"a": None}).pairs()
    with pytest.raises(ValueError):
        repair.check_options(None, "default")
    with pytest.raises(ValueError):
        inventory.recovery_source(spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "node string, origin_lsn long, slot_lsn long"))
    assert nodes.unique_key(spark.createDataFrame([(1,), (1,), (2,)], "id long"), ("id",)).collect()[0].id == 1
    assert diff.too_large(spark.createDataFrame([(bytearray(11),)], "b binary"), ["b"], 10) == ["b"]


def test_big_keys_and_log_positions(spark):
    big = 2**53 + 1
    a, b = frame(spark, [(big, "a", None)]), frame(spark, [(big + 1, "a", None)])
    assert {r.id for r in pair(a, b).collect()} == {big, big + 1}
    row = spark.range(1).select(normalize.lsn_number(F.lit("16/B374D848")).alias("n"), normalize.lsn_text(normalize.lsn_number(F.lit("16/B374D848"))).alias("t")).first()
    assert (int(row.n), row.t) == (0x16B374D848, "16/B374D848")


def test_blocks_cover_all_keys(spark):
    sample = spark.range(100, 200).withColumnRenamed("id", "k")
    ranges = blocks.boundaries(sample, ["k"], 7)
    rows = spark.range(0, 400).withColumnRenamed("id", "k")
    got = blocks.assign(rows, ["k"], ranges)
    assert got.count() == 400
    by = {r.k: r.block_id for r in got.collect()}
    starts = sorted((r.range_start.k, r.block_id) for r in ranges.collect())
    assert all(by[k] == max([b for s, b in starts if s <= k], default=0) for k in by)
    assert {r.k: r.block_id for r in blocks.assign(rows, ["k"], ranges, 0).collect()} == by
    assert blocks.sample_share(10**9) < blocks.sample_share(20_000) < blocks.sample_share(100) == 1
    sampled = blocks.boundaries(spark.range(30_000).withColumnRenamed("id", "k"), ["k"], 10, sampled=True).collect()
    assert len(sampled) == 10 and min(r.range_start.k for r in sampled) == 0
    assert blocks.boundaries(sample.limit(0), ["k"], 3).count() == 0
    assert (blocks.n_blocks(0, 10), blocks.n_blocks(1, 10), blocks.n_blocks(11, 10)) == (0, 1, 2)


def test_tree_root_changes_with_any_row(spark):
    df = frame(spark, [(i, f"n{i}", None) for i in range(50)])
    ranges = blocks.boundaries(df, ["id"], 5)
    trees = [merkle.build(merkle.leaves(x, T, ranges), 5) for x in (df, df.withColumn("name", F.expr("if(id = 33, 'x', name)")))]
    assert [r.node_position for r in merkle.mismatched(*trees).collect()] == [3]
    top = [t.where("node_level = 3").first() for t in trees]
    assert top[0].l0 != top[1].l0 and top[0].n_rows == 50


def test_plan(spark):
    left, right = canonical_case(spark)
    plan = rules.load('{"rules": [{"name": "r", "action": "custom", "when": "n1.name = \'n1\'"}], "default": "skip", "custom": {"name": "concat(n1.name, \'/\', n2.name)"}}')
    chosen = rules.resolved(pair(left, right), T, plan)
    made = rules.repairs(chosen, T, ["name", "amount"], plan)
    assert sorted((r.node, r.id, r.row.name) for r in made.collect()) == [("n1", 1, "n1/changed"), ("n2", 1, "n1/changed")]
    assert {r.rule: r.n_rows for r in rules.usage(chosen).collect()} == {"r": 1, None: 5}
    with pytest.raises(Exception, match="matches no rule"):
        rules.resolved(pair(left, right), T, rules.Plan()).collect()
    with pytest.raises(ValueError):
        rules.load('{"default": "explode"}')


def test_plan_repairs_of_three_nodes(spark):
    """A key on n1 and n2 alone: one write to n3, whatever the action, and no key twice after it."""
    make = lambda *rows: frame(spark, list(rows))
    frames = {"n1": make((1, "a", None), (2, "one", None), (3, "x", None)), "n2": make((1, "a", None), (2, "two", None)), "n3": make((1, "a", None), (3, "y", None))}
    found = diff.diff(nodes.Cluster({n: (lambda _, n=n: frames[n]) for n in frames}), T)
    for action, names in (("keep_n1", {2: "one", 3: "x"}), ("apply_from_n1_upsert", {2: "one", 3: "x"}), ("bidirectional", {2: "one", 3: "y"}), ("keep_n2", {})):
        plan = rules.Plan((), (), action)
        writes = rules.repairs(rules.resolved(found, T, plan), T, ["name", "amount"], plan)
        assert writes.groupBy("node", "id").count().where("count > 1").isEmpty()
        now = repair.applied(frames["n3"], writes, "n3", T)
        assert now.count() == now.select("id").distinct().count()
        if names:
            assert {r.id: r.name for r in now.collect()} == {1: "a", **names}
    plan = rules.Plan((), (), "bidirectional")
    with pytest.raises(Exception, match="different writes"):
        rules.repairs(rules.resolved(found, T, plan), T, ["name", "amount"], plan, conflicts="error").collect()
    plan = rules.Plan((), (), "skip")
    assert rules.repairs(rules.resolved(found, T, plan), T, ["name", "amount"], plan, conflicts="error").count() == 0


def test_conditions(spark):
    from driftwell.plans.conditions import Compiler

    row = "named_struct('i', 5, 'big', 9007199254740993L, 'f', 0.1d, 'g', 9007199254740992d, 'd', cast(0.10 AS decimal(10,2)), 's', 'b', 'u', 'é', 'b', true, 't', timestamp'2024-01-02 03:04:05', 'n', cast(null AS int), 'a', array(1))"
    df = spark.range(1).selectExpr(f"{row} AS x")
    columns = {f.name: (F.col(f"x.{f.name}"), f.dataType) for f in df.schema["x"].dataType.fields}
    c = Compiler({"n1": columns, "n2": columns})
    col = lambda name: {"n1": name}
    holds = lambda x: df.select(c.condition(x).alias("r")).first().r
    true = [
        {"=": [col("f"), 0.1]}, {"=": [col("f"), col("d")]}, {"<": [col("g"), col("big")]}, {"!=": [col("g"), col("big")]}, {"=": [col("i"), 5.0]}, {">": [col("u"), "z"]}, {"<=": [col("i"), 5]}, {">=": [col("i"), 4.99]},
        {"=": [col("b"), True]}, {"!=": [col("b"), False]}, {"=": [col("n"), None]}, {"!=": [col("i"), None]}, {"!=": [col("n"), 1]}, {"=": [None, None]}, {"=": [col("missing"), None]}, {"null": col("n")}, {"not": {"null": col("i")}},
        {"in": [col("s"), ["a", "b"]]}, {"in": [col("n"), [1, None]]}, {"not": {"in": [col("n"), [1]]}}, {"=": [col("t"), "2024-01-02 03:04:05"]}, {"<": [col("t"), "2024-01-03"]}, {"any": [True, {"<": [col("n"), 1]}]}, {"not": {"all": [False, {"<": [col("n"), 1]}]}},
        {"all": []}, {"not": {"any": []}}, {"<": [col("d"), 12345678901234567890]}, {"=": [{"n2": "s"}, {"n1": "s"}]},
    ]
    got = df.select(*[c.condition(x).alias(str(k)) for k, x in enumerate(true)]).first()
    assert [x for x, r in zip(true, got, strict=True) if r is not True] == []
    for x in ({"<": [col("n"), 1]}, {">=": [1, col("n")]}, {"all": [True, {">": [col("n"), 0]}]}):
        with pytest.raises(Exception, match="NULL has no order"):
            holds(x)
    for x, why in (
        ({"<": [col("i"), None]}, "no order"), ({"<": [col("b"), True]}, "no order"), ({"=": [col("i"), "5"]}, "cannot be compared"), ({"=": [col("a"), 1]}, "cannot be compared"), ({"=": [col("b"), 1]}, "cannot be compared"),
        ({"~": [1, 2]}, "unknown operator"), ("n1.x = 1", "not a condition"), ({"=": [{"n3": "x"}, 1]}, "not a column"), ({"=": [[1], 1]}, "not a value"), ({"=": [float("nan"), 1]}, "not a number"), ({"a": 1, "b": 2}, "not a condition"),
    ):
        with pytest.raises(ValueError, match=why):
            c.condition(x)


@pytest.mark.parametrize("seed", range(2))
def test_pruned_diffs_see_nested_differences(spark, seed):
    """Random nested rows in another session zone, of which some differ by as little as can be."""
    import random
    from datetime import datetime, timedelta, timezone

    rng, base = random.Random(seed), datetime(2024, 11, 3, 5, 0, tzinfo=timezone.utc)
    moment = lambda: base + timedelta(microseconds=rng.choice([0, 1, 999, 3_600_000_000, 3_600_000_001]))
    value = lambda: (moment(), [moment(), None], [(moment(), rng.choice([0.0, -0.0, 1e-300, float("nan")]))], rng.choice([None, (moment(), b"\x01")]))
    kind = "id long, at timestamp, many array<timestamp>, pairs array<struct<at: timestamp, x: double>>, one struct<at: timestamp, raw: binary>"
    left = [(i, *value()) for i in range(60)]
    right = [(i, *(value() if i % 3 == 0 else v)) for i, *v in left]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        a, b = (spark.createDataFrame(x, kind) for x in (left, right))
        assert sorted(r.id for r in diff.diff_pruned(a, b, T, 64).collect()) == sorted(r.id for r in diff.diff_pair(a, b, T).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_reports_and_tasks(spark, tmp_path):
    from driftwell.sources import reports

    left, right = canonical_case(spark)
    found = pair(left, right)
    assert reports.write_report(found, f"{tmp_path}/r") and not reports.write_report(found.limit(0), f"{tmp_path}/none")
    again = reports.read_report(spark, f"{tmp_path}/r", T, left.schema)
    assert sorted(map(str, again.select("id", "diff_type", "n1.name").collect())) == sorted(map(str, found.select("id", "diff_type", "n1.name").collect()))
    with pytest.raises(ValueError):
        reports.read_report(spark, f"{tmp_path}/r", T, left.schema) if spark.createDataFrame([(1,)], "x int").write.mode("append").json(f"{tmp_path}/r") is None else None
    reports.write_html(found, T, f"{tmp_path}/r.html")
    page = open(f"{tmp_path}/r.html").read()
    assert "<b>" in page and page.count("<tr>") == 6
    with pytest.raises(KeyError), reports.task(f"{tmp_path}/tasks", "table-diff", table="t"):
        raise KeyError("x")
    with reports.task(f"{tmp_path}/tasks", "table-diff"):
        pass
    assert sorted(r.status for r in reports.tasks(spark, f"{tmp_path}/tasks").collect()) == ["COMPLETED", "FAILED"]
    assert reports.skip_list("a.b, c") == ["a.b", "c"]
    with pytest.raises(ValueError):
        reports.skip_list("a;b")


def test_merge_to_a_fixpoint(spark):
    sized = spark.range(8).selectExpr("id AS block_id", "id * 10 AS range_start", "if(id = 4, 90L, 10L) AS n_rows")
    got = merkle.merged(sized, 100).orderBy("block_id").collect()
    assert sum(r.n_rows for r in got) == 160 and len(got) < 8 and got[0].range_start == 0
    assert all(a.range_end == b.range_start for a, b in zip(got, got[1:], strict=False))


def test_values_that_hashes_must_tell_apart(spark):
    """Pruned diffs and trees see what plain diffs see, whatever the types."""
    from datetime import date, datetime

    schema = "id long, a double, b float, c decimal(20,4), d string, e binary, f array<double>, g timestamp, h date, i boolean"
    nan, inf = float("nan"), float("inf")
    base = (1.0, 1.5, Decimal("1.5000"), "x", bytearray(b"x"), [1.0], datetime(2020, 1, 1), date(2020, 1, 1), True)
    pairs = [
        (base, base), ((1.001, *base[1:]), (1.002, *base[1:])), ((1e17, *base[1:]), (1e17 + 16, *base[1:])), ((nan, *base[1:]), (nan, *base[1:])),
        ((inf, *base[1:]), (-inf, *base[1:])), ((0.0, *base[1:]), (-0.0, *base[1:])), ((None, *base[1:]), (0.0, *base[1:])), ((1.0, 0.1, *base[2:]), (1.0, 0.2, *base[2:])),
        ((*base[:3], "", *base[4:]), (*base[:3], None, *base[4:])), ((*base[:5], [1.0, None], *base[6:]), (*base[:5], [1.0], *base[6:])), ((*base[:4], bytearray(b"y"), *base[5:]), base),
    ]
    left, right = (spark.createDataFrame([(i, *p[k]) for i, p in enumerate(pairs)], schema) for k in (0, 1))
    want = [1, 2, 4, 6, 7, 8, 9, 10]
    assert sorted(r.id for r in diff.diff_pair(left, right, T).collect()) == want
    assert sorted(r.id for r in diff.diff_pruned(left, right, T).collect()) == want
    ranges = blocks.boundaries(left, ["id"], len(pairs))
    trees = [merkle.build(merkle.leaves(x, T, ranges), len(pairs)) for x in (left, right)]
    assert sorted(r.node_position for r in merkle.mismatched(*trees).collect()) == want


def test_kept_trees(spark, tmp_path):
    from driftwell.sources import trees

    df = frame(spark, [(i, f"n{i}", None) for i in range(60)])
    with pytest.raises(FileNotFoundError):
        trees.open_tree(spark, f"file://{tmp_path}/none")
    with pytest.raises(ValueError, match="0 rows"):
        trees.build_trees({"a": df.limit(0)}, T, {"a": f"file://{tmp_path}/a"}, 10)
    kept = trees.build_trees({"a": df, "b": df}, T, {n: f"file://{tmp_path}/{n}" for n in "ab"}, 10)
    assert trees.compare(kept["a"], kept["b"]).count() == 0 and kept["a"].n_leaves == 6
    # changes, one of them below the first key
    new = df.where("id <> 31").unionByName(frame(spark, [(-5, "low", None)])).withColumn("name", F.expr("if(id = 7, 'x', name)"))
    changes = spark.createDataFrame([("DELETE", 31), ("INSERT", -5), ("UPDATE", 7)], "op string, id long")
    now = trees.update(kept["a"], new, T, changes)
    assert now.leaves.agg(F.min("range_start.id")).first()[0] == -5
    fresh = merkle.leaves(new, T, now.ranges)
    key = lambda rows: sorted(tuple(r[c] for c in ("node_position", *merkle.HASH)) for r in rows.collect())
    assert key(trees.open_tree(spark, f"file://{tmp_path}/a").leaves) == key(fresh)
    assert sorted(r.block_id for r in trees.compare(now, kept["b"]).collect()) == [0, 3]
    assert trees.update(now, new, T, changes.limit(0)) is now
    emptied = trees.update(now, new.limit(0), T, spark.createDataFrame([("TRUNCATE", None)], "op string, id long"))
    assert emptied.leaves.agg(F.sum("n_rows")).first()[0] == 0
    healed, n = trees.heal(emptied, df, T, trees.compare(emptied, kept["b"]))
    assert n == 6 and trees.compare(healed, kept["b"]).select("block_id").count() == 1  # its first range starts lower
    assert key(healed.leaves) == key(kept["b"].leaves)
    old = trees.Tree(spark, healed.place, healed.about | {"hash_version": 1})
    assert key(trees.update(old, new, T, changes.limit(0)).leaves) == key(fresh)


@pytest.mark.parametrize("per_part", [1, 3, 7, 1000])
def test_merging_in_parts(spark, per_part):
    """Runs of small leaves over any borders of parts: the same as one pass from the left, again and again."""
    import random

    rng = random.Random(per_part)
    sizes = [rng.choice([0, 1, 2, 3, 10, 60, 100, 140]) for _ in range(60)] + [1] * 25 + [200] + [3] * 8
    want = list(enumerate(sizes))
    while True:
        out, i = [], 0
        while i < len(want):
            start, n = want[i]
            if i + 1 < len(want) and n < 25 and n + want[i + 1][1] < 150:
                n, i = n + want[i + 1][1], i + 1
            out.append((start, n))
            i += 1
        if len(out) == len(want):
            break
        want = out
    sized = spark.createDataFrame([(k, (k,), n) for k, n in enumerate(sizes)], "block_id long, range_start struct<id: long>, n_rows long")
    got = merkle.merged(sized, 100, per_part=per_part).orderBy("block_id").collect()
    assert [(r.block_id, r.range_start.id, r.n_rows) for r in got] == [(k, *w) for k, w in enumerate(want)]
    assert [r.range_end and r.range_end.id for r in got] == [w[0] for w in want[1:]] + [None]


def test_parted_tables(spark, tmp_path):
    from driftwell.sources import parted

    df = spark.range(100).selectExpr("id", "concat('n', id) AS name", "cast(if(id % 10 = 3, null, id) AS decimal(10,2)) AS amount")
    kept = parted.create(df, T, f"file://{tmp_path}/t", 10)
    files = lambda: {r.key_part: r.f for r in kept.with_parts.groupBy("key_part").agg(F.sort_array(F.collect_set("_metadata.file_path")).alias("f")).collect()}
    rows = lambda: {r.id: (r.name, r.amount) for r in kept.frame.collect()}
    before, old = files(), rows()
    assert len(before) == 10 and len(old) == 100
    row = "named_struct('__has', 1, 'name', {}, 'amount', cast(null AS decimal(10,2)))"
    write = lambda op, *ids: spark.createDataFrame([(i,) for i in ids], "id long").selectExpr("'n1' AS node", "id", f"'{op}' AS op", row.format("'new'") + " AS row")
    assert kept.apply(write("upsert", 5).unionByName(write("insert", 6, 1000)).unionByName(write("delete", *range(20, 30))), "n1") == 3
    want = {i: v for i, v in old.items() if not 20 <= i < 30} | {5: ("new", None), 1000: ("new", None)}
    assert rows() == want  # 6 is there already; the third range is gone with its rows
    now = files()
    assert sorted(now) == [0, 1, 3, 4, 5, 6, 7, 8, 9] and sorted(k for k in now if now[k] != before[k]) == [0, 9]
    assert kept.apply(write("upsert", 5).unionByName(write("insert", 25)), "n1") == 2 and rows()[25] == ("new", None)  # the same again, and a key of the range that is gone
    assert kept.apply(write("upsert", 5), "n2") == 0 and kept.apply(write("upsert", 5).limit(0), "n1") == 0
    cells = spark.createDataFrame([("n1", 13, ("x", Decimal("7.5"))), ("n1", 14, (None, Decimal("1")))], "node string, id long, fill struct<name: string, amount: decimal(10,2)>")
    assert kept.fill(cells, "n1") == 1 and rows()[13] == ("n13", Decimal("7.50")) and rows()[14] == ("n14", Decimal("14.00"))
    with pytest.raises(ValueError, match="no rows"):
        parted.create(df.limit(0), T, f"file://{tmp_path}/none", 10)
    with pytest.raises(ValueError, match="is called"):
        parted.create(df.withColumnRenamed("name", "key_part"), T, f"file://{tmp_path}/none", 10)


def test_parted_files_follow_rows_and_not_ranges(spark, tmp_path):
    from driftwell.sources import parted

    df = spark.range(2000).selectExpr("id", "concat('n', id) AS name")
    kept = parted.create(df, T, f"file://{tmp_path}/t", 5)
    held = lambda: kept.with_parts.select("id", "key_part", F.col("_metadata.file_path").alias("f"))
    before = {r.id: (r.key_part, r.f) for r in held().collect()}
    assert len({p for p, _ in before.values()}) == 400 and len({f for _, f in before.values()}) <= 8
    ids = [*range(0, 2000, 40), 3]  # one range in eight, more than are runs in the filter; the first of them twice
    writes = spark.createDataFrame([(i,) for i in ids], "id long").selectExpr("'n1' AS node", "id", "'upsert' AS op", "named_struct('__has', 1, 'name', 'new') AS row")
    old = kept._versions()
    assert kept.apply(writes, "n1") == 50
    after = {r.id: (r.key_part, r.f) for r in held().collect()}
    assert {i: p for i, (p, _) in after.items()} == {i: p for i, (p, _) in before.items()} and all((after[i] != before[i]) == (i // 5 % 8 == 0) for i in before)
    assert kept.frame.where("name = 'new'").count() == 51 and kept.frame.count() == 2000
    with pytest.MonkeyPatch.context() as m:
        m.setattr(parted, "MOST_NAMED", 3)  # ranges that are too many to be named
        assert kept.apply(writes.withColumn("op", F.lit("delete")), "n1") == 50
    assert kept.frame.count() == 1949 and kept.frame.where("name = 'new'").count() == 0
    placed, few = kept._touched(writes)
    with pytest.raises(OSError, match="meanwhile"):  # a repair of a version that is not the last one
        kept._replace(old, placed, kept._old(old, placed, few))
    assert kept.frame.count() == 1949


def test_parted_tables_of_more_ranges_than_bounds_are_sent(spark, tmp_path, monkeypatch):
    from driftwell.sources import parted

    monkeypatch.setattr(blocks, "MOST_BOUNDS", 3)  # rows and bounds meet in one order
    kept = parted.create(spark.range(300).selectExpr("id", "'old' AS name"), T, f"file://{tmp_path}/t", 5)
    assert kept.with_parts.where("id div 5 = key_part").count() == 300 and kept.with_parts.select("_metadata.file_path").distinct().count() <= 8
    writes = spark.range(0, 300, 30).selectExpr("'n1' AS node", "id", "'upsert' AS op", "named_struct('__has', 1, 'name', 'new') AS row")
    assert kept.apply(writes, "n1") == 10
    assert sorted((r.id, r.name) for r in kept.frame.collect()) == [(i, "old" if i % 30 else "new") for i in range(300)]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 101])
def test_rows_find_their_range_in_groups_of_bounds(spark, n):
    ranges = spark.range(n).selectExpr("7 * id AS block_id", "named_struct('a', cast(id div 3 AS long), 'b', concat('x', id % 3)) AS range_start", "cast(null AS struct<a: long, b: string>) AS range_end")
    rows = spark.range(-2, n).selectExpr("if(id = -1, null, id div 2) AS a", "concat('x', id % 5) AS b")
    found = blocks.assign(rows, ["a", "b"], ranges)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(found) == key(blocks.assign(rows, ["a", "b"], ranges, 0))
    plan = merkle.leaves(rows, nodes.Table("t", ("a", "b")), ranges)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"scalar-subquery#\d+ \[\] AS", plan)  # no row carries all bounds
    assert not re.search(r"Filter isnotnull\(.*scalar-subquery", plan)  # and none is searched for twice


def test_samples_of_files(spark, tmp_path):
    spark.range(10_000).repartition(40, F.xxhash64("id")).write.parquet(f"file://{tmp_path}/t")
    df = spark.read.parquet(f"file://{tmp_path}/t")
    some, share = blocks.file_sample(df, 0.1)
    assert share == 0.1 and some.select("_metadata.file_name").distinct().count() == 4
    assert blocks.file_sample(df, 0.1, least=100)[1] == 1.0
    assert some.count() < 2500
    ranges = blocks.boundaries_by_files(df, ["id"], 500, 0.1, least=1)
    sizes = [r["count"] for r in blocks.assign(df, ["id"], ranges).groupBy("block_id").count().collect()]
    assert sum(sizes) == 10_000 and max(sizes) <= 1200 and 15 <= len(sizes) <= 25


def test_capped_runs(spark):
    left, right = canonical_case(spark)
    c = nodes.Cluster({"n1": lambda _: left, "n2": lambda _: right})
    for most, limited in ((3, True), (6, False), (100, False)):
        run = diff.run(c, T, most)
        got = [r.id for r in run.rows.orderBy("id").collect()]
        assert got == [1, 2, 1001, 1002, 2001, 2002][:most]
        assert run.summary() == [{"pair": "n1/n2", "n_rows": 6, "n_kept": min(6, most), "limited": limited, "effective_filter": None}]
    run = diff.run(c, T, 10, "id < 100")
    assert run.rows.count() == 2 and run.summary()[0]["effective_filter"] == "(id < 100)"
    assert diff.effective_filter() is None
    for bad in ({"origin": ("a", "x")}, {"origin": ("a b", "1")}, {"until": ("t", "yesterday")}):
        with pytest.raises(ValueError):
            diff.effective_filter(**bad)


@pytest.mark.parametrize("most", [1, 200])
def test_descent(spark, tmp_path, most):
    """From the roots down, and all leaves at once where too many nodes differ: the leaves with a difference."""
    from driftwell.sources import trees

    df = spark.range(1000).selectExpr("id", "cast(id AS string) AS name")
    for k, ids in enumerate(([], [5, 505, 506, 999])):
        other = df.withColumn("name", F.when(F.col("id").isin(ids), "x").otherwise(F.col("name")))
        kept = trees.build_trees({"a": df, "b": other}, T, {n: f"file://{tmp_path}/{k}-{n}" for n in "ab"}, 10)
        assert kept["a"].n_leaves == 100
        assert sorted(r.block_id for r in trees.compare(kept["a"], kept["b"], most).collect()) == sorted({i // 10 for i in ids})


@pytest.mark.parametrize("most", [1, 2, 5, 200])
def test_rows_near_chosen_ranges(spark, most):
    df = spark.range(200).selectExpr("id", "id % 3 AS other")
    ranges = blocks.boundaries(df.where("id >= 20"), ["id"], 18)
    for chosen in ([], [0], [17], [3, 4, 5, 9], [0, 2, 4, 6, 8, 17]):
        got = {r.id for r in blocks.near_ranges(df, ["id"], ranges, ranges.where(F.col("block_id").isin(chosen)), most).collect()}
        want = {i for i in range(200) if max(i // 10 - 2, 0) in chosen}
        assert want <= got and len(got) <= len(want) + len(chosen)
        if not chosen:
            assert not got
    assert blocks.near_ranges(df, ["id"], ranges, ranges, most_chosen=5).count() == 200


def test_merging_that_does_not_end_is_an_error(spark):
    sized = spark.range(64).selectExpr("id AS block_id", "id AS range_start", "1L AS n_rows")
    with pytest.raises(RuntimeError):
        merkle.merged(sized, 1000, 2)


def test_guards_and_skipped_repairs(spark, tmp_path):
    from driftwell.sources import reports

    left, right = canonical_case(spark)
    found = pair(left, right)
    assert repair.guarded(found, T, left) is found
    with pytest.raises(ValueError, match="not one of table"):
        repair.guarded(found, T, left.drop("amount"))
    with pytest.raises(ValueError, match="recovery"):
        repair.guarded(found, T, left, origin="2")
    writes = repair.from_source(found, T, "n1").withColumn("stale", F.expr("if(id = 1, 'newer', null)"))
    after = {r.id: r.name for r in repair.applied(right, writes, "n2", T).collect()}
    assert after[1] == "changed" and after[2] == "n2"
    told = {(r.node, r.op): (r.n_rows, r.n_skipped) for r in reports.write_repairs(writes, T, f"{tmp_path}/x").collect()}
    assert told == {("n2", "upsert"): (3, 1), ("n2", "delete"): (2, 0)}
    assert reports.write_rerun(found, found.limit(0), T, f"{tmp_path}/y") == {"before": 6, "after": 0}


def test_plan_versions_and_priorities():
    with pytest.raises(ValueError, match="version"):
        rules.load('{"version": 9}')
    with pytest.raises(ValueError, match="both sides"):
        rules.load('{"priority": ["n1"]}')
    with pytest.raises(ValueError):
        rules.load("rules: [")
    assert rules.load('{"priority": ["n2", "n1"], "freshest": {"by": "t"}}').priority == ("n2", "n1")
