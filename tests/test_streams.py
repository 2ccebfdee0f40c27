"""Change log, stateful transactions and drains."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftwell.operators import merkle
from driftwell.sources import changelog, trees
from driftwell.sources.nodes import Table
from driftwell.streaming import drain, transactions

T = Table("t", ("id",))


class Log:
    def __init__(self, spark, folder):
        self.spark, self.place = spark, f"file://{folder}"
        self.log, self.out, self.checkpoint = (f"{self.place}/{x}" for x in ("log", "out", "checkpoint"))

    def put(self, *rows):
        return changelog.append(self.spark.createDataFrame(rows, changelog.SCHEMA), self.log)

    def run(self, target=None, **more):
        return drain.bounded(self.spark, self.log, drain.kept(self.out), self.checkpoint, target, **more)

    def have(self):
        return sorted((r.lsn, r.commit_lsn) for r in drain.delivered(self.spark, self.out).collect())

    def open(self):
        return sorted(r.lsn for r in transactions.open_changes(self.spark, self.checkpoint).collect())


@pytest.fixture(autouse=True)
def few_stores(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, tmp_path)


def test_log_segments(log):
    assert changelog.head(log.log) == 0
    assert log.put((3, 1, "INSERT", 1), (5, 1, "COMMIT", None)) == 5
    assert log.put() == 5
    with pytest.raises(ValueError, match="not behind"):
        log.put((5, 2, "INSERT", 1))
    log.put((9, 2, "INSERT", 1))
    assert [s[:2] for s in changelog.segments(log.log)] == [(3, 5), (9, 9)]
    assert changelog.position(log.spark, log.checkpoint) is None


def test_a_change_without_a_key_stops_the_drain(log):
    log.put((1, 1, "UPDATE", None), (2, 1, "COMMIT", None))
    with pytest.raises(RuntimeError, match="stopped before its target") as error:
        log.run()
    assert "without a primary key" in str(error.value.__cause__)


def test_interleaved_late_aborted_and_open(log):
    log.put((1, 1, "INSERT", 10), (2, 2, "INSERT", 20), (3, 1, "UPDATE", 10), (4, 3, "DELETE", 30), (5, 1, "COMMIT", None), (6, 4, "TRUNCATE", None))
    assert log.run() == 6
    assert log.have() == [(1, 5), (3, 5)] and log.open() == [2, 4, 6]
    log.put((7, 2, "UPDATE", 21), (8, 3, "ABORT", None), (9, 1, "INSERT", 11), (10, 4, "COMMIT", None))  # xid 1 again
    log.run(8)
    assert log.have() == [(1, 5), (3, 5)] and log.open() == [2, 6, 7]
    log.run()
    assert log.have() == [(1, 5), (3, 5), (6, 10)] and log.open() == [2, 7, 9]
    log.run()  # nothing new
    log.put((11, 1, "COMMIT", None), (12, 2, "COMMIT", None), (13, 9, "COMMIT", None))
    log.run()
    assert log.have() == [(1, 5), (2, 12), (3, 5), (6, 10), (7, 12), (9, 11)] and log.open() == []
    keys = {r.lsn: (r.op, r.pk) for r in drain.delivered(log.spark, log.out).collect()}
    assert keys[6] == ("TRUNCATE", None) and keys[7] == ("UPDATE", 21)


def test_one_xid_ends_many_times_in_one_batch(log):
    rows = []
    for k in range(12):
        end = ("COMMIT", "ABORT", "COMMIT")[k % 3]
        rows += [(10 * k + 1, 7, "INSERT", k), (10 * k + 2, 7, "UPDATE", k), (10 * k + 3, 7, end, None)]
    log.put(*rows, (200, 7, "DELETE", 5))
    log.run()
    assert log.have() == sorted((10 * k + i, 10 * k + 3) for k in range(12) if k % 3 != 1 for i in (1, 2)) and log.open() == [200]


def test_targets(log):
    log.put(*[(k, k, op, pk) for k in range(1, 9, 2) for op, pk in (("INSERT", k),)])
    with pytest.raises(ValueError, match="ends at 7"):
        log.run(8)
    assert log.run(3) == 3 and log.open() == [1, 3]
    assert log.run(2) == 3  # it has been passed
    assert log.run() == 7 and log.open() == [1, 3, 5, 7]


def test_a_large_transaction_over_many_batches(spark, log):
    n = 30_000
    changelog.append(spark.range(1, n + 1).selectExpr("id AS lsn", "1L AS xid", "'INSERT' AS op", "id AS pk"), log.log)
    for target in (n // 3, n // 2, n):
        log.run(target)
    assert drain.delivered(spark, log.out).count() == 0 and transactions.open_changes(spark, log.checkpoint).count() == n
    log.put((n + 1, 1, "COMMIT", None))
    log.run()
    got = drain.delivered(spark, log.out)
    assert got.count() == n and got.select("pk").distinct().count() == n and log.open() == []


def test_restart_at_each_position(spark, tmp_path):
    """Wherever a drain stops, the next one ends with the same changes."""
    rows = [(1, 1, "INSERT", 1), (2, 2, "INSERT", 2), (3, 1, "COMMIT", None), (4, 3, "UPDATE", 3), (5, 2, "UPDATE", 2), (6, 2, "COMMIT", None), (7, 3, "ABORT", None)]
    want = [(1, 3), (2, 6), (5, 6)]
    for stop in range(1, 8):
        one = Log(spark, tmp_path / str(stop))
        one.put(*rows[:4])
        one.put(*rows[4:])
        one.run(stop)
        assert one.have() == [x for x in want if x[1] <= stop]
        one.run()
        assert one.have() == want


def test_a_failed_sink_gets_its_batch_again(spark, log):
    log.put((1, 1, "INSERT", 1), (2, 1, "COMMIT", None), (3, 2, "INSERT", 2))

    def broken(df, batch):
        drain.kept(log.out)(df, batch)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="stopped before its target"):
        drain.bounded(spark, log.log, broken, log.checkpoint)
    log.put((4, 2, "COMMIT", None))
    log.run()
    assert log.have() == [(1, 2), (3, 4)]


def test_listen_in_steps_over_a_restart(spark, log):
    log.put(*[(k, k // 4, "COMMIT" if k % 4 == 3 else "INSERT", None if k % 4 == 3 else k) for k in range(1, 40)])
    want = [(k, k - k % 4 + 3) for k in range(1, 40) if k % 4 != 3]
    batches = []
    for more in ([], [(40, 10, "INSERT", 40), (41, 10, "COMMIT", None)]):
        if more:
            log.put(*more)
        q = drain.listen(spark, log.log, drain.kept(log.out), log.checkpoint, "0 seconds", 10)
        q.processAllAvailable()
        batches.append({json.loads(json.loads(p.json)["sources"][0]["endOffset"])["position"] if isinstance(json.loads(p.json)["sources"][0]["endOffset"], str) else json.loads(p.json)["sources"][0]["endOffset"]["position"] for p in q.recentProgress})
        q.stop()
    assert log.have() == [*want, (40, 41)]
    assert batches[0] >= {10, 20, 30, 39} and max(batches[1]) == 41


def test_overdue_transactions_are_reported_and_stay(log):
    log.put((1000, 1, "INSERT", 1), (1500, 2, "INSERT", 2))
    log.run(late=2000)
    log.put((9000, 2, "COMMIT", None), (9500, 3, "INSERT", 3))
    log.run(late=2000)
    log.put((9900, 1, "COMMIT", None))
    log.run(late=2000)
    assert sorted((r.xid, r.lsn) for r in drain.overdue(log.spark, log.out).collect()) == [(1, 1000), (2, 1500)]
    assert log.have() == [(1000, 9900), (1500, 9000)]


def test_tree_and_drain_move_together(spark, tmp_path):
    one, old = Log(spark, tmp_path), spark.range(60).selectExpr("id", "cast(id AS string) AS name")
    tree = trees.build_trees({"a": old}, T, {"a": f"{one.place}/tree"}, 10)["a"]
    new = old.where("id <> 7").withColumn("name", F.expr("if(id = 33, 'x', name)"))
    sink = drain.into_tree(tree.place, lambda: new, T)
    one.put((1, 1, "DELETE", 7), (2, 2, "UPDATE", 33), (3, 1, "COMMIT", None))
    drain.bounded(spark, one.log, sink, one.checkpoint)
    half = trees.open_tree(spark, tree.place)
    assert half.about["number"] == tree.about["number"] + 1 and half.leaves.where("block_id = 3").first().l0 == tree.leaves.where("block_id = 3").first().l0
    one.put((4, 2, "COMMIT", None))
    drain.bounded(spark, one.log, sink, one.checkpoint)
    now = trees.open_tree(spark, tree.place)
    fresh = merkle.leaves(new, T, now.ranges)
    key = lambda df: sorted(map(tuple, df.select("node_position", *merkle.HASH).collect()))
    assert key(now.leaves) == key(fresh)
    sink(spark.createDataFrame([("DELETE", 1)], "op string, pk long"), now.about["batch"])  # again
    assert trees.open_tree(spark, tree.place).about == now.about
    with pytest.raises(OSError, match="another version"):  # an update of a version that is not the last one
        trees.update(half, new, T, spark.createDataFrame([("UPDATE", 5)], "op string, id long"))


class States:
    """The state of one key, in memory."""

    def __init__(self):
        self.maps, self.timers = {}, set()
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.discard

    def getMapState(self, name, *_):
        return Map(self.maps.setdefault(name, {}))

    def getValueState(self, name, *_):
        return Map(self.maps.setdefault(name, {}))


class Map:
    def __init__(self, held):
        self.held = held
        self.getValue, self.removeKey, self.containsKey = held.__getitem__, held.pop, held.__contains__

    def exists(self):
        return bool(self.held)

    def keys(self):
        return iter(list(self.held))

    def iterator(self):
        return iter(list(self.held.items()))

    def updateValue(self, key, value):
        self.held[key] = value

    def get(self):
        return self.held[0]

    def update(self, value):
        self.held[0] = value


@pytest.mark.parametrize("late", [None, 9])
def test_a_bucket_of_random_transactions(monkeypatch, late):
    """Ends in any order within a batch, xids used again, lists of the state and of the memory that are full."""
    monkeypatch.setattr(transactions, "CHUNK", 2)
    monkeypatch.setattr(transactions, "MEMORY", 5)
    draw = random.Random(5)
    for _ in range(60):
        log = [(lsn, draw.randrange(4), draw.choice(["INSERT", "UPDATE", "UPDATE", "COMMIT", "ABORT"]), lsn * 10) for lsn in range(1, draw.randrange(2, 60))]
        ends = lambda lsn, xid, upto=10**9: next((x for x in log if lsn < x[0] <= upto and x[1] == xid and x[2] in ("COMMIT", "ABORT")), None)
        states, got, reported, at = States(), [], set(), 0
        buffer = transactions._Buffer(late)
        buffer.init(states)
        while at < len(log):
            batch = log[at : at + draw.randrange(1, 25)]
            at += len(batch)
            draw.shuffle(batch)
            parts = [pd.DataFrame(batch[k : k + 4], columns=["lsn", "xid", "op", "pk"]) for k in range(0, len(batch), 4)]
            for out in buffer.handleInputRows((3,), iter(parts), None):
                got += out[out["op"] != transactions.OVERDUE].values.tolist()
                reported |= set(out.loc[out["op"] == transactions.OVERDUE, "xid"])
            changes = [x for x in log[:at] if x[2] not in ("COMMIT", "ABORT")]
            assert sorted(got) == sorted([lsn, xid, op, pk, end[0]] for lsn, xid, op, pk in changes for end in [ends(lsn, xid, at)] if end and end[2] == "COMMIT")
            assert sorted(r[0] for (rows,) in states.maps["open"].values() for r in rows) == [x[0] for x in changes if not ends(x[0], x[1], at)]
            if late is not None:
                still = {x[1] for x in changes if not ends(x[0], x[1], at)}
                assert {xid for (xid,) in states.maps["due"].values()} == still and states.timers == {lsn + late for (lsn,) in states.maps["due"]}
                assert reported <= {x[1] for x in changes if (ends(x[0], x[1], at) or (0,))[0] - x[0] >= late}


def test_very_many_transactions_are_few_keys_of_the_state(spark, log):
    n = 3000
    changelog.append(spark.range(1, n + 1).selectExpr("id AS lsn", "id AS xid", "'INSERT' AS op", "id AS pk"), log.log)
    log.run()
    held = spark.read.format("statestore").option("stateVarName", "open").load(log.checkpoint)
    assert held.select("key").distinct().count() <= transactions.BUCKETS and log.open() == list(range(1, n + 1))
