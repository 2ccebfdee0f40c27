"""Transactions of a change stream, released at their commit.

Changes of many transactions stand in the log one among another. Each waits in keyed state until its transaction's COMMIT has
been seen, and goes with an ABORT. So what is held, read and written in a batch are open transactions and the batch
itself, never the log. Transactions are dealt over BUCKETS keys, each of which takes in the changes of very many at a time, as a
call into Python and its state costs the same for one change as for thousands. The changes of one transaction go to SALTS of
these keys by their position, SPAN positions in a row to one, and so those of a large one are held by many tasks and those of
a small one mostly by one; its end is sent to all of them. A bucket's state has a list of at most CHUNK changes for each number
of a transaction; only lists of transactions that end are read. In memory are at most MEMORY changes of a batch, what is beyond waits in the state.

An end holds for what stands before it: an xid that is used again is a new transaction. With ``overdue`` a transaction
that is still open so many positions after its first change is reported by a row (op OVERDUE), at its end at the latest; it stays open. The
timers for that take the log position as the event time, in milliseconds, so positions end at 9.2e15 then; the source
gives them in order, so none is late. A checkpoint keeps to streams with ``overdue`` or to those without, and those of
versions that held changes by transaction are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COMMIT, ABORT, OVERDUE, TRUNCATE = "COMMIT", "ABORT", "OVERDUE", "TRUNCATE"
OPS = ("INSERT", "UPDATE", "DELETE", TRUNCATE)
#: Keys of the state, those that the changes of one transaction are dealt over, and positions in a row that go to one of them. They
#: are fixed, as a checkpoint keeps what they have dealt.
BUCKETS, SALTS, SPAN = 256, 8, 10_000
#: Changes in one list of the state, and changes of a batch that a bucket has in memory.
CHUNK, MEMORY = 10_000, 200_000
FIELDS = "lsn long, xid long, op string, pk long, commit_lsn long"
_CHANGE = ["xid", "lsn", "op", "pk"]
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def checked(stream: DataFrame) -> DataFrame:
    """Only known operations and ends; a change without a key is an error, except TRUNCATE."""
    bad = F.col("pk").isNull() & ~F.col("op").isin(TRUNCATE, COMMIT, ABORT)
    return stream.where(F.col("op").isin(*OPS, COMMIT, ABORT)).withColumn("pk", F.when(bad, F.raise_error(F.lit("change without a primary key"))).otherwise(F.col("pk")))


class _Buffer(StatefulProcessor):
    def __init__(self, overdue: int | None):
        self.overdue = overdue

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.number = handle, handle.getValueState("number", "number long")
        self.open = handle.getMapState("open", "xid long, number long", "rows array<struct<lsn: long, op: string, pk: long>>")
        self.due = None if self.overdue is None else handle.getMapState("due", "lsn long", "xid long")

    def close(self) -> None:
        pass

    def _hold(self, changes: pd.DataFrame) -> None:
        if not len(changes):
            return
        known = {xid for _, (xid,) in self.due.iterator()} if self.due is not None else set()
        number = self.number.get()[0] if self.number.exists() else 0
        for xid, rows in changes.sort_values(["xid", "lsn"]).groupby("xid", sort=False):
            values = list(zip(rows["lsn"].tolist(), rows["op"].tolist(), rows["pk"].tolist(), strict=True))
            for k in range(0, len(values), CHUNK):
                self.open.updateValue((int(xid), number), (values[k : k + CHUNK],))
                number += 1
            if self.due is not None and xid not in known:
                self.due.updateValue((values[0][0],), (int(xid),))
                self.handle.registerTimer(values[0][0] + self.overdue)
        self.number.update((number,))

    def _released(self, xids: set[int]) -> Iterator[pd.DataFrame]:
        """What the state holds of these transactions, which goes from there."""
        parts, n = [], 0
        for xid, number in [k for k in self.open.keys() if k[0] in xids] if self.open.exists() else []:
            rows = self.open.getValue((xid, number))[0]
            self.open.removeKey((xid, number))
            parts.append(pd.DataFrame([tuple(r) for r in rows], columns=_CHANGE[1:]).assign(xid=xid))
            n += len(rows)
            if n >= CHUNK:
                yield pd.concat(parts)[_CHANGE]
                parts, n = [], 0
        if parts:
            yield pd.concat(parts)[_CHANGE]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        ends, parts, n = [], [], 0
        for part in rows:
            is_end = part["op"].isin((COMMIT, ABORT))
            ends.append(part.loc[is_end, ["xid", "lsn", "op"]])
            parts.append(part.loc[~is_end, _CHANGE])
            n += len(parts[-1])
            if n > MEMORY:
                self._hold(pd.concat(parts))
                parts, n = [], 0
        ends = pd.concat(ends).sort_values("lsn", ignore_index=True)
        if not len(ends):
            self._hold(pd.concat(parts) if parts else ends)
            return
        ends["end"] = np.arange(len(ends))
        at, commits, first = ends["lsn"].to_numpy(), (ends["op"] == COMMIT).to_numpy(), ends.groupby("xid")["end"].min()
        firsts, later = [], []
        for part in (*self._released(set(ends["xid"].tolist())), *([pd.concat(parts)] if parts else [])):
            met = pd.merge_asof(part.sort_values("lsn"), ends[["lsn", "xid", "end"]], on="lsn", by="xid", direction="forward")  # the first end that is not before the change
            ended = met["end"].notna()
            later.append(met.loc[~ended, _CHANGE])
            met, end = met[ended], met.loc[ended, "end"].to_numpy(dtype=np.int64)
            if self.due is not None:
                firsts.append(met[end == first.reindex(met["xid"]).to_numpy()].groupby("xid")["lsn"].min())
            done = met[commits[end]].assign(commit_lsn=at[end][commits[end]])
            if len(done):
                yield done[["lsn", "xid", "op", "pk", "commit_lsn"]]
        if self.due is not None:
            for (lsn,), (xid,) in list(self.due.iterator()):
                if xid in first.index:
                    self.due.removeKey((lsn,))
                    self.handle.deleteTimer(lsn + self.overdue)
            begun = pd.concat(firsts).groupby(level=0).min() if firsts else first.iloc[:0]
            late = begun[begun.to_numpy() + self.overdue <= at[first.reindex(begun.index).to_numpy()]]
            if len(late):
                yield self._report(late.index.to_numpy(), late.to_numpy())  # at their end at the latest
        if later:
            self._hold(pd.concat(later))

    def _report(self, xids: np.ndarray, lsns: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"lsn": lsns, "xid": xids, "op": OVERDUE, "pk": 0, "commit_lsn": -1})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        lsn = expiredTimerInfo.getExpiryTimeInMs() - self.overdue
        if self.due.containsKey((lsn,)):
            yield self._report(np.array([self.due.getValue((lsn,))[0]]), np.array([lsn]))


def committed(stream: DataFrame, overdue: int | None = None) -> DataFrame:
    """The changes of a log's stream (lsn, xid, op, pk), each in the batch that shows its commit, with commit_lsn."""
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != _PROVIDER:  # keyed lists need it; set once
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    salt = F.when(F.col("op").isin(COMMIT, ABORT), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.expr(f"cast(pmod(lsn div {SPAN}, {SALTS}) AS int)")))
    dealt = checked(stream).withColumn("salt", F.explode(salt))
    bucket = F.pmod(F.pmod(F.xxhash64("xid"), F.lit(BUCKETS).cast("long")) + F.col("salt") * (BUCKETS // SALTS), F.lit(BUCKETS)).cast("int")
    rows = dealt.select(bucket.alias("bucket"), "xid", "lsn", "op", F.coalesce("pk", F.lit(0).cast("long")).alias("pk"))
    timed = rows if overdue is None else rows.withColumn("at", F.timestamp_millis("lsn")).withWatermark("at", "0 seconds")
    out = timed.groupBy("bucket").transformWithStateInPandas(statefulProcessor=_Buffer(overdue), outputStructType=FIELDS, outputMode="append", timeMode="none" if overdue is None else "eventTime")
    return out.withColumn("pk", F.when(~F.col("op").isin(TRUNCATE, OVERDUE), F.col("pk"))).withColumn("commit_lsn", F.when(F.col("op") != OVERDUE, F.col("commit_lsn")))


def open_changes(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What waits in the state of a checkpoint: xid, lsn, op, pk."""
    held = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
    kept = held.select(F.col("user_map_key.xid").alias("xid"), F.explode("user_map_value.rows").alias("r")).select("xid", "r.lsn", "r.op", "r.pk")
    return kept.withColumn("pk", F.when(F.col("op") != TRUNCATE, F.col("pk")))
