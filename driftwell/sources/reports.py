"""Reports, ranges, skip lists, cluster files and task records: what is read from and written to files."""

from __future__ import annotations

import html
import json
import os
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from ..functions.normalize import check_identifier
from ..operators.diff import HAS
from .nodes import Cluster, Table, parquet_node


def write_report(diffs: DataFrame, place: str) -> bool:
    """A diff as JSON lines, by pair and key, in as many files as Spark has partitions. Nothing is written
    if there are no differences."""
    if diffs.isEmpty():
        return False
    diffs.write.mode("overwrite").json(place, ignoreNullFields=False)
    return True


def write_rerun(before: DataFrame, after: DataFrame, table: Table, place: str) -> dict[str, int]:
    """What of a diff still differs, as a report of its own; returns how many keys did and do."""
    counts = {"before": before.count(), "after": after.count()}
    if counts["after"]:
        write_report(after, place)
    return counts


def write_repairs(repairs: DataFrame, table: Table, place: str) -> DataFrame:
    """The writes of a repair as JSON lines, stale ones in a list of their own; returns how many rows each
    node gets by operation, and how many were left out."""
    stale = F.col("stale") if "stale" in repairs.columns else F.lit(None).cast("string")
    marked = repairs.withColumn("stale", stale)
    marked.where("stale IS NULL").drop("stale").write.mode("overwrite").json(f"{place}/repairs", ignoreNullFields=False)
    write_skipped(marked, table, f"{place}/skipped")
    return marked.groupBy("node", "op").agg(F.count_if(F.col("stale").isNull()).alias("n_rows"), F.count_if(F.col("stale").isNotNull()).alias("n_skipped"))


def write_skipped(repairs: DataFrame, table: Table, place: str) -> None:
    """The repairs that were left out as stale: node, key, op and the reason."""
    repairs.where("stale IS NOT NULL").select("node", *table.key, "op", F.col("stale").alias("reason")).write.mode("overwrite").json(place, ignoreNullFields=False)


def read_report(spark: SparkSession, place: str, table: Table, schema: StructType) -> DataFrame:
    """A report as a diff; ``schema`` is that of the table. Reports of another table are an error."""
    key = [schema[k] for k in table.key]
    others = [f for f in schema.fields if f.name not in table.key]
    row = StructType().add(HAS, T.IntegerType())
    for f in others:
        row = row.add(f)
    whole = StructType()
    for f in key:
        whole = whole.add(f)
    whole = whole.add("n1", row).add("n2", row).add("diff_type", T.StringType()).add("changed_columns", T.StringType()).add("pair", T.StringType())
    df = spark.read.schema(whole).json(place)
    if not df.where(F.col("diff_type").isNull() | F.col("pair").isNull()).isEmpty():
        raise ValueError(f"{place} is not a diff report of {table.name}")
    return df


def write_html(diffs: DataFrame, table: Table, path: str, most: int = 1000) -> None:
    """A page with the first ``most`` differences by key, the parts of values that differ in bold."""
    rows = diffs.orderBy("pair", *table.key).limit(most).collect()

    def cells(old: str, new: str) -> tuple[str, str]:
        a = len(os.path.commonprefix([old, new]))
        b = len(os.path.commonprefix([old[a:][::-1], new[a:][::-1]]))
        bold = lambda x: html.escape(x[:a]) + "<b>" + html.escape(x[a : len(x) - b]) + "</b>" + html.escape(x[len(x) - b :])
        return bold(old), bold(new)

    lines = []
    for r in rows:
        key = "|".join(str(r[k]) for k in table.key)
        for c in [x for x in r["changed_columns"].split(",") if x] or ["*"]:
            old, new = (str(r[n][c]) if c != "*" else ("present" if r[n] and r[n][HAS] else "missing") for n in ("n1", "n2"))
            lines.append("<tr><td>" + "</td><td>".join([html.escape(r["pair"]), html.escape(key), html.escape(c), *cells(old, new)]) + "</td></tr>")
    with open(path, "w") as f:
        f.write("<!doctype html><meta charset=utf-8><title>" + html.escape(table.name) + "</title><table>" + "\n".join(lines) + "</table>")


def write_ranges(ranges: DataFrame, place: str) -> None:
    ranges.write.mode("overwrite").json(place)


def read_ranges(spark: SparkSession, place: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(place)


def skip_list(names: str = "", path: str | None = None) -> list[str]:
    """Tables to leave out: comma-separated, and one a line in a file."""
    found = names.split(",")
    if path:
        with open(path) as f:
            found += f.read().splitlines()
    out = [n.strip() for n in found if n.strip()]
    for n in out:
        for part in n.split("."):
            check_identifier(part)
    return out


def cluster_from(spark: SparkSession, path: str) -> Cluster:
    """A cluster from a JSON file: {"nodes": {name: folder}, "origins": {id: name}}."""
    with open(path) as f:
        raw = json.load(f)
    return Cluster({n: parquet_node(spark, folder) for n, folder in raw["nodes"].items()}, raw.get("origins", {}))


@contextmanager
def task(folder: str, kind: str, **context: object) -> Iterator[dict]:
    """Record a task: one JSON file for each, PENDING while it runs, then COMPLETED or FAILED. Errors are
    raised on."""
    began = datetime.now(timezone.utc)
    record = {"task_type": kind, "status": "PENDING", "started_at": began.isoformat(), "context": context}
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{began.strftime('%Y%m%dT%H%M%S%f')}-{kind}.json")

    def save() -> None:
        with open(path, "w") as f:
            json.dump(record, f)

    save()
    try:
        yield record
    except BaseException as error:
        record |= {"status": "FAILED", "error": str(error)[:1000]}
        raise
    else:
        record["status"] = "COMPLETED"
    finally:
        ended = datetime.now(timezone.utc)
        record |= {"finished_at": ended.isoformat(), "seconds": (ended - began).total_seconds()}
        save()


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.json(folder)
