"""Helpers that several operators share: the shared folder, lineage cuts, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in every operator of this package: blank and the five ASCII controls.
SPACE = r"[\x20\x09-\x0D]+"
#: Spark's setting that removes the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, one is made on a single machine
    (tests); a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-driftwell-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there,
    and a lost executor costs no recomputation. Nothing needs the write's shuffle files once it has ended:
    they go at once, not when the driver next collects garbage."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def lower_az(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """The words of a text as an array; no words for null, empty or blank text."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def held_out(doc_id: Column) -> Column:
    """True for the rows that no label may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fenced(df: DataFrame, **made: Column) -> DataFrame:
    """Add columns that are computed once for each row: a generator stands between them and what
    uses them, so that the optimizer does not repeat an expression at each place of use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in made.items()]))))


#: Tasks that the rows of one key are dealt over: the bits of a long.
SALTS = 64


def salt_of(by: list[str]) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")


def salts(by: list[str]) -> Column:
    """An aggregate: the salts of a key's rows as bits of one number."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt_of(by))).alias("_salts")


def beside(df: DataFrame, side: DataFrame, key: list[str], by: list[str], once: bool = False) -> DataFrame:
    """``df`` joined to ``side``, which has one row for each key. The rows of one key, which may be a third
    of all, are dealt over SALTS tasks by the columns ``by``: ``side`` has a copy for each salt that is
    there, so at most one for each row. A ``side`` made from ``df`` can bring them as ``salts(by)``. With
    ``once`` repeated rows come once, and need no second shuffle for it."""
    known = side if "_salts" in side.columns else side.join(df.groupBy(*key).agg(salts(by)).hint("merge"), key)
    present = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("_salts", i) == 1)
    dealt = known.select(*[c for c in side.columns if c != "_salts"], F.explode(present).alias("_salt"))
    met = df.withColumn("_salt", salt_of(by)).join(dealt.hint("merge"), [*key, "_salt"])
    return (met.distinct() if once else met).drop("_salt")


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores in front until no column of the table is called so."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name
