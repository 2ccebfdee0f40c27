"""Nodes: named places that each hold a copy of the same tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import check_identifier


@dataclass(frozen=True)
class Table:
    """A table by name, with its key. ``meta`` columns say when and where a row was written; they are
    never compared."""

    name: str
    key: tuple[str, ...]
    meta: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for part in self.name.split("."):
            check_identifier(part)
        if not self.key:
            raise ValueError(f"table {self.name} has no primary key")

    def columns(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if c not in self.key and c not in self.meta]


@dataclass
class Cluster:
    """Nodes by name; each gives the DataFrame of a table."""

    nodes: Mapping[str, Callable[[str], DataFrame]]
    origins: dict[str, str] = field(default_factory=dict)

    def frame(self, node: str, table: Table, where: str | Column | None = None) -> DataFrame:
        df = self.nodes[node](table.name)
        return df if where is None else df.where(F.expr(where) if isinstance(where, str) else where)

    def pairs(self, chosen: list[str] | None = None) -> list[tuple[str, str]]:
        """All unordered pairs, by name."""
        names = sorted(chosen or self.nodes)
        if not 2 <= len(names) <= 3:
            raise ValueError(f"a diff takes two or three nodes, not {len(names)}")
        return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


def parquet_node(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{folder}/{name}")


def jdbc_node(spark: SparkSession, url: str, **options: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def same_schema(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns whose types differ; other column lists are an error."""
    if left.columns != right.columns:
        raise ValueError(f"table schemas don't match between nodes: {left.columns} and {right.columns}")
    kinds = dict(right.dtypes)
    return [c for c, kind in left.dtypes if kinds[c] != kind]


def has_rows(df: DataFrame, where: str) -> None:
    """A filter that leaves nothing is an error of its own."""
    if df.where(where).isEmpty():
        raise ValueError("table filter produced no rows")


def unique_key(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The key values that occur more than once."""
    return df.groupBy(*key).count().where("count > 1")


def until(df: DataFrame, column: str, time: str) -> DataFrame:
    """Rows committed by ``time``; rows without a commit time are frozen and stay."""
    return df.where(F.col(column).isNull() | (F.col(column) <= F.lit(time).cast("timestamp")))


def written_by(df: DataFrame, column: str, origin: str) -> DataFrame:
    if not origin.isdigit():
        raise ValueError(f"origin must be numeric: {origin!r}")
    return df.where(F.col(column) == origin)


def key_range(df: DataFrame, key: tuple[str, ...], start: tuple | None, end: tuple | None) -> DataFrame:
    """Rows with start <= key < end, keys of several columns in lexicographic order; None is open."""

    def bound(values: tuple, strict: bool) -> Column:
        out = F.lit(not strict)
        for name, value in reversed(list(zip(key, values, strict=True))):
            v = F.lit(value).cast(df.schema[name].dataType)
            out = (F.col(name) > v) | ((F.col(name) == v) & out)
        return out

    if start is not None:
        df = df.where((F.col(key[0]) >= F.lit(start[0])) & bound(start, False))
    if end is not None:
        df = df.where((F.col(key[0]) <= F.lit(end[0])) & ~bound(end, False))
    return df


def by_keys(df: DataFrame, keys: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The rows of the given keys."""
    return df.join(keys.select(*key).distinct(), list(key), "left_semi")
