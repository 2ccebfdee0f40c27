"""Repair plans: rules that pick an action for each differing row.

A rule's condition is data (``where``, see ``conditions``), with NULL rules and type checks of its own, or Spark SQL (``when``) over
``n1.column`` and ``n2.column``, in which NULL compares as SQL does and a condition that is NULL does not match.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.diff import HAS
from ..operators.repair import DELETE, INSERT, UPSERT
from ..sources.nodes import Table
from .conditions import Compiler

#: ``apply_from`` writes one side's row to the other: replacing what is there, as an upsert, or only where nothing is.
APPLY = tuple(f"apply_from_{n}_{how}" for n in ("n1", "n2") for how in ("replace", "upsert", "insert"))
ACTIONS = ("keep_n1", "keep_n2", *APPLY, "bidirectional", "custom", "skip", "delete")
VERSION = 1


@dataclass(frozen=True)
class Rule:
    name: str
    action: str
    when: str | None = None
    where: dict | bool | None = None
    keys: tuple | None = None
    key_between: tuple | None = None
    diff_types: tuple[str, ...] = ()
    changed: tuple[str, ...] = ()

    def matches(self, table: Table, compiler: Compiler | None = None) -> Column:
        tests = [F.lit(True)]
        if self.keys is not None:
            wanted = [k if isinstance(k, tuple) else (k,) for k in self.keys]
            tests.append(reduce(Column.__or__, [reduce(Column.__and__, [F.col(c) == F.lit(v) for c, v in zip(table.key, k, strict=True)]) for k in wanted]))
        if self.key_between is not None:
            tests.append(F.col(table.key[0]).between(*self.key_between))
        if self.diff_types:
            tests.append(F.col("diff_type").isin(*self.diff_types))
        if self.changed:
            tests.append(F.arrays_overlap(F.split("changed_columns", ","), F.array(*map(F.lit, self.changed))))
        if self.when:
            tests.append(F.coalesce(F.expr(self.when), F.lit(False)))
        if self.where is not None:  # last and only where all else matches: it may be an error elsewhere
            if compiler is None:
                raise ValueError("a condition needs the columns of a diff")
            return F.when(reduce(Column.__and__, [F.coalesce(t, F.lit(False)) for t in tests]), compiler.condition(self.where)).otherwise(False)
        return reduce(Column.__and__, tests)


@dataclass(frozen=True)
class Plan:
    """``overrides`` are tried before ``rules``, and both in order; then ``default``. A custom row takes each
    column from, in this order: ``custom`` (a template ``{{n1.column}}``, or any SQL expression), the side with the
    freshest value of a column (``freshest``: {"by": column, "tie": side}), or the first side of ``priority`` that has one."""

    rules: tuple[Rule, ...] = ()
    overrides: tuple[Rule, ...] = ()
    default: str | None = None
    custom: dict[str, str] = field(default_factory=dict)
    priority: tuple[str, ...] = ("n1", "n2")
    freshest: dict[str, str] | None = None

    def value(self, column: str) -> Column:
        """The value of a column in a custom row."""
        if column in self.custom:
            text = str(self.custom[column])
            template = re.fullmatch(r"\s*\{\{\s*(n[12])\.(\w+)\s*\}\}\s*", text)
            return F.col(f"{template[1]}.{template[2]}") if template else F.expr(text)
        if self.freshest:
            return pick_freshest(column, self.freshest["by"], self.freshest.get("tie", "n1"))
        return F.coalesce(*[F.col(f"{n}.{column}") for n in self.priority])

    def __post_init__(self) -> None:
        for action in [r.action for r in (*self.overrides, *self.rules)] + [self.default or "skip"]:
            if action not in ACTIONS:
                raise ValueError(f"unknown action {action!r}")
        if sorted(self.priority) != ["n1", "n2"]:
            raise ValueError("the priority names both sides")


def load(text: str) -> Plan:
    """A plan from JSON, or from YAML where a reader for it is installed. ``version`` may be left out."""
    try:
        raw = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError:
            raise ValueError("the plan is not JSON, and there is no YAML reader here") from None
        try:
            raw = yaml.safe_load(text)
        except yaml.YAMLError as error:
            raise ValueError("the plan is neither JSON nor YAML") from error
    if raw.get("version", VERSION) != VERSION:
        raise ValueError(f"unknown plan version {raw['version']!r}")
    rule = lambda r: Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.items()})
    more = {k: raw[k] for k in ("freshest",) if k in raw} | ({"priority": tuple(raw["priority"])} if "priority" in raw else {})
    return Plan(tuple(map(rule, raw.get("rules", []))), tuple(map(rule, raw.get("overrides", []))), raw.get("default"), raw.get("custom", {}), **more)


def compiler(diffs: DataFrame, table: Table) -> Compiler:
    """Conditions over the rows of a diff; a key is NULL on a side that lacks the row, as all columns are."""
    sides: dict[str, dict] = {}
    for n in ("n1", "n2"):
        fields = {f.name: (F.col(f"{n}.`{f.name}`"), f.dataType) for f in diffs.schema[n].dataType.fields if f.name != HAS}
        keys = {k: (F.when(F.col(f"{n}.{HAS}").isNotNull(), F.col(k)), diffs.schema[k].dataType) for k in table.key}
        sides[n] = fields | keys
    return Compiler(sides)


def resolved(diffs: DataFrame, table: Table, plan: Plan) -> DataFrame:
    """Each differing row with the first rule that matches, and its action."""
    rule, action, compiled = F.lit(None).cast("string"), F.lit(plan.default), compiler(diffs, table)
    for r in reversed((*plan.overrides, *plan.rules)):
        hit = r.matches(table, compiled)
        rule, action = F.when(hit, F.lit(r.name)).otherwise(rule), F.when(hit, F.lit(r.action)).otherwise(action)
    out = diffs.withColumn("rule", rule).withColumn("action", action)
    return out if plan.default else out.withColumn("action", F.coalesce("action", F.raise_error(F.lit("a row matches no rule and there is no default"))))


def pick_freshest(column: str, by: str, tie: str = "n1") -> Column:
    """The value of the side whose ``by`` is larger; present beats null, ties go to ``tie``."""
    a, b = F.col(f"n1.{by}"), F.col(f"n2.{by}")
    first = F.when(a.isNull() & b.isNull(), F.lit(tie == "n1")).when(b.isNull(), True).when(a.isNull(), False).when(a == b, F.lit(tie == "n1")).otherwise(a > b)
    return F.when(first, F.col(f"n1.{column}")).otherwise(F.col(f"n2.{column}"))


def repairs(chosen: DataFrame, table: Table, columns: list[str], plan: Plan, conflicts: str = "first") -> DataFrame:
    """(node, key, op, row) of all resolved rows: one write for each node and key. With three nodes several pairs may write
    the same row; the first pair by name decides then, so that all follow the first node that an action names. With
    ``conflicts="error"`` writes that are not all the same are an error."""
    if conflicts not in ("first", "error"):
        raise ValueError(f"unknown way to settle conflicts {conflicts!r}")
    n1, n2 = F.substring_index("pair", "/", 1), F.substring_index("pair", "/", -1)
    has = lambda n: F.col(f"{n}.{HAS}").isNotNull()
    blank = F.struct(F.lit(1).alias(HAS), *[plan.value(c).alias(c) for c in columns])
    write = lambda to, op, row: F.struct(to.alias("node"), F.lit(op).alias("op"), row.alias("row"))
    same = F.struct(*[F.col(f"n1.{c}").alias(c) for c in (HAS, *columns)])
    row1, row2 = same, F.struct(*[F.col(f"n2.{c}").alias(c) for c in (HAS, *columns)])

    def keep(own: str, row: Column, to: Column) -> Column:
        return F.when(has(own), F.array(write(to, UPSERT, row))).otherwise(F.array(write(to, DELETE, row)))

    # replace is what a delete of the old row and an insert of the whole new one leave: an upsert of the whole row
    over = lambda own, row, to: F.when(has(own), F.array(write(to, UPSERT, row)))
    insert = lambda own, other, row, to: F.when(has(own) & ~has(other), F.array(write(to, INSERT, row)))
    made = (
        F.when(F.col("action") == "keep_n1", keep("n1", row1, n2))
        .when(F.col("action") == "keep_n2", keep("n2", row2, n1))
        .when(F.col("action") == "apply_from_n1_insert", insert("n1", "n2", row1, n2))
        .when(F.col("action") == "apply_from_n2_insert", insert("n2", "n1", row2, n1))
        .when(F.col("action").isin("apply_from_n1_replace", "apply_from_n1_upsert"), over("n1", row1, n2))
        .when(F.col("action").isin("apply_from_n2_replace", "apply_from_n2_upsert"), over("n2", row2, n1))
        .when(F.col("action") == "bidirectional", F.coalesce(insert("n1", "n2", row1, n2), insert("n2", "n1", row2, n1)))
        .when(F.col("action") == "custom", F.array(write(n1, UPSERT, blank), write(n2, UPSERT, blank)))
        .when(F.col("action") == "delete", F.array(*[write(n, DELETE, row1) for n in (n1, n2)]))
    )
    writes = chosen.select("pair", *table.key, F.explode(made).alias("w")).select("w.node", *table.key, "pair", F.struct("w.op", "w.row").alias("w"))
    picked = writes.groupBy("node", *table.key).agg(F.min_by("w", "pair").alias("w"), F.size(F.collect_set("w")).alias("kinds"))  # a pair or two write to a node
    if conflicts == "error":
        clash = F.raise_error(F.concat(F.lit("different writes to "), "node", F.lit(" for the key "), F.to_json(F.struct(*table.key))))
        picked = picked.withColumn("w", F.when(F.col("kinds") > 1, clash).otherwise(F.col("w")))
    return picked.select("node", *table.key, "w.op", "w.row")


def usage(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("pair", "rule", "action").agg(F.count("*").alias("n_rows"))
