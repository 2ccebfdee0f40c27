"""The registered queries over the test tables, and the same results in DuckDB SQL.

Nodes n1, n2 and n3 are derived from a table: each drops some keys and changes the text column of some rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import normalize
from .operators import blocks, diff, inventory, merkle, repair
from .plans import rules
from .sources import changelog, nodes, parted, reports, trees
from .sources.shared import shared_dir, written
from .streaming import drain, transactions

KEYS = {
    "customer": (("c_custkey",), "c_mktsegment"),
    "orders": (("o_orderkey",), "o_orderstatus"),
    "part": (("p_partkey",), "p_brand"),
    "events": (("event_id",), "event_type"),
    "documents": (("doc_id",), "lang"),
    "conversations": (("conv_id", "turn"), "role"),
}
#: Of each node: rows it drops, rows it changes, by modulus and remainder of the key (fixed values).
_NODES = {"n1": ((83, 5), None), "n2": ((97, 7), (89, 11)), "n3": ((101, 3), (79, 13))}
_PAIRS = {"n1": ((17, 3), None), "n2": ((19, 4), (23, 5))}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(name: str, node: str) -> tuple[str, str, str | None, str]:
    key, text = KEYS[name]
    k, rule = (key[0], _NODES) if len(key) == 1 else ("conv_id * 7 + turn", _PAIRS)
    drop, change = rule[node]
    return f"({k}) % {drop[0]} <> {drop[1]}", text, change and f"({k}) % {change[0]} = {change[1]}", f"{text} || '~{node[1]}'"


def node(spark: SparkSession, sf_dir: str, name: str, which: str) -> DataFrame:
    keep, text, change, new = _parts(name, which)
    df = table(spark, sf_dir, name).where(keep)
    return df.withColumn(text, F.expr(f"CASE WHEN {change} THEN {new} ELSE {text} END")) if change else df


def cte(name: str, which: list[str] | None = None) -> str:
    """The nodes as common table expressions."""
    out = []
    for n in which or (["n1", "n2", "n3"] if len(KEYS[name][0]) == 1 else ["n1", "n2"]):
        keep, text, change, new = _parts(name, n)
        changed = f"* REPLACE (CASE WHEN {change} THEN {new} ELSE {text} END AS {text})" if change else "*"
        out.append(f"{n} AS (SELECT {changed} FROM {name} WHERE {keep})")
    return ", ".join(out)


def spec(name: str) -> nodes.Table:
    return nodes.Table(name, KEYS[name][0])


def cluster(spark: SparkSession, sf_dir: str, name: str, which: tuple[str, ...] = ("n1", "n2")) -> nodes.Cluster:
    return nodes.Cluster({n: (lambda t, n=n: node(spark, sf_dir, t, n)) for n in which})


def columns(name: str) -> list[str]:
    return {
        "customer": ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
        "orders": ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
        "part": ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
        "events": ["ts", "user_id", "event_type", "value", "props"],
        "documents": ["text", "lang", "source", "n_chars"],
        "conversations": ["role", "text"],
    }[name]


def diff_sql(name: str, pairs: tuple[tuple[str, str], ...] = (("n1", "n2"),), where: str = "TRUE", nodes_sql: str = "") -> str:
    """pair, diff_type, key and changed_columns of all pairs."""
    key = KEYS[name][0]
    parts = []
    for a, b in pairs:
        on = " AND ".join(f"a.{k} = b.{k}" for k in key)
        names = ", ".join(f"coalesce(a.{k}, b.{k}) AS {k}" for k in key)
        changed = ", ".join(f"CASE WHEN a.{c} IS DISTINCT FROM b.{c} THEN '{c}' END" for c in columns(name))
        differs = " OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in columns(name))
        parts.append(
            f"SELECT '{a}/{b}' AS pair, CASE WHEN a.{key[0]} IS NULL THEN 'missing_on_n1' WHEN b.{key[0]} IS NULL THEN 'missing_on_n2' ELSE 'row_mismatch' END AS diff_type, {names}, "
            f"CASE WHEN a.{key[0]} IS NULL OR b.{key[0]} IS NULL THEN '' ELSE concat_ws(',', {changed}) END AS changed_columns "
            f"FROM (SELECT * FROM {a} WHERE {where}) a FULL JOIN (SELECT * FROM {b} WHERE {where}) b ON {on} WHERE a.{key[0]} IS NULL OR b.{key[0]} IS NULL OR {differs}"
        )
    return f"WITH {nodes_sql or cte(name)} " + " UNION ALL ".join(parts)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- scans and projections

query("scan_range_half_open", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900")(
    lambda s, d: nodes.key_range(table(s, d, "orders"), ("o_orderkey",), (100,), (900,)).select("o_orderkey", "o_custkey", "o_orderstatus")
)
query("scan_range_composite", "SELECT conv_id, turn, role FROM conversations WHERE (conv_id > 2 OR conv_id = 2 AND turn >= 1) AND (conv_id < 9 OR conv_id = 9 AND turn < 2)")(
    lambda s, d: nodes.key_range(table(s, d, "conversations"), ("conv_id", "turn"), (2, 1), (9, 2)).select("conv_id", "turn", "role")
)
query("point_lookup_simple", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT event_id * 3 FROM events WHERE event_type = 'error')")(
    lambda s, d: nodes.by_keys(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), table(s, d, "events").where("event_type = 'error'").select((F.col("event_id") * 3).alias("o_orderkey")), ("o_orderkey",))
)
query("point_lookup_composite", "SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn) IN (SELECT doc_id, n_chars % 3 FROM documents)")(
    lambda s, d: nodes.by_keys(table(s, d, "conversations").select("conv_id", "turn", "role"), table(s, d, "documents").select(F.col("doc_id").alias("conv_id"), (F.col("n_chars") % 3).alias("turn")), ("conv_id", "turn"))
)
query("row_hash", "SELECT c_custkey, sha256(concat_ws('|', c_custkey::VARCHAR, coalesce(c_name, ''), coalesce(c_mktsegment, ''))) AS row_hash FROM customer")(
    lambda s, d: (lambda t: t.select("c_custkey", normalize.row_hash(t, ["c_custkey", "c_name", "c_mktsegment"], "compat").alias("row_hash")))(table(s, d, "customer"))
)
query("trim_scale_numeric", "SELECT c_custkey, CASE WHEN contains(t, '.') THEN rtrim(rtrim(t, '0'), '.') ELSE t END AS acctbal FROM (SELECT c_custkey, c_acctbal::DECIMAL(20,4)::VARCHAR AS t FROM customer)")(
    lambda s, d: table(s, d, "customer").select("c_custkey", normalize.trim_scale(F.col("c_acctbal").cast("decimal(20,4)")).alias("acctbal"))
)
query("max_octet_length", "SELECT max(octet_length(encode(text)))::BIGINT AS text, max(octet_length(encode(source)))::BIGINT AS source FROM documents")(lambda s, d: diff.octets(table(s, d, "documents"), ["text", "source"]))
_META = "SELECT *, CASE WHEN o_orderkey % 41 <> 0 THEN o_orderdate END AS commit_ts, (o_orderkey % 3)::VARCHAR AS node_origin FROM orders"


def _meta(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").withColumn("commit_ts", F.expr("CASE WHEN o_orderkey % 41 <> 0 THEN o_orderdate END")).withColumn("node_origin", F.expr("cast(o_orderkey % 3 as string)"))


query("until_fence", f"SELECT o_orderkey FROM ({_META}) WHERE commit_ts IS NULL OR commit_ts <= TIMESTAMP '1995-06-01'")(lambda s, d: nodes.until(_meta(s, d), "commit_ts", "1995-06-01 00:00:00").select("o_orderkey"))
query("origin_filter", f"SELECT o_orderkey FROM ({_META}) WHERE node_origin = '2'")(lambda s, d: nodes.written_by(_meta(s, d), "node_origin", "2").select("o_orderkey"))
query("origin_translate", f"SELECT o_orderkey, CASE node_origin WHEN '0' THEN 'local' WHEN '1' THEN 'n1' ELSE node_origin END AS origin FROM ({_META})")(
    lambda s, d: _meta(s, d).select("o_orderkey", normalize.origin_name(F.col("node_origin"), {"1": "n1"}).alias("origin"))
)


@query("filter_has_rows", "SELECT f AS status, EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = f) AS has_rows FROM (VALUES ('F'), ('none')) t(f)")
def _has_rows(s: SparkSession, d: str) -> DataFrame:
    def there(f: str) -> bool:
        try:
            nodes.has_rows(table(s, d, "orders"), f"o_orderstatus = '{f}'")
        except ValueError:
            return False
        return True

    return s.createDataFrame([(f, there(f)) for f in ("F", "none")], "status string, has_rows boolean")


query("timestamp_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN o_orderdate + INTERVAL 123456 MICROSECOND END AS ts FROM orders")(
    lambda s, d: table(s, d, "orders").withColumn("t", F.expr("cast(o_orderdate + INTERVAL 123456 MICROSECONDS as string)"))
    .withColumn("t", F.expr("CASE o_orderkey % 5 WHEN 0 THEN t WHEN 1 THEN concat(replace(t, ' ', 'T'), 'Z') WHEN 2 THEN concat(t, '789+00') WHEN 3 THEN concat(replace(t, ' ', 'T'), '+00:00') ELSE concat('x', t) END"))
    .select("o_orderkey", normalize.parsed_timestamp(F.col("t")).alias("ts"))
)
query("time_of_day_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 6 THEN (o_orderkey % 86400) * 1000000 + o_orderkey % 1000 * 1000 END AS micros FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.expr("o_orderkey % 86400").alias("n"))
    .select("o_orderkey", F.expr("concat(lpad(n div 3600, 2, '0'), ':', lpad(n div 60 % 60, 2, '0'), ':', lpad(n % 60, 2, '0'), '.', lpad(o_orderkey % 1000, 3, '0'), if(o_orderkey % 7 = 6, 'h', ''))").alias("t"))
    .select("o_orderkey", normalize.time_micros(F.col("t")).alias("micros"))
)
query("epoch_scale", "SELECT o_orderkey, o_orderdate::TIMESTAMP AS ts FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", normalize.epoch_timestamp(F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000000 * CASE o_orderkey % 4 WHEN 0 THEN 1L WHEN 1 THEN 1000L WHEN 2 THEN 1000000L ELSE 1000000000L END")).alias("ts"))
)
query("bytes_decode", "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN c_name END AS name FROM customer")(
    lambda s, d: table(s, d, "customer").withColumn("t", F.expr("CASE c_custkey % 3 WHEN 0 THEN concat('\\\\x', lower(hex(c_name))) WHEN 1 THEN base64(encode(c_name, 'UTF-8')) ELSE concat('0x', c_name) END"))
    .select("c_custkey", F.decode(normalize.decoded_bytes(F.col("t")), "UTF-8").alias("name"))
)

# ---- blocks

#: Rows of a block and of a leaf of the hash tree.
_BLOCK, _LEAF = 500, 100


def _ranges_sql(size: int, source: str = "orders", key: str = "o_orderkey") -> str:
    starts = f"SELECT min(k) AS s FROM (SELECT k, ntile((SELECT greatest(1, ceil(count(*) / {size}.0))::BIGINT FROM {source})) OVER (ORDER BY k) AS b FROM (SELECT {key} AS k FROM {source})) GROUP BY b"
    return f"SELECT (row_number() OVER (ORDER BY s) - 1)::BIGINT AS block_id, s AS range_start, lead(s) OVER (ORDER BY s) AS range_end FROM ({starts})"


_IN = "(o.o_orderkey >= r.range_start OR r.block_id = 0) AND (r.range_end IS NULL OR o.o_orderkey < r.range_end)"
_RANGES = _ranges_sql(_BLOCK)
_ASSIGN = f"r AS ({_RANGES}), a AS (SELECT o.*, r.block_id FROM orders o JOIN r ON {_IN})"


def _cut(df: DataFrame, key: list[str], size: int) -> DataFrame:
    return written(blocks.boundaries(df, key, blocks.n_blocks(df.count(), size)), "ranges")


def _ranges(s: SparkSession, d: str, name: str = "orders", size: int = _BLOCK) -> DataFrame:
    return _cut(table(s, d, name), list(KEYS[name][0]), size)


query("block_boundaries", _RANGES)(lambda s, d: _ranges(s, d).select("block_id", F.col("range_start.o_orderkey").alias("range_start"), F.col("range_end.o_orderkey").alias("range_end")))
query("block_boundaries_text", _ranges_sql(20, "customer", "c_name"))(lambda s, d: _cut(table(s, d, "customer"), ["c_name"], 20).select("block_id", F.col("range_start.c_name").alias("range_start"), F.col("range_end.c_name").alias("range_end")))
query(
    "block_boundaries_composite",
    "WITH b AS (SELECT min(struct_pack(c := conv_id, t := turn)) AS s FROM (SELECT conv_id, turn, ntile((SELECT ceil(count(*) / 50.0)::BIGINT FROM conversations)) OVER (ORDER BY conv_id, turn) AS b FROM conversations) GROUP BY b) "
    "SELECT (row_number() OVER (ORDER BY s) - 1)::BIGINT AS block_id, s.c AS start_conv, s.t AS start_turn FROM b",
)(lambda s, d: _ranges(s, d, "conversations", 50).select("block_id", F.col("range_start.conv_id").alias("start_conv"), F.col("range_start.turn").alias("start_turn")))
query("block_counts", f"WITH {_ASSIGN} SELECT block_id, count(*) AS n_rows FROM a GROUP BY block_id")(lambda s, d: blocks.assign(table(s, d, "orders"), ["o_orderkey"], _ranges(s, d)).groupBy("block_id").agg(F.count("*").alias("n_rows")))
query("block_counts_sorted", f"WITH {_ASSIGN} SELECT block_id, count(*) AS n_rows FROM a GROUP BY block_id")(
    lambda s, d: blocks.assign(table(s, d, "orders"), ["o_orderkey"], _ranges(s, d), 0).groupBy("block_id").agg(F.count("*").alias("n_rows"))
)
query("block_assign_text", f"WITH r AS ({_ranges_sql(20, 'customer', 'c_name')}) SELECT c_custkey, block_id FROM customer o JOIN r ON (o.c_name >= r.range_start OR r.block_id = 0) AND (r.range_end IS NULL OR o.c_name < r.range_end)")(
    lambda s, d: blocks.assign(table(s, d, "customer"), ["c_name"], _cut(table(s, d, "customer"), ["c_name"], 20)).select("c_custkey", "block_id")
)
_SKEWED = "SELECT CASE WHEN o_orderkey % 500 = 7 THEN o_orderkey * 1000000007 ELSE o_orderkey END AS o_orderkey FROM orders"
query("block_assign_skewed", f"WITH t AS ({_SKEWED}), r AS ({_ranges_sql(50, 't')}) SELECT o_orderkey, block_id FROM t o JOIN r ON {_IN}")(
    lambda s, d: (lambda t: blocks.assign(t, ["o_orderkey"], _cut(t, ["o_orderkey"], 50)))(table(s, d, "orders").selectExpr("CASE WHEN o_orderkey % 500 = 7 THEN o_orderkey * 1000000007L ELSE o_orderkey END AS o_orderkey"))
)
query("scan_chosen_ranges", f"WITH {_ASSIGN} SELECT o_orderkey, block_id FROM a WHERE block_id % 3 = 1")(
    lambda s, d: (lambda r: blocks.in_ranges(table(s, d, "orders"), ["o_orderkey"], r, r.where("block_id % 3 = 1")).select("o_orderkey", "block_id"))(_ranges(s, d))
)
query(
    "block_hash",
    f"WITH {_ASSIGN} SELECT block_id, sha256(string_agg(concat_ws('|', o_orderkey::VARCHAR, o_orderstatus, o_orderpriority), '|' ORDER BY o_orderkey)) AS block_hash FROM a GROUP BY block_id",
)(lambda s, d: blocks.block_hashes(table(s, d, "orders"), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"], _ranges(s, d)))
_NODE_HASH = f"SELECT block_id, sha256(coalesce(string_agg(concat_ws('|', o.o_orderkey::VARCHAR, o.o_orderstatus), '|' ORDER BY o.o_orderkey) FILTER (o.o_orderkey IS NOT NULL), 'EMPTY_BLOCK')) AS h FROM r LEFT JOIN {{0}} o ON {_IN} GROUP BY block_id"
query("block_hash_empty_block", f"WITH r AS ({_RANGES}), low AS (SELECT * FROM orders WHERE o_orderkey < 700) SELECT block_id, h AS block_hash FROM ({_NODE_HASH.format('low')})")(
    lambda s, d: blocks.block_hashes(table(s, d, "orders").where("o_orderkey < 700"), ["o_orderkey"], ["o_orderstatus"], _ranges(s, d))
)
query(
    "block_mismatch_pairs",
    f"WITH {cte('orders')}, r AS ({_RANGES}), h1 AS ({_NODE_HASH.format('n1')}), h2 AS ({_NODE_HASH.format('n2')}), h3 AS ({_NODE_HASH.format('n3')}) "
    "SELECT 'n1/n2' AS pair, block_id FROM h1 JOIN h2 USING (block_id) WHERE h1.h <> h2.h UNION ALL SELECT 'n1/n3', block_id FROM h1 JOIN h3 USING (block_id) WHERE h1.h <> h3.h "
    "UNION ALL SELECT 'n2/n3', block_id FROM h2 JOIN h3 USING (block_id) WHERE h2.h <> h3.h",
)(lambda s, d: (lambda r: blocks.mismatched_blocks({n: blocks.block_hashes(node(s, d, "orders", n), ["o_orderkey"], ["o_orderstatus"], r) for n in ("n1", "n2", "n3")}).select("pair", "block_id"))(_ranges(s, d)))
query("split_points", "SELECT o_orderkey AS split_key FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) WHERE i > 1 AND (i - 1) % 100 = 0")(
    lambda s, d: blocks.split_points(table(s, d, "orders"), "o_orderkey", 100)
)
query(
    "interval_union",
    "WITH i AS (SELECT event_id * 10 AS a, event_id * 10 + 4 + event_id % 9 AS b FROM events), e AS (SELECT p, sum(d) AS d FROM (SELECT a AS p, 1 AS d FROM i UNION ALL SELECT b, -1 FROM i) GROUP BY p), "
    "s AS (SELECT p AS slice_start, lead(p) OVER (ORDER BY p) AS slice_end, sum(d) OVER (ORDER BY p) AS depth FROM e) SELECT slice_start, slice_end FROM s WHERE depth > 0",
)(lambda s, d: blocks.interval_union(table(s, d, "events").selectExpr("event_id * 10 AS range_start", "event_id * 10 + 4 + event_id % 9 AS range_end")))
query("anchor_node", f"WITH {cte('orders')}, c AS (SELECT 'n1' AS n, count(*) AS c FROM n1 UNION ALL SELECT 'n2', count(*) FROM n2 UNION ALL SELECT 'n3', count(*) FROM n3) SELECT n AS node, c AS n_rows FROM c ORDER BY c DESC, n LIMIT 1")(
    lambda s, d: (lambda c: s.createDataFrame([(blocks.anchor(c), c[blocks.anchor(c)])], "node string, n_rows long"))({n: node(s, d, "orders", n).count() for n in ("n1", "n2", "n3")})
)


@query("block_narrowed", diff_sql("orders"))
def _narrowed(s: SparkSession, d: str) -> DataFrame:
    """Mismatched blocks cut into small pieces; only those that still differ are compared row by row."""
    t, r = spec("orders"), _ranges(s, d)
    a, b = (node(s, d, "orders", n) for n in ("n1", "n2"))
    bad = written(merkle.mismatched(*[merkle.build(merkle.leaves(x, t, r), r.count()) for x in (a, b)]).withColumnRenamed("node_position", "block_id"), "bad")
    small = written(merkle.narrowed(a, b, t, r, bad, 10), "parts")
    return diff.report(diff.diff_pair(*[merkle.within(x, ["o_orderkey"], small) for x in (a, b)], t).withColumn("pair", F.lit("n1/n2")), t)


# ---- diffs

_THREE = (("n1", "n2"), ("n1", "n3"), ("n2", "n3"))


def _diff(name: str, which: tuple[str, ...] = ("n1", "n2"), **options) -> Query:
    return lambda s, d: diff.report(diff.diff(cluster(s, d, name, which), spec(name), **options), spec(name))


query("diff_orders_n1_n2", diff_sql("orders"))(_diff("orders"))
query("diff_part_n1_n2", diff_sql("part"))(_diff("part"))
query("diff_events_n1_n2", diff_sql("events"))(_diff("events"))
query("diff_customer_3way", diff_sql("customer", _THREE))(_diff("customer", ("n1", "n2", "n3")))
query("diff_documents_text", diff_sql("documents"))(_diff("documents"))
query("diff_conversations_composite", diff_sql("conversations"))(_diff("conversations"))
query("diff_block_pruned", diff_sql("orders"))(_diff("orders", pruned=True))
query("diff_filtered", diff_sql("orders", where="o_orderpriority LIKE '1%'"))(_diff("orders", where="o_orderpriority LIKE '1%'"))
query("diff_summary", f"SELECT pair, diff_type, count(*) AS n_rows FROM ({diff_sql('customer', _THREE)}) GROUP BY ALL")(lambda s, d: diff.summary(diff.diff(cluster(s, d, "customer", ("n1", "n2", "n3")), spec("customer"))))
query("diff_capped", f"SELECT pair, diff_type, o_orderkey, changed_columns FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY o_orderkey) AS i FROM ({diff_sql('orders', _THREE)})) WHERE i <= 10")(
    lambda s, d: diff.report(diff.capped(diff.diff(cluster(s, d, "orders", ("n1", "n2", "n3")), spec("orders")), spec("orders"), 10), spec("orders"))
)
query(
    "diff_multiset_lineitem",
    "WITH a AS (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_orderkey % 83 <> 5), b AS (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_orderkey % 97 <> 7) "
    "SELECT l_orderkey, l_linenumber, l_returnflag, sum(v)::BIGINT AS surplus FROM (SELECT *, 1 AS v FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY ALL HAVING sum(v) <> 0",
)(lambda s, d: (lambda t: diff.multiset(t.where("l_orderkey % 83 <> 5"), t.where("l_orderkey % 97 <> 7")))(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")))
_NV = "SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN {0} ELSE c_mktsegment END AS c_mktsegment FROM customer"
query("diff_null_vs_empty_strict", f"SELECT c_custkey FROM ({_NV.format('NULL')}) a JOIN ({_NV.format(repr(''))}) b USING (c_custkey) WHERE a.c_mktsegment IS DISTINCT FROM b.c_mktsegment")(lambda s, d: _null_empty(s, d, "strict"))
query("diff_null_vs_empty_compat", f"SELECT count(*) AS n_differing FROM ({_NV.format('NULL')}) a JOIN ({_NV.format(repr(''))}) b USING (c_custkey) WHERE coalesce(a.c_mktsegment, '') <> coalesce(b.c_mktsegment, '')")(
    lambda s, d: _null_empty(s, d, "compat").agg(F.count("*").alias("n_differing"))
)


def _null_empty(s: SparkSession, d: str, mode: str) -> DataFrame:
    t = table(s, d, "customer")
    side = lambda v, n: t.select("c_custkey", F.expr(f"CASE WHEN c_custkey % 13 = 0 THEN {v} ELSE c_mktsegment END").alias("c_mktsegment")).transform(lambda x: x.select("c_custkey", normalize.row_hash(x, ["c_custkey", "c_mktsegment"], mode).alias(n)))
    return side("NULL", "a").join(side("''", "b"), "c_custkey").where("a <> b").select("c_custkey")


@query(
    "rerun_after_partial_repair",
    f"WITH f AS ({diff_sql('orders')}) SELECT pair, diff_type, o_orderkey, changed_columns FROM f WHERE NOT (diff_type = 'row_mismatch' AND o_orderkey % 2 = 0)",
)
def _rerun(s: SparkSession, d: str) -> DataFrame:
    t, c = spec("orders"), cluster(s, d, "orders")
    found = diff.diff(c, t)
    fixed = repair.from_source(found.where("diff_type = 'row_mismatch' AND o_orderkey % 2 = 0"), t, "n1")
    now = nodes.Cluster({"n1": c.nodes["n1"], "n2": lambda name: repair.applied(c.nodes["n2"](name), fixed, "n2", t)})
    return diff.report(diff.rerun(found, now, t), t)


#: Doubles that are close, huge, infinite, not a number, or zero of either sign, on two nodes.
_D1 = "CASE o_orderkey % 11 WHEN 1 THEN {0}'NaN'{1} WHEN 2 THEN 1e17 WHEN 3 THEN {0}'Infinity'{1} WHEN 4 THEN {2} ELSE o_totalprice END"
_D2 = f"CASE WHEN o_orderkey % 13 <> 5 OR o_orderkey % 11 IN (1, 3, 4) THEN {_D1} WHEN o_orderkey % 11 = 2 THEN 1e17 + 16 ELSE o_totalprice + 0.000001 END"


def _doubles(spark_sql: bool) -> tuple[str, str]:
    made = [x.format("double(" if spark_sql else "", ")" if spark_sql else "::DOUBLE", zero) for x, zero in ((_D1, "0e0"), (_D2, "-0e0"))]
    return made[0], made[1]


_PRICED = nodes.Table("orders", ("o_orderkey",))
_PRICED_SQL = "a AS (SELECT o_orderkey, {0} AS price FROM orders), b AS (SELECT o_orderkey, {1} AS price FROM orders)".format(*_doubles(False))


def _priced(s: SparkSession, d: str) -> list[DataFrame]:
    return [table(s, d, "orders").selectExpr("o_orderkey", f"cast({x} as double) AS price") for x in _doubles(True)]


query("diff_pruned_doubles", f"WITH {_PRICED_SQL} SELECT o_orderkey, 'price' AS changed_columns FROM a JOIN b USING (o_orderkey) WHERE a.price IS DISTINCT FROM b.price")(
    lambda s, d: diff.diff_pruned(*_priced(s, d), _PRICED).select("o_orderkey", "changed_columns")
)
query("rerun_gone_keys", f"SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'missing_on_both' ELSE diff_type END AS diff_type FROM ({diff_sql('orders')})")(
    lambda s, d: (lambda c, t: diff.rerun(diff.diff(c, t), nodes.Cluster({n: (lambda name, n=n: c.nodes[n](name).where("o_orderkey % 2 <> 0")) for n in ("n1", "n2")}), t, "different").select("o_orderkey", "diff_type"))(cluster(s, d, "orders"), spec("orders"))
)
query(
    "schema_diff_tables",
    f"SELECT 'customer' AS name, CASE WHEN count(*) > 0 THEN 'differed' ELSE 'matched' END AS status, count(*) AS n_diffs FROM ({diff_sql('customer', _THREE)}) UNION ALL SELECT 'nation', 'matched', 0 UNION ALL SELECT 'absent', 'failed', NULL UNION ALL SELECT 'part', 'skipped', NULL "
    f"UNION ALL SELECT 'orders', 'differed', count(*) FROM ({diff_sql('orders', _THREE)})",
)(
    lambda s, d: diff.each_table(
        nodes.Cluster({n: (lambda t, n=n: node(s, d, t, n) if t in KEYS else table(s, d, t)) for n in ("n1", "n2", "n3")}),
        [spec("customer"), nodes.Table("nation", ("n_nationkey",)), nodes.Table("absent", ("x",)), spec("part"), spec("orders")],
        ["part"],
    ).select("name", "status", "n_diffs")
)

#: Orders with a list, a record and a list of records of moments; on n2 some are a microsecond later, or an hour in a night on
#: which clocks go back.
_NESTED = nodes.Table("orders", ("o_orderkey",))


def _moments(s: SparkSession, d: str, later: bool) -> DataFrame:
    at = "timestamp_micros(800000000000000 + o_orderkey * 1000003)"  # the same moment in every zone
    moved = f"CASE WHEN o_orderkey % 13 = 5 THEN {at} + INTERVAL 1 MICROSECOND ELSE {at} END" if later else at
    night = f"timestamp_seconds(1730611800 + CASE WHEN o_orderkey % 17 = 3 THEN {3600 if later else 0} ELSE 0 END)"  # 2024-11-03 05:30 UTC
    return table(s, d, "orders").selectExpr("o_orderkey", f"array({at}, {moved}, null) AS many", f"named_struct('one', {night}, 'key', o_orderkey * 1.5d) AS record", f"array(named_struct('at', {moved})) AS records", f"{night} AS night")


_MOVED = "o_orderkey % 13 = 5 OR o_orderkey % 17 = 3"
query("diff_pruned_nested", f"SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 13 = 5 THEN 'many' END, CASE WHEN o_orderkey % 17 = 3 THEN 'record' END, CASE WHEN o_orderkey % 13 = 5 THEN 'records' END, CASE WHEN o_orderkey % 17 = 3 THEN 'night' END) AS changed_columns FROM orders WHERE {_MOVED}")(
    lambda s, d: diff.diff_pruned(_moments(s, d, False), _moments(s, d, True), _NESTED).select("o_orderkey", "changed_columns")
)


# ---- inventories

def _held(s: SparkSession, d: str, *columns: str) -> DataFrame:
    parts = [node(s, d, "customer", n).selectExpr(f"'{n}' AS node", *columns) for n in ("n1", "n2", "n3")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_HELD = " UNION ALL ".join(f"SELECT '{n}' AS node, * FROM {n}" for n in ("n1", "n2", "n3"))
query(
    "table_inventory_diff",
    f"WITH {cte('customer')} SELECT 'row' AS kind, c_name AS name, string_agg(node, ',' ORDER BY node) AS present, (SELECT string_agg(x, ',' ORDER BY x) FROM (VALUES ('n1'), ('n2'), ('n3')) v(x) WHERE NOT list_contains(list(node), x)) AS missing "
    f"FROM (SELECT node, c_name FROM ({_HELD})) GROUP BY c_name HAVING count(*) < 3",
)(lambda s, d: inventory.object_diff(_held(s, d, "'row' AS kind", "c_name AS name"), ["n1", "n2", "n3"]))
query(  # each customer stands for a table of the nodes that hold it, every tenth for a view
    "schema_diff_summary",
    f"WITH {cte('customer')} SELECT c_name AS name, CASE WHEN c_name LIKE '%7' THEN 'skipped' WHEN count(DISTINCT node) < 3 THEN 'partial' ELSE 'common' END AS status FROM ({_HELD}) WHERE c_custkey % 10 <> 0 GROUP BY c_name",
)(
    lambda s, d: inventory.table_plan(_held(s, d, "if(c_custkey % 10 = 0, 'view', 'table') AS kind", "c_name AS name"), ["n1", "n2", "n3"], [r["c_name"] for r in table(s, d, "customer").where("c_name LIKE '%7'").select("c_name").collect()])
)
#: Each customer stands for two nodes that subscribe to each other, but for some (every 11th, one way only).
_SUBS = (
    "SELECT {0} || 'a' || c_custkey AS node, {0} || 'b' || c_custkey AS provider, c_custkey % 7 <> 0 AS enabled, {1}(c_mktsegment, 'x') AS sets FROM customer WHERE c_custkey % 11 <> 4 "
    "UNION ALL SELECT {0} || 'b' || c_custkey, {0} || 'a' || c_custkey, c_custkey % 5 <> 0, CASE WHEN c_custkey % 3 = 0 THEN {1}('x', c_mktsegment) WHEN c_custkey % 3 = 1 THEN {1}(c_mktsegment) ELSE {1}(c_mktsegment, 'x') END FROM customer WHERE c_custkey % 11 <> 3"
)
query(
    "repset_diff_summary",
    f"WITH {cte('customer')}, m AS (SELECT node, 'set' || c_nationkey AS s, c_name AS t FROM ({_HELD})), h AS (SELECT DISTINCT s, node FROM m), t AS (SELECT DISTINCT s, t FROM m) "
    "SELECT t.s AS set_name, t.t AS table_name, coalesce(string_agg(h.node, ',' ORDER BY h.node) FILTER (m.node IS NULL), '') AS missing_on FROM t JOIN h ON t.s = h.s LEFT JOIN m ON m.s = t.s AND m.t = t.t AND m.node = h.node GROUP BY t.s, t.t",
)(lambda s, d: inventory.set_members(_held(s, d, "concat('set', c_nationkey) AS set_name", "c_name AS table_name"), ["n1", "n2", "n3"]))
query(
    "replication_config_diff",
    f"WITH s AS ({_SUBS.format("''", 'list_value')}), j AS (SELECT coalesce(a.node, b.provider) AS n1, coalesce(a.provider, b.node) AS n2, a.enabled AS e1, b.enabled AS e2, list_sort(a.sets) AS s1, list_sort(b.sets) AS s2 FROM s a FULL JOIN s b ON a.node = b.provider AND a.provider = b.node) "
    "SELECT n1, n2, CASE WHEN e1 IS NULL THEN 'missing n1 from n2' WHEN e2 IS NULL THEN 'missing n2 from n1' WHEN NOT e1 OR NOT e2 THEN 'disabled' WHEN s1 <> s2 THEN 'sets differ' ELSE 'ok' END AS status FROM j WHERE n1 < n2",
)(lambda s, d: inventory.subscription_diff(s.sql(_SUBS.format("''", "array").replace("FROM customer", "FROM {c}"), c=table(s, d, "customer"))))
query("recovery_source_of_truth", "SELECT 'n3' AS node, max(o_orderkey)::BIGINT AS lsn FROM orders")(
    lambda s, d: (lambda t: s.createDataFrame([inventory.recovery_source(t)], "node string, lsn long"))(
        table(s, d, "orders").agg(F.max("o_orderkey").alias("m")).select(F.inline(F.array(*[F.struct(F.lit(n).alias("node"), o.alias("origin_lsn"), l.alias("slot_lsn")) for n, o, l in (("n1", F.col("m") - 9, F.col("m")), ("n2", F.lit(None).cast("long"), F.col("m") - 1), ("n3", F.lit(None).cast("long"), F.col("m")))])))
    )
)

# ---- repairs


def _repairs(name: str, build: Callable[[DataFrame, nodes.Table], DataFrame], which: tuple[str, ...] = ("n1", "n2")) -> Query:
    return lambda s, d: build(diff.diff(cluster(s, d, name, which), spec(name)), spec(name)).select("node", *KEYS[name][0], "op")


query("repair_sot_sets", f"SELECT CASE WHEN pair = 'n1/n2' THEN 'n2' ELSE 'n3' END AS node, o_orderkey, CASE WHEN diff_type = 'missing_on_n1' THEN 'delete' ELSE 'upsert' END AS op FROM ({diff_sql('orders', _THREE)}) WHERE pair <> 'n2/n3'")(
    _repairs("orders", lambda x, t: repair.from_source(x, t, "n1"), ("n1", "n2", "n3"))
)
query("repair_insert_only", f"SELECT 'n2' AS node, o_orderkey, 'insert' AS op FROM ({diff_sql('orders')}) WHERE diff_type = 'missing_on_n2'")(_repairs("orders", lambda x, t: repair.from_source(x, t, "n1", "insert_only")))
query("repair_upsert_only", f"SELECT 'n2' AS node, o_orderkey, 'upsert' AS op FROM ({diff_sql('orders')}) WHERE diff_type <> 'missing_on_n1'")(_repairs("orders", lambda x, t: repair.from_source(x, t, "n1", "upsert_only")))
query("repair_bidirectional", f"SELECT CASE WHEN diff_type = 'missing_on_n1' THEN 'n1' ELSE 'n2' END AS node, o_orderkey, 'insert' AS op FROM ({diff_sql('orders')}) WHERE diff_type <> 'row_mismatch'")(_repairs("orders", repair.both_ways))
_HOLES1, _HOLES2 = "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END", "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_nationkey END"


@query(
    "repair_fix_nulls",
    "SELECT 'n1' AS node, c_custkey, c_mktsegment, CASE WHEN c_custkey % 17 = 0 THEN c_nationkey ELSE c_nationkey END AS c_nationkey FROM customer WHERE c_custkey % 13 = 0 UNION ALL SELECT 'n2', c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 17 = 0",
)
def _fix(s: SparkSession, d: str) -> DataFrame:
    t, c = spec("customer"), table(s, d, "customer")
    found = diff.diff(nodes.Cluster({"n1": lambda _: c.withColumn("c_mktsegment", F.expr(_HOLES1)), "n2": lambda _: c.withColumn("c_nationkey", F.expr(_HOLES2))}), t)
    return repair.fill_nulls(found, t, columns("customer")).select("node", "c_custkey", "row.c_mktsegment", "row.c_nationkey")


query("repair_apply_snapshot", f"WITH {cte('orders')} SELECT o_orderkey, o_orderstatus FROM n1")(
    lambda s, d: (lambda t, x: repair.applied(node(s, d, "orders", "n2"), repair.from_source(x, t, "n1"), "n2", t).select("o_orderkey", "o_orderstatus"))(spec("orders"), diff.diff(cluster(s, d, "orders"), spec("orders")))
)
query("repair_roundtrip_empty", "SELECT 0::BIGINT AS n_left")(
    lambda s, d: (lambda t, x: diff.diff_pair(node(s, d, "orders", "n1"), repair.applied(node(s, d, "orders", "n2"), repair.from_source(x, t, "n1"), "n2", t), t).agg(F.count("*").alias("n_left")))(spec("orders"), diff.diff(cluster(s, d, "orders"), spec("orders")))
)
query("repair_counts", f"SELECT 'n2' AS node, CASE WHEN diff_type = 'missing_on_n1' THEN 'delete' ELSE 'upsert' END AS op, count(*) AS n_rows FROM ({diff_sql('orders')}) GROUP BY ALL")(
    lambda s, d: repair.counts(repair.from_source(diff.diff(cluster(s, d, "orders"), spec("orders")), spec("orders"), "n1"))
)


def _stale(s: SparkSession, d: str) -> DataFrame:
    return repair.stale(
        repair.from_source(diff.diff(cluster(s, d, "orders"), spec("orders")), spec("orders"), "n1").join(_meta(s, d).select("o_orderkey", F.col("commit_ts").alias("seen")), "o_orderkey"),
        table(s, d, "orders").select("o_orderkey", F.expr("o_orderdate + CASE WHEN o_orderkey % 5 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END").alias("now")),
        spec("orders"),
        "seen",
        "now",
    )


query(
    "stale_guard",
    f"SELECT f.o_orderkey, CASE WHEN o.o_orderkey % 5 <> 0 AND o.o_orderkey % 41 <> 0 THEN NULL WHEN o.o_orderkey % 41 = 0 THEN 'unknown' ELSE 'newer' END AS stale FROM ({diff_sql('orders')}) f JOIN orders o USING (o_orderkey)",
)(lambda s, d: _stale(s, d).select("o_orderkey", "stale"))
query("origin_batches", f"SELECT CASE WHEN node_origin = '0' THEN '' ELSE node_origin END AS origin, CASE WHEN node_origin <> '0' THEN o_orderkey % 7 END AS lsn, CASE WHEN node_origin <> '0' THEN year(o_orderdate) END AS time, count(*) AS n_rows FROM ({_META}) GROUP BY ALL")(
    lambda s, d: repair.by_origin(_meta(s, d).withColumn("node_origin", F.expr("nullif(node_origin, '0')")).withColumn("lsn", F.expr("o_orderkey % 7")).withColumn("t", F.expr("cast(year(o_orderdate) as long)")), "node_origin", "lsn", "t")
)
query("repair_without_stale", f"WITH {cte('orders')} SELECT o_orderkey, coalesce(n1.o_orderstatus, n2.o_orderstatus) AS o_orderstatus FROM (SELECT * FROM n1 WHERE o_orderkey % 5 <> 0 AND o_orderkey % 41 <> 0) n1 FULL JOIN (SELECT * FROM n2 WHERE o_orderkey % 5 = 0 OR o_orderkey % 41 = 0) n2 USING (o_orderkey)")(
    lambda s, d: repair.applied(node(s, d, "orders", "n2"), _stale(s, d), "n2", spec("orders")).select("o_orderkey", "o_orderstatus")
)
PLAN = rules.Plan(
    (rules.Rule("low keys", "keep_n2", key_between=(0, 200)), rules.Rule("new", "apply_from_n1_insert", diff_types=("missing_on_n2",)), rules.Rule("cheaper", "keep_n1", when="n1.o_totalprice > 150000")),
    (rules.Rule("row", "skip", keys=(5, 11, 100)),),
    "bidirectional",
)
_RESOLVED = f"""WITH f AS ({diff_sql('orders')}), {cte('orders', ['n1'])} SELECT f.*, CASE WHEN f.o_orderkey IN (5, 11, 100) THEN 'skip' WHEN f.o_orderkey BETWEEN 0 AND 200 THEN 'keep_n2'
  WHEN diff_type = 'missing_on_n2' THEN 'apply_from_n1_insert' WHEN n1.o_totalprice > 150000 THEN 'keep_n1' ELSE 'bidirectional' END AS action FROM f LEFT JOIN n1 ON n1.o_orderkey = f.o_orderkey"""


def _resolved(s: SparkSession, d: str) -> DataFrame:
    return rules.resolved(diff.diff(cluster(s, d, "orders"), spec("orders")), spec("orders"), PLAN)


query("plan_resolve_rules", f"SELECT o_orderkey, diff_type, action FROM ({_RESOLVED})")(lambda s, d: _resolved(s, d).select("o_orderkey", "diff_type", "action"))
query(
    "plan_actions",
    f"""WITH r AS ({_RESOLVED}) SELECT 'n1' AS node, o_orderkey, CASE WHEN diff_type = 'missing_on_n2' THEN 'delete' ELSE 'upsert' END AS op FROM r WHERE action = 'keep_n2'
  UNION ALL SELECT 'n2', o_orderkey, 'insert' FROM r WHERE action = 'apply_from_n1_insert' UNION ALL SELECT 'n2', o_orderkey, 'upsert' FROM r WHERE action = 'keep_n1'
  UNION ALL SELECT 'n1', o_orderkey, 'insert' FROM r WHERE action = 'bidirectional' AND diff_type = 'missing_on_n1'""",
)(lambda s, d: rules.repairs(_resolved(s, d), spec("orders"), columns("orders"), PLAN).select("node", "o_orderkey", "op"))
query("plan_pick_freshest", f"WITH {cte('orders')} SELECT o_orderkey, CASE WHEN n1.o_totalprice >= n2.o_totalprice THEN n1.o_orderstatus ELSE n2.o_orderstatus END AS status FROM n1 JOIN n2 USING (o_orderkey) WHERE n1.o_orderstatus <> n2.o_orderstatus")(
    lambda s, d: diff.diff(cluster(s, d, "orders"), spec("orders")).where("diff_type = 'row_mismatch'").select("o_orderkey", rules.pick_freshest("o_orderstatus", "o_totalprice").alias("status"))
)

# ---- hash tree

_TREE_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
_TEXT = " || ".join(f"length({c}::VARCHAR) || ':' || {c}" for c in _TREE_COLUMNS)
_HASHED = ", ".join(f"('0x' || substr(sha256({_TEXT}), {15 * i + 1}, 15))::BIGINT AS l{i}" for i in range(4))
_FOLD = ", ".join(f"coalesce(bit_xor(l{i}), 0)::BIGINT AS l{i}" for i in range(4))


def _leaves_sql(source: str) -> str:
    return f"SELECT block_id AS node_position, count(o.o_orderkey) AS n_rows, {_FOLD} FROM r LEFT JOIN (SELECT o_orderkey, {_HASHED} FROM {source}) o ON {_IN} GROUP BY block_id"


_R = f"r AS ({_ranges_sql(_LEAF)})"
_HEIGHT = "(SELECT ceil(log2(greatest(count(*), 1)))::BIGINT FROM r)"


def _tree_node(s: SparkSession, d: str, which: str) -> DataFrame:
    return node(s, d, "orders", which).select(*_TREE_COLUMNS)


def _tree_ranges(s: SparkSession, d: str) -> DataFrame:
    return _ranges(s, d, size=_LEAF)


def _leaves(s: SparkSession, d: str, which: str, r: DataFrame | None = None) -> DataFrame:
    return merkle.leaves(_tree_node(s, d, which), spec("orders"), _tree_ranges(s, d) if r is None else r)


def _tree(s: SparkSession, d: str, which: str, r: DataFrame) -> DataFrame:
    return merkle.build(written(_leaves(s, d, which, r), "leaves"), r.count())


def _place(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


query("merkle_leaves", f"WITH {cte('orders')}, {_R} {_leaves_sql('n2')}")(lambda s, d: _leaves(s, d, "n2"))
query("merkle_parents", f"WITH {cte('orders')}, {_R}, l AS ({_leaves_sql('n2')}) SELECT k::INT AS node_level, (node_position >> k)::BIGINT AS node_position, sum(n_rows)::BIGINT AS n_rows, {_FOLD} FROM (SELECT l.*, unnest(range(0, {_HEIGHT} + 1)) AS k FROM l) GROUP BY ALL")(
    lambda s, d: _tree(s, d, "n2", _tree_ranges(s, d))
)
query("merkle_mismatched_leaves", f"WITH {cte('orders')}, {_R}, f AS ({diff_sql('orders')}) SELECT DISTINCT block_id AS node_position FROM (SELECT o_orderkey FROM f) o JOIN r ON {_IN}")(
    lambda s, d: (lambda r: merkle.mismatched(_tree(s, d, "n1", r), _tree(s, d, "n2", r), merkle.height(r.count())))(_tree_ranges(s, d))
)
query("merkle_doubles", f"WITH {_PRICED_SQL}, {_R} SELECT DISTINCT block_id AS node_position FROM (SELECT o_orderkey FROM a JOIN b USING (o_orderkey) WHERE a.price IS DISTINCT FROM b.price) o JOIN r ON {_IN}")(
    lambda s, d: (lambda r: merkle.mismatched(*[merkle.build(merkle.leaves(x, _PRICED, r), r.count()) for x in _priced(s, d)]))(_tree_ranges(s, d))
)


def _kept(s: SparkSession, frames: dict[str, DataFrame], name: str = "tree", size: int = _LEAF) -> dict[str, trees.Tree]:
    return trees.build_trees(frames, spec("orders"), {n: _place(s, f"{name}-{n}") for n in frames}, size)


@query("merkle_diff_rows", diff_sql("orders", nodes_sql=cte("orders") + f", r AS ({_ranges_sql(_LEAF, 'n1')})"))
def _tree_diff(s: SparkSession, d: str) -> DataFrame:
    """Kept trees of two nodes; only the rows of leaves that differ are read and joined."""
    t, frames = spec("orders"), {n: node(s, d, "orders", n) for n in ("n1", "n2")}
    kept = _kept(s, frames)
    bad = written(trees.compare(kept["n1"], kept["n2"]), "bad")
    return diff.report(diff.diff_pair(*[trees.rows_near(kept["n1"], frames[n], t, bad) for n in ("n1", "n2")], t).withColumn("pair", F.lit("n1/n2")), t)


def kept_and_full(s: SparkSession, d: str, times: int = 20) -> dict[str, Callable[[], DataFrame]]:
    """For the bench: two copies of ``orders``, so many times over, of which one row in 10,000 differs, stored in order of their key
    with a kept tree each, and the same diff by the trees and in full."""
    t, names = nodes.Table("orders", ("o_orderkey",)), ("a", "b")
    rows = table(s, d, "orders").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("o_orderkey", F.expr("o_orderkey + k * 100000000L")).drop("k")
    other = rows.withColumn("o_orderstatus", F.expr("if(pmod(xxhash64(o_orderkey), 10000) = 7, 'X', o_orderstatus)"))
    place = _place(s, "kept")
    for n, df in zip(names, (rows, other), strict=True):
        df.repartitionByRange(8, *t.key).sortWithinPartitions(*t.key).write.option("parquet.block.size", 1 << 20).parquet(f"{place}/{n}")
    frames = {n: s.read.parquet(f"{place}/{n}") for n in names}
    kept = trees.build_trees(frames, t, {n: f"{place}/tree-{n}" for n in names}, 1000)

    def by_trees() -> DataFrame:
        bad = trees.compare(kept["a"], kept["b"])
        return diff.diff_pair(*[trees.rows_near(kept["a"], frames[n], t, bad) for n in names], t)

    return {"kept_tree_diff": by_trees, "kept_full_diff": lambda: diff.diff_pair(frames["a"], frames["b"], t)}


def _as_changes(found: DataFrame) -> DataFrame:
    op = F.when(F.col("diff_type") == diff.ONLY_SECOND, "INSERT").when(F.col("diff_type") == diff.ONLY_FIRST, "DELETE").otherwise("UPDATE")
    return found.select(op.alias("op"), "o_orderkey")


@query("merkle_update", f"WITH {cte('orders')}, r AS ({_ranges_sql(_LEAF, 'n1')}) {_leaves_sql('n2')}")
def _updated(s: SparkSession, d: str) -> DataFrame:
    """A kept tree of n1 after the changes that lead to n2: hashes of the leaves, of which few were read."""
    a, b = (_tree_node(s, d, n) for n in ("n1", "n2"))
    now = trees.update(_kept(s, {"n1": a})["n1"], b, spec("orders"), _as_changes(diff.diff_pair(a, b, spec("orders"))))
    return trees.open_tree(s, now.place).leaves.select("node_position", *merkle.HASH)


@query(
    "merkle_update_split",
    f"WITH {_R}, t AS (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey + 100000000 FROM orders), a AS (SELECT o.o_orderkey, block_id, range_end FROM t o JOIN r ON {_IN}), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY block_id) AS n FROM a), "
    f"s AS (SELECT range_start AS s FROM r UNION ALL SELECT o_orderkey FROM k WHERE range_end IS NULL AND n > {_LEAF} AND i > 1 AND (i - 1) % {_LEAF} = 0), "
    "q AS (SELECT (row_number() OVER (ORDER BY s) - 1)::BIGINT AS block_id, s AS range_start, lead(s) OVER (ORDER BY s) AS range_end FROM s) "
    "SELECT q.block_id, q.range_start, count(*) AS n_rows FROM q JOIN t ON t.o_orderkey >= q.range_start AND (q.range_end IS NULL OR t.o_orderkey < q.range_end) GROUP BY ALL",
)
def _update_split(s: SparkSession, d: str) -> DataFrame:
    """As many inserts behind the last key as there were rows: the open leaf is split."""
    old = table(s, d, "orders").select(*_TREE_COLUMNS)
    more = old.withColumn("o_orderkey", F.col("o_orderkey") + 100000000)
    now = trees.update(_kept(s, {"n1": old})["n1"], old.unionByName(more), spec("orders"), more.select(F.lit("INSERT").alias("op"), "o_orderkey"))
    return now.leaves.select("block_id", F.col("range_start.o_orderkey").alias("range_start"), "n_rows")


@query(
    "merkle_update_rebalance",
    f"WITH {_R}, t AS (SELECT * FROM orders WHERE o_orderkey % 5 = 0), l AS ({_leaves_sql('t')}) "
    f"SELECT node_position // 2 AS block_id, min(range_start) AS range_start, sum(n_rows)::BIGINT AS n_rows, {_FOLD} FROM l JOIN r ON node_position = block_id GROUP BY ALL",
)
def _update_rebalance(s: SparkSession, d: str) -> DataFrame:
    """Four of five rows are deleted: leaves become slivers and are merged in twos."""
    old = table(s, d, "orders").select(*_TREE_COLUMNS)
    now = trees.update(_kept(s, {"n1": old})["n1"], old.where("o_orderkey % 5 = 0"), spec("orders"), old.where("o_orderkey % 5 <> 0").select(F.lit("DELETE").alias("op"), "o_orderkey"), rebalance=True)
    return now.leaves.select("block_id", F.col("range_start.o_orderkey").alias("range_start"), *merkle.HASH)


@query(
    "merkle_heal",
    f"WITH {cte('orders')}, {_R} SELECT count(DISTINCT block_id) AS n_stale, 0::BIGINT AS n_row_diffs, 0::BIGINT AS n_left FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 97 = 7 OR o_orderkey % 89 = 11) o JOIN r ON {_IN}",
)
def _healed(s: SparkSession, d: str) -> DataFrame:
    """A tree that is stale, as the table moved on without it: leaves differ, rows do not, so they are hashed anew."""
    t, now = spec("orders"), table(s, d, "orders").select(*_TREE_COLUMNS)
    kept = _kept(s, {"stale": _tree_node(s, d, "n2"), "true": now})
    bad = written(trees.compare(kept["stale"], kept["true"]), "bad")
    rows = diff.diff_pair(*[trees.rows_of(kept["true"], now, t, bad)] * 2, t).count()
    tree, n = trees.heal(kept["stale"], now, t, bad)
    return s.createDataFrame([(n, rows, trees.compare(tree, kept["true"]).count())], "n_stale long, n_row_diffs long, n_left long")


@query("merkle_time_zone", f"WITH {_R} SELECT block_id, bool_or({_MOVED}) AS differs, FALSE AS differs_by_zone FROM orders o JOIN r ON {_IN} GROUP BY block_id")
def _zones(s: SparkSession, d: str) -> DataFrame:
    """Leaves of one table hashed in two session zones are equal; an hour that a clock shows twice is two values in both."""
    r, zone = _tree_ranges(s, d), s.conf.get("spark.sql.session.timeZone")
    kept = {}
    try:
        for name, tz, later in (("here", zone, False), ("there", "America/New_York", False), ("later", "America/New_York", True)):
            s.conf.set("spark.sql.session.timeZone", tz)
            kept[name] = written(merkle.leaves(_moments(s, d, later), _NESTED, r).select(F.col("node_position").alias("block_id"), F.struct(*merkle.HASH).alias(name)), "leaves")
    finally:
        s.conf.set("spark.sql.session.timeZone", zone)
    return kept["here"].join(kept["there"], "block_id").join(kept["later"], "block_id").select("block_id", (F.col("there") != F.col("later")).alias("differs"), (F.col("here") != F.col("there")).alias("differs_by_zone"))


query("merkle_tree_walk", f"WITH {_R}, h AS (SELECT {_HEIGHT} AS h), n AS (SELECT DISTINCT k, (block_id >> k)::BIGINT AS p, h FROM (SELECT block_id, h, unnest(range(0, h + 1)) AS k FROM r, h)) SELECT k::INT AS node_level, p AS node_position, array_to_string(list_transform(range(0, h - k + 1), lambda i: lpad((p >> (h - k - i)::INT)::VARCHAR, 10, '0')), '/') AS path FROM n")(
    lambda s, d: (lambda r: merkle.walk(_tree(s, d, "n1", r), merkle.height(r.count())))(_tree_ranges(s, d))
)
_CHANGES = "SELECT event_id AS lsn, event_id // 10 AS xid, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op, CASE WHEN event_type = 'signup' THEN 1000000 + event_id ELSE event_id END AS pk FROM events"


def changes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").selectExpr("event_id AS lsn", "event_id div 10 AS xid", "CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op", "CASE WHEN event_type = 'signup' THEN 1000000 + event_id ELSE event_id END AS pk")


_AT = f"r AS ({_RANGES}), c AS ({_CHANGES}), a AS (SELECT o.*, block_id FROM (SELECT *, pk AS o_orderkey FROM c) o JOIN r ON {_IN})"


def _counters(s: SparkSession, d: str) -> DataFrame:
    return merkle.counters(changes(s, d).withColumnRenamed("pk", "o_orderkey"), _ranges(s, d), "o_orderkey")


query("merkle_update_counters", f"WITH {_AT} SELECT block_id, count(*) FILTER (op = 'INSERT') AS inserts, count(*) FILTER (op = 'DELETE') AS deletes, count(*) FILTER (op = 'UPDATE') AS updates FROM a GROUP BY block_id")(_counters)
query("merkle_dirty_leaves", f"WITH {_AT} SELECT r.block_id AS node_position, EXISTS (SELECT 1 FROM a WHERE a.block_id = r.block_id) AS dirty FROM r")(
    lambda s, d: merkle.mark(_ranges(s, d).select(F.col("block_id").alias("node_position")), _counters(s, d)).select("node_position", "dirty")
)
query("merkle_dirty_after_truncate", f"SELECT block_id AS node_position, TRUE AS dirty FROM ({_RANGES})")(
    lambda s, d: merkle.mark(_ranges(s, d).select(F.col("block_id").alias("node_position")), _counters(s, d), merkle.escalates(s.createDataFrame([("TRUNCATE",)], "op string"), 10)).select("node_position", "dirty")
)
query("cdc_escalation", f"SELECT count(*) FILTER (op = 'UPDATE') >= greatest(1000, 0.01 * (SELECT count(*) FROM orders)) AS escalated FROM ({_CHANGES})")(
    lambda s, d: s.range(1).select(F.lit(merkle.escalates(changes(s, d), table(s, d, "orders").count())).alias("escalated"))
)
query(
    "merkle_split",
    f"WITH {_ASSIGN}, k AS (SELECT o_orderkey, range_end, row_number() OVER (PARTITION BY block_id ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY block_id) AS n FROM a JOIN r USING (block_id)), "
    "s AS (SELECT range_start AS s FROM r UNION ALL SELECT o_orderkey FROM k WHERE n > 40 AND i > 1 AND (i - 1) % 40 = 0 AND (range_end IS NULL OR n - i + 1 >= 10)) SELECT (row_number() OVER (ORDER BY s) - 1)::BIGINT AS block_id, s AS range_start FROM s",
)(lambda s, d: (lambda r: merkle.split(table(s, d, "orders"), ["o_orderkey"], r, r.select("block_id", F.lit(99).alias("inserts")), 40).select("block_id", F.col("range_start.o_orderkey").alias("range_start")))(_ranges(s, d)))
query("merkle_merge", f"WITH r AS ({_ranges_sql(20)}), c AS (SELECT block_id, range_start, count(*) AS n FROM r JOIN orders o ON {_IN} GROUP BY ALL) SELECT block_id // 2 AS block_id, min(range_start) AS range_start, sum(n)::BIGINT AS n_rows FROM c GROUP BY 1")(
    lambda s, d: (lambda r: merkle.merged(blocks.assign(table(s, d, "orders"), ["o_orderkey"], r).groupBy("block_id").agg(F.count("*").alias("n_rows")).join(r, "block_id"), 100).select("block_id", F.col("range_start.o_orderkey").alias("range_start"), "n_rows"))(_ranges(s, d, size=20))
)


def _log(rows: DataFrame, place: str, parts: int = 4) -> str:
    """A change log of ``rows``, appended in so many segments of about as many positions each."""
    kept = written(rows, "log")
    last = kept.agg(F.max("lsn").alias("b")).first()["b"] or 0
    for k in range(parts):
        changelog.append(kept.where((F.col("lsn") > last * k // parts) & (F.col("lsn") <= last * (k + 1) // parts)), f"{place}/log")
    return f"{place}/log"


#: Each change of ``events`` at a position of its own; transactions of ten changes, of ten in a row; each commits right behind them.
_BOUND = f"c AS (SELECT 2 * lsn + 1 AS lsn, xid, op, pk FROM ({_CHANGES})), e AS (SELECT xid, max(lsn) + 1 AS ends FROM c GROUP BY xid), h AS (SELECT max(ends) AS head FROM e)"


@query(
    "cdc_bounded_drain",
    f"WITH {_BOUND} SELECT op, count(*) AS n_rows, max(lsn)::BIGINT AS last_lsn, count(*) FILTER (ends <= head * 2 // 5)::BIGINT AS n_first FROM c JOIN e USING (xid), h WHERE ends <= head * 9 // 10 GROUP BY op",
)
def _drain(s: SparkSession, d: str) -> DataFrame:
    """Two drains with a rising target, both shares of the log."""
    place = _place(s, "drain")
    rows = changes(s, d).withColumn("lsn", 2 * F.col("lsn") + 1)
    ends = rows.groupBy("xid").agg((F.max("lsn") + 1).alias("lsn")).select("lsn", "xid", F.lit("COMMIT").alias("op"), F.lit(None).cast("long").alias("pk"))
    log, out = _log(rows.unionByName(ends), place), f"{place}/out"
    run = lambda share: drain.bounded(s, log, drain.kept(out), f"{place}/checkpoint", changelog.head(log) * share // 10)
    run(4)
    first = written(drain.delivered(s, out).groupBy("op").agg(F.count("*").alias("n_first")), "first")
    run(9)
    return drain.delivered(s, out).groupBy("op").agg(F.count("*").alias("n_rows"), F.max("lsn").alias("last_lsn")).join(first, "op", "left").na.fill(0, ["n_first"])


#: Transactions one among another: ten changes each, 97 positions apart. Of 13 one aborts, of 11 one never ends, and three of four end
#: late, when many others have begun and ended.
_MIXED = (
    "SELECT 4 * event_id + 4 AS lsn, event_id % 97 + 97 * (event_id {0} 970) AS xid, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op, "
    "CASE WHEN event_type = 'signup' THEN 1000000 + event_id ELSE event_id END AS pk FROM events"
)
_ENDS = "SELECT max(lsn) + 1 + 1200 * (xid % 4) AS lsn, xid, CASE WHEN xid % 13 = 7 THEN 'ABORT' ELSE 'COMMIT' END AS op FROM c WHERE xid % 11 <> 5 GROUP BY xid"
_MIXED_SQL = f"c AS ({_MIXED.format('//')}), e AS ({_ENDS}), h AS (SELECT greatest((SELECT max(lsn) FROM c), (SELECT max(lsn) FROM e)) AS head)"
#: Targets of the drains, as shares of the log in percent.
_TARGETS = (35, 70, 100)


def _mixed(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").selectExpr("event_id", "event_type").transform(lambda t: s.sql(_MIXED.format("div").replace("FROM events", "FROM {events}"), events=t))
    ends = s.sql(_ENDS.replace("FROM c", "FROM {c}"), c=rows).withColumn("pk", F.lit(None).cast("long"))
    return rows.unionByName(ends)


_BY_DRAIN = " ".join(f"WHEN e.lsn <= head * {x} // 100 THEN {k}" for k, x in enumerate(_TARGETS, 1))


@query("cdc_interleaved", f"WITH {_MIXED_SQL} SELECT c.lsn, c.xid, c.op, c.pk, e.lsn AS commit_lsn, CASE {_BY_DRAIN} END AS drain FROM c JOIN e ON c.xid = e.xid, h WHERE e.op = 'COMMIT'")
def _interleaved(s: SparkSession, d: str) -> DataFrame:
    """Drains up to three targets, with transactions that are open at each of them and commits that come late: each
    committed change once, with the drain that gave it, told by its commit and by the batches that there were."""
    place = _place(s, "mixed")
    log = _log(_mixed(s, d), place, 5)
    parts = []
    for k, share in enumerate(_TARGETS, 1):  # each drain writes into its own folder from the same checkpoint
        drain.bounded(s, log, drain.kept(f"{place}/out-{k}"), f"{place}/checkpoint", changelog.head(log) * share // 100)
        parts.append(drain.delivered(s, f"{place}/out-{k}").withColumn("drain", F.lit(k)))
    return reduce(DataFrame.unionByName, parts).drop("batch")


query("cdc_open_transactions", f"WITH {_MIXED_SQL} SELECT c.xid, count(*) AS n_changes, min(c.lsn) AS first_lsn FROM c LEFT JOIN e ON c.xid = e.xid, h WHERE c.lsn <= head * 70 // 100 AND (e.lsn IS NULL OR e.lsn > head * 70 // 100) GROUP BY c.xid")(
    lambda s, d: _open_transactions(s, d)
)


def _open_transactions(s: SparkSession, d: str) -> DataFrame:
    """What a drain up to 70 percent of the log has left in its state: the changes of open transactions only."""
    place = _place(s, "open")
    log = _log(_mixed(s, d), place, 3)
    drain.bounded(s, log, drain.kept(f"{place}/out"), f"{place}/checkpoint", changelog.head(log) * 70 // 100)
    return transactions.open_changes(s, f"{place}/checkpoint").groupBy("xid").agg(F.count("*").alias("n_changes"), F.min("lsn").alias("first_lsn"))


@query("cdc_listen_steps", f"WITH {_MIXED_SQL} SELECT op, count(*) AS n_rows, sum(commit_lsn)::BIGINT AS commits FROM (SELECT c.op, e.lsn AS commit_lsn FROM c JOIN e ON c.xid = e.xid WHERE e.op = 'COMMIT') GROUP BY op")
def _listen_steps(s: SparkSession, d: str) -> DataFrame:
    """A drain that runs on and takes in a fifth of the log with each batch, stopped and started again halfway."""
    place = _place(s, "listen")
    log = _log(_mixed(s, d), place, 3)
    step = changelog.head(log) // 5 + 1
    for _ in range(2):
        q = drain.listen(s, log, drain.kept(f"{place}/out"), f"{place}/checkpoint", "0 seconds", step)
        q.processAllAvailable()
        q.stop()
    return drain.delivered(s, f"{place}/out").groupBy("op").agg(F.count("*").alias("n_rows"), F.sum("commit_lsn").alias("commits"))


@query("cdc_tree_upkeep", f"WITH {cte('orders')}, r AS ({_ranges_sql(_LEAF, 'n1')}) {_leaves_sql('n2')}")
def _tree_upkeep(s: SparkSession, d: str) -> DataFrame:
    """A kept tree of n1 that a change stream brings to n2: the drain and the tree's version move together, in two drains, and
    the last batch comes again and changes nothing."""
    place, (a, b) = _place(s, "upkeep"), (_tree_node(s, d, n) for n in ("n1", "n2"))
    tree = _kept(s, {"n1": a})["n1"]
    found = _as_changes(diff.diff_pair(a, b, spec("orders"))).select(F.col("o_orderkey").alias("pk"), "op")
    rows = found.select((4 * F.col("pk") + 4).alias("lsn"), (F.col("pk") % 50).alias("xid"), "op", "pk")
    ends = rows.groupBy("xid").agg((F.max("lsn") + 1).alias("lsn")).select("lsn", "xid", F.lit("COMMIT").alias("op"), F.lit(None).cast("long").alias("pk"))
    log, sink = _log(rows.unionByName(ends), place), drain.into_tree(tree.place, lambda: b, spec("orders"))
    for share in (98, 100):
        drain.bounded(s, log, sink, f"{place}/checkpoint", changelog.head(log) * share // 100)
    now = trees.open_tree(s, tree.place)
    sink(s.createDataFrame([("DELETE", 1)], "op string, pk long"), now.about["batch"])
    return trees.open_tree(s, tree.place).leaves.select("node_position", *merkle.HASH)


# ---- the rest of the catalogue

query("block_assign", f"WITH {_ASSIGN} SELECT o_orderkey, block_id FROM a")(lambda s, d: blocks.assign(table(s, d, "orders"), ["o_orderkey"], _ranges(s, d)).select("o_orderkey", "block_id"))
query("column_inventory", "SELECT column_name AS name, (row_number() OVER () - 1)::BIGINT AS position FROM (DESCRIBE orders)")(lambda s, d: (lambda t: s.createDataFrame([(c, i) for i, c in enumerate(t.columns)], "name string, position long"))(table(s, d, "orders")))
query("row_count_by_node", f"WITH {cte('orders')} SELECT 'n1' AS node, count(*) AS n_rows FROM n1 UNION ALL SELECT 'n2', count(*) FROM n2 UNION ALL SELECT 'n3', count(*) FROM n3")(
    lambda s, d: node(s, d, "orders", "n1").select(F.lit("n1").alias("node")).unionByName(node(s, d, "orders", "n2").select(F.lit("n2").alias("node"))).unionByName(node(s, d, "orders", "n3").select(F.lit("n3").alias("node"))).groupBy("node").agg(F.count("*").alias("n_rows"))
)
_META_TABLE = nodes.Table("orders", ("o_orderkey",), ("commit_ts", "node_origin"))


def _with_meta(s: SparkSession, d: str, only: Callable[[DataFrame], DataFrame]) -> DataFrame:
    meta = lambda n: node(s, d, "orders", n).withColumn("commit_ts", F.expr("CASE WHEN o_orderkey % 41 <> 0 THEN o_orderdate END")).withColumn("node_origin", F.expr("cast(o_orderkey % 3 as string)"))
    return diff.report(diff.diff(nodes.Cluster({n: (lambda _, n=n: only(meta(n))) for n in ("n1", "n2")}), _META_TABLE), _META_TABLE)


query("diff_until", diff_sql("orders", where="o_orderkey % 41 = 0 OR o_orderdate <= TIMESTAMP '1995-06-01'"))(lambda s, d: _with_meta(s, d, lambda t: nodes.until(t, "commit_ts", "1995-06-01 00:00:00")))
query("diff_origin", diff_sql("orders", where="o_orderkey % 3 = 2"))(lambda s, d: _with_meta(s, d, lambda t: nodes.written_by(t, "node_origin", "2")))
query("diff_embeddings_array", "SELECT vec_id FROM embeddings WHERE vec_id % 83 <> 5 AND vec_id % 89 = 11")(
    lambda s, d: (lambda t: diff.diff_pair(t.where("vec_id % 83 <> 5"), t.where("vec_id % 83 <> 5").withColumn("embedding", F.expr("if(vec_id % 89 = 11, slice(embedding, 2, 99999), embedding)")), nodes.Table("embeddings", ("vec_id",))).select("vec_id"))(table(s, d, "embeddings"))
)
query("plan_when_predicate", f"SELECT f.o_orderkey FROM ({diff_sql('orders')}) f JOIN orders o USING (o_orderkey) WHERE f.diff_type = 'row_mismatch' AND o.o_totalprice > 100000 AND o.o_orderpriority IN ('1-URGENT', '2-HIGH')")(
    lambda s, d: rules.resolved(diff.diff(cluster(s, d, "orders"), spec("orders")), spec("orders"), rules.Plan((rules.Rule("r", "skip", when="n1.o_totalprice > 100000 AND n2.o_orderpriority IN ('1-URGENT', '2-HIGH')"),), (), "bidirectional"))
    .where("rule = 'r'")
    .select("o_orderkey")
)
query("plan_pk_range", f"SELECT o_orderkey FROM ({diff_sql('orders')}) WHERE o_orderkey BETWEEN 50 AND 700")(
    lambda s, d: rules.resolved(diff.diff(cluster(s, d, "orders"), spec("orders")), spec("orders"), rules.Plan((rules.Rule("r", "skip", key_between=(50, 700)),), (), "bidirectional")).where("rule = 'r'").select("o_orderkey")
)
query("plan_coalesce", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 13 = 0")(
    lambda s, d: (lambda c, t, p: rules.repairs(
        rules.resolved(diff.diff(nodes.Cluster({"n1": lambda _: c.withColumn("c_mktsegment", F.expr(_HOLES1)), "n2": lambda _: c}), t), t, p), t, columns("customer"), p
    ).where("node = 'n1'").select("c_custkey", "row.c_mktsegment"))(table(s, d, "customer"), spec("customer"), rules.Plan((), (), "custom", {"c_mktsegment": "coalesce(n1.c_mktsegment, n2.c_mktsegment)"}))
)
query(
    "plan_apply_forms",
    f"""WITH f AS ({diff_sql('orders')}), {cte('orders', ['n1', 'n2'])} SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'n2' ELSE 'n1' END AS node, o_orderkey, 'upsert' AS op, CASE WHEN o_orderkey % 2 = 0 THEN n1.o_orderstatus ELSE n2.o_orderstatus END AS status
    FROM f LEFT JOIN n1 USING (o_orderkey) LEFT JOIN n2 USING (o_orderkey) WHERE CASE WHEN o_orderkey % 2 = 0 THEN n1.o_custkey ELSE n2.o_custkey END IS NOT NULL""",
)(
    lambda s, d: (lambda x, t, p: rules.repairs(rules.resolved(x, t, p), t, columns("orders"), p).select("node", "o_orderkey", "op", F.col("row.o_orderstatus").alias("status")))(
        diff.diff(cluster(s, d, "orders"), spec("orders")), spec("orders"), rules.Plan((rules.Rule("even", "apply_from_n1_replace", when="o_orderkey % 2 = 0"),), (), "apply_from_n2_upsert")
    )
)
query(
    "plan_custom_row",
    f"""WITH f AS ({diff_sql('orders')}), {cte('orders', ['n1', 'n2'])} SELECT o_orderkey, n2.o_orderpriority AS priority, 'merged' AS status, coalesce(n2.o_totalprice, n1.o_totalprice)::DECIMAL(18,2) AS price
    FROM f LEFT JOIN n1 USING (o_orderkey) LEFT JOIN n2 USING (o_orderkey)""",
)(
    lambda s, d: (lambda x, t, p: rules.repairs(rules.resolved(x, t, p), t, columns("orders"), p).where("node = 'n1'").select("o_orderkey", F.col("row.o_orderpriority").alias("priority"), F.col("row.o_orderstatus").alias("status"), F.col("row.o_totalprice").cast("decimal(18,2)").alias("price")))(
        diff.diff(cluster(s, d, "orders"), spec("orders")), spec("orders"), rules.load('{"version": 1, "default": "custom", "priority": ["n2", "n1"], "custom": {"o_orderpriority": "{{n2.o_orderpriority}}", "o_orderstatus": "\'merged\'"}}')
    )
)
query("merkle_root_compare", f"WITH {cte('orders')}, {_R}, a AS ({_leaves_sql('n1')}), b AS ({_leaves_sql('n2')}) SELECT x.n = y.n AND x.l0 = y.l0 AS same_as_other, x.l0, x.l1 FROM (SELECT sum(n_rows) AS n, {_FOLD} FROM a) x, (SELECT sum(n_rows) AS n, {_FOLD} FROM b) y")(
    lambda s, d: _roots(s, d)
)
query("merkle_resequence", "SELECT (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS block_id, o_orderkey AS range_start, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS range_end FROM orders")(
    lambda s, d: merkle.resequenced(table(s, d, "orders").select(F.col("o_orderkey").alias("range_start")))
)


@query("merkle_refresh", f"WITH {cte('orders')}, {_R} {_leaves_sql('n2')}")
def _refresh(s: SparkSession, d: str) -> DataFrame:
    r = _tree_ranges(s, d)
    old, new = (_tree(s, d, n, r) for n in ("n1", "n2"))
    return merkle.refreshed(old, _tree_node(s, d, "n2"), spec("orders"), r, merkle.mismatched(old, new))


def _roots(s: SparkSession, d: str) -> DataFrame:
    r = _tree_ranges(s, d)
    top = merkle.height(r.count())
    a, b = (_tree(s, d, n, r).where(F.col("node_level") == top) for n in ("n1", "n2"))
    other = b.select("node_position", F.struct(*merkle.HASH).alias("other"))
    return a.join(other, "node_position").select(F.struct(*merkle.HASH).eqNullSafe(F.col("other")).alias("same_as_other"), "l0", "l1")


@query("report_round_trip", diff_sql("orders"))
def _report(s: SparkSession, d: str) -> DataFrame:
    """A diff that was written as a report and read again."""
    t, place = spec("orders"), _place(s, "report")
    reports.write_report(diff.diff(cluster(s, d, "orders"), t), place)
    return diff.report(reports.read_report(s, place, t, table(s, d, "orders").schema), t)


@query("repair_report", f"SELECT 'n2' AS node, CASE WHEN diff_type = 'missing_on_n1' THEN 'delete' ELSE 'upsert' END AS op, count(*) FILTER (NOT (o_orderkey % 5 = 0 OR o_orderkey % 41 = 0)) AS n_rows, count(*) FILTER (o_orderkey % 5 = 0 OR o_orderkey % 41 = 0) AS n_skipped FROM ({diff_sql('orders')}) GROUP BY ALL")
def _repair_report(s: SparkSession, d: str) -> DataFrame:
    """What a repair writes and what it leaves out as stale, as reports."""
    return reports.write_repairs(_stale(s, d), spec("orders"), _place(s, "repairs"))


@query("stale_skip_log", f"SELECT o_orderkey, CASE WHEN o_orderkey % 41 = 0 THEN 'unknown' ELSE 'newer' END AS reason FROM ({diff_sql('orders')}) WHERE o_orderkey % 5 = 0 OR o_orderkey % 41 = 0")
def _skip_log(s: SparkSession, d: str) -> DataFrame:
    place = _place(s, "skipped")
    reports.write_skipped(_stale(s, d), spec("orders"), place)
    return s.read.schema("o_orderkey long, reason string").json(place)


@query(
    "plan_three_nodes",
    f"WITH {cte('orders')}, w AS (SELECT pair, o_orderkey, right(pair, 2) AS node, left(pair, 2) AS src, CASE WHEN diff_type = 'missing_on_n1' THEN 'delete' ELSE 'upsert' END AS op FROM ({diff_sql('orders', _THREE)})), "
    "p AS (SELECT *, row_number() OVER (PARTITION BY node, o_orderkey ORDER BY pair) AS i FROM w) "
    "SELECT p.node, p.o_orderkey, p.op, CASE WHEN p.op = 'upsert' THEN CASE p.src WHEN 'n1' THEN a.o_orderstatus ELSE b.o_orderstatus END END AS status FROM p LEFT JOIN n1 a ON p.o_orderkey = a.o_orderkey LEFT JOIN n2 b ON p.o_orderkey = b.o_orderkey WHERE i = 1",
)
def _three_nodes(s: SparkSession, d: str) -> DataFrame:
    """Each node follows the first one of its pairs; no key is written twice on a node."""
    t, plan = spec("orders"), rules.Plan((), (), "keep_n1")
    found = rules.resolved(diff.diff(cluster(s, d, "orders", ("n1", "n2", "n3")), t), t, plan)
    return rules.repairs(found, t, columns("orders"), plan).select("node", "o_orderkey", "op", F.expr("if(op = 'upsert', row.o_orderstatus, null)").alias("status"))


_SEGMENT, _NATION, _BALANCE = "c_mktsegment", "c_nationkey", "c_acctbal"
#: Conditions, and the same in SQL over a (n1) and b (n2).
_CONDITIONS: list[tuple[object, str]] = [
    ({"=": [{"n1": _SEGMENT}, {"n2": _SEGMENT}]}, "a.c_mktsegment IS NOT DISTINCT FROM b.c_mktsegment"),
    ({"!=": [{"n1": _NATION}, {"n2": _NATION}]}, "a.c_nationkey IS DISTINCT FROM b.c_nationkey"),
    ({"=": [{"n1": _SEGMENT}, None]}, "a.c_mktsegment IS NULL"),
    ({"in": [{"n1": _SEGMENT}, ["BUILDING", None]]}, "coalesce(a.c_mktsegment = 'BUILDING', TRUE)"),
    ({"not": {"in": [{"n2": _NATION}, [1, 2.0, 3]]}}, "coalesce(b.c_nationkey NOT IN (1, 2, 3), TRUE)"),
    ({"null": {"n1": _SEGMENT}}, "a.c_mktsegment IS NULL"),
    ({"any": [{"null": {"n2": _NATION}}, {"<": [{"n2": _NATION}, 10]}]}, "coalesce(b.c_nationkey < 10, TRUE)"),
    ({"all": [{"not": {"null": {"n2": _NATION}}}, {">=": [{"n2": _NATION}, 12.5]}]}, "coalesce(b.c_nationkey >= 12.5, FALSE)"),
    ({">": [{"n1": _BALANCE}, 1000]}, "a.c_acctbal > 1000"),
    ({"<=": [{"n1": "c_custkey"}, {"n2": _BALANCE}]}, "a.c_custkey <= b.c_acctbal"),
    ({"=": [{"n1": "nowhere"}, None]}, "TRUE"),
    ({"<": [{"n1": "c_name"}, {"n2": _SEGMENT}]}, "a.c_name < b.c_mktsegment"),
    ({"!=": [{"n2": _SEGMENT}, "BUILDING"]}, "b.c_mktsegment IS DISTINCT FROM 'BUILDING'"),
]


@query(
    "plan_conditions",
    f"SELECT a.c_custkey, {', '.join(f'({sql}) AS c{k}' for k, (_, sql) in enumerate(_CONDITIONS))} FROM (SELECT * REPLACE ({_HOLES1} AS c_mktsegment) FROM customer) a JOIN (SELECT * REPLACE ({_HOLES2} AS c_nationkey) FROM customer) b ON a.c_custkey = b.c_custkey WHERE a.c_custkey % 13 = 0 OR a.c_custkey % 17 = 0",
)
def _conditions(s: SparkSession, d: str) -> DataFrame:
    """Each condition over the rows of a diff whose columns have nulls on either side."""
    t, c = spec("customer"), table(s, d, "customer")
    found = diff.diff(nodes.Cluster({"n1": lambda _: c.withColumn(_SEGMENT, F.expr(_HOLES1)), "n2": lambda _: c.withColumn(_NATION, F.expr(_HOLES2))}), t)
    compiled = rules.compiler(found, t)
    return found.select("c_custkey", *[compiled.condition(x).alias(f"c{k}") for k, (x, _) in enumerate(_CONDITIONS)])


query("plan_condition_rules", f"WITH {cte('orders')} SELECT o_orderkey, CASE WHEN diff_type = 'row_mismatch' AND a.o_totalprice > 150000 THEN 'dear' WHEN diff_type = 'missing_on_n1' THEN 'new there' END AS rule FROM ({diff_sql('orders')}) f LEFT JOIN n1 a USING (o_orderkey)")(
    lambda s, d: (lambda t, p: rules.resolved(diff.diff(cluster(s, d, "orders"), t), t, p).select("o_orderkey", "rule"))(
        spec("orders"),
        rules.load(
            '{"default": "skip", "rules": [{"name": "dear", "action": "keep_n1", "diff_types": ["row_mismatch"], "where": {">": [{"n1": "o_totalprice"}, 150000]}}, '
            '{"name": "new there", "action": "keep_n2", "where": {"all": [{"null": {"n1": "o_orderkey"}}, {"not": {"null": {"n2": "o_orderkey"}}}]}}]}'
        ),
    )
)


# ---- tables in key ranges, capped runs, samples of files, members of sets


def _stored(s: SparkSession, d: str, df: DataFrame, name: str, rows_per_part: int) -> parted.Parted:
    return parted.create(df, spec(name), _place(s, f"parted-{name}"), rows_per_part)


#: Repairs of few keys: the differing ones among the first fifth.
_FEW = "o_orderkey * 5 <= (SELECT max(o_orderkey) FROM orders)"


def _few_repairs(s: SparkSession, d: str) -> DataFrame:
    last = table(s, d, "orders").agg(F.max("o_orderkey").alias("m")).first()["m"] or 0
    return repair.from_source(diff.diff(cluster(s, d, "orders"), spec("orders")).where(F.col("o_orderkey") * 5 <= last), spec("orders"), "n1")


@query("repair_parted", f"WITH {cte('orders')} SELECT o_orderkey, o_orderstatus FROM n1 WHERE {_FEW} UNION ALL SELECT o_orderkey, o_orderstatus FROM n2 WHERE NOT ({_FEW})")
def _parted(s: SparkSession, d: str) -> DataFrame:
    """A copy of n2 in key ranges after repairs of its first fifth."""
    kept = _stored(s, d, node(s, d, "orders", "n2"), "orders", _LEAF)
    kept.apply(_few_repairs(s, d), "n2")
    return kept.frame.select("o_orderkey", "o_orderstatus")


@query(
    "repair_parted_rewrites",
    f"WITH {cte('orders')}, r AS ({_ranges_sql(_LEAF, 'n2')}), f AS ({diff_sql('orders')}), t AS (SELECT DISTINCT block_id FROM (SELECT o_orderkey FROM f WHERE {_FEW}) o JOIN r ON {_IN}) SELECT r.block_id AS key_part, t.block_id IS NOT NULL AS rewritten FROM r LEFT JOIN t ON r.block_id = t.block_id",
)
def _parted_rewrites(s: SparkSession, d: str) -> DataFrame:
    """Which ranges of that copy have new files afterwards: those with a repair and no others."""
    kept = _stored(s, d, node(s, d, "orders", "n2"), "orders", _LEAF)
    files = lambda name: written(kept.with_parts.groupBy(parted.PART).agg(F.sort_array(F.collect_set("_metadata.file_path")).alias(name)), "files")
    before = files("before")
    kept.apply(_few_repairs(s, d), "n2")
    return before.join(files("after"), parted.PART, "full_outer").select(parted.PART, (~F.col("before").eqNullSafe(F.col("after"))).alias("rewritten"))


@query("repair_parted_cells", f"SELECT c_custkey, c_name, c_mktsegment, {_HOLES2} AS c_nationkey FROM customer")
def _parted_cells(s: SparkSession, d: str) -> DataFrame:
    """A copy with holes in one column, of which the cells alone are filled from the other node, which has holes of its own."""
    t, c = spec("customer"), table(s, d, "customer")
    one, two = c.withColumn("c_mktsegment", F.expr(_HOLES1)).withColumn("c_nationkey", F.expr(_HOLES2)), c.withColumn("c_nationkey", F.expr(_HOLES2))
    kept = _stored(s, d, one, "customer", 50)
    kept.fill(parted.cells(diff.diff(nodes.Cluster({"n1": lambda _: one, "n2": lambda _: two}), t), t, ["c_mktsegment", "c_nationkey"]), "n1")
    return kept.frame.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")


_WHERE = "o_orderpriority < '4'"
_RUN_SQL = f"SELECT pair, count(*) AS n_rows FROM ({diff_sql('orders', _THREE, _WHERE)}) GROUP BY pair"


@query("diff_run_summary", f"SELECT pair, n_rows, least(n_rows, 300) AS n_kept, n_rows > 300 AS limited, '({_WHERE.replace(chr(39), chr(39) * 2)})' AS effective_filter FROM ({_RUN_SQL})")
def _run_summary(s: SparkSession, d: str) -> DataFrame:
    """The summary of a capped and filtered diff: counted while its rows are computed."""
    run = diff.run(cluster(s, d, "orders", ("n1", "n2", "n3")), spec("orders"), 300, _WHERE)
    kept = {r["pair"]: r["count"] for r in run.rows.groupBy("pair").count().collect()}
    rows = [tuple(x.values()) for x in run.summary()]
    if any(kept.get(x[0], 0) != x[2] for x in rows):
        raise RuntimeError("the summary does not fit its rows")
    return s.createDataFrame(rows, "pair string, n_rows long, n_kept long, limited boolean, effective_filter string")


query("diff_effective_filter", f"SELECT o_orderkey FROM ({_META}) WHERE o_orderstatus = 'F' AND node_origin = '2' AND (commit_ts IS NULL OR commit_ts <= TIMESTAMP '1995-06-01')")(
    lambda s, d: _meta(s, d).where(diff.effective_filter("o_orderstatus = 'F'", ("node_origin", "2"), ("commit_ts", "1995-06-01"))).select("o_orderkey")
)


@query("block_boundaries_by_files", "SELECT count(*) AS n_rows, TRUE AS bounded, TRUE AS few_files FROM orders")
def _by_files(s: SparkSession, d: str) -> DataFrame:
    """Ranges from the keys of an eighth of a table's files: blocks stay near their size, and the scan opens these files alone."""
    place = _place(s, "files")
    table(s, d, "orders").repartition(64, F.xxhash64("o_orderkey")).write.parquet(place)
    df = s.read.parquet(place)
    ranges = written(blocks.boundaries_by_files(df, ["o_orderkey"], 4 * _LEAF, 0.125, least=1), "ranges")
    some, _ = blocks.file_sample(df, 0.125)
    opened = some.select("_metadata.file_name").distinct().count()
    sizes = blocks.assign(df, ["o_orderkey"], ranges).groupBy("block_id").count().agg(F.sum("count").alias("n"), F.max("count").alias("most"))
    return sizes.select(F.col("n").alias("n_rows"), (F.col("most") <= 3 * 4 * _LEAF).alias("bounded"), F.lit(opened <= 8).alias("few_files"))


_SETS = [("n1", "customer"), ("n2", "customer"), ("n3", "customer"), ("n1", "orders"), ("n2", "orders"), ("n3", "part"), ("n1", "nowhere"), ("n2", "nowhere")]


@query(
    "repset_diff_tables",
    f"SELECT 'customer' AS name, p AS nodes, CASE WHEN count(f.pair) > 0 THEN 'differed' ELSE 'matched' END AS status, count(f.pair) AS n_diffs FROM (VALUES ('n1,n2'), ('n1,n3'), ('n2,n3')) v(p) LEFT JOIN ({diff_sql('customer', _THREE)}) f ON replace(f.pair, '/', ',') = p GROUP BY p "
    f"UNION ALL SELECT 'orders', 'n1,n2', 'differed', count(*) FROM ({diff_sql('orders')}) UNION ALL SELECT 'part', 'n3', 'single', NULL UNION ALL SELECT 'nowhere', 'n1,n2', 'failed', NULL",
)
def _set_tables(s: SparkSession, d: str) -> DataFrame:
    """The tables of a replication set, diffed between the nodes that have them in it."""
    members = s.createDataFrame(_SETS, "node string, table_name string")
    return diff.each_member(cluster(s, d, "orders", ("n1", "n2", "n3")), members, {n: spec(n) for n in ("customer", "orders", "part")})
