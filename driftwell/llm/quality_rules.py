"""Quality rules with host verdicts (operator 3), in DataFrame functions only.

Each document is measured by itself. Hosts are then judged by how many of their documents fail a
rule: the rates are shrunk with a beta prior whose two parameters are fitted to all hosts by the
method of moments, so that a host with few documents is not condemned for them. A document is kept
if it fails no rule and its host's shrunken rate is at most ``host_limit``.

Null, empty and blank texts have no words and fail. A null host is a host of its own. Equal rows give
equal rows. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fenced, free_name, words_of, written

WINDOW = 8
MIN_WORDS = 20
#: Percent of the words that may stand in repeated windows, of symbols to words, of lines that repeat.
REPEAT_LIMIT, SYMBOL_LIMIT, DUP_LINE_LIMIT = 30, 10, 50
HOST_LIMIT = 0.5
#: Bounds of the prior's weight in documents, also where hosts do not differ.
PRIOR_MIN, PRIOR_MAX = 2.0, 1000.0


def measure(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host and the counts of each text."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    split = fenced(docs, w=words_of(F.col("text")), lines=F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    split = split.select(
        "doc_id",
        "host",
        "w",
        F.size("w").alias("n"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    last = F.col("n") - WINDOW
    hashes = F.when(last < 0, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)]))
    )
    hashed = fenced(split, h=hashes).drop("w")
    # the windows by hash: those with an equal neighbour are repeated; then their starts in order
    ranked = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    repeated = F.filter("ranked", lambda s, j: (s["x"] == F.get("ranked", j - 1)["x"]) | (s["x"] == F.get("ranked", j + 1)["x"]))
    starts = fenced(fenced(hashed, ranked=ranked).drop("h"), starts=F.sort_array(F.transform(repeated, lambda s: s["i"]))).drop("ranked")
    steps = F.transform("starts", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", j + 1) - p, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return starts.select("doc_id", "host", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_LIMIT * F.col("n_words"))


def rule_failed() -> Column:
    return (
        F.col("base_failed")
        | (100 * F.col("n_symbols") > SYMBOL_LIMIT * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > DUP_LINE_LIMIT * F.col("n_lines"))
    )


def host_rates(measured: DataFrame) -> DataFrame:
    """host, n_docs, n_failed and the shrunken rate; the prior needs two numbers over all hosts."""
    hosts = measured.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("rule_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v")).first()
    m, v = moments["m"] or 0.0, moments["v"] or 0.0
    weight = min(max(m * (1 - m) / v - 1, PRIOR_MIN), PRIOR_MAX) if v > 0 else PRIOR_MAX
    return hosts.withColumn("host_rate", (F.col("n_failed") + m * weight) / (F.col("n_docs") + weight))


def judge(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row for each document: the counts, base_failed, rule_failed, host_rate and kept."""
    measured = written(measure(documents, doc_id, text, host).withColumn("base_failed", base_failed()).withColumn("rule_failed", rule_failed()), "rules")
    hosts = host_rates(measured).select(F.col("host").alias("h"), "host_rate")
    joined = measured.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    return joined.withColumn("kept", ~F.col("rule_failed") & (F.col("host_rate") <= host_limit))


def filtered(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The documents that are kept, with their own columns. Rows are matched by id and, as ids may
    repeat, by the text's hash; null ids count as equal."""
    key, mine = free_name(documents.columns, "_key"), free_name(documents.columns, "_mine")
    keyed = documents.withColumn(key, F.struct(F.col(doc_id), F.xxhash64(F.col(text)), F.col(host)))
    good = judge(keyed, key, text, host).where("kept").select(F.col("doc_id").alias(mine)).distinct().hint("merge")
    return keyed.join(good, F.col(key).eqNullSafe(F.col(mine)), "left_semi").drop(key)


#: The same as ``judge`` in DuckDB SQL over ``documents``.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT r, doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d),
win AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c
  FROM (SELECT r, i, list_slice(w, i, i + {WINDOW - 1}) AS s FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w))),
rep AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM win WHERE c > 1),
cov AS (SELECT r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM rep GROUP BY r),
m AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_LIMIT} * n_words AS base_failed FROM m),
f AS (
  SELECT *, base_failed OR 100 * n_symbols > {SYMBOL_LIMIT} * n_words OR 100 * n_dup_lines > {DUP_LINE_LIMIT} * n_lines AS rule_failed
  FROM b),
h AS (SELECT source AS hs, count(*) AS n, sum(rule_failed::INT) AS bad FROM f GROUP BY source),
p AS (SELECT avg(bad / n) AS mu, coalesce(var_samp(bad / n), 0) AS v FROM h),
q AS (SELECT mu, CASE WHEN v > 0 THEN least(greatest(mu * (1 - mu) / v - 1, {PRIOR_MIN}), {PRIOR_MAX}) ELSE {PRIOR_MAX} END AS k FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT rule_failed AND (bad + mu * k) / (n + k) <= {HOST_LIMIT} AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.hs, q
"""
