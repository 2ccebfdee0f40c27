"""Interaction audit of filters by inclusion-exclusion (operator 11), in DataFrame functions only.

Five filters fail documents; which of them removes a document depends on the order in which they are applied.
For each part of the corpus the numbers J(T) of documents that fail all filters of T are aggregated for all 32
sets T, as sums of products of the five flags, once for all documents and once each for those labelled good and
toxic. Everything else follows from these numbers by Möbius inversion, for all 120 orders at once:

- survivors of the filters Q: the sum over T within Q of (-1)^|T| J(T); what a step removes is the difference of
  two of them, and what fails a step's filter beyond that was removed before, so it is redundant;
- documents that fail exactly S: the sum over T around S of (-1)^(|T|-|S|) J(T); single filters give unique failures;
- the Harsanyi dividend of T in the game "removed by" is (-1)^(|T|+1) J(T), and a filter's Shapley value is the sum of
  the dividends of the sets it is in, each divided by |T|. Times 120 it is a whole number: what the filter removes,
  summed over all orders.

Filters (words are maximal runs of other characters than blank and \\x09-\\x0D, case counts): A: under 200 words; B:
100 * distinct words < 50 * words; C: 100 * [A-Z] characters > 3 * code points; D: holds one of ``#$%&*|``; E: equal
to the text of a smaller doc_id.

Null texts are empty ones, so they are equal to each other. A null lang is the part of the empty string. Rows of equal
doc_id and text are documents of their own, none of them is smaller; a null doc_id is no smaller than any and
has no smaller one, so it never fails E and makes nobody fail. Of several labels of one doc_id, good or toxic holds if
one says so. Extra columns are not read. No documents give no rows. A text of any length is one row of one task.

Texts are read once and leave the first stage as hashes and flags. Copies of one text, be they a third of the
table, are a minimum that is combined on the map side, and its holder is found by (hash, doc_id), a key
that copies do not share. Parts are aggregated on the map side, too.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fenced, words_of, written

FILTERS = "ABCDE"
SETS = range(1 << len(FILTERS))
#: What the filters ask for (fixed values): least words, least distinct words and most capitals in percent, junk.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, JUNK = 200, 50, 3, "[#$%&*|]"
ORDERS = ["".join(x) for x in permutations(FILTERS)]
WEIGHTS = ("all", "good", "toxic")


def flagged(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """doc_id, part, text_hash and the flags a to d (0 or 1), with the number n of equal rows."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    worded = fenced(docs, words=words_of(F.col("t")))
    flag = lambda x: x.cast("int")
    each = worded.select(
        "doc_id",
        "part",
        F.unhex(F.sha2("t", 256)).alias("text_hash"),
        flag(F.size("words") < LEAST_WORDS).alias("a"),
        flag(100 * F.size(F.array_distinct("words")).cast("long") < DISTINCT_PERCENT * F.size("words").cast("long")).alias("b"),
        flag(100 * F.regexp_count("t", F.lit("[A-Z]")).cast("long") > CAPITAL_PERCENT * F.length("t").cast("long")).alias("c"),
        flag(F.col("t").rlike(JUNK)).alias("d"),
    )
    return each.groupBy("doc_id", "part", "text_hash", "a", "b", "c", "d").agg(F.count("*").alias("n"))


def with_copies(flags: DataFrame) -> DataFrame:
    """``flags`` with e: whether the row's text is that of a smaller doc_id."""
    least = flags.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(1)).hint("merge")
    joined = flags.join(least, ["text_hash", "doc_id"], "left")
    return joined.withColumn("e", (F.col("first").isNull() & F.col("doc_id").isNotNull()).cast("int")).drop("first")


def joint_failures(flags: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """part, and for each weight an array of 32 numbers: how many documents fail all filters of the set."""
    said = lambda c: F.max((F.col(c) == 1).cast("int")).alias(c)
    known = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(said("quality"), said("toxic")).hint("merge")
    rows = flags.join(known, "doc_id", "left")
    product = lambda t: reduce(Column.__mul__, [F.col(f.lower()) for i, f in enumerate(FILTERS) if t >> i & 1], F.lit(1).cast("long"))
    weighted = rows.select("part", *[product(t).alias(f"p{t}") for t in SETS], F.col("n").alias("all"), *[(F.col("n") * F.coalesce(c, F.lit(0))).alias(w) for w, c in (("good", "quality"), ("toxic", "toxic"))])
    sums = weighted.groupBy("part").agg(*[F.sum(F.col(f"p{t}") * F.col(w)).alias(f"{w}{t}") for w in WEIGHTS for t in SETS])
    return sums.select("part", *[F.array(*[f"{w}{t}" for t in SETS]).alias(w) for w in WEIGHTS])


def _signed(joint: str, t: Column, size: Column) -> Column:
    return F.when(size % 2 == 0, F.get(joint, t)).otherwise(-F.get(joint, t))


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0).cast("long"), lambda s, x: s + x)


def _sets() -> Column:
    return F.sequence(F.lit(0), F.lit(len(SETS) - 1))


def survivors(joint: str) -> Column:
    """For each set Q, how many documents pass all filters of Q."""
    inside = lambda q: F.filter(_sets(), lambda t: t.bitwiseAND(q) == t)
    return F.transform(_sets(), lambda q: _sum(F.transform(inside(q), lambda t: _signed(joint, t, F.bit_count(t)))))


def exactly(joint: str) -> Column:
    """For each set S, how many documents fail the filters of S and no other."""
    around = lambda s: F.filter(_sets(), lambda t: t.bitwiseAND(s) == s)
    return F.transform(_sets(), lambda s: _sum(F.transform(around(s), lambda t: _signed(joint, t, F.bit_count(t) - F.bit_count(s)))))


def shapley(joint: str) -> Column:
    """For each filter its Shapley value times the number of orders, from the Harsanyi dividends."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(len(FILTERS) - 1)), lambda i: F.call_function("shiftleft", F.lit(1), i))
    dividend = lambda t: _signed(joint, t, F.bit_count(t) + 1) * F.floor(F.lit(len(ORDERS)) / F.bit_count(t))
    return F.transform(bits, lambda b: _sum(F.transform(F.filter(_sets(), lambda t: t.bitwiseAND(b) == b), dividend)))


def steps(joint: DataFrame) -> DataFrame:
    """A row for each part, order and step, from the joint failures."""
    inverted = joint.select("part", F.col("all").alias("fails"), *[survivors(w).alias(f"kept_{w}") for w in WEIGHTS], exactly("all").alias("exact"), shapley("all").alias("shapley"))
    ordered = inverted.select("*", F.explode(F.split(F.lit(" ".join(ORDERS)), " ")).alias("filter_order"))
    bits = F.transform(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda i: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), F.substring("filter_order", i, 1)) - 1))
    each = ordered.withColumn("bits", bits).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    own = each.withColumn("bit", F.get("bits", F.col("step") - 1)).withColumn("before", F.aggregate(F.slice("bits", 1, F.col("step") - 1), F.lit(0), lambda s, b: s + b))
    lost = lambda w: F.get(f"kept_{w}", "before") - F.get(f"kept_{w}", F.col("before") + F.col("bit"))
    return own.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        F.get("kept_all", F.col("before") + F.col("bit")).alias("kept"),
        lost("all").alias("removed"),
        (F.get("fails", "bit") - lost("all")).alias("redundant"),
        F.get("exact", "bit").alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shapley", F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1).alias("shapley"),
    )


def audit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """What each filter does at each step of each order, for each part."""
    flags = written(flagged(documents, doc_id, text, part), "flags")
    return steps(written(joint_failures(with_copies(flags), labels, doc_id), "joint-failures"))


#: The same by applying the filters to each document, in DuckDB SQL.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
least AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT w.doc_id, w.part, coalesce(lab.good, 0) AS good, coalesce(lab.toxic, 0) AS toxic,
    (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 3 * length(w.text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN least.first < w.doc_id THEN 'E' ELSE '' END) AS fails
  FROM w JOIN least ON w.text = least.text LEFT JOIN lab ON w.doc_id = lab.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, i::INT AS step, filter_order[i:i] AS own, filter_order[:i-1] AS before FROM o, range(1, 6) r(i)),
m AS (SELECT part, filter_order, step, own, fails, n, good, toxic, contains(fails, own) AS hit,
  len(regexp_replace(fails, '[^' || before || 'x]', '', 'g')) > 0 AS gone FROM g, s),
r AS (SELECT part, filter_order, step, any_value(own) AS own,
  coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM m GROUP BY part, filter_order, step),
h AS (SELECT part, own, sum(removed)::BIGINT AS shapley FROM r GROUP BY part, own)
SELECT r.part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM r JOIN h ON r.part = h.part AND r.own = h.own
"""
