"""Secret scans (operator 7), in DataFrame functions only.

Three plain patterns give the base spans. Beside them, every long token is compared under two character
Markov models, one of random strings and one of ordinary identifiers: the log-likelihood ratio of its
bigrams decides. Where a token as a whole is ordinary, so are not all of its parts: each stretch of
successive parts between separators whose mean ratio reaches the limit counts by itself. What of a random
span lies in a base span is left out, and the rest of it stays. Both models are bigram tables over ASCII, counted from labelled samples with Spark; the
table of log ratios (one number for each pair of characters) is a constant of the plan.

Positions count code points. Null texts count as empty; a text without findings gives a row with zeros
and an empty list. Of kinds that start at one place, the one listed first comes first. Equal rows give
equal rows, null ids are ids like others, and an empty table gives an empty result. A text of any length is
searched in one row. Extra columns are not read, and ``redacted`` keeps them whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fenced, free_name, written

#: The base patterns by kind (fixed values), in the order in which kinds are listed.
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"(AKIA)([A-Z0-9]+)",
    "hex": r"()([0-9a-f]{24,})",
}
#: Least length of group 2; that of access is 20 with its first four characters.
LEAST = {"assign": 6, "access": 16, "hex": 24}
KINDS = (*PATTERNS, "random")
#: Tokens that the models compare.
TOKEN = r"()([A-Za-z0-9+/_-]{20,})"
ASCII = 128
#: Pseudo-count of each bigram, and the mean log ratio of a bigram from which a token counts as random.
SMOOTH, LIMIT = 0.5, 1.0
#: Inside a token, parts end at separators; a part so far below the limit in sum is ordinary text and ends
#: a stretch, and a stretch has at least so many characters.
SEPARATOR, ORDINARY, LEAST_STRETCH = "[/_-]", -4.0, 20
#: Labelled samples: how many random strings are drawn, and the most texts that give ordinary words.
N_RANDOM, N_ORDINARY = 4000, 2000
#: Ordinary words of programs, from which identifiers are joined (fixed values).
WORDS = (
    "account active address array async base batch buffer build cache call check child class client close code column config connect content context count create current data date default delete "
    "device document element error event field file filter format frame function global handle header height helper image index input insert item label layout length level line list load local "
    "manager map message method model module name network node number object option order output page parent path point policy print process property query range record remove request result "
    "return root row schema search section select server service session source stack start state status step stream string style system table target task test text thread time title total type "
    "update user value version view width window worker write"
).split()


def labelled_samples(spark: SparkSession, prose: DataFrame, text: str = "text") -> DataFrame:
    """Samples (text, random): digests written in three alphabets; identifiers in three styles, and
    words of at most N_ORDINARY texts of ``prose``."""
    seed = F.sha2(F.col("id").cast("string"), 256)
    raw = F.unhex(seed)
    drawn = spark.range(N_RANDOM).select(
        F.explode(F.array(seed, F.regexp_replace(F.base64(raw), "=", ""), F.substring(F.upper(F.translate(F.base64(raw), "+/=", "")), 1, 20))).alias("text"), F.lit(True).alias("random")
    )
    words = F.split(F.lit(" ".join(WORDS)), " ")
    pick = lambda k: F.get(words, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))).cast("int"))
    three = [pick(k) for k in range(3)]
    joined = F.array(F.concat_ws("_", *three), F.concat(three[0], F.initcap(three[1]), F.initcap(three[2])), F.concat_ws("-", *three), F.upper(F.concat_ws("_", *three)), F.concat_ws("/", *three))
    identifiers = spark.range(N_RANDOM).select(F.explode(joined).alias("text"), F.lit(False).alias("random"))
    some = prose.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).orderBy(F.xxhash64("text")).limit(N_ORDINARY)
    ordinary = some.select(F.explode(F.split("text", r"[^A-Za-z0-9+/_-]+")).alias("text"), F.lit(False).alias("random")).where(F.length("text") > 1)
    return drawn.unionByName(identifiers).unionByName(ordinary)


def train(samples: DataFrame, text: str = "text", random: str = "random") -> list[float]:
    """The log ratio of each bigram, at 128 * first + second. There are 16,384 at any input size."""
    s = samples.select(F.col(text).alias("t"), F.col(random).alias("r")).where(F.length("t") > 1)
    pairs = s.select("r", F.explode(F.sequence(F.lit(1), F.length("t") - 1)).alias("i"), "t").select("r", F.expr("ascii(substring(t, i, 1))").alias("a"), F.expr("ascii(substring(t, i + 1, 1))").alias("b"))
    counted = pairs.where(f"a < {ASCII} AND b < {ASCII}").groupBy("r", "a", "b").count().collect()  # at most 2 * 128 * 128 rows
    n = {True: {}, False: {}}
    total = {True: {}, False: {}}
    for row in counted:
        n[row["r"]][row["a"], row["b"]] = row["count"]
        total[row["r"]][row["a"]] = total[row["r"]].get(row["a"], 0) + row["count"]

    def log(kind: bool, a: int, b: int) -> float:
        return math.log((n[kind].get((a, b), 0) + SMOOTH) / (total[kind].get(a, 0) + SMOOTH * 64))

    return [round(log(True, a, b) - log(False, a, b), 4) for a in range(ASCII) for b in range(ASCII)]


def ratio(token: Column, model: list[float]) -> Column:
    """The mean log-likelihood ratio of a token's bigrams."""
    table = F.split(F.lit(" ".join(map(str, model))), " ").cast("array<double>")
    codes = F.transform(F.split(token, ""), F.ascii)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).cast("double").alias("sum"))
    step = lambda acc, c: F.struct(
        c.alias("last"), (acc["sum"] + F.when((acc["last"] < 0) | (c >= ASCII), 0.0).otherwise(F.coalesce(F.get(table, F.greatest(acc["last"], F.lit(0)) * ASCII + c), F.lit(0.0)))).alias("sum")
    )
    return F.aggregate(codes, start, step, lambda acc: acc["sum"] / F.greatest(F.length(token) - 1, F.lit(1)))


def stretches(token: Column, model: list[float], limit: float) -> Column:
    """The spans (start, end) of a token that count as random: all of it, or stretches of its parts."""
    core = lambda p: F.regexp_replace(p, SEPARATOR + "$", "")
    over = lambda v: (ratio(v, model) - limit) * F.greatest(F.length(v) - 1, F.lit(0))
    parts = F.transform(F.split(token, f"(?<={SEPARATOR})", -1), lambda p: F.struct(F.length(p).alias("n"), F.length(core(p)).alias("core"), over(core(p)).alias("over")))
    state = lambda at, start, end, total, out: F.struct(at.alias("at"), start.alias("start"), end.alias("end"), total.alias("total"), out.alias("out"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def closed(acc: Column) -> Column:
        good = (acc["end"] - acc["start"] >= LEAST_STRETCH) & (acc["total"] >= 0)
        return F.when(good, F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["out"])

    def step(acc: Column, p: Column) -> Column:
        at, ends = acc["at"] + p["n"], (p["over"] < ORDINARY) | (acc["total"] + p["over"] < 0)
        return F.when(ends, state(at, at, at, F.lit(0.0), closed(acc))).otherwise(state(at, acc["start"], acc["at"] + p["core"], acc["total"] + p["over"], acc["out"]))

    zero = F.lit(0).cast("int")
    inside = F.aggregate(parts, state(zero, zero, zero, F.lit(0.0), none), step, closed)
    return F.when(ratio(token, model) >= limit, F.array(F.struct(zero.alias("start"), F.length(token).alias("end")))).otherwise(inside)


def _found(text: str, pattern: str) -> Column:
    """All matches, their group 2, and the gaps between them, which splitting at the matches gives."""
    whole, second = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    parts = F.struct(whole.alias("whole"), second.alias("value"), F.split(text, pattern, -1).alias("gap"))
    return F.when(F.col(text).rlike(pattern), parts)


def scan(documents: DataFrame, model: list[float], doc_id: str = "doc_id", text: str = "text", limit: float = LIMIT) -> DataFrame:
    """One row for each document: row (a number of its own), doc_id, and found: array of (start, kind,
    end), in order of start and kind; kind counts from 0 as in KINDS."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = {k: _found("text", p) for k, p in {**PATTERNS, "random": TOKEN}.items()}
    split = fenced(docs, **{f"m_{k}": p for k, p in parts.items()}).drop("text")

    def matches(kind: str) -> Column:
        """Each match as the gap before it, its length, and whether it counts."""
        m = F.col(f"m_{kind}")
        part = lambda gap, n, good: F.struct(gap.alias("gap"), n.alias("n"), good.alias("good"))
        if kind != "random":
            return F.transform(m["whole"], lambda w, i: part(F.length(F.get(m["gap"], i)), F.length(w), F.length(F.get(m["value"], i)) >= LEAST[kind]))
        spans = F.transform(m["value"], lambda v: F.struct(F.length(v).alias("n"), stretches(v, model, limit).alias("at")))

        def pieces(token: Column, i: Column) -> Column:
            """The stretches of a token, and what stands behind the last one."""
            gap, at = F.length(F.get(m["gap"], i)), token["at"]
            own = F.transform(at, lambda s, k: part(s["start"] - F.when(k == 0, -gap).otherwise(F.get(at, k - 1)["end"]), s["end"] - s["start"], F.lit(True)))
            rest = F.when(F.size(at) == 0, part(gap, token["n"], F.lit(False))).otherwise(part(token["n"] - F.element_at(at, -1)["end"], F.lit(0), F.lit(False)))
            return F.concat(own, F.array(rest))

        return F.flatten(F.transform(spans, pieces))

    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.coalesce(matches(k), F.array().cast("array<struct<gap:int,n:int,good:boolean>>")).alias("m")) for i, k in enumerate(KINDS)])
    kept = written(split.select("doc_id", F.filter(kinds, lambda k: F.exists(k["m"], lambda x: x["good"])).alias("kinds")).withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = kept.select("row", F.explode("kinds").alias("k")).select("row", F.col("k.kind").alias("kind"), F.posexplode("k.m").alias("i", "m"))
    upto = Window.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("m.gap").cast("long") + F.col("m.n")).over(upto)
    spans = each.select("row", "kind", end.alias("end"), F.col("m.n").alias("n"), "m.good").where("good").select("row", (F.col("end") - F.col("n")).alias("start"), "kind", "end")
    base = F.col("kind") < len(PATTERNS)
    # of random spans, what no base span covers: a sweep over all starts and ends
    edges = F.array(*[F.struct(F.col(at).alias("at"), F.when(base, n).otherwise(0).alias("b"), F.when(base, 0).otherwise(n).alias("r")) for at, n in (("start", 1), ("end", -1))])
    swept = spans.select("row", F.inline(edges)).groupBy("row", "at").agg(F.sum("b").alias("b"), F.sum("r").alias("r"))
    by = Window.partitionBy("row").orderBy("at")
    covered = swept.select("row", F.col("at").alias("start"), F.lead("at").over(by).alias("end"), F.sum("b").over(by).alias("b"), F.sum("r").over(by).alias("r"))
    outside = covered.where("r > 0 AND b = 0").select("row", "start", F.lit(len(PATTERNS)).alias("kind"), "end")
    apart = spans.where(base).unionByName(outside)
    lists = apart.groupBy(F.col("row").alias("r")).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    joined = kept.select("row", "doc_id").join(lists, F.col("row") == F.col("r"), "left")
    return joined.select("row", "doc_id", F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("found"))


def digests(scanned: DataFrame) -> DataFrame:
    """The counts of the base kinds, the hash of the base spans, and all spans."""
    name = lambda s: F.get(F.array(*map(F.lit, KINDS)), s["kind"])
    said = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
    found = F.col("found")
    count = lambda k: F.size(F.filter(found, lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(PATTERNS)],
        F.sha2(said(F.filter(found, lambda s: s["kind"] < len(PATTERNS))), 256).alias("base_sha256"),
        said(found).alias("spans"),
    )


def redacted(documents: DataFrame, model: list[float], doc_id: str = "doc_id", text: str = "text", mark: str = "<secret>") -> DataFrame:
    """All documents, with ``mark`` in the place of each finding in their texts. Overlapping findings
    are replaced together."""
    key, other, spans = (free_name(documents.columns, n) for n in ("_key", "_other", "_found"))
    keyed = documents.withColumn(key, F.struct(F.col(doc_id), F.xxhash64(F.col(text))))
    found = scan(keyed, model, key, text).where(F.size("found") > 0).select(F.col("doc_id").alias(other), F.col("found").alias(spans)).dropDuplicates([other]).hint("merge")
    joined = keyed.join(found, F.col(key).eqNullSafe(F.col(other)), "left")
    # pieces between findings, each starting where all earlier findings have ended
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.array(F.substr(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(F.col(spans), start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(F.col(text), acc["at"] + 1)))
    return joined.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(whole)).drop(key, other, spans)
