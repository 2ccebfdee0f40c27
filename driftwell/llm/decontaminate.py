"""Benchmark decontamination by templates (operator 6), in DataFrame functions only.

Texts become two arrays of equal length: their words, and the same words with names, numbers and units
replaced by typed placeholders; a capitalised word is a name wherever it stands, so that a word has one
template in every context. Windows of WINDOW words are hashed, as templates and as plain words, and joined
between documents and benchmark items: a question with other names and numbers matches by its templates, a
copy in other case by its words. Template windows with fewer than LITERALS words beside placeholders say
too little and count as plain words only.

For each document and item that share windows, the aligned words tell how much of the item is covered, and
the words in the placeholders whether values were exchanged consistently: one value of the item always
became the same value of the document, and one value of the document stands for one of the item. Both are
measured for each occurrence of the item in the document. A pair is reported if one occurrence covers at
least COVERED percent of the item's words and CONSISTENT percent of the places where a value stands again
keep to its most frequent partner. In the second direction one place may differ, as two numbers may have
become equal by chance. An item whose values stand once each is consistent. What else the document holds
takes nothing from that. n_windows counts the windows of the whole pair.

Items of fewer than WINDOW words are found where all their words stand in a row, as plain words; so every
item that stands whole in a document is reported, whatever its length. Items without words match nothing;
so do null and empty texts. Repeated rows give one pair. Null ids are ids like others. Extra columns are
not read. Empty tables give an empty result. A text of any length is cut into windows in one row; only
windows that the benchmark has leave it.

The hashes of the benchmark are broadcast if they are at most BROADCAST_ROWS, which is counted; beyond
that the join is a shuffle. A pair of a document and an item is the unit of the result, so a window that
many items share gives a row for each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, fenced, free_name, written

WINDOW, LITERALS = 8, 4
COVERED, CONSISTENT = 50, 50
BROADCAST_ROWS = 1_000_000
PAIR = ("doc_id", "dh", "item_id", "ih")
#: Placeholders, and what ends the word of one while both are in one text; from the private use area, whose four texts are freed of first.
NAME, NUMBER, UNIT, END = "\ue001", "\ue002", "\ue003", "\ue004"
#: Unit words that count after a number (fixed values).
UNITS = (
    "mm cm m km in ft yd mi miles mile kilometers kilometres kilometer meters metres meter inches inch feet foot mg g kg t lb lbs oz grams gram kilograms pounds pound ounces tons "
    "ml l liters litres liter gallons gallon s sec secs seconds second min mins minutes minute h hr hrs hours hour days day weeks week months month years year "
    "kmh mph ms hz khz mhz ghz w kw mw v a b kb mb gb tb dollars dollar cents cent euros euro pounds percent pct degrees degree c f k"
).split()
_BLANK = r"\x20\x09-\x0D"


def marked(text: Column) -> Column:
    """The text with names, numbers and units between their placeholder and END. A number is digits with single marks between
    them; the loop never gives back what it has taken: one that might would make the engine go one level deeper with each digit."""
    names = F.regexp_replace(text, r"\p{Lu}(?<![\p{L}\p{N}]\p{Lu})\p{Ll}++(?![\p{L}\p{N}])", f"{NAME}$0{END}")
    numbers = F.regexp_replace(names, r"\p{N}(?:[.,:]?\p{N})*+", f"{NUMBER}$0{END}")
    # a unit follows the END of a number: that of a name is never followed by its own letters
    units = "|".join(sorted(set(UNITS), key=len, reverse=True))
    return F.regexp_replace(numbers, rf"{END}(?<=\p{{N}}{END})([{_BLANK}]?)((?i:{units}))(?![\p{{L}}\p{{N}}])", f"{END}$1{UNIT}$2{END}")


def _plain(both: Column) -> Column:
    return F.regexp_replace(both, f"[{NAME}-{END}]+", "")


def _template(both: Column) -> Column:
    return F.regexp_replace(both, f"([{NAME}-{UNIT}])[^{END}]*+{END}", "$1")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _with_both(df: DataFrame, text: str) -> DataFrame:
    """``df`` with _both: the marked text without punctuation, in lower case."""
    pure = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"[{NAME}-{END}]+", "")
    return fenced(df, _both=F.lower(F.regexp_replace(marked(pure), rf"[^\p{{L}}\p{{N}}\p{{M}}{NAME}-{END}{_BLANK}]+", "")))


def templated(df: DataFrame, text: str) -> DataFrame:
    """``df`` with raw (words without punctuation, in lower case) and tpl (the same with placeholders)."""
    flat = _with_both(df, text)
    return fenced(flat, raw=_words(_plain(F.col("_both"))), tpl=_words(_template(F.col("_both")))).drop("_both")


def hashed(df: DataFrame, text: str) -> DataFrame:
    """``df`` with hr and ht: the hashes of what ``templated`` calls raw and tpl. The marked text is split once, and a word
    without marks is the same in both; no mark reaches beyond its word."""
    split = fenced(_with_both(df, text), _words=_words(F.col("_both"))).drop("_both")
    of = lambda part: F.transform("_words", lambda w: F.xxhash64(F.when(F.contains(w, F.lit(END)), part(w)).otherwise(w)))
    return fenced(split, hr=of(_plain), ht=of(_template)).drop("_words")


def windows(words: str, width: int = WINDOW) -> Column:
    """The hashes of all windows, in order."""
    last = F.size(words) - width
    each = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<long>"))


def windowed(df: DataFrame, *kept: str) -> DataFrame:
    """A row for each window of WINDOW words, from the hashes of all words in ht and hr: ``kept``, pos, wt and wr. A word is
    hashed once, and the windows are compiled code over two arrays of numbers: no array of windows is made."""
    rows = df.select(*kept, "ht", "hr", F.posexplode("hr").alias("pos", "_h")).where(F.col("pos") <= F.size("hr") - WINDOW)
    window = lambda of: F.xxhash64(*[F.get(of, F.col("pos") + k) for k in range(WINDOW)])
    return rows.select(*kept, "pos", window("ht").alias("wt"), window("hr").alias("wr"))


def _both(tpl: Column, raw: Column) -> Column:
    """The hashes of one window: two, or one where it has no placeholder."""
    return F.explode(F.when(tpl == raw, F.array(raw)).otherwise(F.array(tpl, raw)))


def _few(keys: DataFrame) -> DataFrame:
    """The distinct hashes ``w`` as ``k``, sent to all tasks if they are few."""
    hashes = keys.select(F.col("w").alias("k")).distinct()
    return F.broadcast(hashes) if keys.count() <= BROADCAST_ROWS else hashes.hint("merge")


def _slot(word: Column) -> Column:
    return word.rlike("[\ue001-\ue003]")


def leaks(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The pairs (doc_id, item_id) that count, with n_windows, covered and consistent in percent."""
    items = templated(benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("t")).where("t IS NOT NULL"), "t").drop("t")
    items = written(items.withColumnRenamed("raw", "item_raw").withColumnRenamed("tpl", "item_tpl").distinct(), "items")
    of = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    cut = fenced(items, ih=F.xxhash64("item_raw"), ht=of("item_tpl"), hr=of("item_raw"))
    each = windowed(cut, "item_id", "ih", "item_tpl").withColumnRenamed("pos", "at")
    plain = F.size(F.filter(F.slice("item_tpl", F.col("at") + 1, F.lit(WINDOW)), lambda x: ~_slot(x)))
    strong = F.when(plain >= LITERALS, F.col("wt")).otherwise(F.col("wr"))
    keys = written(each.select("item_id", "ih", "at", strong.alias("wt"), "wr").select("item_id", "ih", "at", _both(F.col("wt"), F.col("wr")).alias("w")), "item-windows")
    hashes = _few(keys)

    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).where("t IS NOT NULL")
    worded = docs.withColumn("dh", F.xxhash64("t"))
    lengths = [r["n"] for r in items.select(F.size("item_raw").alias("n")).where(f"n > 0 AND n < {WINDOW}").distinct().collect()]  # at most WINDOW - 1
    rows = windowed(hashed(worded, "t").drop("t"), "doc_id", "dh")
    rows = rows.select("doc_id", "dh", "pos", _both(F.col("wt"), F.col("wr")).alias("w"))
    hits = written(rows.join(hashes, F.col("w") == F.col("k"), "left_semi"), "hits")
    aligned = hits.join(keys, "w").groupBy("doc_id", "dh", "item_id", "ih").agg(F.collect_set(F.struct("pos", "at")).alias("hits"))

    some = hits.select(F.col("doc_id").alias("d"), F.col("dh").alias("x")).distinct().hint("merge")  # grows with the input: never broadcast
    full = templated(docs.withColumn("dh", F.xxhash64("t")).join(some, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("dh") == F.col("x")), "left_semi").dropDuplicates(["doc_id", "dh"]), "t")
    both = aligned.join(full.select(F.col("doc_id").alias("d"), F.col("dh").alias("x"), "raw"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("dh") == F.col("x")))
    item = items.select(F.col("item_id").alias("i"), F.xxhash64("item_raw").alias("y"), "item_raw", "item_tpl")
    both = both.join(item, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("ih") == F.col("y")))
    # aligned words of each pair; pos - at is the diagonal, and the words of slots are kept
    steps = F.sequence(F.lit(0), F.lit(WINDOW - 1))
    word = lambda h, k: F.struct(
        (h["pos"] - h["at"]).alias("diagonal"),
        (h["at"] + k).alias("at"),
        *[F.when(_slot(F.get("item_tpl", h["at"] + k)), F.get(side, h[place] + k)).alias(name) for side, place, name in (("item_raw", "at", "old"), ("raw", "pos", "new"))],
    )
    made = fenced(  # before the pairs are unrolled: what stands beside a generator is computed for each of its rows
        both,
        n_words=F.size("item_raw"),
        n_windows=F.size("hits").cast("long"),
        n_diagonals=F.size(F.array_distinct(F.transform("hits", lambda h: h["pos"] - h["at"]))),
        pairs=F.flatten(F.transform("hits", lambda h: F.transform(steps, lambda k: word(h, k)))),
    ).select(*PAIR, "n_words", "n_windows", "n_diagonals", "pairs")
    each = made.select(*PAIR, "n_words", "n_windows", "n_diagonals", F.inline("pairs"))
    good = occurrences(each.distinct()).where((F.col("covered") >= COVERED) & (F.col("consistent") >= CONSISTENT))
    good = good.select("doc_id", "item_id", "n_windows", "covered", "consistent")
    for n in sorted(lengths):
        short = items.where(F.size("item_raw") == n).select("item_id", F.get(windows("item_raw", n), 0).alias("w")).distinct()
        own = fenced(templated(worded, "t").drop("t"), ws=windows("raw", n)).select("doc_id", "dh", F.posexplode("ws").alias("pos", "w")).join(_few(short), F.col("w") == F.col("k"), "left_semi")
        found = own.distinct().join(short, "w").groupBy("doc_id", "item_id").agg(F.count("*").alias("n_windows"))
        good = good.unionByName(found.select("*", F.lit(100.0).cast("double").alias("covered"), F.lit(100.0).cast("double").alias("consistent")))
    best = good.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max(F.struct("covered", "consistent")).alias("best"))
    return best.select("doc_id", "item_id", "n_windows", "best.covered", "best.consistent")


def occurrences(aligned: DataFrame) -> DataFrame:
    """covered and consistent of each occurrence of an item in a document. An occurrence is one diagonal;
    where a pair has several, also the diagonals of a band half the item wide (two grids, so that no
    neighbours are always parted), and all together. A word of the item counts once in each, on the
    diagonal closest to the one that holds most of its words."""
    half = F.greatest(F.floor(F.col("n_words") / 2), F.lit(1))
    part = lambda kind, number: F.struct(F.lit(kind).alias("kind"), number.cast("long").alias("number"))
    d = F.col("diagonal")
    bands = F.array(part(0, d), part(1, F.floor(d / half)), part(2, F.floor(d / half + 0.5)), part(3, F.lit(0)))
    each = aligned.select("*", F.explode(F.when(F.col("n_diagonals") == 1, F.array(part(0, d))).otherwise(bands)).alias("part")).drop("n_diagonals")
    by = [*PAIR, "n_words", "n_windows", "part"]
    sized = each.withColumn("n", F.count("*").over(Window.partitionBy(*by, "diagonal")))
    main = -F.max(F.struct("n", (-d).alias("d"))).over(Window.partitionBy(*by))["d"]
    nearest = F.min(F.struct(F.abs(d - F.col("main")).alias("off"), "diagonal", "old", "new"))
    words = sized.withColumn("main", main).groupBy(*by, "at").agg(nearest.alias("w")).select(*by, "w.old", "w.new")
    images = words.groupBy(*by, "old", "new").agg(F.count("*").alias("n"))
    # of each value on either side: how often it stands, and how often with its most frequent partner
    side = F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("old").alias("value")), F.struct(F.lit(1).alias("side"), F.col("new").alias("value"))))
    values = images.select(*by, "n", F.col("old").isNotNull().alias("slot"), side).groupBy(*by, "slot", "side", "value").agg(F.sum("n").alias("n"), F.max("n").alias("same"))
    of = lambda k, x: F.sum(F.when(F.col("slot") & (F.col("side") == k), x).otherwise(0))
    lost = F.col("n") - F.col("same")
    counted = values.groupBy(*by).agg(F.sum(F.when(F.col("side") == 0, F.col("n"))).alias("n"), (of(0, F.col("same") - 1) + of(1, F.col("same") - 1)).alias("held"), of(0, lost).alias("lost0"), of(1, lost).alias("lost1"))
    whole = counted.withColumn("lost", F.col("lost0") + F.greatest(F.col("lost1") - 1, F.lit(0)))
    consistent = F.when(F.col("lost") == 0, 100.0).otherwise(100 * F.col("held") / (F.col("held") + F.col("lost")))
    return whole.select(*PAIR, "n_windows", (100 * F.col("n") / F.col("n_words")).alias("covered"), consistent.alias("consistent"))


def filtered(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without a leak, with their own columns."""
    mine = free_name(documents.columns, "_mine")
    bad = leaks(documents, benchmark, doc_id, text).select(F.col("doc_id").alias(mine)).distinct().hint("merge")
    return documents.join(bad, F.col(doc_id).eqNullSafe(F.col(mine)), "left_anti")
