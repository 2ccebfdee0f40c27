"""Substring dedup by paragraphs (operator 9).

Two kinds of paragraph are compared, both of words with A-Z lowered:

- lines of at least MIN_WORDS words. Their shingles are sketched and banded (32 permutations with minimum
  and maximum give 16 bands of four entries: two lines at similarity 0.8 share none with a chance of
  2e-4), colliding lines are joined and confirmed by their exact Jaccard similarity, and the links
  give components;
- pieces of PIECE words that start where the text itself says so: at the least hash of each SPREAD
  successive three-word grams. Every passage of at least PIECE + SPREAD + 2 = 51 words holds such a piece
  whole, wherever it stands and whatever surrounds it. Pieces must be equal (95 bits of hash).

A component counts if it holds paragraphs of different documents. Its first paragraph, by document, text
and position, stays; all others are removals, also in the first document itself, unless they overlap the
first one. Spans of pieces end with the last piece, so up to SPREAD - 1 words at either edge of a passage
inside other text may stay. The spans of a document, in words, are merged where they overlap.

Null, empty and short texts have no paragraphs. Rows with a null id take part in nothing. Repeated rows of
one id are one document. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, free_name, salts, written
from .near_dedup import blocks_of, classes, mixed, word_hashes

MIN_WORDS, PIECE, SPREAD, GRAM = 50, 28, 21, 3
SHINGLE, PERCENT, PERMUTATIONS = 5, 80, 32
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _slid(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least or largest value of each ``width`` successive ones, by doubling."""
    f, now = (np.minimum if least else np.maximum), 1
    while 2 * now <= width:
        x = f(x[:-now], x[now:])
        now *= 2
    return f(x[: len(x) - (width - now)], x[width - now :]) if width > now else x


def pieces(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts (in ``h``) and two hashes of the pieces of many texts, whose words' hashes are joined in
    ``h``; text k has the words from bounds[k] to bounds[k + 1]."""
    n = len(h)
    if n < MIN_WORDS:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    length = np.diff(bounds)[text]
    with np.errstate(over="ignore"):
        g = h[: n - 2] * _MUL + h[1 : n - 1]
        g = mixed(g * _MUL + h[2:])
        low = _slid(g, SPREAD, True)
        span = SPREAD + GRAM - 2  # from the first to the last word that a window of grams touches
        low[text[: n - span] != text[span:]] = 0  # a window counts inside one text only
        pad = np.zeros(SPREAD - 1, np.uint64)
        chosen = _slid(np.concatenate([pad, low, pad]), SPREAD, False) == g  # the least of some window
        start = np.flatnonzero(chosen[: n - PIECE + 1])
        start = start[(text[start] == text[start + PIECE - 1]) & (length[start] >= MIN_WORDS)]
        hashes = []
        for r in (_MUL, np.uint64(0xD6E8FEB86659FD93)):
            up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, r, np.uint64)]), dtype=np.uint64)
            down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(r), -1, 2**64)), np.uint64)]), dtype=np.uint64)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(h * up[:n], dtype=np.uint64)])
            hashes.append(mixed((sums[start + PIECE] - sums[start]) * down[start]))
        return start, hashes[0].view(np.int64), (hashes[1] >> np.uint64(33)).astype(np.int32)


def firsts(text: np.ndarray, start: np.ndarray, u: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of each piece, whether it is the first of its kind in its text or overlaps that one."""
    order = np.lexsort((start, c, u, text))
    keys = np.stack([text[order], u[order], c[order]])
    new = np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]) if len(order) else np.empty(0, bool)
    least = start[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else start
    out = np.empty(len(start), bool)
    out[order] = start[order] - least < PIECE
    return out


def marked(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, h (hash of the text), line_start (words before each line), the pieces (where they start, two
    hashes, whether they are the first of their kind in the text), and the long lines: number and text."""
    docs = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in blocks_of(frame, ["text"]):
                h, starts, offsets, whole = word_hashes(part["text"].tolist())
                feeds = np.flatnonzero(np.frombuffer(whole, np.uint8) == 10)
                before = np.searchsorted(starts, feeds)  # words before each line feed, and so each line's end
                texts, cuts = np.searchsorted(starts, offsets), np.searchsorted(feeds, offsets)
                start, u, c = pieces(h, texts)
                own = np.searchsorted(start, texts)  # of each text, its first piece
                first = firsts(np.repeat(np.arange(len(part)), np.diff(own)), start, u, c)
                rows = []
                for k in range(len(part)):
                    mine, ends = slice(own[k], own[k + 1]), feeds[cuts[k] : cuts[k + 1]]
                    line_start = np.concatenate([[0], before[cuts[k] : cuts[k + 1]] - texts[k]])
                    long = np.flatnonzero(np.diff(line_start) >= MIN_WORDS)
                    begins = np.concatenate([[offsets[k]], ends + 1])
                    rows.append((line_start, start[mine] - texts[k], u[mine], c[mine], first[mine], long, [whole[begins[i] : ends[i]].decode() for i in long]))
                yield pd.concat([part[["doc_id", "h"]], pd.DataFrame(rows, columns=["line_start", "start", "u", "c", "first", "line", "line_text"])], axis=1)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(run, f"doc_id {kind}, h long, line_start array<int>, start array<int>, u array<long>, c array<int>, first array<boolean>, line array<int>, line_text array<string>")


def repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The spans that repeat across documents: doc_id, h, start_word, end_word, first_doc_id (whose copy
    stays), removed."""
    known = written(marked(documents, doc_id, text), "pieces")

    each = known.select("doc_id", "h", F.inline(F.arrays_zip("start", "u", "c", F.col("first").alias("first"))))
    shared = each.groupBy("u", "c").agg(F.min("doc_id").alias("d1"), F.max("doc_id").alias("d2"), salts(["doc_id"])).where("d1 < d2").drop("d2")
    met = written(beside(each, shared, ["u", "c"], ["doc_id"]).withColumn("stays", F.expr("doc_id = d1 AND first")), "shared-pieces")
    span = ["doc_id", "h", F.col("start").alias("s"), (F.col("start") + PIECE).alias("e"), F.col("d1").alias("first_doc_id")]
    # of the first document's texts one keeps its copy
    copies = met.where("stays").withColumn("least", F.min("h").over(Window.partitionBy("u", "c")))
    found = met.where("NOT stays").select(*span, F.lit(True).alias("removed")).unionByName(copies.select(*span, F.expr("h <> least").alias("removed")))

    # texts are compared as written here: A-Z lowered
    long = known.select("doc_id", "h", F.inline(F.arrays_zip("line", F.col("line_text").alias("text")))).withColumn("id", F.xxhash64("text"))
    grouped = classes(long.select("id", "text"), SHINGLE, PERCENT, "id", "text", PERMUTATIONS, one_text=True)
    of = grouped.select(F.col("doc_id").alias("id"), F.col("component_id").alias("group")).distinct()  # each line has a set
    placed = written(beside(long.select("doc_id", "h", "line", "id"), of, ["id"], ["doc_id", "line"]).drop("id"), "lines")
    several = placed.groupBy("group").agg(F.min(F.struct("doc_id", "h", "line")).alias("first"), F.max("doc_id").alias("d2"), salts(["doc_id", "line"])).where("first.doc_id < d2").drop("d2")
    whole = beside(placed, several, ["group"], ["doc_id", "line"]).select("doc_id", "h", "line", "first")
    where = known.select(F.col("doc_id").alias("d"), F.col("h").alias("x"), "line_start").dropDuplicates(["d", "x"])
    spans = whole.join(where, (F.col("doc_id") == F.col("d")) & (F.col("h") == F.col("x"))).select(
        "doc_id", "h", F.get("line_start", F.col("line")).alias("s"), F.get("line_start", F.col("line") + 1).alias("e"), F.col("first.doc_id").alias("first_doc_id"),
        F.expr("NOT (doc_id = first.doc_id AND h = first.h AND line = first.line)").alias("removed"),
    )

    every = found.unionByName(spans)
    by = Window.partitionBy("doc_id", "h", "removed").orderBy("s", "e")
    fresh = F.coalesce(F.col("s") > F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    runs = every.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "h", "removed", "run").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"), F.min("first_doc_id").alias("first_doc_id")).drop("run")


def cleaned(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents, with the removals cut out of their texts; white space around them stays."""
    d, h, spans = (free_name(documents.columns, n) for n in ("_d", "_h", "_cut"))
    found = repeats(documents, doc_id, text).where("removed").groupBy(F.col("doc_id").alias(d), F.col("h").alias(h)).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(spans))
    joined = documents.join(found, (F.col(doc_id) == F.col(d)) & (F.xxhash64(text) == F.col(h)), "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, cuts in zip(texts, spans, strict=True):
            if cuts is not None and t is not None:
                at = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
                for c in reversed(list(cuts)):
                    s, e = at[c["start_word"]][0], at[c["end_word"] - 1][1]
                    t = t[:s] + t[e:]
            out.append(t)
        return pd.Series(out, dtype=object)

    return joined.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(cut(F.col(text), F.col(spans)))).drop(d, h, spans)
