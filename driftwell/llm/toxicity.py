"""Toxicity (operator 1): a convolutional text classifier, trained and run in numpy.

A word's vector is the mean of the embeddings of its hash and of the hashes of its first letters. Filters
over one, two and three neighbouring words give values at each position; the largest of each filter over
the whole text goes into a logistic layer. It is trained with Adam on at most MAX_TRAIN labelled texts of
each class, of at most MAX_TRAIN_CHARS characters and MAX_TRAIN_WORDS words, whose held-out flag is false and whose hash is of the first
fold; hashes seen in fewer than MIN_TEXTS of these count as unknown. The texts of the other fold calibrate
the scores (two numbers) and give each language the threshold with the best F1 among its own rows. A score
never depends on the language; only the verdict ``toxic`` does.

Texts are scored whole, in blocks of words whose largest values are combined. Null and empty texts have no
words and get the score of a text in which nothing was found. Rows without labels are only scored; with no
labels of both kinds every score is 0. Equal rows give equal rows; extra columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, written

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 16, (1, 2, 3)
SLOTS = sum(WIDTHS)
PREFIXES = (3, 4, 5, 6)
MAX_TRAIN, MAX_TRAIN_WORDS, MIN_TEXTS = 3000, 2000, 4
#: Longer texts are not looked at for training; the words of those left are counted.
MAX_TRAIN_CHARS = 12 * MAX_TRAIN_WORDS
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.01, 1e-4
#: Smoothing of the first log-odds, share of words left out, and what slows the embeddings' first steps.
PRIOR, DROPPED, SLOW = 40.0, 0.5, 1e-3
#: Words that are scored at once.
BLOCK = 100_000
BINS = 200
DEFAULT_THRESHOLD = 0.7


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def hashed(distinct: list[bytes]) -> np.ndarray:
    """The buckets of each word and of its prefixes; bucket 0 is unknown."""
    columns = [distinct] + [[w.strip(b".,;:!?\"'()")[:k] for w in distinct] for k in PREFIXES]
    out = [pd.util.hash_array(np.array(c, dtype=object), categorize=False) % np.uint64(BUCKETS - 1) + np.uint64(1) if c else np.empty(0, np.uint64) for c in columns]
    salt = np.arange(len(columns), dtype=np.uint64) * np.uint64(7919)
    return ((np.stack(out, 1) + salt) % np.uint64(BUCKETS - 1) + np.uint64(1)).astype(np.int32)


def numbered(texts: list[list[bytes]]) -> tuple[list[bytes], list[np.ndarray]]:
    """The distinct words, and each text as their numbers."""
    index: dict[bytes, int] = {}
    ids = [np.fromiter((index.setdefault(w, len(index)) for w in t), np.int32, len(t)) for t in texts]
    return list(index), ids


@dataclass
class Net:
    seen: np.ndarray  # which buckets are known
    embed: np.ndarray
    filters: np.ndarray  # slots x dim x filters
    bias: np.ndarray
    out: np.ndarray

    def vectors(self, buckets: np.ndarray) -> np.ndarray:
        return self.embed[np.where(self.seen[buckets], buckets, 0)].mean(1)

    def values(self, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The filters' values at each position; positions beyond the end count as zero vectors."""
        parts, slot = [], 0
        padded = np.concatenate([ids, np.full(max(WIDTHS), len(vectors), np.int32)])
        whole = np.concatenate([vectors, np.zeros((1, DIM), np.float32)])
        for width in WIDTHS:
            total = 0
            for k in range(width):
                total = total + (whole @ self.filters[slot])[padded[k : k + len(ids)]]
                slot += 1
            parts.append(total)
        return np.concatenate(parts, 1) + self.bias

    def pooled(self, texts: list[list[bytes]]) -> np.ndarray:
        """The largest values of each text, not below zero."""
        out = np.zeros((len(texts), len(self.bias)), np.float32)
        block: list[tuple[int, list[bytes]]] = []
        n = 0
        for i, t in enumerate(texts):
            for k in range(0, len(t), BLOCK):
                block.append((i, t[k : k + BLOCK + max(WIDTHS) - 1]))
                n += len(block[-1][1])
                if n >= BLOCK:
                    self._pool(block, out)
                    block, n = [], 0
        self._pool(block, out)
        return out

    def _pool(self, block: list[tuple[int, list[bytes]]], out: np.ndarray) -> None:
        if block:
            distinct, ids = numbered([t for _, t in block])
            gap = np.full(max(WIDTHS), len(distinct), np.int32)  # so that no filter spans two texts
            starts = np.cumsum([0] + [len(x) + len(gap) for x in ids[:-1]])
            joined = np.concatenate([x for pair in zip(ids, [gap] * len(ids), strict=True) for x in pair])
            vectors = np.concatenate([self.vectors(hashed(distinct)), np.zeros((1, DIM), np.float32)])
            most = np.maximum.reduceat(self.values(vectors, joined), starts, 0)
            np.maximum.at(out, [i for i, _ in block], most)

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.out[:-1] + self.out[-1]


def apart(texts: list[list[bytes]]) -> list[int]:
    """The texts without near copies of earlier ones, which would make their rare words look common: of
    four least hashes of neighbouring words, at most one may be that of an earlier text."""
    kept, seen = [], [set(), set(), set(), set()]
    mul = np.random.default_rng(2).integers(0, 2**63, 4, np.uint64) | np.uint64(1)
    for i, t in enumerate(texts):
        if t:
            with np.errstate(over="ignore"):
                h = pd.util.hash_array(np.array(t, dtype=object), categorize=False)
                h = h[:-1] * np.uint64(31) + h[1:] if len(h) > 1 else h
                least = [int((h * m).min()) for m in mul]
            if sum(x in s for x, s in zip(least, seen, strict=True)) < 2:
                kept.append(i)
            for x, s in zip(least, seen, strict=True):
                s.add(x)
    return kept


def train(texts: list[list[bytes]], labels: np.ndarray) -> Net:
    """Adam on the logistic loss; only the positions that win a pool get a gradient. The first number of
    an embedding starts as the log-odds of its bucket, smoothed by PRIOR texts, the others near zero. In
    each batch a share DROPPED of the distinct words is left out, so that no single word decides."""
    rng = np.random.default_rng(1)
    keep = apart(texts)
    texts, labels = [texts[k] for k in keep], labels[keep]
    distinct, ids = numbered(texts)
    buckets = hashed(distinct)
    counts, ones = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for x, y in zip(ids, labels.tolist(), strict=True):
        here = np.unique(buckets[np.unique(x)])
        counts[here] += 1
        ones[here] += y
    rate = labels.mean()
    odds = np.log((ones + PRIOR * rate) / (counts - ones + PRIOR * (1 - rate))) - np.log(rate / (1 - rate))
    net = Net(
        counts >= MIN_TEXTS,
        rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32),
        rng.normal(0, 0.3, (SLOTS, DIM, FILTERS)).astype(np.float32),
        np.zeros(FILTERS * len(WIDTHS), np.float32),
        np.concatenate([rng.normal(0, 0.3, FILTERS * len(WIDTHS)), [0.0]]).astype(np.float32),
    )
    net.embed[:, 0] = odds
    net.embed[0] = 0
    params = {"filters": net.filters, "bias": net.bias, "out": net.out}
    first, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    squares = np.full(BUCKETS, SLOW, np.float32)
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(ids))
        for at in range(0, len(order), BATCH):
            some = [k for k in order[at : at + BATCH] if len(ids[k])]
            if not some:
                continue
            words_here, back = np.unique(np.concatenate([ids[k] for k in some]), return_inverse=True)
            drop = rng.random(len(words_here)) < DROPPED
            vectors = net.vectors(buckets[words_here]) * ~drop[:, None]
            cuts = np.cumsum([len(ids[k]) for k in some])
            local = np.split(back.astype(np.int32), cuts[:-1])
            pooled = np.zeros((len(some), len(net.bias)), np.float32)
            where = np.zeros((len(some), len(net.bias)), np.int64)
            for j, x in enumerate(local):
                v = net.values(vectors, x)
                where[j] = v.argmax(0)
                pooled[j] = v[where[j], np.arange(v.shape[1])]
            alive = pooled > 0
            pooled *= alive
            error = (1 / (1 + np.exp(-np.clip(net.logit(pooled), -30, 30))) - labels[some]) * weight[some] / len(some)
            grads = {"out": np.concatenate([pooled.T @ error, [error.sum()]]), "filters": np.zeros_like(net.filters)}
            g = error[:, None] * net.out[None, :-1] * alive
            grads["bias"] = g.sum(0)
            padded = np.concatenate([vectors, np.zeros((1, DIM), np.float32)])
            dvec = np.zeros_like(padded)
            slot = 0
            for w, width in enumerate(WIDTHS):
                cols = slice(w * FILTERS, (w + 1) * FILTERS)
                for k in range(width):
                    spot = np.stack([np.concatenate([x, np.full(width, len(vectors), np.int32)])[where[j, cols] + k] for j, x in enumerate(local)])
                    grads["filters"][slot] = np.einsum("jfd,jf->df", padded[spot], g[:, cols])
                    np.add.at(dvec, spot.ravel(), (g[:, cols, None] * net.filters[slot].T[None]).reshape(-1, DIM))
                    slot += 1
            step += 1
            for k, p in params.items():
                grad = grads[k].astype(np.float32) + DECAY * p
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                p -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            moved = np.nonzero(~drop & (np.abs(dvec[:-1]).sum(1) > 0))[0]
            b = buckets[words_here[moved]]
            b = np.where(net.seen[b], b, 0)
            d = np.repeat(dvec[moved] / b.shape[1], b.shape[1], 0)
            np.add.at(squares, b.ravel(), (d**2).mean(1))
            np.add.at(net.embed, b.ravel(), -RATE * d / np.sqrt(squares[b.ravel()])[:, None])
            net.embed[0] = 0
    return net


def platt(logits: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic fit to counts at ``logits``, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        g = np.array([((n * p - ones) * logits).sum() + 1e-3 * (a - 1), (n * p - ones).sum()])
        w = n * p * (1 - p)
        h = np.array([[(w * logits**2).sum() + 1e-3, (w * logits).sum()], [(w * logits).sum(), w.sum() + 1e-3]])
        d = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(a - d[0], 1e-3), b - d[1]
    return float(a), float(b)


def _fold() -> Column:
    """Of a labelled row: 0 to train, 2 to calibrate, 1 held out."""
    return F.crc32(F.col("doc_id").cast("string")) % 3


def _logits(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, lang and the logit of each text, which is scored whole."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[["doc_id", "lang"]].assign(logit=net.logit(net.pooled([words(t) for t in frame["text"]])).astype(float))

    kinds = dict(docs.dtypes)
    return docs.mapInPandas(run, f"doc_id {kinds['doc_id']}, lang {kinds['lang']}, logit double")


def fit(docs: DataFrame, marks: DataFrame) -> Net | None:
    """Train on a bounded sample of each class: ids are drawn by hash among the labels of the first fold,
    and their texts are looked up, so no other text leaves its place."""
    sample = []
    for y in (0, 1):
        drawn = marks.where((_fold() == 0) & (F.col("y") == y)).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
        texts = docs.where(F.length("text") <= MAX_TRAIN_CHARS).join(F.broadcast(drawn), "doc_id", "left_semi")  # at most MAX_TRAIN ids
        rows = texts.groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id").select("text").collect()  # of a repeated id the first text
        sample += [(t, y) for t in (words(r["text"]) for r in rows) if len(t) <= MAX_TRAIN_WORDS]
    if len({y for _, y in sample}) < 2:
        return None
    return train([t for t, _ in sample], np.array([y for _, y in sample]))


def calibrated(rows: DataFrame) -> tuple[float, float]:
    """Slope and offset from the labelled logits of the other fold, by the counts of their bins."""
    at = F.least(F.greatest(F.round(F.col("logit") * 5), F.lit(-BINS)), F.lit(BINS))
    bins = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("ones")).orderBy("bin").collect()  # at most 2 * BINS + 1 rows
    if not bins:
        return 1.0, 0.0
    return platt(np.array([r["bin"] / 5 for r in bins]), np.array([r["ones"] for r in bins]), np.array([r["n"] for r in bins]))


def thresholds(rows: DataFrame) -> DataFrame:
    """(lang, threshold): of each language the bin edge with the best F1 over its calibration rows."""
    bins = rows.groupBy("lang", F.floor(F.col("score") * BINS).alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
    down = Window.partitionBy("lang").orderBy(F.desc("bin"))
    hit, called, total = F.sum("ones").over(down), F.sum("n").over(down), F.sum("ones").over(Window.partitionBy("lang"))
    each = bins.select("lang", "bin", (2 * hit / (called + total)).alias("f1")).where("f1 > 0")
    return each.groupBy("lang").agg((F.max_by("bin", F.struct("f1", "bin")) / BINS).alias("threshold"))


def scores(documents: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang, held_out, score, and toxic: whether the score reaches the language's threshold."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    held = held_out(F.col("doc_id")).alias("held_out")
    net = fit(docs, marks)
    if net is None:
        return docs.select("doc_id", "lang", held, F.lit(0.0).cast("double").alias("score"), F.lit(False).alias("toxic"))
    raw = written(_logits(docs, net), "toxicity")
    known = raw.join(marks.where(_fold() == 2), "doc_id")
    a, b = calibrated(known)
    score = 1 / (1 + F.exp(-F.least(F.greatest(a * F.col("logit") + b, F.lit(-30.0)), F.lit(30.0))))
    limits = thresholds(known.withColumn("score", score)).select(F.col("lang").alias("l"), "threshold")
    joined = raw.withColumn("score", score).join(limits, F.col("lang").eqNullSafe(F.col("l")), "left")
    return joined.select("doc_id", "lang", held, "score", (F.col("score") >= F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD))).alias("toxic"))
