"""Quality classifier (operator 8): ridge regression on random Fourier features of document statistics.

The statistics of every text are computed once and written. Standardised and clipped, they go through
FEATURES cosines with fixed random weights, whose inner products approximate a Gaussian kernel. Each
partition sums its normal equations; Spark adds the sums; the solution is of fixed size. Scores are then
made probabilities by isotonic regression over BINS bins of rows that the ridge did not see. A small share
of the uncalibrated score is mixed in, so that equal probabilities keep their order.

Labels are used of rows whose held-out flag is false: half of them (by the same hash) for the ridge, half
for the calibration. Null and empty texts have statistics of zero and get a score as all others. Rows
without labels, or with null labels, are only scored. With no labels at all every score is 0.5. Equal rows
give equal rows; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, written

FEATURES, WIDTH, RIDGE, BINS, CLIP = 256, 4.0, 1e-3, 1000, 4.0
MIXED = 0.01
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]
N_STATS = 17


def stats(text: str | None) -> list[float]:
    raw = (text or "").encode()
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(len(raw), 1)
    w = raw.split()
    m = max(len(w), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(len(lines), 1)
    upper, lower = hist[65:91].sum(), hist[97:123].sum()
    top = max(Counter(w).values()) if w else 0
    return [
        np.log1p(len(w)),
        np.log1p(len(raw) / m),
        len(set(w)) / m,
        sum(map(bytes.__eq__, w, w[1:])) / m,
        len(set(zip(w, w[1:], strict=False))) / m,
        top / m,
        upper / max(upper + lower, 1),
        hist[48:58].sum() / n,
        hist[_SYMBOLS].sum() / m,
        hist[33] / m,
        (hist[46] + hist[44]) / m,
        hist[128:].sum() / n,
        np.log1p(k),
        1 - len(set(lines)) / k,
        np.log1p(len(w) / k),
        (hist[58:65].sum() + hist[34:48].sum() + hist[91:97].sum()) / n,
        np.log1p(max(map(len, w), default=0)),
    ]


def measured(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "x": [stats(t) for t in frame["text"]]})

    return docs.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


@dataclass
class Model:
    mean: np.ndarray
    std: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(8)
        w, b = rng.normal(0, 1 / WIDTH, (N_STATS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.std, -CLIP, CLIP)
        return np.concatenate([np.cos(z @ w + b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))], 1)

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.beta, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.ridge(x)
        return (1 - MIXED) * np.interp(raw, self.knots, self.values) + MIXED * (raw + 0.5) / 2


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.array(frame["x"].tolist(), float).reshape(-1, N_STATS)


def isotonic(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The non-decreasing rates of bins in order (pool adjacent violators)."""
    pools: list[list[float]] = []
    for c, s in zip(n.tolist(), ones.tolist(), strict=True):
        pools.append([c, s, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            c, s, k = pools.pop()
            pools[-1] = [pools[-1][0] + c, pools[-1][1] + s, pools[-1][2] + k]
    return np.concatenate([np.full(k, s / c) for c, s, k in pools])


def fit(known: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id") -> Model | None:
    """``known`` has doc_id and x. What reaches the driver is of fixed size: moments, the summed normal
    equations, and the counts of the bins."""
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    rows = known.join(marks.where(~held_out(F.col("doc_id"))), "doc_id").withColumn("fold", F.crc32(F.col("doc_id").cast("string")) % 3)
    moments = rows.where("fold = 0").agg(F.count("*").alias("n"), *[f(F.get("x", i)).alias(f"{k}{i}") for i in range(N_STATS) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not moments["n"]:
        return None
    std = np.array([moments[f"s{i}"] for i in range(N_STATS)])
    model = Model(np.array([moments[f"m{i}"] for i in range(N_STATS)]), np.where(std > 1e-9, std, 1.0), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))

    def equations(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for frame in frames:
            z = model.features(_matrix(frame))
            total += z.T @ np.concatenate([z, frame["y"].to_numpy()[:, None]], 1)
        yield pd.DataFrame({"i": range(FEATURES + 1), "row": list(total)})

    def added(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "row": [np.sum(np.stack(frame["row"].to_list()), 0)]})

    sums = rows.where("fold = 0").select("x", "y").mapInPandas(equations, "i int, row array<double>").groupBy("i").applyInPandas(added, "i int, row array<double>")
    table = np.array([r["row"] for r in sums.orderBy("i").collect()])
    model.beta = np.linalg.solve(table[:, :-1] + RIDGE * moments["n"] / FEATURES * np.eye(FEATURES + 1), table[:, -1])

    def binned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"bin": np.minimum((model.ridge(_matrix(frame)) + 0.5) / 2 * BINS, BINS - 1).astype(int), "y": frame["y"]})

    counted = rows.where("fold = 2").select("x", "y").mapInPandas(binned, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).orderBy("bin").collect()
    if counted:
        model.knots = np.array([(r["bin"] + 0.5) / BINS * 2 - 0.5 for r in counted])
        model.values = isotonic(np.array([r["n"] for r in counted]), np.array([r["ones"] for r in counted]))
    else:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def scores(documents: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out and score of each document."""
    known = written(measured(documents, doc_id, text), "stats")
    model = fit(known, labels, label)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = _matrix(frame)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": model.score(x) if model else np.full(len(x), 0.5)})

    scored = known.mapInPandas(run, f"doc_id {known.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
