"""Whitening of embeddings by a tiled covariance (operator 13).

A vector's entries c become whole numbers x = floor(SCALE * c) + SHIFT. Sums of x for each dimension come first, exactly.
For the covariance the dimensions are cut into blocks of ``tile`` columns, and each pair of blocks is a tile. Each task
cuts its rows into row-blocks, centres them and sends each column block, under the key of every tile it belongs
to, to one place by (tile, row-block); there the two column blocks are multiplied, and the products are summed for each
tile. So no task holds more than two blocks of ``block_rows`` x ``tile`` numbers, and a table of any length and width
is spread over row-blocks times tiles. The tiles are assembled on the driver, which is as large as the square of the
number of dimensions (at most MOST_DIMS, more is an error), never as the number of rows, and its eigenvectors are
found there.

Centring is x - floor(S/n), which is exact, less the fraction that is left of S/n: a double has all digits of the small
number that remains. The covariance of the whitened values is measured from these themselves, again centred.

Rows whose vector is null or holds null or non-finite entries are dropped. Vectors of different lengths, entries whose x, and
deviations that go beyond a long are errors. Components without variance (an eigenvalue below rounding) cannot be
whitened and are left out, so fewer than eight may come back. Repeated rows and null ids are rows of their own. Extra columns
are not read. No vectors give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

SCALE, SHIFT = 1024, 100_000
COMPONENTS, TILE, BLOCK_ROWS = 8, 32, 4096
MOST_DIMS = 8192
_MOST = 2.0**62


def whole(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors count, and their x as a matrix of longs."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    sizes = np.diff(np.asarray(vectors.offsets))
    flat = vectors.values.slice(vectors.offsets[0].as_py(), int(sizes.sum())) if len(vectors) else vectors.values
    fine = np.isfinite(flat.to_numpy(zero_copy_only=False))  # a null entry is not a number
    ends = np.concatenate([[0], np.cumsum(sizes)])
    bad = np.concatenate([[0], np.cumsum(~fine)])
    good = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[ends[1:]] == bad[ends[:-1]])
    lengths = set(sizes[good].tolist())
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(lengths)[:5]}")
    values = flat.to_numpy(zero_copy_only=False)[np.repeat(good, sizes)]
    x = np.floor(SCALE * values)
    if len(x) and np.abs(x).max() >= _MOST:
        raise OverflowError("an entry is beyond a long")
    return good, (x.astype("int64") + SHIFT).reshape(int(good.sum()), lengths.pop() if lengths else 0)


@dataclass(frozen=True)
class Fit:
    """What whitening needs: the number of vectors, the sums, and by component its vector, eigenvalue and share."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    base = [s // n for s in sums]
    return (x - np.array(base, "int64")) - np.array([(s - n * b) / n for s, b in zip(sums, base, strict=True)])


def totals(vectors: DataFrame) -> tuple[int, tuple[int, ...]]:
    """The number of vectors and the sums by dimension; tasks send one row each for a batch."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = whole(batch["v"])
            if len(x):
                if x.size and float(np.abs(x).max()) * len(x) >= _MOST:
                    raise OverflowError("a sum is beyond a long")
                yield pa.RecordBatch.from_pydict({"n": [len(x)], "sums": pa.array([x.sum(axis=0).tolist()], pa.list_(pa.int64()))})

    each = vectors.select("v").mapInArrow(partial, "n long, sums array<long>").select("n", F.size("sums").alias("dims"), F.posexplode_outer("sums").alias("dim", "s"))
    got = each.groupBy("dims", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).limit(MOST_DIMS + 1).collect()  # a row for each dimension
    if len({r["dims"] for r in got}) > 1:
        raise ValueError(f"vectors of different lengths: {sorted({r['dims'] for r in got})}")
    if len(got) > MOST_DIMS:
        raise ValueError(f"more than {MOST_DIMS} dimensions")
    known = sorted((r["dim"], r["s"], r["n"]) for r in got if r["dim"] is not None)
    return (known[0][2], tuple(s for _, s, _ in known)) if known else (0, ())


def tiles(vectors: DataFrame, n: int, sums: tuple[int, ...], tile: int = TILE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The sums of products of centred entries, one row (i, j, a, b, value) for each entry of each tile i <= j."""
    blocks = range(-(-len(sums) // tile))
    kind = "block long, i int, j int, side int, m binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting: list[np.ndarray] = []

        def sent(rows: np.ndarray) -> pa.RecordBatch:
            columns = [np.ascontiguousarray(rows[:, b * tile : (b + 1) * tile]).tobytes() for b in blocks]
            keys = [(i, j, s) for i in blocks for j in blocks if i <= j for s in ((0, 1) if i < j else (0,))]
            return pa.RecordBatch.from_arrays(
                [pa.array([number] * len(keys), pa.int64()), *[pa.array([k[c] for k in keys], pa.int32()) for c in range(3)], pa.array([columns[(i, j)[s]] for i, j, s in keys], pa.binary())],
                names=["block", "i", "j", "side", "m"],
            )

        for batch in batches:
            _, x = whole(batch["v"])
            if len(x):
                waiting.append(centred(x, n, sums))
            while sum(map(len, waiting)) >= block_rows:
                rows = np.concatenate(waiting)
                yield sent(rows[:block_rows])
                number += 1
                waiting = [rows[block_rows:]]
        if sum(map(len, waiting)):
            yield sent(np.concatenate(waiting))

    def multiplied(key: tuple, sides: pa.Table) -> pa.Table:
        _, i, j = (k.as_py() for k in key)
        width = lambda b: min(tile, len(sums) - b * tile)
        m = {s: np.frombuffer(x, "float64").reshape(-1, width((i, j)[s])) for s, x in zip(sides["side"].to_pylist(), sides["m"].to_pylist(), strict=True)}
        product = m[0].T @ m[1 if i < j else 0]
        return pa.table({"i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "product": pa.array([product.ravel().tolist()], pa.list_(pa.float64()))})

    products = vectors.select("v").mapInArrow(cut, kind).groupBy("block", "i", "j").applyInArrow(multiplied, "i int, j int, product array<double>")
    entries = products.select("i", "j", F.posexplode("product").alias("at", "value")).groupBy("i", "j", "at").agg(F.sum("value").alias("value"))
    wide = F.when(F.col("j") == blocks[-1], len(sums) - blocks[-1] * tile).otherwise(tile)
    return entries.select("i", "j", F.floor(F.col("at") / wide).cast("int").alias("a"), (F.col("at") % wide).cast("int").alias("b"), "value")


def fit(vectors: DataFrame, components: int = COMPONENTS, tile: int = TILE, block_rows: int = BLOCK_ROWS) -> Fit:
    n, sums = totals(vectors)
    d = len(sums)
    if not d:
        return Fit(n, sums, np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    cov = np.zeros((d, d))
    t = tiles(vectors, n, sums, tile, block_rows).toArrow()  # at most MOST_DIMS squared entries
    i, j, a, b, value = (t[c].to_numpy() for c in ("i", "j", "a", "b", "value"))
    cov[i * tile + a, j * tile + b] = value / n
    cov[j * tile + b, i * tile + a] = value / n
    values, columns = np.linalg.eigh(cov)
    values, columns = values[::-1], columns[:, ::-1]
    use = min(components, int((values > d * np.finfo(float).eps * max(values[0], 0)).sum()))
    return Fit(n, sums, columns[:, :use].T.copy(), values[:use].copy(), values[:use] / np.trace(cov))


def projected(vectors: DataFrame, model: Fit) -> DataFrame:
    """vec_id, deviation and whitened (an array with an entry for each component) of each vector that counts."""
    out = T.StructType([vectors.schema["vec_id"], *T._parse_datatype_string("deviation long, whitened array<double>").fields])
    scaled = model.vectors / np.sqrt(model.values)[:, None]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = whole(batch["v"])
            if not len(x):
                continue
            reach = model.n * (float(np.abs(x - SHIFT).max()) + SHIFT) + max(map(abs, model.sums))
            if reach >= _MOST:
                raise OverflowError("a deviation is beyond a long")
            y = model.n * x - np.array(model.sums, "int64")
            if float(np.square(y.astype("float64")).sum(axis=1).max()) >= _MOST * 1.99:
                raise OverflowError("a deviation is beyond a long")
            w = model.centred(x) @ scaled.T
            yield pa.RecordBatch.from_arrays([batch["vec_id"].filter(pa.array(good)), pa.array(np.square(y).sum(axis=1)), pa.array(w.tolist(), pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"])

    return vectors.mapInArrow(project, out)


def identity_error(whitened: DataFrame, components: int) -> float:
    """The largest absolute entry of the covariance of ``whitened`` minus the identity."""
    n, *means = whitened.agg(F.count("*"), *[F.avg(F.col("whitened")[k]) for k in range(components)]).first()
    off = [F.col("whitened")[k] - F.lit(m) for k, m in enumerate(means)]
    pairs = [(a, b) for a in range(components) for b in range(a, components)]
    got = whitened.agg(*[F.sum(off[a] * off[b]) for a, b in pairs]).first()
    return max(abs(v / n - (a == b)) for v, (a, b) in zip(got, pairs, strict=True))


def whiten(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, tile: int = TILE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row for each vector that counts and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    vectors = embeddings.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    model = fit(vectors, components, tile, block_rows)
    use = len(model.values)
    rows = written(projected(vectors, model), "whitened") if use else projected(vectors, model).limit(0)
    error = identity_error(rows, use) if use else 0.0
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    share = F.get(F.array(*[F.lit(float(x)) for x in model.explained]), F.col("k")) if use else F.lit(None).cast("double")
    return each.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
