import numpy as np
import pytest

from driftwell.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, v string"


def brute(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    x = np.array([np.floor(1024 * np.asarray(v, "float32").astype("float64")) for _, v in kept]).astype("int64") + 100_000
    n, s = len(x), x.sum(axis=0)
    d = x - s / n
    values, q = np.linalg.eigh(d.T @ d / n)
    values, q = values[::-1], q[:, ::-1]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return [i for i, _ in kept], n, deviation, d @ q[:, :8] / np.sqrt(values[:8]), values / values.sum()


def made(dims=21, n=300, seed=1):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, dims)) * np.linspace(1, 3, dims) + 5
    rows = [(i, v.astype("float32").tolist()) for i, v in enumerate(vectors)]
    nan, inf = float("nan"), float("inf")
    rows += [(900, None), (901, [nan, *[0.0] * (dims - 1)]), (902, [None, *[0.0] * (dims - 1)]), (903, [*[0.0] * (dims - 1), -inf]), (None, rows[0][1]), (5, rows[5][1])]
    return rows


@pytest.mark.parametrize(("tile", "block_rows"), [(8, 32), (21, 7), (100, 4096), (1, 50)])
def test_equals_numpy(spark, tile, block_rows):
    rows = made()
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], SCHEMA).repartition(3)
    got = whitening.whiten(df, tile=tile, block_rows=block_rows).collect()
    ids, n, deviation, w, explained = brute(rows)
    key = lambda i: -1 if i is None else i
    mine = sorted((key(r.vec_id), r.component, r.deviation, abs(r.whitened)) for r in got)
    want = sorted((key(i), k + 1, deviation[p], abs(w[p, k])) for p, i in enumerate(ids) for k in range(8))
    assert [m[:3] for m in mine] == [x[:3] for x in want]
    assert np.allclose([m[3] for m in mine], [x[3] for x in want], rtol=0, atol=1e-9)
    for r in got:
        assert r.n == n and r.identity_error < 1e-10 and abs(r.explained / explained[r.component - 1] - 1) < 1e-10
    for k in range(8):  # one sign for all rows of a component
        signs = {np.sign(r.whitened * w[ids.index(r.vec_id), k]) for r in got if r.component == k + 1 and abs(r.whitened) > 1e-6}
        assert len(signs) == 1


def test_few_dimensions_and_no_variance(spark):
    rows = [(i, [float(i % 7), float(i % 3), 1.5], 0, "") for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in got} == {1, 2} and len(got) == 80
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0], 0, "") for i in range(5)], SCHEMA))
    assert same.count() == 0 and same.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("rows", [[], [(1, None, 0, "")], [(1, [float("nan")], 0, "")], [(1, [], 0, "")]])
def test_nothing_to_fit(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_errors(spark):
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(spark.createDataFrame([(1, [1.0], 0, ""), (2, [1.0, 2.0], 0, "")], SCHEMA).coalesce(1)).collect()
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(spark.createDataFrame([(1, [1.0], 0, ""), (2, [1.0, 2.0], 0, "")], SCHEMA).repartition(2, "vec_id")).collect()
    with pytest.raises(Exception, match="beyond a long"):
        whitening.whiten(spark.createDataFrame([(1, [1e30], 0, "")], SCHEMA)).collect()
    with pytest.raises(Exception, match="beyond a long"):
        whitening.whiten(spark.createDataFrame([(i, [1e7 * i], 0, "") for i in range(300)], SCHEMA)).collect()
