"""Block Lanczos against a dense solver, whitening against numpy over whole tables, exact deviations and edge cases."""

import numpy as np
import pytest

from fathomline.llm import whitening as Wh
from fathomline.llm.queries import op12_block_lanczos_whitening

SF = "/root/testdata/sf0.01"


def random_matrix(d, rank, seed=0):
    half = np.random.default_rng(seed).normal(size=(d, rank))
    return half @ half.T


@pytest.mark.parametrize("matrix", [np.diag([5.0] * 10 + [3, 2, 1, 0]), np.zeros((6, 6)), np.eye(20), random_matrix(30, 2), random_matrix(120, 200), np.diag(np.arange(40.0)), np.array([[3.0]])])
def test_block_lanczos(matrix):
    values, axes = Wh.block_lanczos(lambda q: matrix @ q, len(matrix), 4)
    k = min(4, len(matrix))
    scale = max(np.abs(matrix).max(), 1)
    assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1][:k]).max() < 1e-12 * scale * len(matrix)
    assert np.abs(matrix @ axes - axes * values).max() < 1e-12 * scale * len(matrix)
    assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-13


def test_against_numpy(spark):
    rows = op12_block_lanczos_whitening(spark, SF).collect()
    source = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    usable = [(i, v) for i, v in source if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(256 * np.array([v for _, v in usable], np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    c = fit - sums / n
    cov = c.T @ c / n
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1], axes[:, ::-1]
    want = (x - sums / n) @ axes[:, :4] / np.sqrt(e[:4])
    assert len(rows) == 4 * len(usable)
    got = {(r.vec_id, r.component): r for r in rows}
    sign = np.sign([sum(got[i, k + 1].whitened * want[j, k] for j, (i, _) in enumerate(usable)) for k in range(4)])
    for j, (i, _) in enumerate(usable):
        for k in range(4):
            r = got[i, k + 1]
            assert abs(r.whitened * sign[k] - want[j, k]) < 1e-9 and r.n == n and r.deviation == ((n * x[j] - sums) ** 2).sum()
            assert abs(r.explained - e[k] / np.trace(cov)) < 1e-10 and r.identity_error < 1e-9


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [0.0, 0.5], 2), (3, None, 3), (4, [None, 1.0], 4), (5, [nan, 1.0], 5), (6, [inf, 1.0], 6), (7, [-0.001, 0.25], 7)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, whitened int")
    found = Wh.whiten(df, keep=("vec_id", "whitened"))
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == 8 and {r[1] for r in rows} == {1, 2, 7} and all(r[3] == 3 for r in rows)
    fit = np.array([[256, 0], [0, 128], [-1, 64]])
    s = fit.sum(0)
    assert {r[1]: r[4] for r in rows} == {1: int(((3 * fit[0] - s) ** 2).sum()), 2: int(((3 * fit[1] - s) ** 2).sum()), 7: int(((3 * fit[2] - s) ** 2).sum())}
    assert Wh.whiten(df.limit(0)).count() == 0
    assert Wh.whiten(spark.createDataFrame([(1, [])], "vec_id bigint, embedding array<double>")).count() == 0
    same = Wh.whiten(spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0])], "vec_id bigint, embedding array<float>")).collect()
    assert len(same) == 4 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 and r.identity_error == 0 for r in same)
    line = Wh.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 3.0 * i]) for i in range(5)], "vec_id bigint, embedding array<float>")).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in line) and {round(r.explained, 9) for r in line if r.component == 1} == {1.0}
    with pytest.raises(Exception, match="differ in length"):
        Wh.whiten(spark.createDataFrame([(1, [2.0]), (2, [2.0, 3.0])], "vec_id bigint, embedding array<float>")).collect()


def test_deviations_of_any_size():
    x, sums, n = np.array([[2**40, -(2**40)], [1, 2]]), [2**50, 3], 10**6
    assert Wh.deviations(x, n, sums) == [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
