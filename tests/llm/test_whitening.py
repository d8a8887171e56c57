import math
from fractions import Fraction

import numpy as np
import pytest

from ledgerloom.llm import queries, whitening

from ..conftest import rows

SCHEMA = "vec_id long, embedding array<float>, x string, component int, n string"
DATA = "/root/testdata/sf0.001"


def table(spark, items):
    return spark.createDataFrame([(i, v, "x", 7, "n") for i, v in items], SCHEMA)


def brute(items, k=4):
    """By exact covariance and a plain eigensolver."""
    sound = [(i, [math.floor(256 * c) for c in v]) for i, v in items if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in sound})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    d = len(sums)
    v = [[sum(Fraction(n * x[a] - sums[a]) * (n * x[b] - sums[b]) for x in fit) / n**3 for b in range(d)] for a in range(d)]
    values, vectors = np.linalg.eigh(np.array(v, dtype=np.float64))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for i, x in sound:
        dev = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        centred = np.array([float(Fraction(c) - Fraction(s, n)) for c, s in zip(x, sums, strict=True)])
        out[i] = n, dev, centred @ vectors / np.sqrt(values), values / float(sum(v[a][a] for a in range(d)))
    return out


def against(df, want, tolerance=1e-9):
    signs, seen = {}, 0
    for r in df.collect():
        n, dev, white, explained = want[r["vec_id"]]
        k = r["component"] - 1
        assert (r["n"], int(r["deviation"])) == (n, dev)
        assert r["explained"] == pytest.approx(explained[k], rel=1e-10) and r["identity_error"] < 1e-10
        if abs(white[k]) > 1e-6:
            assert signs.setdefault(k, np.sign(white[k] * r["whitened"])) == np.sign(white[k] * r["whitened"])
        assert abs(r["whitened"]) == pytest.approx(abs(white[k]), abs=tolerance)
        seen += 1
    assert seen == sum(len(w[2]) for w in want.values())


def test_whitening_against_exact_covariance(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(90, 6)) * [3, 2, 1.5, 1, 0.5, 0.1] + [500, 0, -7, 0, 0, 1]).astype(np.float32).tolist()
    items = list(enumerate(vectors)) + [(200, vectors[3]), (201, vectors[3])]
    odd = [(300, None), (301, []), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [math.nan] * 6), (304, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0]), (305, [1.0])]
    against(whitening.whitened(table(spark, items + odd)), brute(items))
    repeated = whitening.whitened(table(spark, items + [(0, vectors[0]), (None, vectors[1])]))
    assert repeated.filter("vec_id = 0").count() == 8 and repeated.filter("vec_id is null").count() == 4


def test_registered_query(spark):
    items = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = queries.QUERIES["op12_whitening"](spark, DATA)
    fit = {tuple(math.floor(256 * c) for c in v) for _, v in items if v and all(c is not None and math.isfinite(c) for c in v)}
    x = np.array(sorted(fit), dtype=np.float64)
    y = x - x.mean(axis=0)
    values = np.linalg.eigvalsh(y.T @ y / len(x))[::-1]
    some = found.select("component", "n", "explained", "identity_error").distinct().orderBy("component").collect()
    assert [r["explained"] for r in some] == pytest.approx((values / values.sum())[:4].tolist(), rel=1e-9)
    assert all(r["n"] == len(x) and r["identity_error"] < 1e-9 for r in some)
    assert dict(found.dtypes)["deviation"] == "bigint" and found.count() == 4 * len(items)


def test_edges(spark):
    assert whitening.whitened(table(spark, [])).count() == 0
    assert whitening.whitened(table(spark, [(1, None), (2, [None])])).count() == 0
    same = whitening.whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))
    assert rows(same, "vec_id", "component", "n", "whitened", "explained", "identity_error") == [(i, c, 1, None, 0.0, None) for i in (1, 2) for c in (1, 2)]
    line = whitening.whitened(table(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0])]))
    assert [(r["component"], r["whitened"] and abs(r["whitened"]), r["explained"]) for r in line.orderBy("vec_id", "component").collect()] == [(1, pytest.approx(1), 1.0), (2, None, 0.0)] * 2
    with pytest.raises(Exception, match="farther than"):
        whitening.whitened(table(spark, [(1, [1e30]), (2, [0.0])])).count()


def test_sums_of_products_are_exact():
    rng = np.random.default_rng(2)
    for top in (50, 1 << 20, (1 << 31) - 1):
        y = rng.integers(-top, top, (40, 3))
        a, b, c = (x.tolist() for x in whitening.products(y))
        want = [sum(int(r[i]) * int(r[j]) for r in y) for i, j in zip(*np.triu_indices(3), strict=True)]
        assert [(x << 32) + (z << 16) + w for x, z, w in zip(a, b, c, strict=True)] == want


def rotated(values, seed):
    n = len(values)
    rng = np.random.default_rng(seed)
    q = np.eye(n, dtype=np.longdouble)
    for _ in range(4):
        u = rng.normal(size=n).astype(np.longdouble)
        q = q - 2 * np.outer(u, u @ q) / (u @ u)
    a = (q * np.array(values, dtype=np.longdouble)) @ q.T
    return (a + a.T) / 2, q


@pytest.mark.skipif(np.finfo(np.longdouble).eps > 1e-18, reason="no wider floating point here")
@pytest.mark.parametrize("gap", [1e-3, 1e-7, 1e-9])
def test_clustered_eigenvalues(gap):
    """Beyond what single and double precision can tell apart."""
    values = [5, 4 + 2 * gap, 4 + gap, 4, 1, 1 - gap, 0.2, 1e-9]
    a, q = rotated(values, 3)
    found, x = whitening.eigen(a)
    assert found.tolist() == pytest.approx(values, abs=1e-15)
    turned = np.abs(q.T.astype(np.float64) @ x)
    assert np.abs(turned - np.eye(len(values))).max() < 1e-17 / gap + 1e-14


def test_equal_and_missing_eigenvalues():
    for values in ([3, 3, 3, 1], [2, 0, 0, 0], [1, 1, 1, 1]):
        a, _ = rotated(values, 4)
        found, x = whitening.eigen(a)
        assert found.tolist() == pytest.approx(values, abs=1e-14)
        assert np.abs(x.T @ x - np.eye(4)).max() < 1e-14
        assert np.abs(a.astype(np.float64) @ x - x * found).max() < 1e-14
