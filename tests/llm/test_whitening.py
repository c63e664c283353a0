from fractions import Fraction

import numpy as np
import pytest

from regressa.llm import whitening
from regressa.llm.queries import op11_embedding_whitening
from regressa.llm.whitening import refined_eigenvectors, whiten
from tests.conftest import SF0001

HIGH = np.longdouble


def symmetric(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values),) * 2))[0].astype(HIGH)
    for _ in range(3):
        q = q @ (1.5 * np.eye(len(values)) - 0.5 * q.T @ q)
    a = (q * np.array(values, HIGH)) @ q.T
    return (a + a.T) / 2, q


SPECTRA = {
    "spread": list(np.linspace(1, 10, 64)),
    "geometric": [2.0 ** -i for i in range(40)],
    "clustered": [1 + 1e-9 * i for i in range(8)] + list(np.linspace(2, 3, 24)),
    "tight": [1 + 1e-12 * i for i in range(8)] + list(np.linspace(2, 3, 24)),
    "two clusters": [1 + 1e-10 * i for i in range(8)] + [2 + 1e-8 * i for i in range(8)] + [5.0],
    "nested": [1, 1 + 1e-11, 1 + 1e-6, 1 + 1e-6 + 1e-11, 3],
    "equal": [1.0] * 6 + [2.0] * 4 + [5.0],
    "singular": [0.0] * 10 + [1, 2, 3],
}


@pytest.mark.parametrize("name", SPECTRA)
def test_eigenvectors_to_double_precision(name):
    values = np.array(SPECTRA[name])
    a, q = symmetric(values)
    got, x = refined_eigenvectors(a)
    order = np.argsort(-values, kind="stable")
    values, q = values[order], q[:, order]
    assert np.abs(got - values).max() <= 1e-15 * values.max()
    assert np.abs(x.T @ x - np.eye(len(values))).max() <= 1e-16
    assert np.abs(a @ x - x * got).max() <= 3e-16 * values.max()
    gaps = np.abs(values[:, None] - values) + np.diag([np.inf] * len(values))
    for i, gap in enumerate(gaps.min(axis=1)):
        if gap:  # as exact as the gap lets an eigenvector be
            off = np.abs(x[:, i] * np.sign(x[:, i] @ q[:, i]) - q[:, i]).max()
            assert off <= 1e-15 * values.max() / min(gap, 1) + 1e-16


def test_float32_alone_is_not_enough():
    a, q = symmetric(SPECTRA["clustered"])
    plain = np.linalg.eigh(a.astype(np.float32))[1]
    assert np.abs(plain.T @ plain - np.eye(len(a))).max() > 1e-9


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for high in (100, 10 ** 9, 1 << 61):
        x = rng.integers(-high, high, size=(9_000 if high == 100 else 60, 3))
        big = x.astype(object)
        assert (whitening.exact_products(x) == big.T @ big).all()


def brute(rows, top=32):
    """The contract with fractions and a double eigensolver."""
    x = [(i, [int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v]) for i, v in rows
         if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    n, d = len(x), len(x[0][1])
    sums = [sum(r[1][j] for r in x) for j in range(d)]
    z = np.array([[n * v - s for v, s in zip(r, sums, strict=True)] for _, r in x], object)
    cov = (z.T @ z)
    cov = np.array([[float(Fraction(int(c), n ** 3)) for c in row] for row in cov])
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1][:top], vector[:, ::-1][:, :top]
    w = (z.astype(float) / n) @ vector / np.sqrt(value)
    return {(i, k + 1): (n, sum(int(a) ** 2 for a in z[r]), w[r, k], value[k] / np.trace(cov))
            for r, (i, _) in enumerate(x) for k in range(len(value))}


def agrees(got, want):
    sign = {}
    assert {(r["vec_id"], r["component"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        n, deviation, whitened, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        s = sign.setdefault(r["component"], 1.0 if r["whitened"] * whitened >= 0 else -1.0)
        assert r["whitened"] == pytest.approx(s * whitened, abs=1e-6)
        assert r["explained"] == pytest.approx(explained, rel=1e-9) and r["identity_error"] < 1e-9


def test_query_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF0001}/embeddings.parquet").collect()]
    agrees(op11_embedding_whitening(spark, SF0001).collect(), brute(rows))


def frame(spark, rows, kind="array<float>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, component int, v int, `a.b` int")


def test_rows_of_every_kind(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).tolist(), 1, 2, 3) for i in range(20)]
    odd = [(90, None, 1, 1, 1), (91, [1.0, None, 2.0], 1, 1, 1), (92, [1.0, float("nan"), 2.0], 1, 1, 1),
           (93, [1.0, float("inf"), 2.0], 1, 1, 1), (94, [1.0, 2.0], 1, 1, 1), (95, [], None, None, None)]
    for kind in ("array<float>", "array<double>"):
        want = [(i, [float(np.float32(c)) if kind == "array<float>" else c for c in v])
                for i, v, *_ in rows]
        agrees(whiten(frame(spark, rows + odd, kind).repartition(4)).collect(), brute(want))
    doubled = whiten(frame(spark, rows + rows[:5] + [(None, *rows[0][1:])])).collect()
    assert len(doubled) == 26 * 3 and doubled[0]["n"] == 26


def test_tables_without_variance(spark):
    same = [(i, [1.0, 2.0], 0, 0, 0) for i in range(5)]
    assert whiten(frame(spark, same)).count() == 0
    assert whiten(frame(spark, same[:1])).count() == 0
    assert whiten(frame(spark, [])).count() == 0
    line = [(i, [float(i), 2.0 * i], 0, 0, 0) for i in range(5)]
    assert {r["component"] for r in whiten(frame(spark, line)).collect()} == {1}


def test_large_entries(spark):
    rows = [(i, [1e25 * i, float(i % 3)], 0, 0, 0) for i in range(6)]
    out = whiten(frame(spark, rows, "array<double>")).collect()
    assert len(out) >= 6 and all(r["deviation"] is None for r in out)
