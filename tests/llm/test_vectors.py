"""Whitening and centroid clustering against numpy, and the eigensolver on clustered eigenvalues."""

import hashlib
import math
import random
from pathlib import Path

import numpy as np
import pytest

from worktrace.llm import centroids, queries, whitening

SF = "/root/testdata/sf0.001"
BAD = [None, [0.1, None, 0.3], [0.1, float("nan"), 0.3], [0.1, float("inf"), 0.3], [], [0.5, 0.5]]


def _table(spark, vectors, **more):
    rows = [(i, v, "x", 1) for i, v in vectors]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, n int").repartition(3)


@pytest.mark.parametrize("spread", [0, 1e-12, 1e-7, 1e-4, 0.1])
def test_eigenvectors_of_clusters(spread):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q + q @ (np.eye(40) - q.T @ q) / 2  # orthonormal to extended precision
    values = np.concatenate((50 + spread * np.arange(6), 20 + spread * np.arange(3), np.linspace(1, 10, 31))).astype(np.longdouble)
    a = (q * values) @ q.T
    got, x = whitening.eigenpairs(np.asarray((a + a.T) / 2))
    order = np.argsort(values)
    assert np.abs(np.sort(got) - values[order]).max() < 1e-15
    assert np.abs(x.T @ x - np.eye(40)).max() < 1e-16
    assert np.abs(x.T @ a @ x - np.diag(got)).max() < 1e-15
    apart = np.abs((x[:, np.argsort(got)] * q[:, order]).sum(axis=0))
    if spread >= 1e-4:
        assert np.abs(apart - 1).max() < 1e-13
    else:  # the single ones
        assert np.abs(apart[:31] - 1).max() < 1e-13


def test_principal_equals_numpy():
    rng = np.random.default_rng(1)
    for size in (1, 2, 7, 64):
        a = rng.normal(size=(3 * size, size))
        v = a.T @ a
        e, x = whitening.principal(v)
        want, y = np.linalg.eigh(v)
        assert e == pytest.approx(want[::-1], rel=1e-12)
        assert np.abs(np.abs((x * y[:, ::-1]).sum(axis=0)) - 1).max() < 1e-9
    e, x = whitening.principal(np.zeros((3, 3)))
    assert not e.any() and (x == np.eye(3)).all()


def _by_hand(vectors, k):
    good = [(i, v) for i, v in vectors if v is not None and len(v) == 3 and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1000000 for c in v)) for i, v in good]
    fit = sorted({t for _, t in x})
    n, s = len(fit), [sum(t[j] for t in fit) for j in range(3)]
    z = np.array([[t[j] - s[j] / n for j in range(3)] for t in fit])
    cov = z.T @ z / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, t in x:
        deviation = sum((n * t[j] - s[j]) ** 2 for j in range(3))
        white = np.array([t[j] - s[j] / n for j in range(3)]) @ u[:, :k] / np.sqrt(e[:k])
        out.setdefault(i, []).append((deviation, np.abs(white), n, e / cov.trace()))
    return out


def test_whitened_rows_equal_numpy(spark):
    rng = np.random.default_rng(5)
    base = [(i, [float(np.float32(c)) for c in rng.normal(0, (1, 3, 0.5), 3)]) for i in range(80)]
    vectors = [*base, *((90 + i, base[3][1]) for i in range(40)), (5, base[7][1]), *((200 + i, v) for i, v in enumerate(BAD))]
    got = {}
    for r in whitening.whiten(_table(spark, vectors), components=2).collect():
        got.setdefault(r.vec_id, []).append(r)
    want = _by_hand(vectors, 2)
    assert got.keys() == want.keys()
    for i, rows in got.items():
        assert len(rows) == 2 * len(want[i])
        for deviation, white, n, share in want[i]:
            own = [r for r in rows if r.deviation == deviation]
            assert len(own) >= 2
            for r in own:
                assert r.n == n and r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
                assert abs(r.whitened) == pytest.approx(white[r.component - 1], rel=1e-9, abs=1e-12)
                assert r.identity_error < 1e-10


def test_whitening_without_variance_or_rows(spark):
    assert whitening.whiten(_table(spark, []).where("false")).count() == 0
    assert whitening.whiten(_table(spark, [(1, None), (2, [])])).count() == 0
    same = whitening.whiten(_table(spark, [(1, [0.5, 1.0]), (None, [0.5, 1.0])])).collect()
    assert sorted((r.vec_id is None, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same) == [(a, c, 1, 0, None, None, 0.0) for a in (False, True) for c in (1, 2)]
    flat = whitening.whiten(_table(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [3.0, 1.0])])).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)}
    far = whitening.whiten(_table(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1.0, 2.0])])).collect()
    assert len(far) == 6 and all(r.deviation is None for r in far if r.vec_id != 3)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_whitening_query(spark):
    rows = queries.op11_whitening(spark, SF).toPandas()
    given = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.floor(64 * np.stack(given.embedding).astype(np.float64)) + 1000000
    z = np.unique(x, axis=0) - np.unique(x, axis=0).mean(axis=0)
    e, u = np.linalg.eigh(z.T @ z / len(z))
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    got = rows.pivot(index="vec_id", columns="component", values="whitened").loc[given.vec_id].to_numpy()
    want = (x - np.unique(x, axis=0).mean(axis=0)) @ u / np.sqrt(e)
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-9
    assert rows.identity_error.nunique() == 1 and rows.identity_error.iloc[0] < 1e-10


def _clustered(vectors, k, rounds, size):
    kept = [(i, tuple(math.floor(64 * float(np.float32(c))) for c in v)) for i, v in vectors if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda t: (hashlib.sha256(f"1:{'' if t[0] is None else t[0]}".encode()).hexdigest(), t[1]))
    c = [t[1] for t in order[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    place = lambda: [min((far(x, m), j) for j, m in enumerate(c)) for _, x in kept]
    for _ in range(rounds):
        own = place()
        for j in range(len(c)):
            members = [x for (_, x), (_, at) in zip(kept, own, strict=True) if at == j]
            if members:
                c[j] = tuple(sum(m[d] for m in members) // len(members) for d in range(size))
    own = place()
    total = sum(d for d, _ in own)
    inertia = [sum(d for d, at in own if at == j) for j in range(len(c))]
    return sorted(((i, j, d, inertia[j], total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, own, strict=True)), key=repr)


@pytest.mark.parametrize("case", ["clouds", "copies", "few", "far"])
def test_clusters_equal_plain_python(spark, case):
    rng = random.Random(case)
    if case == "few":
        vectors = [(1, [0.1, 0.2, 0.3]), (2, [0.1, 0.2, 0.3]), (2, [0.4, 0.2, 0.3])]
    elif case == "copies":  # ties, null ids, empty clusters
        vectors = [*((i, [0.5, 0.5, -0.5]) for i in range(60)), *((i, [0.25 * (i % 3), 0.0, 0.0]) for i in range(60, 90)), (None, [0.1, 0.1, 0.1])]
    elif case == "far":
        vectors = [(i, [rng.choice([-1e4, 1e4]) + rng.random() for _ in range(3)]) for i in range(50)]
    else:
        vectors = [(i, [rng.gauss(i % 5, 0.4) for _ in range(3)]) for i in range(300)]
    vectors += [(900 + i, v) for i, v in enumerate(BAD)]
    got = centroids.cluster_centroids(_table(spark, vectors), k=5, rounds=3, dimensions=3).collect()
    assert sorted(map(tuple, got), key=repr) == _clustered(vectors, 5, 3, 3)


def test_clusters_of_nothing(spark):
    assert centroids.cluster_centroids(_table(spark, []).where("false")).count() == 0
    assert centroids.cluster_centroids(_table(spark, [(1, [0.1, 0.2])])).count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_cluster_query_equals_sql(spark):
    import duckdb

    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    df, want = queries.op13_clusters(spark, SF), duck.sql(queries.ORACLE_SQL["op13_clusters"])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())
