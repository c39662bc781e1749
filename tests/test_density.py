"""Density clusters against plain Python, in blocks of any size, and their report."""

import math
import random
from collections import Counter

import pytest

from worktrace.operators import density as dn

RADII, LEAST = [0.4, 1.0], [3, 6]


def _brute(points, r, m):
    """{key: (n_near, kind, cores it may belong to)} and the part of each core."""
    keys = list(points)
    near = {a: [b for b in keys if math.dist(points[a], points[b]) <= r] for a in keys}
    core = {a for a in keys if len(near[a]) >= m}
    part = {}
    for a in sorted(core):
        if a in part:
            continue
        todo, seen = [a], {a}
        while todo:
            for y in near[todo.pop()]:
                if y in core and y not in seen:
                    seen.add(y)
                    todo.append(y)
        part |= dict.fromkeys(seen, a)
    return near, core, part


def _rows(seed=4, n=220):
    rng = random.Random(seed)
    centre = [(0, 0, 0), (4, 0, 1), (0, 5, 2), (4.9, 0.4, 1.2)]
    out = {}
    for i in range(n):
        c = rng.choice(centre)
        out[f"k{i:04d}"] = [rng.gauss(v, 0.45) for v in c] if rng.random() < 0.8 else [rng.uniform(-4, 9) for _ in c]
    for i in range(60):  # copies: one vector with a large share of all rows
        out[f"z{i:04d}"] = [8.0, 8.0, 8.0]
    return out


@pytest.mark.parametrize(("pivots", "block"), [(1, 4096), (1, 20), (12, 15), (300, 7)])
def test_equal_brute_force_whatever_the_blocks(spark, pivots, block):
    points = _rows()
    table = spark.createDataFrame(list(points.items()), "key string, features array<double>").repartition(4)
    got = {(r.key, r.radius, r.least): r for r in dn.density_clusters(table, "key", RADII, LEAST, pivots, block).collect()}
    assert len(got) == len(points) * 4
    kinds = Counter()
    for r in RADII:
        for m in LEAST:
            near, core, part = _brute(points, r, m)
            whole = {}
            for key in points:
                row = got[key, r, m]
                kinds[row.kind] += 1
                touching = [b for b in near[key] if b in core]
                assert row.n_near == len(near[key])
                assert row.kind == ("core" if key in core else "border" if touching else "noise")
                if touching:
                    best = key if key in core else min(touching, key=lambda b: math.dist(points[b], points[key]))  # noqa: B023
                    whole.setdefault(part[best], []).append(key)
            want = {k: min(keys) for keys in whole.values() for k in keys}
            assert {k: got[k, r, m].cluster for k in points} == {k: want.get(k) for k in points}
    assert min(kinds[k] for k in ("core", "border", "noise")) > 20


def test_odd_tables(spark):
    schema = "key string, features array<double>"
    assert dn.density_clusters(spark.createDataFrame([], schema), "key", [1.0], [2]).collect() == []
    rows = [("a", [0.0, 1.0]), ("a", [0.0, 1.0]), (None, [-0.0, 1.0]), ("n", None), ("v", [None, 1.0]), ("i", [float("inf"), 0.0]), ("nan", [float("nan"), 0.0]), ("far", [9.0, 9.0])]
    got = sorted((str(r.key), r.n_near, r.kind, r.cluster) for r in dn.density_clusters(spark.createDataFrame(rows, schema), "key", [0.5], [3]).collect())
    assert got == [("None", 3, "core", "a"), ("a", 3, "core", "a"), ("a", 3, "core", "a"), ("far", 1, "noise", None)]


def test_standard_vectors(spark):
    rows = spark.createDataFrame([("a", 1.0, 5), ("b", 3.0, 5), ("c", None, 5), ("d", float("nan"), None)], "k string, x double, y int")
    assert {r.k: list(r.features) for r in dn.standard_vectors(rows, ["x", "y"], ["k"]).collect()} == {"a": [-1.0, 0.0], "b": [1.0, 0.0], "c": [0.0, 0.0], "d": [0.0, 0.0]}
    assert dn.standard_vectors(rows.limit(0), ["x", "y"], ["k"]).collect() == []


def test_report(spark):
    rows = [(1, "x", "p")] * 3 + [(1, "y", "q")] * 2 + [(1, None, "p")] + [(2, "x", "p"), (2, "x", "q")] + [(3, c, t) for c in "xy" for t in "pq" for _ in range(5)]
    got = {r.s: r.asDict() for r in dn.density_report(spark.createDataFrame(rows, "s int, cluster string, truth string"), ["s"], "cluster", "truth").collect()}
    one = {c: got[1][c] for c in ("n_rows", "n_clusters", "n_noise", "largest", "ari", "nmi", "noise_share")}
    assert one == pytest.approx({"n_rows": 6, "n_clusters": 2, "n_noise": 1, "largest": 3, "ari": 1, "nmi": 1, "noise_share": 1 / 6})
    assert got[2]["ari"] is None and got[2]["n_clusters"] == 1
    assert got[3]["nmi"] == pytest.approx(0, abs=1e-12) and got[3]["ari"] < 0.01


def test_pieces_equal_single_distances_at_and_beside_the_radius():
    import numpy as np

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(70, 5)) + 1000, rng.normal(size=(90, 5)) + 1000
    away = dn._apart(x, y)
    # radii that are distances themselves, and the next number below: rounding of the product must not decide
    radii = [float(away[3, 4]), float(np.nextafter(away[3, 4], 0)), float(away[60, 80]), 1.5]
    got = np.zeros((len(radii), *away.shape), dtype=bool)
    for i, j, each in dn._pieces(x, y, radii, rows=16, columns=32):
        for e, near in enumerate(each):
            got[e, i : i + near.shape[0], j : j + near.shape[1]] = near
    assert all((got[e] == (away <= r)).all() for e, r in enumerate(radii))
    assert got[0, 3, 4] and not got[1, 3, 4]


def test_points_are_not_sent_to_more_blocks_than_asked(spark):
    """Without an own number of pivots the blocks stay few, so that a point is not sent once for every 512 points that there are."""
    import random as rd

    rng = rd.Random(1)
    rows = spark.createDataFrame([(i, [rng.random() for _ in range(6)], 1) for i in range(20_000)], "id long, features array<double>, weight long")
    sent = {}
    dealt = dn._dealt
    dn._dealt = lambda points, reach, pivots, block: sent.update(pivots=pivots, block=block) or dealt(points, reach, pivots, block)
    try:
        dn.density_clusters(rows.select("id", "features").limit(20_000), "id", [0.05], [5])
    finally:
        dn._dealt = dealt
    assert sent["pivots"] <= 32 and sent["block"] >= 2048


def _clouds(n=3000, seed=7):
    import numpy as np

    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.6, (n // 3, 6)) for c in (0, 2, 5)])
    x[:, 3:5] = x[:, :2]  # columns that say the same
    x[::7] = np.round(x[::7])
    return np.unique(x, axis=0)


@pytest.mark.parametrize("ahead", [True, False])
def test_leaves_leave_out_no_pair_and_most_of_the_others(ahead):
    import numpy as np

    x = _clouds()
    rng = np.random.default_rng(1)
    x = rng.permutation(x)
    y = x if ahead else rng.permutation(x)[:1000] + 0.25
    away = dn._apart(x, y)
    radii = [0.5, float(np.sort(away[3])[20]), 1.0]
    left, right = dn._both(x, y)
    right = left if ahead else right
    got, seen = np.zeros((3, *away.shape), dtype=bool), 0
    for start, end, columns, each in dn._close(left, right, radii, ahead):
        for e, near in enumerate(each):
            u, v = np.nonzero(near)
            got[e, left.rows[start + u], right.rows[columns[v]]] = True
            if ahead:
                got[e, right.rows[columns[v]], left.rows[start + u]] = True
        seen += (end - start) * len(columns)
    assert all((got[e] == (away <= r)).all() for e, r in enumerate(radii))
    assert seen < 0.75 * away.size


def test_large_and_tiny_numbers_are_not_lost_to_single_precision():
    import numpy as np

    rng = np.random.default_rng(5)
    for scale in (1e-30, 1e-22, 1e15, 1e30, 1e160):
        x = rng.normal(size=(40, 3)) * scale
        with np.errstate(over="ignore"):
            away = dn._apart(x, x)
            r = float(np.median(away)) if np.isfinite(away).all() and away.max() > 0 else scale
            left, _ = dn._both(x, x[:0])
            got = np.zeros(away.shape, dtype=bool)
            for start, _, columns, (near,) in dn._close(left, left, [r]):
                got[left.rows[start : start + len(near)][:, None], left.rows[columns[: near.shape[1]]][None, :]] = near
            assert (got == (away <= r)).all(), scale


def test_parts_are_joined_without_comparing_what_is_one_already():
    import numpy as np

    x = _clouds()
    r, places = 0.8, np.arange(len(_clouds()))
    ordered, _ = dn._both(x, x[:0])
    compared, within = [0], dn._within
    dn._within = lambda a, rows, b, columns, *more: compared.__setitem__(0, compared[0] + len(a.x[rows]) * len(columns)) or within(a, rows, b, columns, *more)
    try:
        root = dn._bridged(ordered, ordered, r, places, places, places.copy())
    finally:
        dn._within = within
    u, v = np.nonzero(dn._apart(x, x) <= r)
    assert (root == dn._joined(places.copy(), u, v)).all()
    assert compared[0] < 0.6 * len(x) ** 2
    none = ordered.only(np.zeros(len(x), dtype=bool))
    assert not list(dn._found(ordered, none, r)) and not list(dn._found(none, ordered, r))
    assert (dn._bridged(none, ordered, r, places, places, places.copy()) == places).all() and (dn._bridged(ordered, none, r, places, places, places.copy()) == places).all()


def test_kinds_without_parts_are_the_same(spark):
    table = spark.createDataFrame(list(_rows().items()), "key string, features array<double>")
    kinds = lambda **kw: sorted((r.key, r.radius, r.least, r.n_near, r.kind) for r in dn.density_clusters(table, "key", RADII, LEAST, 6, 40, **kw).collect())
    assert kinds() == kinds(parts=False)
    assert "cluster" not in dn.density_clusters(table.limit(0), "key", RADII, LEAST, parts=False).columns
