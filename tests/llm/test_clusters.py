import numpy as np

from tesserae.llm import clusters as C
from tesserae.llm.components import stars

S = "id string, embedding array<double>, cid bigint, v string"


def data(seed=1, groups=40, dim=128):
    rnd = np.random.default_rng(seed)
    rows, truth = [], {}
    for g in range(groups):
        centre = rnd.normal(size=dim)
        for k in range(1 if g % 3 else int(rnd.integers(1, 30))):
            i = f"m{len(rows):05d}"
            rows.append((i, ((centre + 0.35 * rnd.normal(size=dim)) * rnd.uniform(0.1, 9)).tolist()))
            truth[i] = g
    return rows, truth


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], S)


def test_groups_found(spark):
    rows, truth = data()
    rows += rows[:5]
    got = {r.id: r.first_id for r in C.clusters(frame(spark, rows)).collect()}
    first = {}
    for i in sorted(truth):
        first.setdefault(truth[i], i)
    assert got == {i: first[g] for i, g in truth.items()}


def test_unusable_rows_and_copies(spark):
    v, w = [1.0] + [0.0] * 127, [0.0, 1.0] + [0.0] * 126
    rows = [("a", v), ("b", v), ("c", None), ("d", [0.0] * 128), ("e", [float("nan")] * 128), ("f", [1.0] * 64), ("g", w), ("h", [None] * 128), ("i", [float("inf")] + [0.0] * 127)]
    members = C.clusters(frame(spark, rows))
    assert {(r.id, r.first_id) for r in members.collect()} == {("a", "a"), ("b", "a"), ("g", "g")}
    assert [tuple(r) for r in C.found(members).collect()] == [("a", "b")]
    assert C.clusters(frame(spark, [])).collect() == []
    assert C.clusters(frame(spark, rows[2:6])).collect() == []
    assert [(r.id, r.first_id) for r in C.clusters(frame(spark, rows[:1])).collect()] == [("a", "a")]


def brute(x, threshold):
    """Average linkage one pair at a time: the best pair of all is merged until none reaches the threshold."""
    groups, s = [[k] for k in range(len(x))], x @ x.T
    while True:
        pairs = [(s[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups[:i])]
        best = max(pairs, default=(-1,))
        if best[0] < threshold:
            return {frozenset(g) for g in groups}
        groups[best[2]] += groups.pop(best[1])


def continuum(seed, n, dim=6):
    """Vectors without gaps: clusters run into each other, and most hang together in one component."""
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def as_groups(members):
    out = {}
    for r in members.collect():
        out.setdefault(r.first_id, set()).add(int(r.id[1:]))
    return {frozenset(g) for g in out.values()}


def test_equals_brute_force_without_gaps(spark):
    x = continuum(3, 110)
    df = spark.createDataFrame([(f"m{k:03d}", v.tolist()) for k, v in enumerate(x)], "id string, embedding array<double>")
    want = brute(x, 0.72)
    assert 10 < len(want) < 100 and max(map(len, want)) > 3
    assert as_groups(C.clusters(df, dim=6, spread=99)) == want
    assert as_groups(C.clusters(df, dim=6, whole=4, spread=99)) == want  # nearly all by rounds on the cluster


def test_merge_rounds_is_average_linkage():
    for seed in range(6):
        x = continuum(seed, 60)
        label = C.merge_rounds(x.copy(), np.ones(60), 0.6)
        assert {frozenset(np.flatnonzero(label == g).tolist()) for g in np.unique(label)} == brute(x, 0.6)


def test_blocks_skip_no_pair(spark, monkeypatch):
    rows, truth = data(2, 12)
    monkeypatch.setattr(C, "BLOCK", 7)
    got = {r.id: r.first_id for r in C.clusters(frame(spark, rows)).collect()}
    assert len(set(got.values())) == len(set(truth.values()))


def test_calibrated_tables():
    assert 1 == C.tables(1) < C.tables(16) < C.tables(1024)
    rng = np.random.default_rng(2)
    near = C.Pivots(C._unit(rng.normal(size=(64, 128))))
    x = C._unit(rng.normal(size=(500, 128)))
    y = C._unit(0.72 * x + (1 - 0.72**2) ** 0.5 * C._unit(rng.normal(size=(500, 128))))
    met = np.zeros(500, bool)
    for _ in range(C.tables(64)):
        order, sign = rng.permutation(128), rng.choice([-1, 1], 128)
        met |= near.nearest(x[:, order] * sign) == near.nearest(y[:, order] * sign)
    assert met.mean() >= 0.94


def test_two_levels_of_pivots(monkeypatch):
    monkeypatch.setattr(C, "FLAT", 100)
    rng = np.random.default_rng(5)
    p, x = (C._unit(rng.normal(size=(n, 16))).astype(np.float32) for n in (900, 200))
    assert np.mean(C.Pivots(p).nearest(x) == (x @ p.T).argmax(axis=1)) > 0.8


def test_bytes_lose_no_more_than_they_say():
    v = C._unit(np.random.default_rng(4).normal(size=(50, 128))).astype(np.float32)
    scale, lost, q = C._unpacked(C._packed(v, np.int8), 128, np.int8)
    assert np.allclose(np.linalg.norm(v - q * scale[:, None], axis=1), lost, atol=1e-6) and lost.max() < 0.02
    assert np.abs(C._unit_of(C._packed(v, np.int16), 128, np.int16) @ v.T - v @ v.T).max() < 1e-4


def test_stars(spark):
    rnd = np.random.default_rng(1)
    edges = [(f"n{a:03d}", f"n{b:03d}") for a, b in rnd.integers(0, 200, (150, 2)).tolist()] + [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(60)] + [("hub", f"h{k}") for k in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.root for r in stars(spark.createDataFrame([*edges, ("self", "self")], "a string, b string")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def test_summary(spark):
    rows, truth = data(5, 9)
    got = {r.first_id: r for r in C.summary(frame(spark, [*rows, ("zz", rows[0][1]), ("zz", rows[0][1])])).collect()}
    assert sum(r["size"] for r in got.values()) == len(truth) + 1
    assert all(1 <= len(r.typical) <= 3 for r in got.values())
