import random
from collections import deque

from tesserae.operators import graph as G

E = "id string, source_id string, target_id string, relation_type string, strength double, bidirectional boolean, status string, depth int"


def frame(spark, edges):
    return spark.createDataFrame([(*e, True, "active", 0) for e in edges], E)


def bfs(edges, start, depth, types, direction, least):
    adj = {}
    for i, s, t, r, w in sorted(edges):
        if (types is None or r in types) and (w or 0) >= least and s and t:
            if direction != "incoming":
                adj.setdefault(s, []).append((0, i, t))
            if direction != "outgoing":
                adj.setdefault(t, []).append((1, i, s))
    seen, out, todo = {start}, {}, deque([(start, 0, [])])
    while todo:
        n, k, path = todo.popleft()
        if k == depth:
            continue
        for _, i, m in sorted(adj.get(n, [])):
            if m not in seen:
                seen.add(m)
                out[m] = (k + 1, path + [i])
                todo.append((m, k + 1, path + [i]))
    return out


def test_traverse_against_bfs(spark):
    rnd = random.Random(5)
    edges = [(f"e{k:03d}", f"n{rnd.randrange(25)}", f"n{rnd.randrange(25)}", rnd.choice(["refines", "relates_to"]), rnd.choice([None, 0.2, 0.9])) for k in range(60)] + [("x1", "n1", "n1", "refines", 1.0), ("x2", None, "n2", "refines", 1.0)]
    df = frame(spark, edges)
    starts = spark.createDataFrame([("n1",), ("n2",), ("none",), ("n1",), (None,)], "id string")
    for args in ((3, None, "both", 0.0), (2, ["refines"], "outgoing", 0.5), (4, None, "incoming", 0.0)):
        got = {}
        for r in G.traverse(df, starts, *args).collect():
            got.setdefault(r.root, {})[r.id] = (r.depth, list(r.path))
        for s in ("n1", "n2"):
            assert got.get(s, {}) == bfs(edges, s, *args)
        assert "none" not in got
    assert G.traverse(df, starts, 0).collect() == []


def test_centrality(spark):
    df = frame(spark, [("1", "a", "h", "refines", 1.0), ("2", "b", "h", "refines", 1.0), ("3", "h", "a", "refines", 1.0), ("4", "a", None, "refines", 1.0)])
    assert {r.id: (r.in_degree, r.centrality) for r in G.centrality(df).collect()} == {"h": (2, 1.0), "a": (1, 0.5)}
    assert G.centrality(frame(spark, [])).collect() == []


def test_batches(spark):
    df = spark.createDataFrame([(f"{k:04d}",) for k in range(205)], "id string")
    got = {r.id: r.batch for r in G.batches(df, "id", 50).collect()}
    assert got == {f"{k:04d}": k // 50 for k in range(205)}


def test_related(spark):
    df = frame(spark, [("1", "a", "code", "source_of", 1.0), ("2", "a", "b", "refines", 1.0), ("3", "b", "c", "refines", 1.0), ("4", "c", "d", "refines", 1.0), ("5", "a", "gone", "refines", 1.0)])
    mem = spark.createDataFrame([(x,) for x in ("a", "b", "c", "d", "code")], "id string")
    got = G.related(df, mem.where("id = 'a'"), mem).collect()
    assert got[0].related == ["code", "b", "c"]
