import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import similarity as V
from tesserae.operators import similar as S

M = "id string, summary string, content string, local_embedding array<float>, sid string, n int"


def tok(s, c):
    import re

    return {t for t in re.sub(r"[^a-z0-9_]+", " ", f"{s or ''} {c or ''}".lower()).split(" ") if t}


def jac(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def rows(seed, n=120):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        w = [f"w{rnd.randrange(30)}" for _ in range(rnd.randint(0, 12))]
        if out and rnd.random() < 0.5:
            w = out[rnd.randrange(len(out))][2].split()
            if w and rnd.random() < 0.7:
                w[0] = f"v{rnd.randrange(9)}"
        out.append((f"m{k:03d}", rnd.choice(["", "common"]), " ".join(w), None, "x", 1))
    return out


def test_set_join_against_brute_force(spark):
    r = rows(1)
    df = spark.createDataFrame([*r, *r[:3], ("null", None, None, None, "x", 1)], M)
    for t in (0.5, 0.75):
        sets = {}
        for i, s, c, *_ in r:
            if tok(s, c):
                sets.setdefault(frozenset(tok(s, c)), []).append(i)
        names = {k: min(v) for k, v in sets.items()}
        want = {tuple(sorted((names[a], names[b]))) for a in sets for b in sets if a != b and jac(a, b) >= t}
        assert {(x.class_a, x.class_b) for x in S.similar_classes(df, t).collect()} == want
        links = {x.id: x.links for x in S.similar_texts(df, t).collect()}
        assert links == {i: sum(a != b and jac(a, b) >= t for b in sets) for a, ids in sets.items() for i in ids}


def test_empty(spark):
    none = spark.createDataFrame([], M)
    assert S.similar_classes(none).collect() == [] and S.first_duplicates(none, none).collect() == []


def brute_dedup(cands, existing):
    def hyb(p, q):
        if p[4] is not None and q[4] is not None:
            import numpy as np

            a, b = np.array(p[4], float), np.array(q[4], float)
            return float(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b))
        return jac(tok(p[2], p[3]), tok(q[2], q[3]))

    out, kept = {}, {}
    for c in sorted(cands, key=lambda c: (c[5], c[6], c[0])):
        scored = [(hyb(c, e), e[0]) for e in existing if tok(c[2], c[3]) and tok(e[2], e[3]) or (c[4] is not None and e[4] is not None)]
        best = max((s for s, _ in scored), default=0)
        if best >= 0.75:
            out[c[0]] = ("skip", None) if best >= 0.85 else ("merge", min(i for s, i in scored if s == best))
        elif any(hyb(c, k) >= 0.75 for k in kept.get(c[5], [])):
            out[c[0]] = ("skip", None)
        else:
            out[c[0]] = ("keep", None)
            kept.setdefault(c[5], []).append(c)
    return out


def test_deduplicate_against_loop(spark):
    rnd = random.Random(9)
    made = []
    for k in range(70):
        w = [f"w{rnd.randrange(14)}" for _ in range(rnd.randint(4, 8))]
        v = [rnd.gauss(0, 1) for _ in range(2)] + [0.0] * 30 if rnd.random() < 0.4 else None
        made.append((f"m{k:03d}", None, "s", " ".join(w), v, f"b{rnd.randrange(3)}", rnd.randrange(5)))
    cands, existing = made[:45], made[45:]
    schema = "id string, x string, summary string, content string, local_embedding array<double>, batch string, ord int"
    got = {r.id: (r.decision, r.match) for r in S.deduplicate(spark.createDataFrame(cands, schema), spark.createDataFrame(existing, schema)).collect()}
    assert got == brute_dedup(cands, existing)


def test_first_fit_chain(spark):
    items = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")], "a string, b string")
    assert {r.id: r.kept for r in S.first_fit(items, pairs).collect()} == {"a": True, "b": False, "c": True, "d": False, "e": True}


def test_scalars(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], ["a"], []), ([1.0, 2.0], [2.0, 4.0], ["a", "b"], ["b", "c"]), ([1.0], [1.0, 2.0], [], []), (None, [1.0], ["a"], ["a"])], "a array<double>, b array<double>, x array<string>, y array<string>")
    got = [tuple(r) for r in df.select(V.cosine(F.col("a"), F.col("b")), V.jaccard(F.col("x"), F.col("y")), V.hybrid(F.col("x"), F.col("y"), F.col("a"), F.col("b"))).collect()]
    assert got[0] == (0.0, 0.0, 0.0) and abs(got[1][0] - 1) < 1e-12 and got[1][1] == 1 / 3 and got[2] == (None, 1.0, 1.0) and got[3] == (None, 1.0, 1.0)
    marks = [0.05, 0.1, 0.39, 0.4, 0.5, 0.51, 0.6, 0.61]
    s = spark.createDataFrame([(m,) for m in marks], "s double").select(V.classify(F.col("s")).alias("c"), V.prefilter(F.col("s")).alias("p")).collect()
    assert [r.c for r in s] == ["ignore", "relate", "relate", "suggest", "suggest", "consolidate", "consolidate", "consolidate"]
    assert [r.p for r in s] == ["definitely_different", "maybe", "maybe", "maybe", "maybe", "maybe", "maybe", "definitely_similar"]


words = st.lists(st.sampled_from("abcdef"), max_size=5)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(words, words), min_size=1, max_size=20))
def test_jaccard_properties(spark, pairs):
    df = spark.createDataFrame([(list(set(a)), list(set(b))) for a, b in pairs], "a array<string>, b array<string>")
    for r in df.select(V.jaccard(F.col("a"), F.col("b")).alias("x"), V.jaccard(F.col("b"), F.col("a")).alias("y"), V.jaccard(F.col("a"), F.col("a")).alias("z")).collect():
        assert 0 <= r.x <= 1 and r.x == r.y and r.z == 1


def test_auto_edges_of_the_whole_range(spark):
    r = rows(5)
    new, old = r[:20], r[20:]
    edges = spark.createDataFrame([], "source_id string, target_id string, relation_type string")
    got = {(x.source_id, x.target_id): (x.strength, x.status) for x in S.auto_edges(spark.createDataFrame(new, M), spark.createDataFrame(old, M), edges).collect()}
    score = {(a[0], b[0]): jac(tok(*a[1:3]), tok(*b[1:3])) for a in new for b in old if tok(*a[1:3]) and tok(*b[1:3])}
    assert got == {k: (round(v, 6), "suggested" if 0.4 <= v <= 0.5 else "active") for k, v in score.items() if v >= 0.1}
    assert any(v < 0.4 for v, _ in got.values()) and "suggested" in {s for _, s in got.values()}


def test_hybrid_block_paths(spark, monkeypatch):
    from tesserae.operators import blocks

    rnd = random.Random(4)
    made = [(f"m{k:02d}", "s", " ".join(f"w{rnd.randrange(9)}" for _ in range(rnd.randint(0, 6))), [rnd.gauss(0, 1) for _ in range(rnd.choice([2, 2, 3]))] if rnd.random() < 0.6 else None, "x") for k in range(60)]
    made += [("nan", "s", "w1 w2", [float("nan"), 1.0], "x"), ("zero", "s", "w1 w2", [0.0, 0.0], "x"), ("none", None, None, None, "x")]
    df = spark.createDataFrame(made, "id string, summary string, content string, v array<double>, tokens string")

    def score(p, q):
        a, b = (None if r[3] is None or any(x != x for x in r[3]) else r[3] for r in (p, q))
        if a is not None and b is not None and len(a) == len(b):
            n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
            return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0
        j = jac(tok(p[1], p[2]), tok(q[1], q[2]))
        return j if j >= 0.1 else 0.0

    want = {(p[0], q[0]): round(score(p, q), 6) for p in made for q in made if p[0] != q[0] and score(p, q) >= 0.3}
    for at_once in (10_000, 9):
        real = blocks.compare
        monkeypatch.setattr(blocks, "compare", lambda q, r, f, schema, at_once, k=at_once: real(q, r, f, schema, k))
        monkeypatch.setattr(blocks, "ROWS_AT_ONCE", 20)
        assert {(r.cid, r.id): round(r.score, 6) for r in blocks.hybrid(df.unionByName(df), df, 0.3).collect()} == want
        monkeypatch.setattr(blocks, "compare", real)


def test_hot_token_may_be_split(spark):
    """No hand-made partitioning stands before the join on tokens, which would keep AQE from splitting a skewed one."""
    _, classes = S.set_classes(spark.createDataFrame(rows(3), M), S.compared_text())
    assert "REPARTITION_BY" not in S.set_join(classes, classes, 0.5, itself=True)._jdf.queryExecution().executedPlan().toString()


def in_blocks(monkeypatch, at_once=9):
    """Queries are compared in blocks of a few."""
    from tesserae.operators import blocks

    real = blocks.compare
    monkeypatch.setattr(blocks, "compare", lambda q, r, f, schema, at_once, k=at_once: real(q, r, f, schema, k))
    monkeypatch.setattr(blocks, "ROWS_AT_ONCE", 20)


def one_scan(spark, tmp_path, schema=M, made=None):
    """(queries, rows) of one file, as the registered queries take them."""
    spark.createDataFrame(made or rows(5), schema).write.parquet(f"{tmp_path}/m.parquet")
    m = spark.read.parquet(f"{tmp_path}/m.parquet").distinct()
    new = m.where("substring(id, 4) in ('0', '5')")
    return new, m.join(new.select("id"), "id", "left_anti")


def test_hybrid_pairs_in_blocks_of_one_scan(spark, monkeypatch, tmp_path):
    in_blocks(monkeypatch)
    new, old = one_scan(spark, tmp_path, M.replace("sid", "x").replace("n int", "embedding array<float>"), [(*r[:5], None) for r in rows(5)])
    r = rows(5)
    asked = [x for x in r if x[0][3] in "05"]
    score = {tuple(sorted((a[0], b[0]))): jac(tok(*a[1:3]), tok(*b[1:3])) for a in asked for b in r if b not in asked}
    assert {(x.id_a, x.id_b): x.score for x in S.hybrid_pairs(new, old).collect()} == {k: round(v, 6) for k, v in score.items() if v >= 0.5}


def test_deduplicate_in_blocks_of_one_scan(spark, monkeypatch, tmp_path):
    rnd = random.Random(11)
    made = [(f"m{k:03d}", None, "s", " ".join(f"w{rnd.randrange(14)}" for _ in range(rnd.randint(4, 8))), None, f"b{rnd.randrange(3)}", rnd.randrange(5)) for k in range(120)]
    in_blocks(monkeypatch)
    new, old = one_scan(spark, tmp_path, "id string, x string, summary string, content string, local_embedding array<double>, batch string, ord int", made)
    want = brute_dedup([x for x in made if x[0][3] in "05"], [x for x in made if x[0][3] not in "05"])
    assert {r.id: (r.decision, r.match) for r in S.deduplicate(new, old).collect()} == want


def test_sweep_and_prefixes_agree(spark, monkeypatch):
    """Sets of which most share their rarest tokens are swept, in blocks, and both joins find the same."""
    rnd = random.Random(2)
    n = 700
    sizes = [rnd.choice([1, 2, 5, 14, 34, 60, 120]) for _ in range(n)]
    texts = [" ".join(f"w{rnd.randrange(2 * k + 3)}" for _ in range(k)) for k in sizes]
    df = spark.createDataFrame([(f"m{k:03d}", "", x) for k, x in enumerate(texts)], "id string, summary string, content string")
    members, classes = S.set_classes(df, S.compared_text())
    monkeypatch.setattr(S, "_FEW", 0)
    monkeypatch.setattr(S, "SWEPT", 90)
    monkeypatch.setattr(S, "_COLUMNS", 50)
    plan = lambda: S.self_join(members, classes, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan()
    for t in (0.5, 0.75):
        found = [(r.class_a, r.class_b, r.jaccard) for r in S.similar_classes(df, t).collect()]
        with monkeypatch.context() as m:
            m.setattr(S, "_SWEPT_A_MEETING", 0)
            assert "FlatMapGroupsInArrow" not in plan()
            assert sorted(found) == sorted((r.class_a, r.class_b, r.jaccard) for r in S.similar_classes(df, t).collect())
        assert len(found) == len(set(found)) > 10


def test_auto_edges_in_blocks_of_one_scan(spark, monkeypatch, tmp_path):
    in_blocks(monkeypatch)
    edges = spark.createDataFrame([], "source_id string, target_id string, relation_type string")
    r = rows(5)
    asked = [x for x in r if x[0][3] in "05"]
    score = {(a[0], b[0]): jac(tok(*a[1:3]), tok(*b[1:3])) for a in asked for b in r if b not in asked}
    assert {(x.source_id, x.target_id): x.strength for x in S.auto_edges(*one_scan(spark, tmp_path), edges).collect()} == {k: round(v, 6) for k, v in score.items() if v >= 0.1}


def test_links_of_swept_classes(spark, monkeypatch):
    """Copies of a text share a class; both joins give each of them the same links."""
    made = [(i, s, c) for i, s, c, *_ in rows(7)]
    df = spark.createDataFrame([*made, *(("x" + i, s, c) for i, s, c in made)], "id string, summary string, content string")
    monkeypatch.setattr(S, "SWEPT", 20)
    swept = {(r.id, r.class_id): r.links for r in S.similar_texts(df, 0.5).collect()}
    monkeypatch.setattr(S, "_FEW", 0)
    monkeypatch.setattr(S, "_SWEPT_A_MEETING", 0)
    assert swept == {(r.id, r.class_id): r.links for r in S.similar_texts(df, 0.5).collect()}
    assert max(swept.values()) > 1


def test_auto_edges_leaves_out_edges_without_a_join(spark, monkeypatch, tmp_path):
    """Edges there are already stay with the rows compared; the pairs found are not shuffled to leave them out."""
    r = rows(5)
    asked = [x for x in r if x[0][3] in "05"]
    score = {(a[0], b[0]): round(jac(tok(*a[1:3]), tok(*b[1:3])), 6) for a in asked for b in r if b not in asked}
    want = {k: v for k, v in score.items() if v >= 0.1}
    gone = sorted(want)[::3]
    edges = spark.createDataFrame([*((*k, "relates_to") for k in [*gone, *gone[:5]]), *((*k, "supports") for k in want), (gone[0][0], None, "relates_to"), (None, gone[0][1], "relates_to")], "source_id string, target_id string, relation_type string")
    new, old = one_scan(spark, tmp_path)
    for at_once in (10_000, 9):
        in_blocks(monkeypatch, at_once)
        found = S.auto_edges(new, old, edges)
        assert {(x.source_id, x.target_id): x.strength for x in found.collect()} == {k: v for k, v in want.items() if k not in gone}
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().split("InArrow")[0]
        monkeypatch.undo()


def test_sweep_lays_out_only_sets_that_share_a_rare_token(monkeypatch):
    """Less than half as many bitmaps are compared as there are pairs of like size, and nothing similar is missed, in one block or two."""
    import numpy as np

    rnd = random.Random(8)
    words = 400
    sets = [{rnd.randrange(words) for _ in range(rnd.choice([1, 3, 12, 30]))} for _ in range(600)]
    sets += [{*sorted(s)[1:], rnd.randrange(words)} for s in sets[:150]]
    df = np.bincount([w for s in sets for w in s], minlength=words)
    rank = np.empty(words, int)
    rank[np.argsort(df, kind="stable")] = np.arange(words)
    n = np.array([len(s) for s in sets])
    codes = np.concatenate([np.sort(rank[sorted(s)]) for s in sets]).astype(np.int32)
    bits = [np.array([sum({1 << int(rank[w]) % 64 for w in s if rank[w] // 64 % S.WORDS == k}) for s in sets], np.uint64) for k in range(S.WORDS)]
    side = lambda rows: S._Side(n, codes, np.cumsum(n) - n, bits, rows)
    x, a, b = side(np.arange(len(sets))), side(np.arange(0, len(sets), 2)), side(np.arange(1, len(sets), 2))
    monkeypatch.setattr(S, "_PAIRS", 500)
    for t in (0.4, 0.5, 0.75):
        want = {(i, j) for i in range(len(sets)) for j in range(i) if jac(sets[i], sets[j]) >= t}
        for little in (0, 1 << 30):
            monkeypatch.setattr(S, "_LITTLE", little)
            for p, q in ((x, x), (a, a), (b, b), (a, b), (b, a)):
                found = [(max(k), min(k)) for i, j, _ in S._similar(p, q, words, t) for k in zip(p.rows[i].tolist(), q.rows[j].tolist(), strict=True)]
                both = set(p.rows.tolist()), set(q.rows.tolist())
                assert len(found) == len(set(found)) and set(found) == {(i, j) for i, j in want if (i in both[0] and j in both[1]) or (j in both[0] and i in both[1])}
        times = np.diff(S._Postings(x, words, t).at)
        like = sum(min(n[i], n[j]) >= t * max(n[i], n[j]) for i in range(len(sets)) for j in range(i))
        assert (times * (times - 1) / 2).sum() < like / 2


def test_links_leave_tasks_as_counts(spark):
    """Of many similar texts, tasks pass on a count a class and not the pairs."""
    df = spark.createDataFrame([(f"m{k:03d}", "", f"a b c d e f x{k}") for k in range(60)], "id string, summary string, content string")
    found = S.similar_texts(df, 0.5)
    assert {(r.id, r.links) for r in found.collect()} == {(f"m{k:03d}", 59) for k in range(60)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "sid_a" not in plan


def test_blocks_are_written_once_however_many_they_meet(spark, monkeypatch, tmp_path):
    """With more blocks of queries no more rows are shuffled, but for one a block, and all pairs are found."""
    r = rows(5)
    asked = [x for x in r if x[0][3] in "05"]
    want = {(a[0], b[0]): round(jac(tok(*a[1:3]), tok(*b[1:3])), 6) for a in asked for b in r if b not in asked and jac(tok(*a[1:3]), tok(*b[1:3])) >= 0.1}
    edges = spark.createDataFrame([], "source_id string, target_id string, relation_type string")
    new, old = one_scan(spark, tmp_path)
    sc, gate = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def written():
        sc.listenerBus().waitUntilEmpty(10_000)
        stages = sc.statusStore().stageList(None, False, False, gate.new_array(gate.jvm.double, 0), gate.jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    counts = []
    for at_once in (12, 3):
        in_blocks(monkeypatch, at_once)
        found = S.auto_edges(new, old, edges)
        before = written()
        assert {(x.source_id, x.target_id): x.strength for x in found.collect()} == want
        counts.append(written() - before)
        monkeypatch.undo()
    assert counts[1] - counts[0] <= 8


def test_scores_of_edges_are_rounded_where_they_are_found(spark):
    """Halves go away from zero, as SQL has it, and no row is rounded again after it left its task."""
    import numpy as np

    from tesserae.operators import blocks

    made = [k / 128 for k in range(-128, 129)] + [random.Random(3).uniform(-1, 1) for _ in range(2000)]
    want = [r.s for r in spark.createDataFrame([(x,) for x in made], "s double").select(F.round("s", 6).alias("s")).collect()]
    assert blocks._rounded(np.array(made), 6).tolist() == want
    many = [f"w{k}" for k in range(128)]
    df = lambda i, words: spark.createDataFrame([(i, "", " ".join(words), None, "x", 1)], M)
    found = S.auto_edges(df("a", many), df("b", many[:65]), spark.createDataFrame([], "source_id string, target_id string, relation_type string"))
    assert [(r.strength, r.status) for r in found.collect()] == [(0.507813, "active")]
    assert "round(" not in found._jdf.queryExecution().optimizedPlan().toString()
