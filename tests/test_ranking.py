import random

from tesserae import constants as C
from tesserae.operators import ranking as R

S = "id string, memory_type string, summary string, rank double, lines string"


def make(seed, n=80):
    rnd = random.Random(seed)
    return [(f"m{k:03d}", rnd.choice(C.MEMORY_TYPES), "\n".join("x" * rnd.randint(0, 60) for _ in range(rnd.randint(1, 8))), rnd.choice([0.1, 0.5, round(rnd.random(), 3)])) for k in range(n)]


def lines(t):
    return t.count("\n") + 1


def tokens(t):
    return -(-len(t) // 4)


def loop(rows, target, most):
    ranked = sorted((r for r in rows if r[1] != "code"), key=lambda r: (-r[3], r[0]))
    used, total, one = {}, 0, []
    for r in ranked:
        if used.get(r[1], 0) >= C.LINE_BUDGETS[r[1]]:
            continue
        if total + tokens(r[2]) > most:
            break
        one.append(r[0])
        used[r[1]] = used.get(r[1], 0) + lines(r[2])
        total += tokens(r[2])
        if total >= target:
            break
    two = []
    if total < target:
        for r in ranked:
            if r[0] in one:
                continue
            if total + tokens(r[2]) > most:
                break
            two.append(r[0])
            total += tokens(r[2])
            if total >= target:
                break
    return {**{i: 1 for i in one}, **{i: 2 for i in two}}


def test_selection_against_loop(spark):
    for seed, target, most in ((1, 1300, 1800), (2, 60, 90), (3, 5000, 5200), (4, 300, 310)):
        rows = [r for r in make(seed) if r[1] != "code"]
        df = spark.createDataFrame([(*r, "clash") for r in rows], S)
        assert {r.id: r["pass"] for r in R.select_for_surface(df, target, most).collect()} == loop(rows, target, most), seed
    assert R.select_for_surface(spark.createDataFrame([], S)).collect() == []


def allocate(rows, budgets, overflow):
    groups = {}
    for r in sorted(rows, key=lambda r: (-r[3], r[0])):
        groups.setdefault(r[1], []).append(r)
    one, rest, left = [], [], sum(budgets.values())
    for t, rs in groups.items():
        n, k = 0, 0
        for k, r in enumerate(rs):
            if n + lines(r[2]) > budgets[t]:
                rest += rs[k:]
                break
            n += lines(r[2])
            one.append(r[0])
        left -= n
    out = {i: 1 for i in one}
    if overflow:
        for r in sorted(rest, key=lambda r: (-r[3], r[0])):
            if lines(r[2]) <= left:
                out[r[0]] = 2
                left -= lines(r[2])
    return out


def test_allocation_against_loop(spark):
    for seed in (1, 2, 3):
        rows = make(seed)
        budgets = {t: random.Random(seed).randint(0, 12) for t in C.MEMORY_TYPES}
        df = spark.createDataFrame([(*r, "clash") for r in rows], S)
        for overflow in (True, False):
            assert {r.id: r["pass"] for r in R.allocate_budget(df, budgets, overflow).collect()} == allocate(rows, budgets, overflow)


def test_fixed_values():
    """Every constant that must equal its published value, written out once more."""
    assert C.LINE_BUDGETS == {"architecture": 25, "decision": 25, "pattern": 25, "gotcha": 20, "progress": 30, "context": 15, "code_description": 10, "code": 0}
    assert (C.IGNORE_BELOW, C.RELATE_BELOW, C.SUGGEST_TO, C.SIMILAR_ABOVE, C.DIFFERENT_BELOW) == (0.1, 0.4, 0.5, 0.6, 0.1)
    assert (C.DEDUP, C.INTRA_BATCH, C.MERGE_CEILING, C.CONSOLIDATION) == (0.75, 0.75, 0.85, 0.5)
    assert (C.PREFILTER_LIMIT, C.MIN_COSINE, C.KEYWORD_OVERLAP_WEIGHT, C.RECALL_LIMIT, C.TRAVERSAL_DEPTH) == (100, 0.25, 0.3, 10, 2)
    assert (C.PROMPT_MIN_TOKENS, C.PROMPT_LIMIT, C.AND_MIN, C.AND_MAX, C.FALLBACK_MIN_UNIGRAMS, C.FALLBACK_COSINE, C.FALLBACK_LIMIT) == (2, 5, 2, 6, 4, 0.65, 3)
    assert (C.W_CONFIDENCE, C.W_PRIORITY, C.W_CENTRALITY, C.W_ACCESS, C.BRANCH_BOOST, C.RECENCY_DAYS) == (0.5, 0.2, 0.15, 0.15, 0.1, 14.0)
    assert (C.SURFACE_TARGET, C.SURFACE_MAX, C.RENDER_MAX) == (1300, 1800, 2000) and C.HALF_LIVES == {"pattern": 60, "gotcha": 45, "context": 30, "progress": 7}
    assert (C.ARCHIVE_BELOW, C.ARCHIVE_DAYS, C.PRUNE_DAYS, C.VACUUM_DAYS, C.HUB_ABOVE, C.LIFECYCLE_FALLBACK_HOURS) == (0.3, 14, 30, 90, 0.5, 2.0)
    assert (C.PRUNE_SESSIONS, C.PRUNE_MEMORIES, C.PRUNE_GROWTH, C.PRUNE_LEAST, C.PRUNE_BATCH) == (5, 50, 1.25, 8, 80)
    assert (C.EMBED_BATCH, C.CLASSIFY_BATCH, C.TRANSCRIPT_BYTES, C.MAX_ENTITIES, C.MAX_FACTS, C.KNOWN_ENTITIES) == (100, 10, 100_000, 5, 3, 20)
    assert len(C.STOP_WORDS) == 128 and len(set(C.STOP_WORDS)) == 128
