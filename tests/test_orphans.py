import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tesserae.operators import orphans

T = [dt.datetime(2024, 1, 1) + dt.timedelta(days=k) for k in range(60)]
EDGE = "id string, source_id string, target_id string, created_at timestamp_ntz, loaded_at timestamp_ntz, extra string"
FACT = "id string, source_memory_id string, created_at timestamp_ntz, loaded_at timestamp_ntz"
MEM = "id string, loaded_at timestamp_ntz, family string, block int"  # columns with clashing names


def found(spark, edges, facts, mems, gone):
    frames = [
        spark.createDataFrame([(*e, "x") for e in edges], EDGE), spark.createDataFrame(facts, FACT),
        spark.createDataFrame([(*m, "f", 1) for m in mems], MEM), spark.createDataFrame([(g,) for g in gone], "memory_id string"),
    ]
    return {(r.table_name, r.row_id, r.field_name, r.period, r.reason) for r in orphans.orphan_references(*frames).collect()}


def brute(edges, facts, mems, gone):
    norm = lambda x: None if x is None or not x.strip(" \t") else x.strip(" \t").lower()
    live = {}
    for i, t in mems:
        if norm(i):
            live[norm(i)] = min(t, live.get(norm(i), t))
    for g in gone:
        live.pop(norm(g), None)
    out, first = set(), {}
    for e in edges:
        first[e[0]] = min(e[4], first.get(e[0], e[4]))
    rows = [("edges", e[0], f, r, e[3], first[e[0]]) for e in edges for f, r in (("source_id", e[1]), ("target_id", e[2]))] + [("facts", f[0], "source_memory_id", f[1], f[2], f[3]) for f in facts]
    for t, i, f, r, c, load in rows:
        if norm(r) is None:
            continue
        if norm(r) not in live:
            out.add((t, i, f, c.strftime("%Y-%m"), "missing"))
        elif live[norm(r)] > load:
            out.add((t, i, f, c.strftime("%Y-%m"), "late"))
    return out


def test_cases(spark):
    edges = [
        ("e1", "mem-001", "mem-002", T[5], T[6]), ("e1", "mem-001", "mem-002", T[5], T[40]),  # delivered twice
        ("e2", " MEM-003\t", "mem-999", T[5], T[6]), ("e3", None, " ", T[5], T[6]), ("e4", "memo-001", "mem-0001", T[5], T[6]),
        ("e5", "mem-unknown", "12345678901234567890123", T[5], T[6]), ("e6", "mem-064", "mem-063", T[5], T[6]),
    ]
    facts = [("f1", "mem-005", T[1], T[2]), ("f2", "mem-004", T[1], T[30])]
    mems = [("mem-001", T[0]), ("mem-001", T[50]), ("mem-002", T[20]), ("mem-003", T[0]), ("mem-004", T[10]), ("mem-063", T[0]), ("mem-064", T[0]), ("mem-065", T[0])]
    gone = ["mem-004 "]
    assert found(spark, edges, facts, mems, gone) == brute(edges, facts, mems, gone)


def test_empty(spark):
    assert found(spark, [], [], [("mem-1", T[0])], []) == set()
    assert found(spark, [("e1", "mem-1", None, T[0], T[0])], [], [], []) == {("edges", "e1", "source_id", "2024-01", "missing")}


ids = st.one_of(st.integers(0, 200).map(lambda n: f"mem-{n:04d}"), st.sampled_from(["", "x", "7", "mem-", "MEM-0003", "a1b2"]))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(ids, ids, st.integers(0, 59)), max_size=60), st.lists(st.tuples(ids, st.integers(0, 59)), max_size=120), st.lists(ids, max_size=8))
def test_against_brute_force(spark, refs, mems, gone):
    edges = [(f"e{k}", a, b, T[0], T[t]) for k, (a, b, t) in enumerate(refs)]
    mems = [(i, T[t]) for i, t in mems]
    assert found(spark, edges, [], mems, gone) == brute(edges, [], mems, gone)


def test_one_parent_of_most_rows(spark):
    edges = [(f"e{k}", "mem-0001", f"mem-{k % 7:04d}", T[0], T[1]) for k in range(3000)]
    got = found(spark, edges, [], [("mem-0001", T[0])], [])
    assert got == brute(edges, [], [("mem-0001", T[0])], [])
