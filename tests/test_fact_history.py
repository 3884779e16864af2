import datetime as dt
import random

import pytest

from tesserae.operators import fact_history as H

S = "id string, entity_id string, predicate string, object string, valid_from timestamp_ntz, valid_to timestamp_ntz, loaded_at timestamp_ntz, period string"
BASE = dt.datetime(2024, 1, 1)


def brute(rows):
    load, best = {}, {}
    for r in rows:
        load[r[0]] = min(r[6], load.get(r[0], r[6]))
    for i, e, p, o, f, t, _ in rows:
        p, o = (x.strip(" \t").lower() if x else "" for x in (p, o))
        if p and o and f:
            k = (e, p, f)
            best[k] = max(best.get(k, (dt.datetime.min, "", "", None)), (load[i], i, o, t), key=lambda v: v[:2])
    groups = {}
    for (e, p, f), (_, _, o, t) in best.items():
        groups.setdefault((e, p), []).append((f, o, t))
    out = set()
    for (e, p), seq in groups.items():
        seq.sort()
        ends = []
        for k, (f, o, t) in enumerate(seq):
            nxt = seq[k + 1][0] if k + 1 < len(seq) else None
            own = t if t and t > f else None
            ends.append(min((x for x in (own, nxt) if x), default=None))
        cur = None
        for (f, o, _), end in zip(seq, ends):
            if cur and cur[0] == o and cur[2] == f:
                cur[2] = end
            else:
                if cur:
                    out.add((e, p, *cur))
                cur = [o, f, end]
        out.add((e, p, *cur))
    return out


def got(spark, rows, period="month"):
    df = H.fact_history(spark.createDataFrame([(*r, "clash") for r in rows], S), period)
    return {(r.entity_id, r.predicate, r.object, r.valid_from, r.valid_to) for r in df.collect()}


def random_rows(seed, n=300):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        f = BASE + dt.timedelta(days=rnd.randrange(200))
        t = rnd.choice([None, f + dt.timedelta(days=rnd.randrange(-5, 60))])
        rows.append((f"f{k:04d}", rnd.choice(["a", "a", "b"]), rnd.choice(["p", " P\t", "q", None, " "]), rnd.choice(["x", "X ", "y", "z", "", None]), rnd.choice([f, f, f, None]), t, BASE + dt.timedelta(hours=rnd.randrange(5000))))
    return rows + [(*r[:6], r[6] + dt.timedelta(days=9)) for r in rows[:20]]


@pytest.mark.parametrize("seed,period", [(1, "month"), (2, "week"), (3, "year")])
def test_against_brute_force(spark, seed, period):
    rows = random_rows(seed)
    assert got(spark, rows, period) == brute(rows)


def test_empty_and_nulls(spark):
    assert got(spark, []) == set()
    assert got(spark, [("f", "a", None, "x", BASE, None, BASE), ("g", "a", "p", " ", BASE, None, BASE), ("h", "a", "p", "x", None, None, BASE)]) == set()


def test_version_over_many_periods(spark):
    rows = [(f"f{k}", "a", "p", "x", BASE + dt.timedelta(days=30 * k), None, BASE) for k in range(12)]
    assert got(spark, rows) == {("a", "p", "x", BASE, None)}


def test_state_at(spark):
    rows = [("f1", "a", "p", "x", BASE, None, BASE), ("f2", "a", "p", "y", BASE + dt.timedelta(days=40), BASE + dt.timedelta(days=50), BASE), ("f3", "a", "q", "z", BASE + dt.timedelta(days=70), None, BASE)]
    p = H.patches(spark.createDataFrame([(*r, "clash") for r in rows], S))
    c = H.checkpoints(p)
    at = lambda d: {(r.predicate, r.object) for r in H.state_at(p, c, (BASE + dt.timedelta(days=d)).isoformat(" ")).collect()}
    assert at(10) == {("p", "x")}
    assert at(45) == {("p", "y")}
    assert at(55) == set()
    assert at(80) == {("q", "z")}


def test_found_seconds(spark):
    rows = [("f1", "a", "p", "x", dt.datetime(1969, 12, 31, 23, 59, 59), dt.datetime(1970, 1, 1, 0, 0, 1, 900000), BASE)]
    r = H.found(H.fact_history(spark.createDataFrame([(*x, "c") for x in rows], S))).first()
    assert (r.from_s, r.to_s) == (-1, 1)


def stored(spark, path):
    p = H.stored_patches(spark, path)
    return {tuple(r[c] for c in ("entity_id", "predicate", "period", "valid_from", "object", "until", "load", "id")) for r in p.collect()}


def versions(spark, path):
    return {tuple(r[c] for c in ("at", "entity_id", "predicate", "valid_from", "object", "id")) for r in spark.read.parquet(f"{path}/versions").collect()}


def test_appended_equals_rebuilt(spark, tmp_path):
    """A month of updates, with late facts, corrections of old ones and a new attribute, folded in without reading the rest."""
    rows = random_rows(7, 400)
    first = [r for r in rows if r[6] < BASE + dt.timedelta(hours=3000)]
    rest = [r for r in rows if r[6] >= BASE + dt.timedelta(hours=3000)]
    rest += [("late", "a", "p", "late", BASE - dt.timedelta(days=400), None, BASE + dt.timedelta(days=900)), ("new", "n", "p", "x", BASE + dt.timedelta(days=500), None, BASE)]
    frame = lambda r: spark.createDataFrame([(*x, "clash") for x in r], S)
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    H.write_history(frame(rows + rest[-2:]), one)
    H.write_history(frame(first), two)
    H.append_history(frame(rest), two)
    assert stored(spark, one) == stored(spark, two)
    both = H.patches(frame(rows + rest[-2:]))
    c = H.checkpoints(both)
    for day in (-390, 3, 80, 190, 260, 600):
        at = (BASE + dt.timedelta(days=day, hours=5)).isoformat(" ")
        want = {tuple(r) for r in H.state_at(both, c, at).collect()}
        assert {tuple(r) for r in H.stored_state_at(spark, one, at).collect()} == want == {tuple(r) for r in H.stored_state_at(spark, two, at).collect()}, day
    assert versions(spark, one) <= versions(spark, two) | versions(spark, one)
    again = H.reconstruct(*(lambda p: (p, H.checkpoints(p)))(H.stored_patches(spark, two).drop("load", "id")))
    assert {(r.entity_id, r.predicate, r.object, r.valid_from, r.valid_to) for r in again.collect()} == brute(rows + rest[-2:])


def test_append_touches_only_its_periods(spark, tmp_path):
    import os

    path = str(tmp_path / "h")
    frame = lambda r: spark.createDataFrame([(*x, "clash") for x in r], S)
    H.write_history(frame(random_rows(3)), path)
    files = lambda: {d: sorted(os.listdir(f"{path}/patches/{d}")) for d in os.listdir(f"{path}/patches") if "=" in d}
    before = files()
    assert H.append_history(frame([("z", "a", "p", "zz", BASE + dt.timedelta(days=45), None, BASE + dt.timedelta(days=999))]), path) == ["2024-02"]
    after = files()
    assert {d for d in after if after[d] != before.get(d)} == {"period=2024-02"}
    assert ("a", "p", "zz") in {tuple(r) for r in H.stored_state_at(spark, path, "2024-02-15 12:00:00").collect()}
    assert H.append_history(frame([]), path) == []
    empty = str(tmp_path / "none")
    H.write_history(frame([]), empty)
