import random

from tesserae.llm import tagsets as T

S = "id string, tags array<string>, sid string, n int"  # extra columns with clashing names


def brute(rows, threshold=0.6):
    sets = {}
    for i, tags in rows:
        s = frozenset(x.strip(" \t").lower() for x in tags or () if x and x.strip(" \t"))
        if i is not None and len(s) >= 3:
            sets[i] = s
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def got(spark, rows):
    df = T.similar_pairs(spark.createDataFrame([(*r, "x", 1) for r in rows], S))
    out = [tuple(r) for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_defined_cases(spark):
    rows = [("a", ["x", "y", "z"]), ("a", ["x", "y", "z"]), ("b", [" X", "y\t", "Z", "z", None, " "]), ("c", ["x", "y"]), ("d", None), ("e", []), ("f", ["x", "y", "z", "u", "v"]), ("g", ["x", "y", "z", "u"]), (None, ["x", "y", "z"])]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == set()


def test_recall_against_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(400):
        base = [f"t{rnd.randrange(400)}" for _ in range(rnd.randint(3, 12))] + ["common"]
        rows.append((f"a{k:04d}", base))
        rows.append((f"b{k:04d}", [t for t in base if rnd.random() > 0.2] + [f"t{rnd.randrange(400)}"]))
    want, have = brute(rows), got(spark, rows)
    assert have <= want and len(have) >= 0.99 * len(want)


def test_many_copies(spark):
    rows = [(f"m{k:03d}", ["p", "q", "r"]) for k in range(60)] + [("z", ["p", "q", "r", "s"])]
    assert got(spark, rows) == brute(rows)
    classes = {r.id: (r.class_id, r.links) for r in T.similarity_classes(spark.createDataFrame([(*r, "x", 1) for r in rows], S)).collect()}
    assert classes["m059"] == ("m000", 1) and classes["z"] == ("z", 1)


def test_calibration():
    for n in (10, 10_000, 10**9):
        width, tables, radius = T.calibrate(n)
        assert 1 - (1 - 0.8**width) ** tables >= 0.999 and 0 < radius < T.CODE_BITS // 2
