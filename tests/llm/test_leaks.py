import random
import re

from tesserae.llm import leaks as L

D, I = "doc_id bigint, text string, term string, pos int", "item_id bigint, suite string, text string, answer string"


def words(t):
    return [w.lower() for w in re.findall(r"[^\W_]+", t or "")]


def brute(docs, items, n=12):
    grams = lambda t: {tuple(words(t)[k : k + n]) for k in range(len(words(t)) - n + 1)}
    g = {i: grams(t) for i, t in items}
    return {(d, i) for d, t in docs for i, s in g.items() if s & grams(t)}


def frames(spark, docs, items):
    return spark.createDataFrame([(d, t, "x", 0) for d, t in docs], D), spark.createDataFrame([(i, "s", t, "a") for i, t in items], I)


def got(spark, docs, items):
    return {tuple(r) for r in L.leaked(*frames(spark, docs, items)).collect()}


def case(seed):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(12)] + ["the", "of"]
    make = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(make(rnd.randint(5, 40)))) for k in range(12)]
    docs = []
    for d in range(60):
        w = make(rnd.randint(0, 60))
        src = words(rnd.choice(items)[1])
        a = rnd.randrange(len(src))
        piece = src[a : a + rnd.randint(8, 16)]
        if rnd.random() < 0.3 and len(piece) > 4:
            piece[3] = "zz"
        at = rnd.randint(0, len(w))
        docs.append((d, " -- ".join(w[:at] + [p.upper() for p in piece] + w[at:])))
    return docs, items


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs, items = case(seed)
        assert got(spark, docs, items) == brute(docs, items)


def test_defined_cases(spark):
    twelve = " ".join(f"a{k}" for k in range(12))
    items = [(1, twelve), (1, twelve), (2, " ".join(["x"] * 12)), (3, "too short"), (4, None), (5, ""), (6, "pre " + twelve)]
    docs = [(1, twelve), (2, twelve.replace("a5", "b5")), (3, None), (4, ""), (5, " ".join(["X"] * 30)), (6, "y, ".join(twelve.split())), (7, twelve.replace(" ", "_\n")), (8, twelve), (9, " ".join(["x"] * 11))]
    assert got(spark, docs, items) == brute(docs, items) == {(1, 1), (1, 6), (5, 2), (7, 1), (7, 6), (8, 1), (8, 6)}
    assert got(spark, [], items) == set() and got(spark, docs, []) == set()


def test_terms_in_parts(spark, monkeypatch):
    docs, items = case(3)
    monkeypatch.setattr(L, "TERMS_AT_ONCE", 5)
    assert got(spark, docs, items) == brute(docs, items)


def brute_near(docs, items, share=0.75, window=L.WINDOW, slack=L.SLACK):
    out = {}
    for d, text in docs:
        w = L.words(text)
        stretches = [set(w[k : k + window + slack]) for k in range(max(1, len(w) - window - slack + 1))]
        for i, item in items:
            v = L.words(item)
            for k in range(len(v) - window + 1):
                asked = set(v[k : k + window])
                best = max((len(asked & s) / len(asked) for s in stretches), default=0)
                if best >= share - 1e-9:
                    out[d, i] = max(out.get((d, i), 0), round(best, 6))
    return out


def near(spark, docs, items):
    return {(r.doc_id, r.item_id): r.share for r in L.near_leaks(*frames(spark, docs, items)).collect()}


def test_near(spark):
    w = [f"a{k}" for k in range(12)]
    docs = [
        (1, " ".join(w[:6] + ["zz"] + w[7:])), (2, "nothing of it"), (3, " ".join(w[:1] + ["put", "in"] + w[1:])), (4, " ".join(w[:4] + w[6:])), (5, " ".join(reversed(w))), (6, " ".join(w[:8])), (7, None),
        (8, " ".join(w[:6] + ["far"] * 9 + w[6:])),
    ]
    got = near(spark, docs, [(1, " ".join(w)), (2, "short"), (3, None)])
    # one word replaced, two put in, two left out, turned round; eight words are too few, and six on either side too far apart
    assert got == {(1, 1): 0.916667, (3, 1): 1.0, (4, 1): 0.833333, (5, 1): 1.0}


def test_near_against_brute_force(spark):
    rnd = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(10, 30)))) for k in range(12)]
    docs = []
    for d in range(60):
        w = [rnd.choice(vocabulary[:40]) for _ in range(rnd.randint(0, 40))]
        if d % 3:
            piece = L.words(rnd.choice(items)[1])[:14]
            for _ in range(rnd.randint(0, 4)):
                k = rnd.randrange(len(piece))
                piece[k : k + 1] = rnd.choice([[], [f"new{d}"], [piece[k], "extra"]])
                piece = piece or ["x"]
            w[5:5] = piece
        docs.append((d, " ".join(w)))
    want = brute_near(docs, items)
    assert len(want) > 15 and near(spark, docs, items) == want
