import datetime as dt

import pytest
from pyspark.sql import functions as F

from tesserae.functions import decay as D
from tesserae.functions import text as X
from tesserae.operators import ingest, inspect, knowledge, lifecycle, store
from tesserae.operators import surface

NOW = "2024-06-01 00:00:00"
T = dt.datetime(2024, 1, 1)
E = "id string, source_id string, target_id string, relation_type string, strength double, bidirectional boolean, status string"
M = "id string, status string, memory_type string, confidence double, access_count int, pinned boolean, last_accessed_at timestamp_ntz, updated_at timestamp_ntz"


def ids(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "id string")


@pytest.fixture
def edges(spark):
    return spark.createDataFrame([("1", "a", "b", "relates_to", 0.5, False, "active"), ("2", "b", "c", "refines", None, True, "suggested"), ("3", "c", "a", "relates_to", 0.4, False, "archived"), ("4", None, "a", "bogus", 2.0, None, None)], E)


def test_edge_mutations(spark, edges):
    got = lambda df: {r.id: r.status for r in df.collect()}
    assert got(store.archive_edges(edges, ids(spark, "c"))) == {"1": "active", "2": "archived", "3": "archived", "4": None}
    assert set(got(store.delete_edges(edges, ids(spark, "c", None)))) == {"1", "4"}
    new = spark.createDataFrame([("9", "a", "b", "relates_to", 0.5, False, "active"), ("8", "a", "c", "relates_to", 0.5, False, "active"), ("7", "a", "c", "relates_to", 0.6, False, "active"), ("6", "x", "x", "refines", 0.1, False, "active"), ("5", "x", "y", "refines", None, False, "active")], E)
    after = store.insert_edges(edges, new)
    assert after.count() == 5 and after.where("target_id = 'c' and source_id = 'a'").count() == 1
    assert {(r.memory_id, r.edge_id) for r in store.edges_of(edges, ids(spark, "b", "c")).collect()} == {("b", "2"), ("c", "2")}


def test_retype(spark, edges):
    said = spark.createDataFrame([("a", "b", "refines", 0.9, 1), ("a", "b", "contradicts", 0.8, 2), ("b", "c", "refines", 0.9, 1)], "source_id string, target_id string, relation_type string, strength double, ord int")
    got = {r.id: (r.relation_type, r.strength, r.bidirectional, r.status) for r in store.retype_edges(edges, said).collect()}
    assert got["1"] == ("contradicts", 0.8, True, "active") and got["2"] == ("refines", None, True, "suggested")


def test_update_and_insert(spark):
    s = spark.createDataFrame([("a", "x", T), ("b", "y", T)], "id string, v string, updated_at timestamp_ntz")
    after = {r.id: (r.v, r.updated_at) for r in store.update(s, spark.createDataFrame([("a", "z"), ("q", "n")], "id string, v string"), NOW).collect()}
    assert after == {"a": ("z", dt.datetime(2024, 6, 1)), "b": ("y", T)}
    grown = store.insert(s, spark.createDataFrame([("a", "no"), ("c", "new"), ("c", "new")], "id string, v string"), ["id"])
    assert sorted(r.id for r in grown.collect()) == ["a", "b", "c"]


def test_lifecycle_archives_then_prunes_in_one_run(spark):
    rows = [
        ("old", "active", "progress", 0.4, 0, False, T, T), ("pinned", "active", "progress", 0.4, 0, True, T, T), ("hub", "active", "progress", 0.4, 0, False, T, T), ("arch", "archived", "pattern", 0.9, 0, True, T, T),
        ("stable", "active", "decision", 0.2, 0, False, dt.datetime(2024, 5, 10), T), ("fresh", "active", "context", 0.9, 3, False, dt.datetime(2024, 5, 31), T), ("sup", "superseded", "context", 0.1, 0, False, T, T),
    ]
    m = spark.createDataFrame(rows, M)
    e = spark.createDataFrame([("1", "old", "hub", "refines", 1.0, False, "active"), ("2", "fresh", "stable", "refines", 1.0, False, "archived")], E)
    out = lifecycle.run_lifecycle(m, e, NOW)
    assert {r.id: r.after for r in out.collect()} == {"old": "pruned", "pinned": "active", "hub": "active", "arch": "pruned", "stable": "archived", "fresh": "active", "sup": "superseded"}
    assert tuple(lifecycle.counts(out).first())[1:] == (2, 2)
    m2, e2 = lifecycle.apply_lifecycle(m, e, out, NOW)
    assert {r.id for r in e2.collect()} == {"2"} and m2.where("status = 'pruned'").count() == 2


def test_gates():
    t = dt.datetime(2024, 1, 1)
    assert lifecycle.should_run(None, None, t) and lifecycle.should_run(t, t + dt.timedelta(1), t) and not lifecycle.should_run(t, t, t + dt.timedelta(hours=1)) and lifecycle.should_run(t, None, t + dt.timedelta(hours=2))
    assert lifecycle.should_prune(5, 0) and lifecycle.should_prune(0, 50) and not lifecycle.should_prune(4, 60, 50) and lifecycle.should_prune(0, 63, 50)


def test_facts(spark):
    f = spark.createDataFrame([("1", "e", "p", "X", T), ("2", "e", "p", "x", T + dt.timedelta(1)), ("3", "e", "p", "y", T + dt.timedelta(2)), ("4", "e", "p", "x", T + dt.timedelta(3))], "id string, entity_id string, predicate string, object string, at timestamp_ntz")
    got = {r.id: (r.valid_to, r.superseded) for r in knowledge.supersede(f, ["at", "id"], ["entity_id", "predicate"]).collect()}
    assert got == {"1": (T + dt.timedelta(2), None), "3": (T + dt.timedelta(3), "X"), "4": (None, "y")}


def test_chunks_resume_to_the_end(spark):
    texts = ["", "one\ntwo\n", "ä" * 50 + "\n" + "b" * 5, "x\n" * 40, "日本語" * 20, None, "no break at all " * 9]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    state, got = df.withColumn("cursor", F.lit(0).cast("bigint")), {k: "" for k in range(len(texts))}
    for _ in range(30):
        c = ingest.next_chunk(state, budget=31).collect()
        for r in c:
            assert len(r.chunk.encode()) <= 31
            got[r.id] += r.chunk
        state = spark.createDataFrame([(r.id, texts[r.id], r.new_cursor) for r in c], "id int, text string, cursor bigint")
    assert got == {k: t or "" for k, t in enumerate(texts)}


def test_parse_response(spark):
    good = '{"content":"c","summary":"s","memory_type":"pattern","scope":"project","confidence":0.5,"priority":3,"tags":["a"]}'
    bad = good.replace('"priority":3', '"priority":3.5')
    fact = '{"entity_name":" A ","entity_type":"person","predicate":"p","object":"o"}'
    rows = [(1, f"[{good},{bad}]"), (2, f'x\n```json\n{{"memories":[{good}],"entities":[{fact},{{"entity_name":""}}]}}\n```'), (3, "nonsense"), (4, ""), (5, None), (6, '{"memories":3}')]
    got = {r.id: (len(r.memories), [e.entity_name for e in r.entities]) for r in ingest.parse_response(spark.createDataFrame(rows, "id int, response string")).collect()}
    assert got == {1: (1, []), 2: (1, ["A"]), 3: (0, []), 4: (0, []), 5: (0, []), 6: (0, [])}


def test_embedder_failures_stay_with_their_rows(spark):
    def embed(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [[1.0] * (3 if t == "short" else 4) for t in texts]

    df = spark.createDataFrame([(k, t) for k, t in enumerate(["a", "short", "bad", "b"])], "id int, t string").coalesce(1)
    got = {r.id: (r.vector, r.error) for r in ingest.with_embeddings(df, embed, "id", "t", 4, batch=2).collect()}
    assert got[0] == ([1.0] * 4, None) and got[1] == (None, "3 numbers, not 4") and got[2] == (None, "no") and got[3] == (None, "no")


def test_text_scalars(spark):
    df = spark.createDataFrame([("The v1.2 cold-start, of a Cold-Start!",), ("",), (None,)], "t string")
    r = df.select(X.token_set(F.col("t")), X.unigrams(F.col("t")), X.keywords(F.col("t")), X.padded_tokens(F.col("t")), X.estimate_tokens(F.col("t"))).collect()
    assert r[0][0] == ["the", "v1", "2", "cold", "start", "of", "a"] and r[0][1] == ["v1.2", "cold-start"] and r[0][2] == ["v1.2", "cold-start", "v1.2 cold-start"] and r[1][0] == [] and r[1][4] == 0 and r[2][0] is None and r[2][3] == ""
    s = spark.createDataFrame([("code_description", "aSTARTxENDbSTARTcEND START")], "c string, t string").select(X.capitalised(F.col("c")), X.strip_blocks(F.col("t"), "START", "END"), X.project_name(F.lit("/a/b/")), X.project_name(F.lit("/"))).first()
    assert tuple(s) == ("Code Description", "ab START", "b", "unknown")


def test_decay(spark):
    rows = [("progress", 0.8, False, 0, 0.0), ("decision", 0.8, False, 9, 0.0), ("progress", 0.8, True, 0, 0.0), ("pattern", 0.8, False, 3, 1.0)]
    df = spark.createDataFrame(rows, "t string, c double, p boolean, a int, k double").withColumn("at", F.lit("2024-05-25").cast("timestamp_ntz"))
    got = [r[0] for r in df.select(D.decayed(F.col("c"), F.col("p"), F.col("t"), F.col("a"), F.col("k"), F.col("at"), NOW)).collect()]
    assert abs(got[0] - 0.4) < 1e-12 and got[1] == 0.8 and got[2] == 0.8 and abs(got[3] - 0.8 * 0.5 ** (7 / (60 * (1 + 0.3 * 2) * 2))) < 1e-12


def test_inspect_is_zero_filled(spark):
    assert {r.memory_type: r.n for r in inspect.by_type(spark.createDataFrame([("x", "pattern")], "id string, memory_type string")).collect()}["code"] == 0


def test_render():
    from pyspark.sql import Row

    text = surface.render([Row(memory_type="gotcha", summary="mind"), Row(memory_type="pattern", summary="do"), Row(memory_type="gotcha", summary="that")], "main", [Row(name="A", entity_type="person", facts=["p: o"])])
    assert text.index("## Entities") < text.index("## Gotcha") < text.index("- mind") < text.index("- that") < text.index("## Pattern")
    assert surface.cut_to("a\n" * 100, 5).startswith("a\n" * 9) and surface.wrap("  ") == ""


def test_supersede_across_segments(spark):
    import random

    rnd = random.Random(3)
    rows = [(f"{k:03d}", rnd.choice("ef"), "p", rnd.choice(["x", "X", "y"]), T + dt.timedelta(days=rnd.randrange(200))) for k in range(120)]
    want, last = {}, {}
    for i, e, _, o, at in sorted(rows, key=lambda r: (r[4], r[0])):
        prev = last.get(e)
        if prev is None or prev[1].lower() != o.lower():
            want[i] = [None, prev[1] if prev else None]
            if prev:
                want[prev[0]][0] = at
            last[e] = (i, o)
    df = spark.createDataFrame([*rows, ("n", None, "p", "x", T), ("m", "e", "p", "x", None)], "id string, entity_id string, predicate string, object string, at timestamp_ntz")
    for period in ("week", "year"):
        got = {r.id: [r.valid_to, r.superseded] for r in knowledge.supersede(df, ["at", "id"], ["entity_id", "predicate"], period).collect()}
        assert got == want


def test_update_clears_and_never_multiplies(spark):
    s = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, v string, n int")
    twice = spark.createDataFrame([("a", None, 5), ("a", "q", 4)], "id string, v string, n int")
    assert sorted(map(tuple, store.update(s, twice, NOW).collect())) == [("a", "x", 5), ("b", "y", 2)]
    assert sorted(map(tuple, store.update(s, twice, NOW, clear=("v",)).collect())) == [("a", None, 5), ("b", "y", 2)]
    first = store.insert(s, spark.createDataFrame([("c", "z", 9), ("c", "a", 1)], "id string, v string, n int"), ["id"])
    assert [r.v for r in first.where("id = 'c'").collect()] == ["a"]
