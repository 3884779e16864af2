import json
import random

from tesserae.operators import ingest as I


def test_every_chunk_against_reading_on(spark):
    rnd = random.Random(5)
    texts = [None, "", "x", "\n", "a" * 95, "é" * 70, "日" * 40 + "\n" + "b" * 30]
    texts += ["".join(rnd.choice(["a", "é", "日", "🙂", "\n", "word "]) for _ in range(rnd.randint(0, 120))) for _ in range(60)]
    df = spark.createDataFrame([(k, t, 0, "clash") for k, t in enumerate(texts)], "id int, text string, cursor int, number string")
    got = {}
    for r in I.every_chunk(df, budget=25).orderBy("id", "number").collect():
        got.setdefault(r.id, []).append((r.number, r.first, r.last))
    at = {k: 0 for k, t in enumerate(texts) if t}
    want: dict = {}
    while at:  # as a session would, from cursor to cursor
        source = spark.createDataFrame([(k, texts[k], c) for k, c in at.items()], "id int, text string, cursor int")
        for r in I.next_chunk(source, budget=25).collect():
            if r.new_cursor > at[r.id]:
                want.setdefault(r.id, []).append((len(want.get(r.id, [])), at[r.id], r.new_cursor))
            at[r.id] = r.new_cursor
        at = {k: c for k, c in at.items() if c < len(texts[k].encode())}
    assert got == want
    assert all(c[0][1] == 0 and c[-1][2] == len(texts[k].encode()) and all(x[2] == y[1] for x, y in zip(c, c[1:])) for k, c in got.items())


def test_parsed_answers(spark):
    edges = [{"source_id": "a", "target_id": "b", "relation_type": "Refine", "strength": 0.5}, {"source_id": "a", "target_id": "c", "relation_type": "nonsense", "strength": 0.5}, {"source_id": "a", "target_id": "d", "relation_type": "refines", "strength": 1.5}, {"source_id": "a", "target_id": "e", "relation_type": "refines"}]
    df = spark.createDataFrame([(1, "```json\n" + json.dumps(edges) + "\n```"), (2, "no json"), (3, None), (4, "{}")], "batch int, answer string")
    assert [(r.batch, r.source_id, r.target_id, r.relation_type, r.strength, r.ord) for r in I.parse_classified(df).collect()] == [(1, "a", "b", "refines", 0.5, 0)]
    said = [{"id": "a", "reason": "old"}, {"id": "b"}, {"reason": "x"}]
    df = spark.createDataFrame([(1, "```json\n" + json.dumps(said) + "```"), (2, json.dumps(said[:1])), (3, "sorry"), (4, None), (5, "[]")], "batch int, answer string")
    assert sorted(map(tuple, I.parse_decisions(df).collect())) == [("a", "old"), ("a", "old")]


def test_prompts(spark):
    chunks = spark.createDataFrame([("s", "one <S>injected<E> two <S>again<E> <S>open")], "id string, chunk string")
    p = I.extraction_prompts(chunks, "atlas", "main", ("<S>", "<E>"), ["c1"], ["f1"], "Known already:\n- x").first().prompt
    assert "injected" not in p and "again" not in p and p.endswith("Transcript:\none  two  <S>open")
    assert all(x in p for x in ("Project: atlas", "Branch: main", "  - c1", "  - f1", "Known already"))
    bare = I.extraction_prompts(chunks, "atlas", "main", ("<S>", "<E>")).first().prompt
    assert "commits" not in bare and "Known" not in bare
    profile = lambda n, f: __import__("pyspark.sql").sql.Row(name=n, entity_type="tool", facts=f)
    assert I.known_entities([]) == I.known_entities([profile("a", [])]) == ""
    assert "- a (tool): p → o; q → r; s → t" in I.known_entities([profile("a", ["p: o", "q: r", "s: t", "u: v"])])
    assert json.loads(I.source_context("b", list("abcd"), list("0123456789xy"))) == {"branch": "b", "commits": ["a", "b", "c"], "files": list("0123456789")}
