import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tesserae import api

D = "/root/testdata/sf0.001"
NOW = "2026-01-01 00:00:00"


@pytest.fixture(scope="module")
def state(spark):
    s = api.State.load(spark, D)
    return api.State(s.memories.cache(), s.edges.cache(), s.entities.cache(), s.facts.cache(), s.checkpoints.cache())


def test_recall_counts_accesses(state):
    hits, after = api.recall(state, "cache", now=NOW)
    n = hits.count()
    assert 0 < n <= 10
    before = {r.id: r.access_count for r in state.memories.select("id", "access_count").collect()}
    assert sum(r.access_count - before[r.id] for r in after.memories.select("id", "access_count").collect()) == n


def test_remember_forget(spark, state):
    new = spark.createDataFrame([("new1", "The harbour ledger must be closed before the tide turns", "decision", "project", 7, ["tide"], "s1"), ("new2", "", "decision", "project", 7, None, "s1")], "id string, content string, memory_type string, scope string, priority int, tags array<string>, source_session string")
    outcome, after = api.remember(state, new, NOW)
    assert [(r.id, r.duplicate_of) for r in outcome.collect()] == [("new1", None)]
    assert after.memories.count() == state.memories.count() + 1
    again, _ = api.remember(after, new.withColumn("id", F.concat("id", F.lit("b"))), NOW)
    assert [(r.id, r.duplicate_of) for r in again.collect()] == [("new1b", "new1")]
    gone, last = api.forget(after, NOW, query="harbour tide")
    assert [r.id for r in gone.collect()] == ["new1"] and last.memories.where("id = 'new1' and status = 'archived'").count() == 1


def test_lifecycle_generate_inspect(state):
    counts, after = api.lifecycle(state, NOW)
    assert counts.first().pruned >= 0 and after.memories.count() <= state.memories.count()
    text = api.generate(state, "main", NOW)
    assert "# Memory: main" in text and "## Entities" in text
    assert {r.measure for r in api.inspect(state).collect()} >= {"memories", "edges", "facts"}


def test_extract(spark, state):
    def ask(prompt):
        if "boom" in prompt:
            raise RuntimeError("down")
        m = {"content": "Basalt arches carry the eastern viaduct now", "summary": "viaduct", "memory_type": "decision", "scope": "project", "confidence": 0.8, "priority": 5, "tags": []}
        return json.dumps({"memories": [m, m], "entities": [{"entity_name": "Viaduct", "entity_type": "tool", "predicate": "made_of", "object": "basalt"}]})

    t = spark.createDataFrame([("sess-new", "hello\nworld\n"), ("sess-bad", "boom\n")], "session_id string, text string")
    report, after = api.extract(state, t, ask, "main", NOW)
    assert {(r.session_id, r.kept, r.skipped, r.error) for r in report.collect()} == {("sess-new", 1, 1, None), ("sess-bad", 0, 0, "down")}
    assert after.memories.count() == state.memories.count() + 1
    assert after.facts.where("object = 'basalt' and valid_to is null").count() == 1
    cur = {r.session_id: r.cursor_position for r in after.checkpoints.collect()}
    assert cur["sess-new"] == 12 and cur["sess-bad"] == 5


def test_outside_models(state):
    judged = api.ai_prune(state, lambda p: json.dumps([{"id": p.split("\n\n")[1].split(" | ")[0], "reason": "old"}, {"id": "nobody", "reason": "x"}]), NOW)
    assert judged.memories.where("status = 'archived'").count() > state.memories.where("status = 'archived'").count()

    def classify(p):
        e = json.loads(p.split("\n\n")[1].split("\n")[0])
        return "```json\n" + json.dumps([{"source_id": e["source_id"], "target_id": e["target_id"], "relation_type": "Refine", "strength": 0.7}]) + "\n```"

    after = api.semantic_edges(state, classify)
    assert after.edges.where("relation_type = 'refines'").count() > state.edges.where("relation_type = 'refines'").count()
    errors, filled = api.backfill(state, lambda texts: [[1.0] * 32 for _ in texts], "local_embedding", 32, "atlas", NOW)
    assert errors.where("error is not null").count() == 0 and filled.memories.where("status = 'active' and local_embedding is null").count() == 0


def test_index_code_and_merge(spark, state):
    files = spark.createDataFrame([("src/x.py", "l1\nl2\nl3", "does x", 2, 3)], "file_path string, text string, description string, first int, last int")
    one = api.index_code(state, files, "s", NOW)
    code = one.memories.where("memory_type = 'code' and content = 'l2\nl3'")
    assert code.count() == 1 and one.edges.count() == state.edges.count() + 1
    two = api.index_code(one, files.withColumn("text", F.lit("l1\nl2\nnew")), "s", NOW)
    assert two.memories.where("status = 'superseded'").count() == one.memories.where("status = 'superseded'").count() + 2
    a, b = (r.id for r in state.memories.where("status = 'active'").orderBy("id").limit(2).collect())
    merged = api.merge(state, spark.createDataFrame([(a, b, "s", "c")], "a string, b string, summary string, content string"), "s", NOW)
    assert merged.memories.where(F.col("id").isin(a, b) & (F.col("status") == "superseded")).count() == 2 and merged.edges.where("relation_type = 'supersedes'").count() >= 2


def test_traverse_entity_surface_cache(spark, state):
    start = state.edges.select(F.col("source_id").alias("id")).limit(1)
    assert api.traverse(state, start, 1).count() >= 0
    with pytest.raises(ValueError):
        api.traverse(state, start, 11)
    some = state.facts.where("valid_to is null").orderBy("id").first()
    name = state.entities.where(F.col("id") == some.entity_id).first().name
    assert some.id in {r.fact_id for r in api.entity_query(state, name).collect()}
    cache = spark.createDataFrame([], "branch string, cwd string, surface string, key string, generated_at timestamp_ntz")
    cache = api.cache_surface(cache, "old", "main", "/p", "2025-12-01 00:00:00")
    cache = api.cache_surface(cache, "text", "main", "/p", "2025-12-30 00:00:00")
    assert [tuple(r) for r in api.load_surface(cache, "main", "/p", NOW).collect()] == [("text", True)]
    assert [tuple(r) for r in api.load_surface(cache, "main", "/p", "2025-12-30 20:00:00").collect()] == [("text", False)]
    assert api.load_surface(cache, "other", "/p", NOW).collect() == []


def test_snapshots(spark, state, tmp_path):
    api.State(state.memories.limit(3), state.edges.limit(2), state.entities.limit(1), state.facts.limit(1), state.checkpoints.limit(1)).save(str(tmp_path / "s1"))
    assert api.State.load(spark, str(tmp_path / "s1")).memories.count() == 3
    with pytest.raises(Exception):
        state.save(str(tmp_path / "s1"))


def test_rollback(spark, state, tmp_path):
    small = api.State(state.memories.limit(3), state.edges.limit(2), state.entities.limit(1), state.facts.limit(1), state.checkpoints.limit(1))

    def broken(s):
        raise RuntimeError("half way")

    back, error = api.guarded(small, broken, str(tmp_path / "before"))
    assert error == "half way" and back.memories.count() == 3
    after, error = api.guarded(small, lambda s: api.State(s.memories.limit(1), s.edges, s.entities, s.facts, s.checkpoints), str(tmp_path / "again"))
    assert error is None and after.memories.count() == 1


def test_due_or_not(state):
    latest = state.memories.agg(F.max("created_at")).first()[0]
    assert api.lifecycle_if_needed(state, str(latest), latest)[0] is None
    counts, _ = api.lifecycle_if_needed(state, NOW, None)
    assert counts.first().decayed > 0
    asked, _ = api.ai_prune_if_needed(state, lambda p: "[]", NOW, sessions=5)
    assert asked and not api.ai_prune_if_needed(state, lambda p: "[]", NOW, sessions=0, active_at_last=10**6)[0]


def test_extraction_prompt_and_vectors(spark, state):
    seen = []

    def ask(prompt):
        assert "feature-x" in prompt and "  - c1" in prompt and "  - a.py" in prompt and "Known already:" in prompt and "shown before" not in prompt, prompt
        m = {"content": "Obsidian ledger kept apart", "summary": "ledger", "memory_type": "decision", "scope": "project", "confidence": 0.8, "priority": 5, "tags": []}
        return json.dumps({"memories": [m], "entities": []})

    def embed(texts):
        if any("ledger" not in t for t in texts):
            raise RuntimeError(texts)
        return [[1.0] + [0.0] * 31 for _ in texts]

    t = spark.createDataFrame([("sess-v", "hello <!-- MEMORY_START -->shown before<!-- MEMORY_END --> world\n")], "session_id string, text string")
    report, after = api.extract(state, t, ask, "feature-x", NOW, "atlas", ["c1", "c2", "c3", "c4"], ["a.py"], embed)
    assert [(r.kept, r.error) for r in report.collect()] == [(1, None)], seen
    new = after.memories.where("source_session = 'sess-v'").first()
    assert new.local_embedding[0] == 1.0 and json.loads(new.source_context) == {"branch": "feature-x", "commits": ["c1", "c2", "c3"], "files": ["a.py"]}


def test_raw_tables_give_each_record_once(spark):
    s = api.State.load(spark, D)
    assert s.memories.count() == s.memories.select("id").distinct().count()
    assert [tuple(r) for r in api.lifecycle(s, NOW)[0].collect()] == [tuple(r) for r in entry.queries()["lifecycle_counts"](spark, D).collect()]


def test_entry_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
