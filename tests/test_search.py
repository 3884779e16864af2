import sqlite3

import numpy as np
import pytest

from tesserae.operators import blocks as B
from tesserae.operators import search as S

M = "id string, scope string, status string, memory_type string, content string, summary string, tags array<string>, source_context string, score string, r int"
DOCS = [
    ("a", "project", "active", "pattern", "The cold cache keeps stale rows in Zürich", "cold cache", ["cache", "Cold-start"]),
    ("b", "project", "active", "gotcha", "retry the cache; cache again, cold start", "retry", ["net"]),
    ("c", "global", "active", "context", "nothing here", "cold cold cold", None),
    ("d", "project", "archived", "context", "cache cache cache", "cache", []),
    ("e", "global", "active", "decision", "a-b a-b a b a", "phrases", ["foo bar", "baz"]),
    ("f", "global", "active", "decision", "snake_case and foo-bar strasse straße", "", ["x", None]),
    ("g", "project", "active", "decision", "", "", None),
    ("h", "project", "active", "decision", "cold. start near the retry\ncache", "long text " * 300, ["cold start"]),
]


@pytest.fixture(scope="module")
def memories(spark):
    return spark.createDataFrame([(*d, "{}", "x", 1) for d in DOCS], M).drop("score", "r")


@pytest.fixture(scope="module")
def fts():
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table f using fts5(id unindexed, content, summary, tags)")
    import json

    for d in DOCS:
        c.execute("insert into f values (?, ?, ?, ?)", (d[0], d[4], d[5], json.dumps([t for t in d[6] or [] if t])))
    return c


def oracle(c, query, every):
    parts = ['"' + p.replace('"', '""') + '"' for p in query.split()]
    rows = c.execute("select id, rank from f where f match ? order by rank, id", ((" " if every else " OR ").join(parts),)).fetchall()
    active = {d[0] for d in DOCS if d[2] == "active"}
    return [(i, round(-r, 9)) for i, r in rows if i in active]


@pytest.mark.parametrize("every", [True, False])
@pytest.mark.parametrize("query", ["cache", "cold cache", "cold-start retry", "foo-bar", "a-b", "a-b-a", "zurich cold", "strasse", "snake case", "-- cache", "missing cold"])
def test_against_fts5(memories, fts, query, every):
    got = [(r.id, round(r.score, 9)) for r in S.keyword_search(memories, query, 50, every).collect()]
    want = oracle(fts, " ".join(p for p in query.split() if any(ch.isalnum() for ch in p)), every)
    assert sorted(got) == sorted(want)


def test_no_tokens_match_nothing(memories):
    assert S.keyword_search(memories, "-- ??", 5).collect() == []
    assert S.keyword_search(memories.limit(0), "cache", 5).collect() == []


def test_postings(memories):
    index = S.postings(memories)
    rows = {(r.term, r.id, r.column): r.positions for r in index.collect()}
    assert rows[("cache", "b", "content")] == [2, 3]
    stats = {r.term: (r.rows, r.occurrences) for r in S.term_statistics(index).collect()}
    assert stats["cold"] == (4, 9)


def test_prompt_recall_prefers_all_words(memories):
    got = [r.id for r in S.prompt_recall(memories, "cold cache please").collect()]
    assert got[0] in ("a", "b", "h") and set(got) >= {"a", "b", "c"}
    assert S.prompt_recall(memories, "the").collect() == []
    assert "a" not in [r.id for r in S.prompt_recall(memories, "cold cache", surface="shows cold cache already").collect()]


def test_tag_only(memories):
    assert {r.id for r in memories.where(S.tag_only(["net"])).collect()} == {"a", "c", "d", "e", "f", "g", "b", "h"} - set()
    assert S.unigrams_of("Please fix the v1.2 cold-start, cold-start!") == ["fix", "v1.2", "cold-start"]


@pytest.mark.parametrize("at_once", [7, 2000])
def test_nearest_against_numpy(spark, monkeypatch, at_once):
    rnd = np.random.default_rng(1)
    rows = [(f"m{k:03d}", rnd.normal(size=8).tolist()) for k in range(90)] + [("n1", None), ("n2", [0.0] * 8), ("n3", [1.0] * 5), ("m000", None)]
    rows += [("t1", rows[0][1]), ("t2", rows[0][1])]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    monkeypatch.setattr(B, "QUERIES_AT_ONCE", at_once)
    monkeypatch.setattr(B, "ROWS_AT_ONCE", 40)
    got = {}
    for r in B.nearest(df.where("id like 'm00%' and v is not null"), df, 8, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    pool = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if v is not None and len(v) == 8 and any(v)]
    for q, u in pool:
        if q.startswith("m00"):
            best = sorted(((-round(float(u @ v), 9), i) for i, v in pool if i != q))[:4]
            assert got[q] == [i for _, i in best]


def test_merge_and_positions(spark):
    df = spark.createDataFrame([("a", 0.5, "project"), ("a", 0.9, "global"), ("b", 0.7, "global"), ("c", 0.7, "project")], "id string, score double, source string")
    assert [(r.id, r.source) for r in S.merge_results(df, 3).collect()] == [("c", "project"), ("b", "global"), ("a", "project")]
    one = S.position_scores(df.limit(1), [df["id"].asc()]).collect()
    assert one[0].score == 1.0


def test_text_is_never_shuffled(memories):
    counted = S.occurrences(memories, [["cache"], ["cold", "start"]])
    assert set(counted.columns) == {"id", "status", "scope", "_f0", "_f1", "_len"}
    hits = S.bm25(counted, [0], True)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "summary" not in plan
    again = S.keyword_search(memories.unionByName(memories), "cache", 9)  # delivered twice, counted once
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, S.keyword_search(memories, "cache", 9).collect()))
