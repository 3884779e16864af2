"""One function per command. Each takes the state of the store and gives results, and the next state where it changes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tesserae import constants as C
from tesserae.functions.decay import branch_of
from tesserae.functions.text import cache_key, embedding_text, line_range, summary_of
from tesserae.operators import graph, ingest, inspect as inspecting, knowledge, lifecycle as cycle, ranking, search, similar, store, surface
from tesserae.sources.tables import cut, records, table


@dataclass(frozen=True)
class State:
    """The tables of a store; both scopes live in one, told apart by ``scope``."""

    memories: DataFrame
    edges: DataFrame
    entities: DataFrame
    facts: DataFrame
    checkpoints: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> State:
        """The tables at ``path``, each record once however often it was delivered."""
        return cls(*(records(table(spark, path, t)) for t in ("memories", "edges", "entities", "facts", "extraction_checkpoints")))

    def save(self, path: str) -> None:
        for name, df in zip(("memories", "edges", "entities", "facts", "extraction_checkpoints"), (self.memories, self.edges, self.entities, self.facts, self.checkpoints), strict=True):
            store.write_snapshot(df, f"{path}/{name}.parquet")


def guarded(s: State, change: Callable[[State], State], path: str) -> tuple[State, str | None]:
    """(state after ``change``, error): the state is written to ``path`` before, and where the change fails it is read back from there."""
    s.save(path)
    try:
        return change(s), None
    except Exception as e:  # whatever fails, the store must stand as it was
        return State.load(s.memories.sparkSession, path), str(e)


def recall(s: State, query: str, vector: list[float] | None = None, limit: int = C.RECALL_LIMIT, branch: str | None = None, now: str | None = None) -> tuple[DataFrame, State]:
    """The best memories for a query with what they are linked to; their accesses are counted if ``now`` is given."""
    hits = search.recall(s.memories, s.edges, query, vector, limit=limit, branch=branch)
    return hits, replace(s, memories=store.hit_access(s.memories, hits.select("id"), now)) if now else s


def prompt_recall(s: State, prompt: str, vector: list[float] | None = None, shown: str | None = None) -> DataFrame:
    return search.prompt_recall_with_fallback(s.memories, prompt, vector, surface=shown)


def remember(s: State, new: DataFrame, now: str) -> tuple[DataFrame, State]:
    """(id, duplicate_of) of memories entered by hand (id, content, memory_type, scope, priority, tags, source_session), and the state with those that are none.

    Duplicates are looked for by words among the active memories of the same scope.
    """
    made = new.withColumns({"summary": summary_of(F.col("content")), "confidence": F.lit(1.0), "source_type": F.lit("manual"), "source_context": F.lit("{}")})
    made = store.with_defaults(made, now)
    valid = made.where(F.size(store.memory_errors()) == 0)
    found = None
    for scope in C.SCOPES:
        there = s.memories.where((F.col("status") == "active") & (F.col("scope") == scope))
        part = similar.first_duplicates(valid.where(F.col("scope") == scope), there)
        found = part if found is None else found.unionByName(part)
    outcome = valid.select("id").join(found.select(F.col("cid").alias("id"), F.col("id").alias("duplicate_of")), "id", "left")
    fresh = valid.join(outcome.where("duplicate_of is null").select("id"), "id", "left_semi")
    return outcome, replace(s, memories=store.insert(s.memories, fresh, ["id"]))


def forget(s: State, now: str, ids: DataFrame | None = None, query: str | None = None, limit: int = 10) -> tuple[DataFrame, State]:
    """Archives the given memories; by query only if it has a single hit, else the hits are candidates to choose from."""
    if ids is None:
        ids = search.keyword_search(s.memories, query or "", limit).select("id")
        if len(ids.take(2)) != 1:
            return ids, s
    memories, edges = store.forget(s.memories, s.edges, ids, now)
    return ids, replace(s, memories=memories, edges=edges)


def consolidate(s: State, threshold: float = C.CONSOLIDATION, asked: DataFrame | None = None) -> DataFrame:
    """(id_a, id_b, score): pairs of similar active memories by hybrid similarity, most similar first, to be reviewed.

    All active memories are compared with all, block against block; ``asked`` (one id column) restricts one
    side. For copies by words alone ``similar.similar_texts`` gives classes instead of pairs.
    """
    active = s.memories.where(F.col("status") == "active")
    return similar.hybrid_pairs(active if asked is None else store.by_ids(active, asked), active, threshold)


def merge(s: State, pairs: DataFrame, session: str, now: str) -> State:
    """Reviewed pairs (a, b, summary, content) merged, their originals superseded."""
    merged = store.merge_pairs(s.memories, pairs, session)
    memories, edges = store.supersede_pairs(s.memories, s.edges, merged, now)
    rows = store.with_defaults(merged.drop("a", "b").withColumns({"source_type": F.lit("manual"), "source_context": F.lit("{}")}), now)
    return replace(s, memories=store.insert(memories, rows, ["id"]), edges=edges)


def index_code(s: State, files: DataFrame, session: str, now: str) -> State:
    """Files (file_path, text, description, first, last) indexed as prose and code; earlier rows of the same files are superseded."""
    f = files.withColumn("prose_id", F.concat_ws(":", F.lit("prose"), F.sha2(F.concat_ws("|", "file_path", "description", "text"), 256))).withColumn("code_id", F.concat_ws(":", F.lit("code"), F.sha2(F.concat_ws("|", "file_path", "text", "description"), 256)))
    context = F.to_json(F.struct(F.lit("code_index").alias("source"), "file_path", F.col("first").alias("start_line"), F.col("last").alias("end_line")))
    code = F.when(F.col("first").isNull(), F.col("text")).otherwise(line_range(F.col("text"), F.col("first"), F.coalesce("last", F.size(F.split("text", "\n", -1)))))
    shared = {"source_type": F.lit("code_index"), "source_session": F.lit(session), "source_context": context, "scope": F.lit("project"), "confidence": F.lit(1.0)}
    kinds = (("prose_id", "code_description", F.col("description"), 7), ("code_id", "code", code, 5))
    rows = None
    for key, kind, content, priority in kinds:
        part = f.select(F.col(key).alias("id"), F.lit(kind).alias("memory_type"), content.alias("content"), summary_of(F.col("description")).alias("summary"), F.lit(priority).alias("priority"), *(v.alias(k) for k, v in shared.items()))
        rows = part if rows is None else rows.unionByName(part)
    memories, edges = store.index_code(s.memories, s.edges, f.select("file_path", "prose_id", "code_id"), now)
    return replace(s, memories=store.insert(memories, store.with_defaults(rows, now), ["id"]), edges=edges)


def lifecycle(s: State, now: str) -> tuple[DataFrame, State]:
    """What a lifecycle run does (decayed, archived, pruned), and the state after it and after vacuuming."""
    outcome = cycle.run_lifecycle(s.memories, s.edges, now)
    memories, edges = cycle.apply_lifecycle(s.memories, s.edges, outcome, now)
    memories, edges, facts = store.vacuum(memories, edges, s.facts, now)
    return cycle.counts(outcome), replace(s, memories=memories, edges=edges, facts=facts)


def lifecycle_if_needed(s: State, now: str, last_run: datetime | None) -> tuple[DataFrame | None, State]:
    """As ``lifecycle`` if there is a memory newer than the last run, or that is too long ago or never was; else (None, state)."""
    latest = store.latest_timestamp(s.memories).first().latest
    return lifecycle(s, now) if cycle.should_run(last_run, latest, datetime.fromisoformat(now)) else (None, s)


_JUDGE = """Below are memories, one a line: id | type | confidence | accesses | PIN if pinned | day | summary.
Name those that can be archived: said again by another line, overtaken by a newer one, done with, of one session only, or common knowledge.
Never name pinned ones, ones of the last three days with a confidence of 0.7 or more, or architecture and decision memories of 0.8 or more. When in doubt keep.
Answer with a JSON list of {"id", "reason"} and nothing else; [] if there is none.

"""


def ai_prune(s: State, ask: Callable[[str], str], now: str) -> State:
    """Batches of active memories shown to an outside judge, and those it names archived, unless pinned or unknown."""
    active = s.memories.where(F.col("status") == "active")
    if len(active.take(C.PRUNE_LEAST)) < C.PRUNE_LEAST:
        return s
    pin = F.when(F.col("pinned"), F.lit("PIN"))
    line = F.concat_ws(" | ", "id", "memory_type", F.concat(F.lit("conf="), F.format_number("confidence", 2)), F.concat(F.lit("acc="), "access_count"), pin, F.date_format("created_at", "yyyy-MM-dd"), F.substring("summary", 1, 140))
    lines = graph.batches(active.select("id", line.alias("line")), "id", C.PRUNE_BATCH).groupBy("batch")
    prompts = lines.agg(F.concat(F.lit(_JUDGE), F.array_join(F.sort_array(F.collect_list("line")), "\n")).alias("prompt"))  # PRUNE_BATCH lines each
    answers = cut(ingest.with_answers(prompts, ask, "batch", "prompt")).where("error is null")
    memories, edges = cycle.apply_decisions(s.memories, s.edges, ingest.parse_decisions(answers), now)
    return replace(s, memories=memories, edges=edges)


def ai_prune_if_needed(s: State, ask: Callable[[str], str], now: str, sessions: int, active_at_last: int = 0) -> tuple[bool, State]:
    """(whether the judge was asked, state): after enough sessions since it last was, or enough more active memories than then."""
    n = s.memories.where(F.col("status") == "active").count()
    return (True, ai_prune(s, ask, now)) if cycle.should_prune(sessions, n, active_at_last) else (False, s)


def traverse(s: State, start: DataFrame, depth: int = C.TRAVERSAL_DEPTH, types: list[str] | None = None, direction: str = "both", least: float = 0.0) -> DataFrame:
    """(root, id, depth, path, summary): existing memories reached from the starts."""
    if not 0 <= depth <= 10 or not 0 <= least <= 1 or direction not in ("both", "outgoing", "incoming") or any(t not in C.RELATIONS for t in types or []):
        raise ValueError("depth 0..10, strength 0..1, a known direction and known relations, please")
    return graph.traverse(store.live_edges(s.edges), start, depth, types, direction, least).join(s.memories.select("id", "summary").dropDuplicates(["id"]), "id")


def inspect(s: State) -> DataFrame:
    return inspecting.telemetry(s.memories, s.edges, s.entities, s.facts)


def backfill(s: State, embed: Callable[[list[str]], list[list[float]]], column: str, dim: int, project: str, now: str) -> tuple[DataFrame, State]:
    """(id, error) of active memories without a vector, and the state with those that could be embedded."""
    queue = s.memories.where((F.col("status") == "active") & F.col(column).isNull()).select("id", embedding_text(F.col("memory_type"), F.col("summary"), project).alias("text"))
    made = cut(ingest.with_embeddings(queue, embed, "id", "text", dim))  # asked once, whatever is lost
    kind = dict(s.memories.dtypes)[column]
    return made.select("id", "error"), replace(s, memories=store.update(s.memories, made.where("error is null").select("id", F.col("vector").cast(kind).alias(column)), now))


_CLASSIFY = f"""Each line below is a pair of memories: their ids, and their summaries a and b.
Say how a relates to b: one of {', '.join(C.RELATIONS)}; relates_to if nothing closer holds. strength is 0 to 1.
Answer with a JSON list of {{"source_id", "target_id", "relation_type", "strength"}} and nothing else.

"""


def semantic_edges(s: State, classify: Callable[[str], str]) -> State:
    """``relates_to`` edges shown to an outside classifier in batches, and re-typed as it says."""
    text = s.memories.select("id", "summary").dropDuplicates(["id"])
    e = store.live_edges(s.edges, "relates_to").select("id", "source_id", "target_id")
    both = e.join(text.select(F.col("id").alias("source_id"), F.col("summary").alias("a")), "source_id").join(text.select(F.col("id").alias("target_id"), F.col("summary").alias("b")), "target_id")
    line = F.to_json(F.struct("source_id", "target_id", "a", "b"))
    lines = graph.batches(both.select("id", line.alias("line")), "id", C.CLASSIFY_BATCH).groupBy("batch")
    prompts = lines.agg(F.concat(F.lit(_CLASSIFY), F.array_join(F.sort_array(F.collect_list("line")), "\n")).alias("prompt"))  # CLASSIFY_BATCH lines each
    answers = cut(ingest.with_answers(prompts, classify, "batch", "prompt")).where("error is null")
    said = ingest.parse_classified(answers.select("batch", "answer")).withColumn("ord", F.struct("batch", "ord"))
    return replace(s, edges=store.retype_edges(s.edges, said))


def entity_query(s: State, query: str, history: bool = False, limit: int = 5) -> DataFrame:
    """The facts, each with its source, of the entities of exactly this name, or else of those that match it; ``history``: ended ones too."""
    exact = knowledge.entity_by_name(s.entities, query)
    found = exact if not exact.isEmpty() else search.search_entities(s.entities, query, limit)
    return knowledge.entity_answer(s.facts, s.memories, found.select("id", "name"), history)


def generate(s: State, branch: str, now: str, stale_hours: float | None = None) -> str:
    """The surface text of a branch: the best active memories within the budgets, under known entities."""
    active = s.memories.where(F.col("status") == "active")
    ranked = ranking.ranked(active, graph.centrality(store.live_edges(s.edges)), branch, now)
    few = ranking.select_for_surface(ranked)
    tagged = few.join(active.select("id", "tags"), "id", "left").orderBy(F.desc("rank"), "id")
    selected: list[Row] = tagged.collect()  # bounded by the token budget
    known: list[Row] = knowledge.profiles(s.entities, s.facts, C.MAX_ENTITIES).collect()
    return surface.render(selected, branch, known, stale_hours)


def cache_surface(cache: DataFrame, text: str, branch: str, cwd: str, now: str) -> DataFrame:
    """The cache with a surface in place of the branch's and folder's old one."""
    row = cache.sparkSession.createDataFrame([(branch, cwd, text)], "branch string, cwd string, surface string")
    row = row.withColumns({"key": cache_key(F.col("branch"), F.col("cwd")), "generated_at": F.lit(now).cast("timestamp_ntz")})
    return cache.where(F.col("key") != cache_key(F.lit(branch), F.lit(cwd))).unionByName(row.select(*cache.columns))


def load_surface(cache: DataFrame, branch: str, cwd: str, now: str) -> DataFrame:
    """(surface, stale): a cached surface (key, branch, cwd, surface, generated_at); older than a day it is stale but still given."""
    mine = cache.where((F.col("key") == cache_key(F.lit(branch), F.lit(cwd))) & (F.col("branch") == branch) & (F.col("cwd") == cwd))
    age = F.timestamp_diff("SECOND", F.col("generated_at"), F.lit(now).cast("timestamp_ntz"))
    return mine.select("surface", (age > 86400).alias("stale"))


def extract(
    s: State, transcripts: DataFrame, ask: Callable[[str], str], branch: str, now: str, project: str = "unknown", commits: list[str] = (), files: list[str] = (),
    embed: Callable[[list[str]], list[list[float]]] | None = None, dim: int = 32,
) -> tuple[DataFrame, State]:
    """New transcript text (session_id, text) turned into memories and facts by an outside model.

    Per session: read on from the checkpoint within the byte budget, take out blocks that were put in from the
    store, ask with branch, commits, files and known entities, parse, embed (if an embedder is given; a failing
    one leaves words to compare by), drop and merge duplicates, insert, link to similar memories, supersede
    facts, and move the cursor (also if the model failed). Answers and vectors are written once and never
    asked for again. Gives (session_id, kept, merged, skipped, error).
    """
    at = store.latest_checkpoints(s.checkpoints).select("session_id", F.col("cursor_position").alias("cursor"))
    source = transcripts.join(at, "session_id", "left").withColumn("id", F.col("session_id"))
    chunks = cut(ingest.next_chunk(source))
    known = ingest.known_entities(knowledge.profiles(s.entities, s.facts, C.KNOWN_ENTITIES).collect())  # KNOWN_ENTITIES rows
    prompts = ingest.extraction_prompts(chunks.where("chunk <> ''"), project, branch, (surface.START, surface.END), commits, files, known)
    answers = cut(ingest.with_answers(prompts, ask, "id", "prompt"))
    parsed = cut(ingest.parse_response(answers.select("id", F.coalesce("answer", F.lit("")).alias("response"))))
    new = parsed.select(F.col("id").alias("batch"), F.posexplode("memories").alias("ord", "m")).select("batch", "ord", "m.*")
    kind = dict(s.memories.dtypes)["local_embedding"]
    new = new.withColumns({"id": F.concat_ws(":", "batch", F.lit(now), "ord"), "source_session": F.col("batch"), "source_type": F.lit("extraction"), "source_context": F.lit(ingest.source_context(branch, commits, files))})
    if embed is None:
        new = new.withColumn("local_embedding", F.lit(None).cast(kind))
    else:
        texts = new.select("id", embedding_text(F.col("memory_type"), F.col("summary"), project).alias("text"))
        vectors = cut(ingest.with_embeddings(texts, embed, "id", "text", dim)).select("id", F.col("vector").cast(kind).alias("local_embedding"))
        new = new.join(vectors, "id", "left")
    active = s.memories.where(F.col("status") == "active")
    decided = cut(similar.deduplicate(new, active, dim=dim))
    kept = new.join(decided.where("decision = 'keep'").select("id"), "id", "left_semi")
    joined = new.select(F.col("id"), "content").join(decided.where("decision = 'merge'").select("id", "match"), "id")
    appended = joined.groupBy("match").agg(F.array_join(F.sort_array(F.collect_list("content")), "\n---\n").alias("more"))  # an incoming batch's texts for one memory
    grown = s.memories.join(appended, F.col("id") == F.col("match")).select("id", F.concat_ws("\n---\n", "content", "more").alias("content"))
    memories = store.update(s.memories, grown, now)
    rows = store.with_defaults(kept.drop("batch", "ord").withColumn("priority", F.col("priority").cast("int")), now)
    links = similar.auto_edges(kept, active, s.edges, dim=dim).withColumns({"id": F.concat_ws(">", "source_id", "target_id"), "relation_type": F.lit("relates_to"), "bidirectional": F.lit(True)})
    said = parsed.select(F.col("id").alias("batch"), F.posexplode("entities").alias("ord", "e")).select("batch", "ord", "e.*")
    entities = store.upsert_entities(s.entities, said.select(F.concat_ws(":", F.lower("entity_name"), "entity_type").alias("id"), F.col("entity_name").alias("name"), "entity_type"))
    own = entities.select(F.col("id").alias("entity_id"), F.lower("name").alias("_n"), "entity_type")
    stamp = F.lit(now).cast("timestamp_ntz")
    incoming = said.join(own, (F.lower("entity_name") == F.col("_n")) & (said["entity_type"] == own["entity_type"])).select(F.concat_ws(":", "batch", F.lit(now), "ord").alias("id"), "entity_id", "predicate", "object", stamp.alias("at"), F.lit(True).alias("fresh"))
    standing = knowledge.current(s.facts).select("id", "entity_id", "predicate", "object", F.col("valid_from").alias("at"), F.lit(False).alias("fresh"))
    stream = standing.unionByName(incoming).withColumn("_p", F.lower("predicate"))
    after = knowledge.supersede(stream, ["at", "fresh", "id"], ["entity_id", "_p"])
    ended = after.where(~F.col("fresh") & (F.col("valid_to") == stamp)).select("id", "valid_to")
    added = after.where("fresh").select("id", "entity_id", "predicate", "object", F.lit(0.7).alias("confidence"), F.col("at").alias("valid_from"), "valid_to", stamp.alias("created_at"))
    facts = store.update(s.facts, ended, now).unionByName(added, allowMissingColumns=True)
    moved = chunks.select(F.concat_ws(":", "id", F.lit(now)).alias("id"), F.col("id").alias("session_id"), F.col("new_cursor").alias("cursor_position"), stamp.alias("extracted_at"))
    tally = new.select("batch", "id").join(decided, "id").groupBy("batch").agg(*(F.count_if(F.col("decision") == d).alias(n) for d, n in (("keep", "kept"), ("merge", "merged"), ("skip", "skipped"))))
    zero = F.lit(0).cast("bigint")
    report = chunks.select(F.col("id").alias("session_id")).join(tally.withColumnRenamed("batch", "session_id"), "session_id", "left").join(answers.select(F.col("id").alias("session_id"), "error"), "session_id", "left")
    report = report.select("session_id", *(F.coalesce(c, zero).alias(c) for c in ("kept", "merged", "skipped")), "error")
    state = State(store.insert(memories, rows, ["id"]), store.insert_edges(s.edges, links), entities, facts, store.save_checkpoint(s.checkpoints, moved))
    return report, state


def maintenance(
    s: State, now: str, branch: str, classify: Callable[[str], str] | None = None, judge: Callable[[str], str] | None = None,
    last_run: datetime | None = None, sessions: int = 0, active_at_last: int = 0,
) -> tuple[str, State]:
    """Edges re-typed, lifecycle and pruning if they are due, surface written; outside models only where given."""
    s = semantic_edges(s, classify) if classify else s
    _, s = lifecycle_if_needed(s, now, last_run)
    if judge:
        _, s = ai_prune_if_needed(s, judge, now, sessions, active_at_last)
    return generate(s, branch, now), s


def branch_memories(s: State, branch: str) -> DataFrame:
    return s.memories.where(branch_of(F.col("source_context")) == branch)
