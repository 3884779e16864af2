"""State of the store: scans, validation, and mutations as functions from state to state.

A mutation returns the next state of a table; persisting it means writing a new snapshot
(``write_snapshot``), which readers pick up by path. Nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae import constants as C
from tesserae.functions.text import summary_of

LIVE = ["active", "suggested"]


def once(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct records over the given columns: rows delivered again fall together."""
    return df.select(*columns).distinct()


# scans and lookups


def with_status(memories: DataFrame, status: str) -> DataFrame:
    return memories.where(F.col("status") == status)


def by_ids(memories: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is among ``ids`` (one column), whatever their status."""
    return memories.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_semi")


def by_file(memories: DataFrame, path: str | Column, memory_type: str) -> DataFrame:
    """Active rows of a type whose JSON context names the file."""
    return memories.where((F.col("status") == "active") & (F.col("memory_type") == memory_type) & (F.get_json_object("source_context", "$.file_path") == path))


def with_vector(memories: DataFrame, column: str) -> DataFrame:
    return memories.where(F.col(column).isNotNull())


def latest_timestamp(memories: DataFrame) -> DataFrame:
    return memories.where(F.col("status").isin("active", "archived")).agg(F.max("created_at").alias("latest"))


def live_edges(edges: DataFrame, relation: str | None = None) -> DataFrame:
    """Active and suggested edges of a valid relation."""
    kept = edges.where(F.col("status").isin(LIVE) & F.col("relation_type").isin(C.RELATIONS))
    return kept.where(F.col("relation_type") == relation) if relation else kept


def edges_of(edges: DataFrame, memory_ids: DataFrame) -> DataFrame:
    """(memory_id, edge_id): live edges that start at a memory, or end there and are bidirectional. One shuffle by end, no disjunctive join."""
    live = edges.where(F.col("status").isin(LIVE))
    ends = live.select(F.col("id").alias("edge_id"), F.explode(F.when(F.col("bidirectional"), F.array("source_id", "target_id")).otherwise(F.array("source_id"))).alias("memory_id"))
    return ends.join(memory_ids.select(F.col(memory_ids.columns[0]).alias("memory_id")).distinct(), "memory_id", "left_semi").select("memory_id", "edge_id").distinct()


def latest_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """One row per session: the latest checkpoint (ties: larger cursor)."""
    latest = checkpoints.groupBy("session_id").agg(F.max(F.struct("extracted_at", "cursor_position", "id")).alias("m"))
    return latest.select("session_id", F.col("m.cursor_position").alias("cursor_position"), F.col("m.extracted_at").alias("extracted_at"))


# validation


def _text(c: str) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def _within(c: str, low: float, high: float) -> Column:
    return F.coalesce(F.col(c).between(low, high), F.lit(False))


def _one_of(c: str, values: list[str]) -> Column:
    return F.coalesce(F.col(c).isin(values), F.lit(False))


def errors(**checks: Column) -> Column:
    """The names of the checks that fail; nulls fail."""
    return F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in checks.items())))


def memory_errors() -> Column:
    return errors(
        id=_text("id"), content=_text("content"), summary=_text("summary"), source_session=_text("source_session"), memory_type=_one_of("memory_type", C.MEMORY_TYPES), scope=_one_of("scope", C.SCOPES),
        source_type=_one_of("source_type", C.SOURCE_TYPES), status=_one_of("status", C.MEMORY_STATUSES), confidence=_within("confidence", 0, 1), priority=_within("priority", 1, 10), access_count=_within("access_count", 0, 2**31 - 1),
    )


def edge_errors() -> Column:
    return errors(
        source_id=_text("source_id"), target_id=_text("target_id"), self_loop=F.coalesce(F.col("source_id") != F.col("target_id"), F.lit(False)), relation_type=_one_of("relation_type", C.RELATIONS),
        strength=_within("strength", 0, 1), status=_one_of("status", C.EDGE_STATUSES),
    )


def checkpoint_errors() -> Column:
    return errors(session_id=_text("session_id"), cursor_position=F.coalesce(F.col("cursor_position") >= 0, F.lit(False)))


def entity_errors() -> Column:
    return errors(id=_text("id"), name=_text("name"), entity_type=_one_of("entity_type", C.ENTITY_TYPES))


def fact_errors() -> Column:
    return errors(
        id=_text("id"), entity_id=_text("entity_id"), predicate=_text("predicate"), object=_text("object"), source_memory_id=_text("source_memory_id"), confidence=_within("confidence", 0, 1), valid_from=F.col("valid_from").isNotNull()
    )


def with_defaults(memories: DataFrame, now: str) -> DataFrame:
    """Trimmed texts and defaults for what may be left out when a memory is made."""
    at = F.lit(now).cast("timestamp_ntz")
    fill = {"pinned": F.lit(False), "access_count": F.lit(0), "status": F.lit("active"), "created_at": at, "updated_at": at, "last_accessed_at": at}
    out = memories.withColumns({c: F.trim(c) for c in ("id", "content", "source_session")} | {"summary": F.trim(F.coalesce("summary", summary_of(F.col("content"))))})
    return out.withColumns({c: F.coalesce(c, v) if c in out.columns else v for c, v in fill.items()})


def sanitise_relation(c: Column) -> Column:
    """The relation meant by a spelling, or null."""
    names = {r: r for r in C.RELATIONS} | C.RELATION_ALIASES
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.lower(F.trim(c)))


# mutations


def insert(state: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The state with those new rows whose key it lacks; of new rows with one key the first by all orderable columns is taken."""
    order = [c for c, kind in new.dtypes if c not in key and not kind.startswith("map")]
    first = new.groupBy(*key).agg(F.min_by(F.struct(*new.columns), F.struct(*order) if order else F.lit(0)).alias("_m")).select("_m.*")
    fresh = first.join(state.select(*key), key, "left_anti").select(*new.columns)
    return state.unionByName(fresh, allowMissingColumns=True)


def insert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Valid new edges whose (source, target, relation) is not taken yet."""
    return insert(edges, new.where(F.size(edge_errors()) == 0), ["source_id", "target_id", "relation_type"])


def delete(state: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    return state.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_anti").select(*state.columns)


def update(state: DataFrame, changes: DataFrame, now: str, key: str = "id", clear: tuple[str, ...] = ()) -> DataFrame:
    """The given columns of ``changes`` set where not null, and ``updated_at`` moved; rows without changes stay as they are.

    In the columns named by ``clear`` null is a value too and is set. Of several changes to one key the
    least counts, so that no row is multiplied.
    """
    fields = [c for c in changes.columns if c != key]
    once = changes.groupBy(key).agg(F.min(F.struct(*fields)).alias("_m") if fields else F.lit(True).alias("_m"))
    renamed = once.select(F.col(key), F.lit(True).alias("_hit"), *(F.col(f"_m.{c}").alias(f"_new_{c}") for c in fields))
    joined = state.join(renamed, key, "left")
    hit = F.coalesce("_hit", F.lit(False))
    values = {c: F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)) if c in clear else F.coalesce(f"_new_{c}", c) for c in fields}
    if "updated_at" in state.columns and fields:
        values["updated_at"] = F.when(hit, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("updated_at"))
    return joined.withColumns(values).select(*state.columns)


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(edge id): edges with either end among ``ids``."""
    ends = edges.select("id", F.explode(F.array("source_id", "target_id")).alias("end"))
    return ends.join(ids.select(F.col(ids.columns[0]).alias("end")).distinct(), "end", "left_semi").select("id").distinct()


def archive_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges at the given memories archived."""
    hit = touching(edges, ids).withColumn("_hit", F.lit(True))
    return edges.join(hit, "id", "left").withColumn("status", F.when(F.col("_hit"), "archived").otherwise(F.col("status"))).select(*edges.columns)


def delete_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the edges at the given memories."""
    return edges.join(touching(edges, ids), "id", "left_anti").select(*edges.columns)


def vacuum(memories: DataFrame, edges: DataFrame, facts: DataFrame, now: str, days: int = C.VACUUM_DAYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Memories pruned and untouched for ``days`` removed, with their edges and facts."""
    limit = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    gone = memories.where((F.col("status") == "pruned") & (F.col("updated_at") < limit)).select("id")
    return delete(memories, gone), delete_edges(edges, gone), delete(facts, gone, "source_memory_id")


def save_checkpoint(checkpoints: DataFrame, new: DataFrame) -> DataFrame:
    """Checkpoints with those of ``new`` in place of their sessions' old ones."""
    return checkpoints.join(new.select("session_id").distinct(), "session_id", "left_anti").select(*checkpoints.columns).unionByName(new)


def upsert_entities(entities: DataFrame, new: DataFrame) -> DataFrame:
    """Entities with those of ``new`` whose (lower name, type) is unknown; known ones keep their aliases."""
    key = [F.lower("name").alias("_k"), "entity_type"]
    fresh = new.withColumn("_k", F.lower("name")).dropDuplicates(["_k", "entity_type"]).join(entities.select(*key).distinct(), ["_k", "entity_type"], "left_anti").drop("_k")
    return entities.unionByName(fresh, allowMissingColumns=True)


def hit_access(memories: DataFrame, hits: DataFrame, now: str) -> DataFrame:
    """One more access, now, for the memories among ``hits``."""
    marked = hits.select(F.col(hits.columns[0]).alias("id")).distinct().withColumn("_hit", F.lit(True))
    joined = memories.join(marked, "id", "left")
    return joined.withColumns(
        {"access_count": F.when(F.col("_hit"), F.col("access_count") + 1).otherwise(F.col("access_count")), "last_accessed_at": F.when(F.col("_hit"), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("last_accessed_at"))}
    ).select(*memories.columns)


def merge_pairs(memories: DataFrame, pairs: DataFrame, session: str) -> DataFrame:
    """The merged memory of each pair (a, b): the higher priority's type (ties: a's), tags of both, the stronger flags, full confidence.

    ``pairs`` has columns a, b, summary, content. Columns: id (of the pair), and the merged fields.
    """
    side = lambda x: memories.select(F.col("id").alias(x), F.struct("memory_type", "scope", "priority", "pinned", "tags", "embedding").alias(f"{x}_"))
    m = pairs.join(side("a"), "a").join(side("b"), "b")
    higher = F.when(F.col("b_.priority") > F.col("a_.priority"), F.col("b_.memory_type")).otherwise(F.col("a_.memory_type"))
    none = F.array().cast("array<string>")
    return m.select(
        F.concat_ws("+", "a", "b").alias("id"), "a", "b", F.col("content"), F.col("summary"), higher.alias("memory_type"),
        F.when((F.col("a_.scope") == "global") | (F.col("b_.scope") == "global"), "global").otherwise("project").alias("scope"),
        F.lit(1.0).alias("confidence"), F.greatest("a_.priority", "b_.priority").alias("priority"), (F.col("a_.pinned") | F.col("b_.pinned")).alias("pinned"),
        F.array_distinct(F.concat(F.coalesce("a_.tags", none), F.coalesce("b_.tags", none))).alias("tags"), F.coalesce("a_.embedding", "b_.embedding").alias("embedding"),
        F.lit(0).alias("access_count"), F.lit("active").alias("status"), F.lit(session).alias("source_session"),
    )


def supersede_pairs(memories: DataFrame, edges: DataFrame, merged: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """After merging: both originals superseded, their edges gone, and a ``supersedes`` edge from the merged memory to each."""
    old = merged.select("id", F.explode(F.array("a", "b")).alias("old"))
    state = update(memories, old.select(F.col("old").alias("id"), F.lit("superseded").alias("status")).distinct(), now)
    links = old.select(
        F.concat_ws(">", "id", "old").alias("id"), F.col("id").alias("source_id"), F.col("old").alias("target_id"), F.lit("supersedes").alias("relation_type"), F.lit(1.0).alias("strength"), F.lit(False).alias("bidirectional"), F.lit("active").alias("status")
    )
    return state, delete_edges(edges, old.select("old")).unionByName(links, allowMissingColumns=True)


def index_code(memories: DataFrame, edges: DataFrame, new: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Newly indexed files (file_path, prose_id, code_id) supersede earlier active rows of their files, and link prose to code."""
    path = F.get_json_object("source_context", "$.file_path")
    mine = new.select("prose_id").unionByName(new.select(F.col("code_id").alias("prose_id")))
    earlier = memories.where((F.col("status") == "active") & F.col("memory_type").isin("code", "code_description")).withColumn("file_path", path)
    old = earlier.join(new.select("file_path").distinct(), "file_path", "left_semi").select("id").join(mine.select(F.col("prose_id").alias("id")), "id", "left_anti")
    state = update(memories, old.withColumn("status", F.lit("superseded")), now)
    links = new.select(
        F.concat_ws(">", "prose_id", "code_id").alias("id"), F.col("prose_id").alias("source_id"), F.col("code_id").alias("target_id"), F.lit("source_of").alias("relation_type"), F.lit(1.0).alias("strength"), F.lit(False).alias("bidirectional"), F.lit("active").alias("status")
    )
    return state, insert_edges(edges, links)


def retype_edges(edges: DataFrame, classified: DataFrame) -> DataFrame:
    """``relates_to`` edges re-typed by an outside classifier (source_id, target_id, relation_type, strength; of repeated pairs the last by ``ord``).

    Re-typed edges become bidirectional and active, unless their new key is taken; then they stay.
    """
    w = Window.partitionBy("source_id", "target_id").orderBy(F.desc("ord"))
    last = classified.withColumn("r", F.row_number().over(w)).where("r = 1").select("source_id", "target_id", F.col("relation_type").alias("_type"), F.col("strength").alias("_strength"))
    taken = edges.select("source_id", "target_id", F.col("relation_type").alias("_type"), F.lit(True).alias("_taken")).distinct()
    joined = edges.join(last, ["source_id", "target_id"], "left").join(taken, ["source_id", "target_id", "_type"], "left")
    change = (F.col("relation_type") == "relates_to") & F.col("_type").isin(C.RELATIONS) & (F.col("_type") != "relates_to") & F.col("_taken").isNull() & F.col("_strength").between(0, 1)
    hit = F.coalesce(change, F.lit(False))
    return joined.withColumns(
        {
            "relation_type": F.when(hit, F.col("_type")).otherwise(F.col("relation_type")), "strength": F.when(hit, F.col("_strength")).otherwise(F.col("strength")),
            "bidirectional": hit | F.col("bidirectional"), "status": F.when(hit, "active").otherwise(F.col("status")),
        }
    ).select(*edges.columns)


def forget(memories: DataFrame, edges: DataFrame, ids: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """The given memories archived, whatever their status, with their edges."""
    marked = ids.select(F.col(ids.columns[0]).alias("id")).distinct().withColumn("status", F.lit("archived"))
    return update(memories, marked, now), archive_edges(edges, ids)


def write_snapshot(state: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """The state written as a new snapshot; an existing path is an error, so no reader ever sees a half-written one change."""
    w = state.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
