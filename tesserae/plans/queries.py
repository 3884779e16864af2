"""Registered queries over the given tables, each beside its SQL where SQL can state it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import api
from tesserae import constants as C
from tesserae.functions import decay as D
from tesserae.functions import similarity as S
from tesserae.functions import text as X
from tesserae.operators import blocks, graph, ingest, inspect, knowledge, lifecycle, ranking, search, similar, store
from tesserae.plans import sql_text as Q
from tesserae.plans.sql_text import NOW
from tesserae.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


class Tables:
    """The distinct records of a directory's tables, over the columns asked for."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    def __getattr__(self, name: str) -> Callable[..., DataFrame]:
        def read(*columns: str) -> DataFrame:
            df = table(self.spark, self.d, name)
            return store.once(df, *columns) if columns else df

        return read


MEM, EDG = Q.memories, Q.edges
EDGE_COLUMNS = ("id", "source_id", "target_id", "relation_type", "strength", "bidirectional", "status")
_PINNED = MEM("id", "pinned")
_LIVE = "status in ('active', 'suggested')"
_FIFTIETH = "try_cast(regexp_extract(id, '[0-9]+$') as bigint) % 50 = 0"


def fiftieth(df: DataFrame) -> DataFrame:
    """The stated query set: rows whose id number is divisible by 50."""
    return df.where(F.regexp_extract("id", "([0-9]+)$", 1).try_cast("bigint") % 50 == 0)


# scans and lookups


@query("select distinct id, memory_type, summary from memories where status = 'active'")
def scan_active(spark, d):
    return store.with_status(Tables(spark, d).memories("id", "memory_type", "summary", "status"), "active").drop("status")


@query("select distinct id, memory_type, summary from memories where status = 'archived'")
def scan_archived(spark, d):
    return store.with_status(Tables(spark, d).memories("id", "memory_type", "summary", "status"), "archived").drop("status")


@query("select distinct id, status, scope from memories where id in (select target_id from edges where relation_type = 'supersedes')")
def memories_by_ids(spark, d):
    t = Tables(spark, d)
    return store.by_ids(t.memories("id", "status", "scope"), t.edges("target_id", "relation_type").where("relation_type = 'supersedes'").select("target_id"))


@query(f"select distinct {Q.json_at('source_context', 'file_path')} file_path, memory_type, id from memories where status = 'active' and memory_type in ('code', 'code_description') and {Q.json_at('source_context', 'file_path')} is not null")
def indexed_by_file(spark, d):
    m = Tables(spark, d).memories("id", "status", "memory_type", "source_context")
    path = F.get_json_object("source_context", "$.file_path")
    rows = store.by_file(m, path, "code").unionByName(store.by_file(m, path, "code_description"))
    return rows.select(path.alias("file_path"), "memory_type", "id")


@query("select distinct id, status, len(embedding) dim from memories where embedding is not null")
def with_embedding(spark, d):
    return store.with_vector(Tables(spark, d).memories(), "embedding").select("id", "status", F.size("embedding").alias("dim")).distinct()


@query("select distinct id, len(local_embedding) dim from memories where local_embedding is not null and id in (select source_id from edges where relation_type = 'source_of')")
def with_embedding_by_ids(spark, d):
    t = Tables(spark, d)
    rows = store.with_vector(t.memories(), "local_embedding").select("id", F.size("local_embedding").alias("dim")).distinct()
    return store.by_ids(rows, t.edges("source_id", "relation_type").where("relation_type = 'source_of'").select("source_id"))


@query("select max(created_at) latest from memories where status in ('active', 'archived')")
def latest_timestamp(spark, d):
    return store.latest_timestamp(Tables(spark, d).memories("id", "status", "created_at"))


@query(f"""select distinct m.id memory_id, e.id edge_id from {_PINNED} m join edges e on (e.source_id = m.id or (e.target_id = m.id and e.bidirectional)) where m.pinned and e.{_LIVE}""")
def edges_for_memory(spark, d):
    t = Tables(spark, d)
    return store.edges_of(t.edges(*EDGE_COLUMNS), t.memories("id", "pinned").where("pinned").select("id"))


@query(f"select distinct id, source_id, target_id, relation_type from edges where {_LIVE} and relation_type in ({Q.RELATIONS})")
def all_edges(spark, d):
    return store.live_edges(Tables(spark, d).edges("id", "source_id", "target_id", "relation_type", "status")).drop("status").distinct()


@query(f"select distinct id, source_id, target_id from edges where {_LIVE} and relation_type = 'relates_to'")
def relates_to_edges(spark, d):
    return store.live_edges(Tables(spark, d).edges("id", "source_id", "target_id", "relation_type", "status"), "relates_to").select("id", "source_id", "target_id").distinct()


@query("select session_id, arg_max(cursor_position, (extracted_at, cursor_position, id)) cursor_position, max(extracted_at) extracted_at from extraction_checkpoints group by 1")
def latest_checkpoints(spark, d):
    return store.latest_checkpoints(Tables(spark, d).extraction_checkpoints("id", "session_id", "cursor_position", "extracted_at"))


@query("with e as (select distinct id, name from entities) select a.id, a.name, count(*) same_name from e a join e b on lower(a.name) = lower(b.name) group by all")
def entities_by_name(spark, d):
    return knowledge.entities_sharing_names(Tables(spark, d).entities("id", "name"))


@query("select distinct id, name, entity_type from entities")
def all_entities(spark, d):
    return Tables(spark, d).entities("id", "name", "entity_type").orderBy("name", "id")


@query("select distinct id, entity_id, predicate, object, created_at from facts where valid_to is null")
def current_facts(spark, d):
    return knowledge.current(Tables(spark, d).facts("id", "entity_id", "predicate", "object", "created_at", "valid_to")).drop("valid_to")


@query("select distinct entity_id, id, predicate, object, created_at, valid_to from facts")
def facts_by_entity(spark, d):
    return knowledge.history(Tables(spark, d).facts("entity_id", "id", "predicate", "object", "created_at", "valid_to"))


@query("select distinct source_memory_id, id, predicate, object from facts where source_memory_id in (select id from memories where status = 'archived')")
def facts_by_memory(spark, d):
    t = Tables(spark, d)
    return knowledge.facts_by_memory(t.facts("source_memory_id", "id", "predicate", "object"), t.memories("id", "status").where("status = 'archived'").select("id"))


# validation and projections


def _sql_errors(**checks: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"case when coalesce({c}, false) then null else '{n}' end" for n, c in checks.items()) + "], lambda x: x is not null), ',')"


_E_MEM = _sql_errors(
    id="trim(id) <> ''", content="trim(content) <> ''", summary="trim(summary) <> ''", source_session="trim(source_session) <> ''", memory_type=f"memory_type in ({Q.MEMORY_TYPES})", scope=f"scope in ({Q.SCOPES})",
    source_type=f"source_type in ({Q.SOURCE_TYPES})", status=f"status in ({Q.MEMORY_STATUSES})", confidence="confidence between 0 and 1", priority="priority between 1 and 10", access_count="access_count between 0 and 2147483647",
)


@query(f"select distinct id, {_E_MEM} errors from memories")
def validate_memories(spark, d):
    m = Tables(spark, d).memories("id", "content", "summary", "source_session", "memory_type", "scope", "source_type", "status", "confidence", "priority", "access_count")
    return m.select("id", F.array_join(store.memory_errors(), ",").alias("errors"))


@query(
    f"""select distinct id, {_sql_errors(source_id="trim(source_id) <> ''", target_id="trim(target_id) <> ''", self_loop="source_id <> target_id", relation_type=f"relation_type in ({Q.RELATIONS})", strength="strength between 0 and 1", status=f"status in ({Q.EDGE_STATUSES})")} errors from edges"""
)
def validate_edges(spark, d):
    return Tables(spark, d).edges(*EDGE_COLUMNS).select("id", F.array_join(store.edge_errors(), ",").alias("errors"))


@query(f"""select distinct id, {_sql_errors(session_id="trim(session_id) <> ''", cursor_position="cursor_position >= 0")} errors from extraction_checkpoints""")
def validate_checkpoints(spark, d):
    return Tables(spark, d).extraction_checkpoints("id", "session_id", "cursor_position").select("id", F.array_join(store.checkpoint_errors(), ",").alias("errors"))


@query(f"""select distinct id, {_sql_errors(id="trim(id) <> ''", name="trim(name) <> ''", entity_type=f"entity_type in ({Q.ENTITY_TYPES})")} errors from entities""")
def validate_entities(spark, d):
    return Tables(spark, d).entities("id", "name", "entity_type").select("id", F.array_join(store.entity_errors(), ",").alias("errors"))


@query(
    f"""select distinct id, {_sql_errors(id="trim(id) <> ''", entity_id="trim(entity_id) <> ''", predicate="trim(predicate) <> ''", object="trim(object) <> ''", source_memory_id="trim(source_memory_id) <> ''", confidence="confidence between 0 and 1", valid_from="valid_from is not null")} errors from facts"""
)
def validate_facts(spark, d):
    return Tables(spark, d).facts("id", "entity_id", "predicate", "object", "source_memory_id", "confidence", "valid_from").select("id", F.array_join(store.fact_errors(), ",").alias("errors"))


@query(
    f"with w as (select distinct lower(trim(unnest(string_split(text, ' ')), ' ')) word from documents) select word, {Q.RELATION_OF} relation from w where word <> ''"
)
def sanitised_relations(spark, d):
    words = Tables(spark, d).documents("text").select(F.explode(F.split("text", " ")).alias("w")).select(F.lower(F.trim("w")).alias("word")).distinct().where("word <> ''")
    return words.select("word", store.sanitise_relation(F.col("word")).alias("relation"))


@query(f"select distinct id from memories where {Q.json_at('source_context', 'branch')} = 'main'")
def branch_filter(spark, d):
    return Tables(spark, d).memories("id", "source_context").where(D.branch_of(F.col("source_context")) == "main").select("id")


@query(
    """select distinct id, content from memories where status = 'active' and not (contains(lower(content || ' ' || summary), 'cache') or contains(lower(content || ' ' || summary), 'retry'))
and len(list_filter(coalesce(tags, []), lambda x: lower(x) in ('cache', 'retry'))) > 0"""
)
def tag_only_matches(spark, d):
    m = Tables(spark, d).memories("id", "content", "summary", "tags", "status").where("status = 'active'")
    tagged = F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda x: F.lower(x).isin("cache", "retry"))
    return m.where(tagged & search.tag_only(["cache", "retry"])).select("id", "content")


@query("select distinct id, embedding is null pending_remote, local_embedding is null pending_local from memories where status = 'active' and (embedding is null or local_embedding is null)")
def embedding_queues(spark, d):
    m = Tables(spark, d).memories().where("status = 'active' and (embedding is null or local_embedding is null)")
    return m.select("id", F.col("embedding").isNull().alias("pending_remote"), F.col("local_embedding").isNull().alias("pending_local")).distinct()


@query("select doc_id, case when length(text) <= 200 then text else substr(text, 1, 197) || '...' end summary from documents where text is not null")
def document_summaries(spark, d):
    return Tables(spark, d).documents().where("text is not null").select("doc_id", X.summary_of(F.col("text")).alias("summary"))


@query("select doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) lines from documents where text is not null")
def line_ranges(spark, d):
    return Tables(spark, d).documents().where("text is not null").select("doc_id", X.line_range(F.col("text"), F.lit(2), F.lit(4)).alias("lines"))


# text


@query(f"select distinct id, len({Q.tokens('summary || chr(32) || content')}) n, array_to_string(list_sort({Q.tokens('summary || chr(32) || content')}), ' ') tokens from memories")
def tokenised(spark, d):
    m = Tables(spark, d).memories("id", "summary", "content").select("id", similar.compared_text(None).alias("t"))
    return m.select("id", F.size("t").alias("n"), F.array_join(F.array_sort("t"), " ").alias("tokens"))


_UNI = rf"list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^A-Za-z0-9_\s.\-]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: length(x) > 1 and x not in ({Q.STOP_WORDS}))"
_UNI_ORDERED = "list_filter(u0, lambda x, i: list_position(u0, x) = i)"


@query(f"with a as (select doc_id, {_UNI} u0 from documents where text is not null) select doc_id, len({_UNI_ORDERED}) n, array_to_string({_UNI_ORDERED}, ' ') words from a")
def unigrams(spark, d):
    e = Tables(spark, d).documents().where("text is not null").select("doc_id", X.unigrams(F.col("text")).alias("u"))
    return e.select("doc_id", F.size("u").alias("n"), F.array_join("u", " ").alias("words"))


@query(f"with a as (select doc_id, {_UNI} u0 from documents where text is not null), b as (select doc_id, {_UNI_ORDERED} u from a) select doc_id, array_to_string(list_transform(range(1, least(len(u) - 1, 10) + 1), lambda i: u[i] || ' ' || u[i + 1]), '|') pairs from b")
def bigrams(spark, d):
    e = Tables(spark, d).documents().where("text is not null").select("doc_id", X.bigrams(X.unigrams(F.col("text"))).alias("b"))
    return e.select("doc_id", F.array_join("b", "|").alias("pairs"))


@query("select doc_id, length(regexp_replace(text, '```.*?```', '', 'gs')) n from documents where text is not null")
def without_blocks(spark, d):
    return Tables(spark, d).documents().where("text is not null").select("doc_id", F.length(X.strip_blocks(F.col("text"), "```", "```")).alias("n"))


@query("select distinct source, '[query] [project:atlas] ' || trim(source) as input from documents where source is not null")
def query_inputs(spark, d):
    return Tables(spark, d).documents("source").where("source is not null").select("source", X.query_embedding_text(F.col("source"), "atlas").alias("input"))


@query("select doc_id, ceil(length(text) / 4)::bigint tokens, len(string_split(text, chr(10)))::bigint lines from documents where text is not null")
def size_estimates(spark, d):
    return Tables(spark, d).documents().where("text is not null").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"), X.estimate_lines(F.col("text")).alias("lines"))


@query("select distinct id, '[' || memory_type || '] [project:atlas] ' || summary as input from memories")
def embedding_inputs(spark, d):
    return Tables(spark, d).memories("id", "memory_type", "summary").select("id", X.embedding_text(F.col("memory_type"), F.col("summary"), "atlas").alias("input"))


@query("select distinct source, substr(sha256(lang || ':' || source), 1, 16) key, coalesce(nullif(list_last(string_split(regexp_replace(source, '/+$', ''), '/')), ''), 'unknown') project from documents where lang is not null and source is not null")
def cache_keys(spark, d):
    docs = Tables(spark, d).documents("lang", "source").where("lang is not null and source is not null")
    return docs.select("source", X.cache_key(F.col("lang"), F.col("source")).alias("key"), X.project_name(F.col("source")).alias("project")).distinct()


# similarity


@query(f"select distinct id, case when strength < 0.1 then 'ignore' when strength < 0.4 then 'relate' when strength <= 0.5 then 'suggest' else 'consolidate' end as action, case when strength > 0.6 then 'definitely_similar' when strength < 0.1 then 'definitely_different' else 'maybe' end bucket from edges where strength is not null")
def classified_edges(spark, d):
    e = Tables(spark, d).edges("id", "strength").where("strength is not null")
    return e.select("id", S.classify(F.col("strength")).alias("action"), S.prefilter(F.col("strength")).alias("bucket"))


_PAIR_SQL = f"""with m as (select distinct id, {Q.tokens('summary || chr(32) || content')} t, local_embedding::double[] v from memories),
e as (select distinct id, source_id, target_id from edges)
select e.id, round({Q.jaccard('a.t', 'b.t')}, 6) jaccard,
  round(case when a.v is not null and b.v is not null and len(a.v) = len(b.v) then {Q.cosine('a.v', 'b.v')} when {Q.jaccard('a.t', 'b.t')} < 0.1 then 0 else {Q.jaccard('a.t', 'b.t')} end, 6) + 0.0 hybrid
from e join m a on a.id = e.source_id join m b on b.id = e.target_id"""


@query(_PAIR_SQL)
def edge_similarity(spark, d):
    t = Tables(spark, d)
    m = t.memories().select("id", similar.compared_text(None).alias("t"), F.col("local_embedding").alias("v")).dropDuplicates(["id"])
    e = t.edges("id", "source_id", "target_id")
    a, b = (m.select(F.col("id").alias(f"{s}_id"), F.col("t").alias(f"{s}_t"), F.col("v").alias(f"{s}_v")) for s in ("source", "target"))
    both = e.join(a, "source_id").join(b, "target_id")
    score = S.hybrid(F.col("source_t"), F.col("target_t"), F.col("source_v"), F.col("target_v"))
    return both.select("id", F.round(S.jaccard(F.col("source_t"), F.col("target_t")), 6).alias("jaccard"), F.round(score, 6).alias("hybrid"))


_LOCAL = "local_embedding is not null and len(local_embedding) = 32 and len(list_filter(local_embedding, lambda x: x <> 0)) > 0"


@query(
    f"""with m as (select distinct id, local_embedding::double[] v from memories where {_LOCAL}), q as (select id query_id, v qv from m where {_FIFTIETH}),
s as (select query_id, id, round(list_cosine_similarity(qv, v), 9) score from q, m where id <> query_id),
r as (select *, row_number() over (partition by query_id order by score desc, id) rank from s) select query_id, id, rank, round(score, 6) score from r where rank <= 5"""
)
def nearest_memories(spark, d):
    m = Tables(spark, d).memories("id", "local_embedding").select("id", F.col("local_embedding").cast("array<double>").alias("v"))
    return blocks.nearest(fiftieth(m), m, 32, 5).withColumn("score", F.round("score", 6))


def _one_vector(m: DataFrame, column: str, dim: int) -> list[float]:
    """The vector of the smallest id that has one; one row reaches the driver."""
    row = m.where((F.size(column) == dim) & F.exists(column, lambda x: x != 0) & ~F.exists(column, lambda x: F.isnan(x))).orderBy("id").select(column).first()
    return [float(x) for x in row[0]] if row else [1.0] * dim


_Q1 = f"q as (select local_embedding::double[] qv from memories where {_LOCAL} order by id limit 1)"


@query(f"""with {_Q1}, m as (select distinct id, local_embedding::double[] v from memories where {_LOCAL})
select id, round(list_cosine_similarity(qv, v), 6) score from m, q where list_cosine_similarity(qv, v) >= 0.25 order by list_cosine_similarity(qv, v) desc, id limit 10""")
def cosine_topk(spark, d):
    m = Tables(spark, d).memories("id", "local_embedding")
    return search.vector_search(m, "local_embedding", _one_vector(m, "local_embedding", 32), 10, C.MIN_COSINE).select("id", F.round("score", 6).alias("score"))


_QT = "cold cache retry index"


@query(f"""with {_Q1}, m as (select distinct id, local_embedding::double[] v, {Q.tokens("summary || ' ' || array_to_string(coalesce(tags, []), ' ')")} t from memories where {_LOCAL}),
s as (select id, list_cosine_similarity(qv, v) * (1 + 0.3 * {Q.jaccard(Q.tokens("'" + _QT + "'"), 't')}) score from m, q where list_cosine_similarity(qv, v) >= 0.25)
select id, round(score, 6) score from s order by s.score desc, id limit 10""")
def fused_topk(spark, d):
    m = Tables(spark, d).memories("id", "summary", "tags", "local_embedding")
    return search.fused_search(m, "local_embedding", _one_vector(m, "local_embedding", 32), _QT, 10).select("id", F.round("score", 6).alias("score"))


_CLASSES = f"""with m as (select distinct id, list_sort({Q.tokens('summary || chr(32) || content')}) t from memories),
c as (select t, min(id) class_id from m where len(t) > 0 group by t), tok as (select class_id, unnest(t) w, len(t) n from c),
p as (select a.class_id class_a, b.class_id class_b, count(*)::double / (any_value(a.n) + any_value(b.n) - count(*)) jaccard from tok a join tok b on a.w = b.w and a.class_id < b.class_id group by all having jaccard >= 0.5)
"""


@query(_CLASSES + "select class_a, class_b, round(jaccard, 6) jaccard from p")
def similar_pairs(spark, d):
    return similar.similar_classes(Tables(spark, d).memories("id", "summary", "content"))


@query(_CLASSES + ", l as (select k, count(*) n from (select class_a k from p union all select class_b from p) group by 1) select m.id, c.class_id, coalesce(l.n, 0) links from m join c using (t) left join l on l.k = c.class_id")
def similar_members(spark, d):
    return similar.similar_texts(Tables(spark, d).memories("id", "summary", "content"))


_DUPLICATE = f"""with m as (select distinct id, status, {Q.tokens('summary || chr(32) || content')} t from memories), k as (select id, status, t, len(t) n, unnest(t) w from m),
p as (select a.id cid, b.id, count(*)::double / (any_value(a.n) + any_value(b.n) - count(*)) j from k a join k b on a.w = b.w and a.id <> b.id and b.status = 'active' group by 1, 2)
"""


@query(_DUPLICATE + "select cid, min(id) id from p where j >= 0.75 group by 1")
def first_duplicates(spark, d):
    m = Tables(spark, d).memories("id", "status", "summary", "content")
    return similar.first_duplicates(m, m.where("status = 'active'"))


def _hybrid_sql(v: str) -> str:
    """CTEs ending in ``p`` (cid, id, score): the fiftieth ids against the other active memories; ``v``: the vector compared."""
    j = Q.jaccard("c.t", "m.t")
    fine = "len(list_filter(v, lambda x: x is null or isnan(x))) = 0"
    return f"""with m0 as (select distinct id, status, {Q.tokens("summary || ' ' || content")} t, ({v})::double[] v, {_FIFTIETH} asked from memories),
m as (select id, status, t, asked, case when v is not null and {fine} then v end v from m0), c as (select * from m where asked),
p as (select c.id cid, m.id, case when c.v is not null and m.v is not null and len(c.v) = len(m.v) then {Q.cosine('c.v', 'm.v')} when {j} < 0.1 then 0 else {j} end score from c, m where m.status = 'active' and not m.asked)
"""


@query(_hybrid_sql("coalesce(embedding, local_embedding::double[])") + "select least(cid, id) id_a, greatest(cid, id) id_b, round(score, 6) score from p where score >= 0.5")
def hybrid_pairs(spark, d):
    m = Tables(spark, d).memories()
    new = fiftieth(m)
    return similar.hybrid_pairs(new, m.where("status = 'active'").join(new.select("id"), "id", "left_anti"))


_TO_32 = "case when len(local_embedding) = 32 then local_embedding end"


@query(
    _hybrid_sql(_TO_32)
    + """select cid source_id, id target_id, round(score, 6) strength, case when round(score, 6) >= 0.4 and round(score, 6) <= 0.5 then 'suggested' else 'active' end status from p
where score >= 0.1 and not exists (select 1 from edges e where e.relation_type = 'relates_to' and e.source_id = cid and e.target_id = p.id)"""
)
def auto_edges(spark, d):
    t = Tables(spark, d)
    m = t.memories().select("id", "status", "summary", "content", "local_embedding")
    new = fiftieth(m)
    return similar.auto_edges(new, m.where("status = 'active'").join(new.select("id"), "id", "left_anti"), t.edges("source_id", "target_id", "relation_type"))


_DEDUP = (
    _hybrid_sql(_TO_32).replace("with m0", "with recursive m0")
    + f""", b as (select distinct id, source_session batch, created_at ord from memories), best as (select cid id, max(round(score, 9)) score from p where score >= 0.75 group by 1),
hit as (select best.id, best.score, (select min(p.id) from p where p.cid = best.id and round(p.score, 9) = best.score) "match" from best),
f as (select c.id, c.t, c.v, batch, row_number() over (partition by batch order by ord, c.id) k from c join b on b.id = c.id where c.id not in (select id from hit)),
x as (select a.batch, a.k ka, b.k kb from f a join f b on a.batch = b.batch and a.k < b.k where case when a.v is not null and b.v is not null and len(a.v) = len(b.v) then {Q.cosine('a.v', 'b.v')} else {Q.jaccard('a.t', 'b.t')} end >= 0.75),
w(batch, k, kept) as (select batch, 0::bigint, []::bigint[] from (select distinct batch from f) union all
  select w.batch, w.k + 1, case when exists (select 1 from x where x.batch is not distinct from w.batch and x.kb = w.k + 1 and list_contains(w.kept, x.ka)) then w.kept else list_append(w.kept, w.k + 1) end
  from w where exists (select 1 from f where f.batch is not distinct from w.batch and f.k = w.k + 1)),
z as (select batch, arg_max(kept, k) kept from w group by 1)
select id, case when score >= 0.85 then 'skip' else 'merge' end decision, case when score < 0.85 then "match" end "match" from hit union all
select f.id, case when list_contains(z.kept, f.k) then 'keep' else 'skip' end, null from f join z on z.batch is not distinct from f.batch"""
)


@query(_DEDUP)
def dedup_candidates(spark, d):
    m = Tables(spark, d).memories().select("id", "status", "summary", "content", "local_embedding", "source_session", "created_at").dropDuplicates(["id"])
    new = fiftieth(m).withColumnsRenamed({"source_session": "batch", "created_at": "ord"})
    return similar.deduplicate(new, m.where("status = 'active'").join(new.select("id"), "id", "left_anti"))


# search


def _search(phrases: list[list[str]], every: bool, limit: int) -> str:
    return f"with {Q.bm25(phrases, every)} select id, round(score, 6) score from scored order by scored.score desc, id limit {limit}"


def _searched(spark: SparkSession, d: str) -> DataFrame:
    """Memories as delivered: search reads their texts once and tells records apart by what it counts."""
    return Tables(spark, d).memories().select("id", "status", "scope", "memory_type", "content", "summary", "tags", "source_context")


@query(_search([["cache"], ["index"]], True, 20))
def keyword_and(spark, d):
    return search.keyword_search(_searched(spark, d), "cache index", 20).select("id", F.round("score", 6).alias("score"))


@query(_search([["nested"], ["queue"], ["retry"]], False, 20))
def keyword_or(spark, d):
    return search.keyword_search(_searched(spark, d), "nested queue retry", 20, every=False).select("id", F.round("score", 6).alias("score"))


@query(_search([["cold", "start"]], True, 20))
def keyword_phrase(spark, d):
    return search.keyword_search(_searched(spark, d), "cold-start", 20).select("id", F.round("score", 6).alias("score"))


_POS = "case when count(*) over () = 1 then 1.0 else 1 - (row_number() over (order by scored.score desc, id) - 1) / greatest(count(*) over () - 1, 1) * 0.5 end"


@query(f"with {Q.bm25([['cache'], ['index']], True)}, top as (select * from scored order by score desc, id limit 20) select id, round({_POS.replace('scored.', 'top.')}, 6) score from top")
def position_scores(spark, d):
    hits = search.keyword_search(_searched(spark, d), "cache index", 20)
    return search.position_scores(hits, [F.desc("score"), F.asc("id")]).select("id", F.round("score", 6).alias("score"))


_ENT = f"list_filter({Q.search_tokens('name')}, lambda x: x in ('systems', 'dorothy')) <> [] or list_filter({Q.search_tokens(chr(97) + 'rray_to_string(aliases, chr(32))')}, lambda x: x in ('systems', 'dorothy')) <> []"


@query(f"select distinct id, name from entities where {_ENT} order by id limit 50")
def entity_search(spark, d):
    return search.search_entities(Tables(spark, d).entities("id", "name", "aliases"), "systems dorothy", 50).select("id", "name")


@query(
    f"""with t as (select id, col, unnest(toks) term from (
  select id, 'content' col, {Q.search_tokens('content')} toks from {MEM('id', 'content')} union all select id, 'summary', {Q.search_tokens('summary')} from {MEM('id', 'summary')}
  union all select id, 'tags', {Q.search_tokens("array_to_string(tags, ' ')")} from {MEM('id', 'tags')}))
select term, count(distinct id) as rows, count(*)::bigint occurrences from t group by 1"""
)
def index_statistics(spark, d):
    m = Tables(spark, d).memories("id", "content", "summary", "tags")
    return search.term_statistics(search.postings(m))


_PROMPT = "why does the retry cache keep the index stale"


def _prompt_sql() -> str:
    words = ["retry", "cache", "keep", "index", "stale"]
    both = [*words, "retry cache", "cache keep", "keep index", "index stale"]
    ctes, tiers = [], []
    for t, (parts, every) in enumerate(((words, True), (both, False))):
        for s, scope in enumerate(('project', 'global')):
            cte = Q.bm25([p.split() for p in parts], every, f"scope = '{scope}'")
            for n in ("toks", "counted", "stats", "scored"):
                cte = cte.replace(f"{n} as (", f"{n}{t}{s} as (").replace(f"from {n}", f"from {n}{t}{s}").replace(f", {n} where", f", {n}{t}{s} where")
            ctes.append(cte)
            tiers.append(f"select id, memory_type, content, summary, {1000 * (2 * t + s)} + row_number() over (order by score desc, id) p from (select * from scored{t}{s} order by score desc, id limit 5)")
    seen = " or ".join(f"contains(lower(content || ' ' || summary), '{w}')" for w in words)
    return f"""with {', '.join(ctes)}, u as ({' union all '.join(tiers)}), f as (select * from u qualify row_number() over (partition by id order by p) = 1)
select row_number() over (order by p) place, id, memory_type, summary from f where {seen} order by p limit 5"""


@query(_prompt_sql())
def prompt_recall(spark, d):
    return search.prompt_recall(_searched(spark, d), _PROMPT)


@query(_prompt_sql().replace(" order by p limit 5", " and (summary is null or not contains((select string_agg(summary, chr(10)) from (select distinct id, summary from memories where pinned and length(summary) > 20)), summary)) order by p limit 5"))
def prompt_recall_shown(spark, d):
    """As ``prompt_recall`` beside a surface that shows the pinned memories already."""
    pinned = Tables(spark, d).memories("id", "pinned", "summary").where("pinned and length(summary) > 20")
    shown = "\n".join(r.summary for r in pinned.select("summary").collect())  # a surface is text in the driver
    return search.prompt_recall(_searched(spark, d), _PROMPT, shown)


@query(
    f"""with {_Q1}, m as (select distinct id, memory_type, summary, local_embedding::double[] v from memories where {_LOCAL}), s as (select *, list_cosine_similarity(qv, v) c from m, q where list_cosine_similarity(qv, v) >= 0.65 order by c desc, id limit 3)
select row_number() over (order by c desc, id) place, id, memory_type, summary from s"""
)
def prompt_fallback(spark, d):
    """A prompt that no memory's words match, answered by its vector."""
    m = Tables(spark, d).memories().select("id", "status", "scope", "memory_type", "content", "summary", "tags", "source_context", "local_embedding")
    vector = _one_vector(m, "local_embedding", 32)
    return search.prompt_recall_with_fallback(m, "qqzx wwvk yyjh ppqz", vector, "local_embedding")


def _recall_sql(best: str) -> str:
    """``best``: CTEs ending in ``m`` (id, score, source), the merged hits; with what each is linked to, code first, then by distance."""
    live = f"select distinct id, source_id, target_id, relation_type from edges where {_LIVE} and relation_type in ({Q.RELATIONS})"
    return f"""with {best}, e as ({live}), mv as (select source_id f, target_id t from e union select target_id, source_id from e), known as (select distinct id from memories),
d1 as (select m.id root, t id from m join mv on mv.f = m.id where t <> m.id), d2 as (select d1.root, mv.t id from d1 join mv on mv.f = d1.id),
r as (select m.id root, e.target_id id, 0 depth from m join e on e.source_id = m.id and e.relation_type = 'source_of' union all select root, id, 1 from d1 union all select root, id, 2 from d2 where id <> root),
n as (select root, id, min(depth) depth from r where id in (select id from known) group by 1, 2),
l as (select root, string_agg(id, ',' order by depth, id) related from n group by 1)
select m.id, round(m.score, 6) score, m.source, coalesce(l.related, '') related from m left join l on l.root = m.id"""


def _recalled(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"), "source", F.array_join("related", ",").alias("related"))


_MERGED = "m as (select id, arg_min(score, p) score, arg_min(source, p) source from u group by 1 order by 2 desc, min(p), id limit 10)"
_KEYWORD = ", ".join(
    re.sub(r"\b(toks|counted|stats|scored)\b", rf"\g<1>{k}", Q.bm25([["cache"], ["retry"]], True, f"scope = '{scope}'")) + f", t{k} as (select id, '{scope}' as source, {k} p, score s from scored{k} order by score desc, id limit 10),"
    f" h{k} as (select id, source, p, case when count(*) over () = 1 then 1.0 else 1 - (row_number() over (order by s desc, id) - 1) / greatest(count(*) over () - 1, 1) * 0.5 end score from t{k})"
    for k, scope in enumerate(("project", "global"))
)


@query(_recall_sql(f"{_KEYWORD}, u as (select * from h0 union all select * from h1), {_MERGED}"))
def recall_keyword(spark, d):
    return _recalled(search.recall(_searched(spark, d), Tables(spark, d).edges(*EDGE_COLUMNS), "cache retry"))


_FUSED = f"list_cosine_similarity(qv, v) * (1 + 0.3 * {Q.jaccard(Q.tokens(chr(39) + _QT + chr(39)), 't')})"
_SEMANTIC = (
    f"{_Q1}, v as (select distinct id, scope, local_embedding::double[] v, {Q.tokens("summary || ' ' || array_to_string(coalesce(tags, []), ' ')")} t from memories where {_LOCAL}), "
    + ", ".join(
        re.sub(r"\b(toks|counted|stats|scored)\b", rf"\g<1>{k}", Q.bm25([["cold"], ["cache"], ["retry"], ["index"]], False, f"scope = '{scope}'"))
        + f", t{k} as (select id from scored{k} order by score desc, id limit 100),"
        f" h{k} as (select id, '{scope}' as source, {k} p, {_FUSED} score from v, q where scope = '{scope}' and (id in (select id from t{k}) or not exists (select 1 from t{k})) and list_cosine_similarity(qv, v) >= 0.25 order by score desc, id limit 10)"
        for k, scope in enumerate(("project", "global"))
    )
)


@query(_recall_sql(f"{_SEMANTIC}, u as (select id, source, p, score from h0 union all select id, source, p, score from h1), {_MERGED}"))
def recall_semantic(spark, d):
    t = Tables(spark, d)
    m = t.memories().select("id", "status", "scope", "memory_type", "content", "summary", "tags", "source_context", "local_embedding")
    return _recalled(search.recall(m, t.edges(*EDGE_COLUMNS), _QT, _one_vector(m, "local_embedding", 32), "local_embedding"))


# graph


_CENT = f"""cent as (select target_id id, count(*) in_degree, count(*) / (max(count(*)) over ()) centrality from (select distinct id, target_id from edges where {_LIVE} and relation_type in ({Q.RELATIONS})) where target_id is not null group by 1)"""


@query(f"with {_CENT} select id, in_degree, round(centrality, 9) centrality from cent")
def centrality(spark, d):
    e = store.live_edges(Tables(spark, d).edges("id", "target_id", "status", "relation_type"))
    return graph.centrality(e).withColumn("centrality", F.round("centrality", 9))


def _bfs(starts: str, moves: str, depth: int) -> str:
    return f"""with recursive mv as materialized ({moves}), st as (select distinct id root from {starts}),
w(root, id, depth) as (select root, root, 0 from st union select w.root, mv.t, w.depth + 1 from w join mv on mv.f = w.id where w.depth < {depth})
select root, id, min(depth) depth from w where id <> root group by 1, 2"""


_NEWEST = "(select id from memories where status = 'active' order by created_at desc, id limit 1)"


@query(_bfs(_NEWEST, f"select source_id f, target_id t from {EDG('id', 'source_id', 'target_id', 'relation_type', 'status')} where {_LIVE} union select target_id, source_id from edges where {_LIVE}", 2))
def bfs_newest(spark, d):
    t = Tables(spark, d)
    start = t.memories("id", "status", "created_at").where("status = 'active'").orderBy(F.desc("created_at"), "id").limit(1).select("id")
    return graph.traverse(store.live_edges(t.edges(*EDGE_COLUMNS)), start, 2, paths=False)


@query(_bfs("(select id from memories where pinned)", f"select distinct source_id f, target_id t from edges where {_LIVE} and relation_type in ('derived_from', 'refines', 'source_of') and coalesce(strength, 0) >= 0.4", 3))
def bfs_filtered(spark, d):
    t = Tables(spark, d)
    e = store.live_edges(t.edges(*EDGE_COLUMNS))
    return graph.traverse(e, t.memories("id", "pinned").where("pinned").select("id"), 3, ["derived_from", "refines", "source_of"], "outgoing", 0.4, paths=False)


@query(
    f"""with recursive mv as materialized (select distinct id eid, source_id f, target_id t from edges where {_LIVE} and relation_type in ('supersedes', 'refines')), st as (select distinct id root from memories where pinned),
w(root, id, depth, path) as (select root, root, 0, []::varchar[] from st union all select w.root, mv.t, w.depth + 1, list_append(w.path, mv.eid) from w join mv on mv.f = w.id where w.depth < 3),
s as (select root, id, min(depth) depth from w where id <> root group by 1, 2)
select s.root, s.id, s.depth, array_to_string(min(w.path), '>') path from s join w on w.root = s.root and w.id = s.id and w.depth = s.depth group by 1, 2, 3"""
)
def bfs_paths(spark, d):
    t = Tables(spark, d)
    e = store.live_edges(t.edges(*EDGE_COLUMNS))
    return graph.traverse(e, t.memories("id", "pinned").where("pinned").select("id"), 3, ["supersedes", "refines"], "outgoing").withColumn("path", F.array_join("path", ">"))


@query(f"with b as ({_bfs('(select id from memories where pinned)', f'select distinct source_id f, target_id t from edges where {_LIVE} and relation_type = ' + chr(39) + 'relates_to' + chr(39), 2)}) select root, depth, count(*) n from b where id in (select id from memories) group by 1, 2")
def traverse_by_depth(spark, d):
    t = Tables(spark, d)
    e = store.live_edges(t.edges(*EDGE_COLUMNS), "relates_to")
    return graph.by_depth(graph.traverse(e, t.memories("id", "pinned").where("pinned").select("id"), 2, direction="outgoing", paths=False), t.memories("id"))


@query(f"select distinct e.source_id root, e.target_id id from edges e where e.relation_type = 'source_of' and e.{_LIVE} and e.target_id in (select id from memories where memory_type = 'code') and e.source_id in (select id from memories where memory_type = 'code_description')")
def source_code(spark, d):
    t = Tables(spark, d)
    m = t.memories("id", "memory_type")
    return graph.source_code(store.live_edges(t.edges(*EDGE_COLUMNS)), m, m.where("memory_type = 'code_description'").select("id"))


@query(f"with e as {EDG('id', 'source_id', 'target_id', 'relation_type', 'status')} select count(*) filter (source_id in (select id from memories) and target_id in (select id from memories)) as whole, count(*) filter (not (source_id in (select id from memories) and target_id in (select id from memories))) skipped from e where relation_type = 'relates_to' and {_LIVE} and source_id is not null and target_id is not null")
def endpoint_report(spark, d):
    t = Tables(spark, d)
    e = store.live_edges(t.edges(*EDGE_COLUMNS)).where("source_id is not null and target_id is not null")
    return graph.endpoint_report(e, t.memories("id"))


# ranking


_RANK = f"""{_CENT},
m as (select distinct id, memory_type, summary, confidence, priority, access_count, source_context, pinned, last_accessed_at from memories where status = 'active' and memory_type <> 'code'),
mx as (select greatest(max(ln(access_count + 1)), 1.0) lg from m),
r as (select m.id, memory_type, summary, round(greatest(0, least(1, (confidence * 0.5 + priority / 10 * 0.2 + coalesce(centrality, 0) * 0.15 + ln(access_count + 1) / lg * 0.15 + case when {Q.json_at('source_context', 'branch')} = 'main' then 0.1 else 0 end)
  / case when pinned then 1 else 1 + {Q.days('last_accessed_at')} / 14.0 end)), 12) rank from m left join cent using (id), mx)"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    m = t.memories("id", "status", "memory_type", "summary", "confidence", "priority", "access_count", "source_context", "pinned", "last_accessed_at").where("status = 'active'")
    return ranking.ranked(m, graph.centrality(store.live_edges(t.edges("id", "target_id", "status", "relation_type"))), "main", NOW)


@query(f"with {_RANK} select id, round(rank, 6) rank from r")
def rank_all(spark, d):
    return _ranked(spark, d).select("id", F.round("rank", 6).alias("rank"))


_SIZED = f"{_RANK}, z as (select *, len(string_split(summary, chr(10))) lines, ceil(length(summary) / 4)::bigint tokens from r)"


def _surface_sql(target: int, most: int) -> str:
    return f"""with {_SIZED},
e as (select *, coalesce(sum(lines) over (partition by memory_type order by rank desc, id rows between unbounded preceding and 1 preceding), 0) lb from z),
f as (select *, sum(tokens) over (order by rank desc, id) tt from e where lb < {Q.LINE_BUDGET}),
one as (select id, memory_type, rank, tokens from f where tt - tokens < {target} and tt <= {most}),
g as (select *, (select coalesce(sum(tokens), 0) from one) + sum(tokens) over (order by rank desc, id) tt from z where id not in (select id from one)),
two as (select id, memory_type, rank from g where tt - tokens < {target} and tt <= {most})
select id, memory_type, round(rank, 6) rank, 1 as pass from one union all select id, memory_type, round(rank, 6), 2 from two"""


@query(_surface_sql(1300, 1800))
def surface_select(spark, d):
    return ranking.select_for_surface(_ranked(spark, d)).select("id", "memory_type", F.round("rank", 6).alias("rank"), "pass")


@query(_surface_sql(9000, 9500))
def surface_select_wide(spark, d):
    """With room for so many tokens that the line budgets decide the first pass."""
    return ranking.select_for_surface(_ranked(spark, d), 9000, 9500).select("id", "memory_type", F.round("rank", 6).alias("rank"), "pass")


@query(
    f"""with recursive {_SIZED}, c as (select *, sum(lines) over (partition by memory_type order by rank desc, id) cum from z), one as (select * from c where cum <= {Q.LINE_BUDGET}),
o as (select id, memory_type, rank, lines, row_number() over (order by rank desc, id) i from c where cum > {Q.LINE_BUDGET}),
w(i, room, took) as (select 0::bigint, 150 - (select coalesce(sum(lines), 0) from one)::bigint, false union all select o.i, case when o.lines <= w.room then w.room - o.lines else w.room end, o.lines <= w.room from w join o on o.i = w.i + 1 where w.room > 0)
select id, memory_type, round(rank, 6) rank, 1 as pass from one union all select id, memory_type, round(rank, 6), 2 from o where i in (select i from w where took)"""
)
def allocate_budget(spark, d):
    return ranking.allocate_budget(_ranked(spark, d)).withColumn("rank", F.round("rank", 6))


# decay and lifecycle


_HALF = Q.HALF_LIFE + " * (1 + 0.3 * log2(1.0 + access_count)) * (1 + coalesce(centrality, 0))"
_LIFE = f"""{_CENT}, m as (select distinct id, status, memory_type, confidence, access_count, pinned, last_accessed_at from memories),
h as (select m.*, coalesce(centrality, 0) c, {_HALF} hl, {Q.days('last_accessed_at')} idle from m left join cent using (id)),
x as (select *, case when pinned or hl is null then confidence else confidence * pow(0.5, idle / hl) end eff from h),
y as (select *, case when status = 'archived' and idle >= 30 then 'prune' when status <> 'active' then 'none' when pinned or c > 0.5 then 'exempt' when eff < 0.3 and idle >= 14 then 'archive' else 'none' end act from x),
o as (select *, case when (status = 'archived' or act = 'archive') and idle >= 30 then 'pruned' when act = 'archive' then 'archived' else status end fin from y)"""


def _life(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = Tables(spark, d)
    return t.memories("id", "status", "memory_type", "confidence", "access_count", "pinned", "last_accessed_at"), t.edges(*EDGE_COLUMNS)


@query(f"with {_LIFE} select id, round(hl, 6) half_life, round(eff, 6) effective, floor(idle)::bigint idle_days, act as action from o")
def decay(spark, d):
    a = lifecycle.assessed(*_life(spark, d), NOW)
    return a.select("id", F.round("half_life", 6).alias("half_life"), F.round("effective", 6).alias("effective"), F.floor("idle_days").alias("idle_days"), "action")


@query(f"with {_LIFE} select id, status as before, fin as after, (status = 'active' and abs(eff - confidence) > 0.001) decayed from o")
def lifecycle_run(spark, d):
    return lifecycle.run_lifecycle(*_life(spark, d), NOW)


@query(f"with {_LIFE} select count(*) filter (status = 'active' and abs(eff - confidence) > 0.001) decayed, count(*) filter (status = 'active' and fin in ('archived', 'pruned')) archived, count(*) filter (fin = 'pruned' and status <> 'pruned') pruned from o")
def lifecycle_counts(spark, d):
    return lifecycle.counts(lifecycle.run_lifecycle(*_life(spark, d), NOW))


@query(
    f"""with {_LIFE}, e as (select distinct id, source_id, target_id, status from edges), p as (select id from o where fin = 'pruned' and status <> 'pruned'), a as (select id from o where fin = 'archived' and status <> 'archived')
select id, case when source_id in (select id from a) or target_id in (select id from a) then 'archived' else status end status from e where not (source_id in (select id from p) or target_id in (select id from p))"""
)
def lifecycle_edges(spark, d):
    m, e = _life(spark, d)
    return lifecycle.apply_lifecycle(m.withColumn("updated_at", F.col("last_accessed_at")), e, lifecycle.run_lifecycle(m, e, NOW), NOW)[1].select("id", "status")


@query(
    """with g as (select distinct id from memories where status = 'pruned' and updated_at < timestamp '2026-01-01' - interval 90 days)
select distinct 'memories' as kind, id from memories where id not in (select id from g) union all
select distinct 'edges', id from edges where not (source_id in (select id from g) or target_id in (select id from g)) union all
select distinct 'facts', id from facts where source_memory_id is null or source_memory_id not in (select id from g)"""
)
def vacuumed(spark, d):
    t = Tables(spark, d)
    states = store.vacuum(t.memories("id", "status", "updated_at"), t.edges("id", "source_id", "target_id"), t.facts("id", "source_memory_id"), NOW)
    parts = [s.select(F.lit(k).alias("kind"), "id") for k, s in zip(("memories", "edges", "facts"), states, strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("with m as (select distinct id from memories where status = 'active' and not pinned) select id, (row_number() over (order by id) - 1) // 80 as batch from m")
def prune_batches(spark, d):
    m = Tables(spark, d).memories("id", "status", "pinned").where("status = 'active' and not pinned").select("id")
    return graph.batches(m, "id", C.PRUNE_BATCH).select("id", "batch")


# facts


_STREAM = "(select distinct id, entity_id, predicate, object, created_at from facts where predicate is not null and object is not null)"
_SUPER = f"""with k as (select *, lag(lower(object)) over w prev from {_STREAM} window w as (partition by entity_id, lower(predicate) order by created_at, id)),
h as (select id, entity_id, lower(predicate) predicate, object, created_at as at, lead(created_at) over w valid_to, lag(object) over w superseded from k where prev is null or prev <> lower(object) window w as (partition by entity_id, lower(predicate) order by created_at, id))"""


def _superseded(spark: SparkSession, d: str) -> DataFrame:
    f = Tables(spark, d).facts("id", "entity_id", "predicate", "object", "created_at").where("predicate is not null and object is not null")
    f = f.select("id", "entity_id", F.lower("predicate").alias("predicate"), "object", F.col("created_at").alias("at"))
    return knowledge.supersede(f, ["at", "id"], ["entity_id", "predicate"])


@query(_SUPER + " select * from h")
def facts_superseded(spark, d):
    return _superseded(spark, d)


@query(_SUPER + " select id, entity_id, predicate, superseded, object from h where superseded is not null")
def fact_conflicts(spark, d):
    return knowledge.conflicts(_superseded(spark, d)).select("id", "entity_id", "predicate", "superseded", "object")


@query(
    """with e as (select distinct id, name, entity_type from entities qualify row_number() over (partition by lower(name) order by id) = 1), f as (select distinct id, entity_id, predicate, object, created_at from facts where valid_to is null),
r as (select *, row_number() over (partition by entity_id order by created_at desc, id) rn from f),
g as (select entity_id, count(*) n_facts, string_agg(case when rn <= 3 then concat_ws(': ', predicate, object) end, '; ' order by rn) facts from r group by 1)
select e.id, e.name, e.entity_type, n_facts, facts from e join g on g.entity_id = e.id"""
)
def entity_profiles(spark, d):
    t = Tables(spark, d)
    p = knowledge.profiles(t.entities("id", "name", "entity_type"), t.facts("id", "entity_id", "predicate", "object", "created_at", "valid_to"))
    return p.withColumn("facts", F.array_join("facts", "; "))


_FOUND = f"found as (select distinct id, name from entities where {_ENT} order by id limit 50)"


@query(
    f"""with {_FOUND}, f as (select distinct id, entity_id, source_memory_id from facts), n as (select entity_id, count(*) n from f group by 1),
s as (select entity_id, count(distinct source_memory_id) n from f where source_memory_id in (select id from memories) group by 1)
select found.id, name, coalesce(n.n, 0) n_facts, coalesce(s.n, 0) n_sources from found left join n on n.entity_id = found.id left join s on s.entity_id = found.id"""
)
def entity_query(spark, d):
    t = Tables(spark, d)
    found = search.search_entities(t.entities("id", "name", "aliases"), "systems dorothy", 50)
    return knowledge.entity_query(t.entities("id", "name"), t.facts("id", "entity_id", "source_memory_id", "valid_to"), t.memories("id"), found, history=True)


@query(
    f"""with {_FOUND}, f as (select distinct id, entity_id, predicate, object, valid_from, valid_to, source_memory_id from facts where valid_to is null)
select found.id, name, f.id fact_id, predicate, object, valid_from, valid_to, m.id as source from found left join f on f.entity_id = found.id left join (select distinct id from memories) m on m.id = f.source_memory_id"""
)
def entity_answer(spark, d):
    t = Tables(spark, d)
    found = search.search_entities(t.entities("id", "name", "aliases"), "systems dorothy", 50)
    return knowledge.entity_answer(t.facts("id", "entity_id", "predicate", "object", "valid_from", "valid_to", "source_memory_id", "created_at"), t.memories("id"), found)


# inspect


@query(f"select memory_type, count(distinct id) n from (select unnest([{Q.MEMORY_TYPES}]) memory_type) left join memories using (memory_type) group by 1")
def inspect_by_type(spark, d):
    return inspect.by_type(Tables(spark, d).memories("id", "memory_type"))


@query("select scope, count(distinct id) n from (values ('project'), ('global')) v(scope) left join memories using (scope) group by 1")
def inspect_by_scope(spark, d):
    return inspect.by_scope(Tables(spark, d).memories("id", "scope"))


@query("select count(distinct id) pending from memories where embedding is null and local_embedding is null")
def pending_embeddings(spark, d):
    m = Tables(spark, d).memories().where("embedding is null and local_embedding is null").select("id", "embedding", "local_embedding").dropDuplicates(["id"])
    return inspect.pending_vectors(m)


@query(
    """select 'memories' measure, count(distinct id) n from memories union all select 'active', count(distinct id) from memories where status = 'active' union all select 'archived', count(distinct id) from memories where status = 'archived' union all
select 'pinned', count(distinct id) from memories where pinned union all select 'pending', count(distinct id) from memories where embedding is null and local_embedding is null union all
select 'edges', count(distinct id) from edges union all select 'suggested', count(distinct id) from edges where status = 'suggested' union all select 'entities', count(distinct id) from entities union all
select 'facts', count(distinct id) from facts union all select 'current_facts', count(distinct id) from facts where valid_to is null"""
)
def telemetry(spark, d):
    t = Tables(spark, d)
    empty = lambda c: F.when(F.col(c).isNotNull(), F.lit(1)).alias(c)
    m = t.memories().select("id", "status", "pinned", empty("embedding"), empty("local_embedding")).distinct()
    return inspect.telemetry(m, t.edges("id", "status"), t.entities("id"), t.facts("id", "valid_to"))


@query(f"select source_session session_id, round((epoch_us(timestamp '{NOW}') - epoch_us(max(created_at))) / 3600e6, 6) as hours from memories group by 1")
def staleness(spark, d):
    return inspect.staleness(Tables(spark, d).memories("id", "source_session", "created_at"), NOW)


# ingest


BUDGET = 2000
_CHUNK = f"""with l as (select doc_id id, text, strlen(text) total, string_split(text, chr(10)) ls from documents where text is not null),
x as (select *, list_transform(range(1, len(ls)), lambda i: strlen(array_to_string(ls[1:i], chr(10))) + 1) ends from l),
y as (select *, list_max(list_filter(ends, lambda e: e <= {BUDGET})) fit from x)
select id, (case when total <= {BUDGET} then total when fit is not null then fit else list_max(list_filter(list_transform(range(0, {BUDGET} + 1), lambda k: strlen(substr(text, 1, k))), lambda b: b <= {BUDGET})) end)::bigint new_cursor from y"""


@query(_CHUNK)
def transcript_chunks(spark, d):
    docs = Tables(spark, d).documents().select(F.col("doc_id").alias("id"), "text", F.lit(0).alias("cursor"))
    return ingest.next_chunk(docs, budget=BUDGET).select("id", "new_cursor")


@query()
def transcript_resumed(spark, d):
    docs = Tables(spark, d).documents().select(F.col("doc_id").alias("id"), "text")
    first = ingest.next_chunk(docs.withColumn("cursor", F.lit(0)), budget=BUDGET)
    return ingest.next_chunk(docs.join(first.select("id", F.col("new_cursor").alias("cursor")), "id"), budget=BUDGET).select("id", "new_cursor", F.length("chunk").alias("n"))


@query()
def transcript_read(spark, d):
    return ingest.every_chunk(Tables(spark, d).documents(), "doc_id", budget=BUDGET)


_RESPONSE_PRIORITY = "case when access_count % 7 = 0 then priority + 0.5 else priority end"


@query("select id, (case when access_count % 7 = 0 then 0 else 1 end)::int memories from (select distinct id, access_count from memories)")
def parsed_candidates(spark, d):
    m = Tables(spark, d).memories("id", "content", "summary", "memory_type", "scope", "confidence", "priority", "access_count")
    one = F.to_json(F.array(F.struct("content", "summary", "memory_type", "scope", "confidence", F.expr(_RESPONSE_PRIORITY).alias("priority"))))
    fenced = F.when(F.col("access_count") % 2 == 0, F.concat(F.lit("Found:\n```json\n"), one, F.lit("\n```"))).otherwise(F.concat(F.lit('{"memories":'), one, F.lit(',"entities":[]}')))
    return ingest.parse_response(m.select("id", fenced.alias("response"))).select("id", F.size("memories").alias("memories"))


# mutations


def _live_state(spark: SparkSession, d: str) -> api.State:
    return api.State.load(spark, d)


@query(f"with {_LIFE} select count(*) filter (status = 'active' and abs(eff - confidence) > 0.001) decayed, count(*) filter (status = 'active' and fin in ('archived', 'pruned')) archived, count(*) filter (fin = 'pruned' and status <> 'pruned') pruned from o")
def command_lifecycle(spark, d):
    return api.lifecycle(_live_state(spark, d), NOW)[0]


@query(SQL["telemetry"])
def command_inspect(spark, d):
    return api.inspect(_live_state(spark, d))


@query(SQL["recall_keyword"])
def command_recall(spark, d):
    return _recalled(api.recall(_live_state(spark, d), "cache retry")[0])


@query("with m as (select distinct id, source_session, access_count from memories) select id, case when id in (select source_memory_id from facts) then access_count + 1 else access_count end access_count from m")
def access_updated(spark, d):
    t = Tables(spark, d)
    m = t.memories("id", "access_count", "last_accessed_at")
    return store.hit_access(m, t.facts("source_memory_id").where("source_memory_id is not null"), NOW).select("id", "access_count")


@query("with p as (select distinct id from memories where pinned) select distinct id, case when source_id in (select id from p) or target_id in (select id from p) then 'archived' else status end status from edges")
def edges_archived(spark, d):
    t = Tables(spark, d)
    return store.archive_edges(t.edges(*EDGE_COLUMNS), t.memories("id", "pinned").where("pinned").select("id")).select("id", "status")


@query("select distinct id from edges where not (source_id in (select id from memories where status = 'pruned') or target_id in (select id from memories where status = 'pruned'))")
def edges_deleted(spark, d):
    t = Tables(spark, d)
    return store.delete_edges(t.edges(*EDGE_COLUMNS), t.memories("id", "status").where("status = 'pruned'").select("id")).select("id")


@query(
    """with n as (select distinct target_id source_id, source_id target_id from edges where bidirectional and relation_type = 'relates_to' and strength between 0 and 1 and source_id <> target_id and trim(source_id) <> '' and trim(target_id) <> '' and status in ('active', 'suggested', 'archived')),
have as (select distinct source_id, target_id from edges where relation_type = 'relates_to') select source_id, target_id from n anti join have using (source_id, target_id)"""
)
def edges_inserted(spark, d):
    e = Tables(spark, d).edges(*EDGE_COLUMNS)
    back = e.where("bidirectional and relation_type = 'relates_to'").select(F.concat("id", F.lit("-back")).alias("id"), F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "relation_type", "strength", "bidirectional", "status")
    return store.insert_edges(e, back).where("id like '%-back'").select("source_id", "target_id")


@query("with e as (select distinct id, name, entity_type from entities), n as (select distinct lower(predicate) k from facts where predicate is not null) select k as added from n where k not in (select lower(name) from e where entity_type = 'concept' and name is not null)")
def entities_upserted(spark, d):
    t = Tables(spark, d)
    new = t.facts("predicate").where("predicate is not null").select(F.concat(F.lit("new-"), "predicate").alias("id"), F.col("predicate").alias("name"), F.lit("concept").alias("entity_type"))
    return store.upsert_entities(t.entities("id", "name", "entity_type"), new).where("id like 'new-%'").select(F.lower("name").alias("added"))


@query(
    """with e as (select distinct id, source_id, target_id, relation_type, strength, bidirectional, status from edges), c as (select source_id, target_id, arg_max(relation_type, id) ty from e where relation_type in ('refines', 'contradicts') group by 1, 2),
h as (select e.*, case when e.relation_type = 'relates_to' and c.ty is not null and not exists (select 1 from e x where x.source_id = e.source_id and x.target_id = e.target_id and x.relation_type = c.ty) then c.ty end ty from e left join c on c.source_id = e.target_id and c.target_id = e.source_id)
select id, coalesce(ty, relation_type) relation_type, case when ty is null then strength else 0.9 end strength, ty is not null or bidirectional as bidirectional, case when ty is null then status else 'active' end status from h"""
)
def edges_retyped(spark, d):
    e = Tables(spark, d).edges(*EDGE_COLUMNS)
    said = e.where("relation_type in ('refines', 'contradicts')").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "relation_type", F.lit(0.9).alias("strength"), F.col("id").alias("ord"))
    return store.retype_edges(e, said).select("id", "relation_type", "strength", "bidirectional", "status")


_PAIRS_OF = "with e as (select distinct source_id a, target_id b from edges where relation_type = 'supersedes' and status = 'active' and source_id <> target_id), m as (select distinct id, memory_type, scope, priority, pinned, tags from memories)"


@query(
    _PAIRS_OF
    + """ select e.a || '+' || e.b id, case when y.priority > x.priority then y.memory_type else x.memory_type end memory_type, case when x.scope = 'global' or y.scope = 'global' then 'global' else 'project' end as scope, greatest(x.priority, y.priority) priority, x.pinned or y.pinned pinned,
array_to_string(list_sort(list_distinct(list_filter(list_concat(coalesce(x.tags, []), coalesce(y.tags, [])), lambda t: t is not null))), '|') tags from e join m x on x.id = e.a join m y on y.id = e.b"""
)
def pairs_merged(spark, d):
    t = Tables(spark, d)
    m = t.memories().select("id", "memory_type", "scope", "priority", "pinned", "tags", "embedding").dropDuplicates(["id"])
    pairs = t.edges("source_id", "target_id", "relation_type", "status").where("relation_type = 'supersedes' and status = 'active' and source_id <> target_id").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.lit("s").alias("summary"), F.lit("c").alias("content")).distinct()
    merged = store.merge_pairs(m, pairs, "merge")
    return merged.select("id", "memory_type", "scope", "priority", "pinned", F.array_join(F.array_sort(F.array_compact("tags")), "|").alias("tags"))


@query(
    f"""with m as (select distinct id, status, memory_type, {Q.json_at('source_context', 'file_path')} fp from memories), n as (select fp, max(id) code_id from m where memory_type = 'code' and fp is not null group by 1)
select m.id, case when m.status = 'active' and m.memory_type in ('code', 'code_description') and n.fp is not null and m.id <> n.code_id then 'superseded' else m.status end status from m left join n on n.fp = m.fp"""
)
def code_indexed(spark, d):
    t = Tables(spark, d)
    m = t.memories("id", "status", "memory_type", "source_context")
    path = F.get_json_object("source_context", "$.file_path")
    new = m.where("memory_type = 'code'").withColumn("file_path", path).where("file_path is not null").groupBy("file_path").agg(F.max("id").alias("code_id")).withColumn("prose_id", F.col("code_id"))
    return store.index_code(m, t.edges(*EDGE_COLUMNS), new, NOW)[0].select("id", "status")


@query("with n as (select session_id, max(cursor_position) + 1 cursor_position from extraction_checkpoints group by 1) select session_id, cursor_position from n")
def checkpoints_saved(spark, d):
    c = Tables(spark, d).extraction_checkpoints("id", "session_id", "cursor_position", "extracted_at")
    new = c.groupBy("session_id").agg(F.max("id").alias("id"), (F.max("cursor_position") + 1).alias("cursor_position"), F.max("extracted_at").alias("extracted_at"))
    return store.save_checkpoint(c, new.select("id", "session_id", "cursor_position", "extracted_at")).select("session_id", "cursor_position")


@query(f"select distinct id, case when id in (select source_id from edges where relation_type = 'contradicts') then 'archived' else status end status from memories")
def forgotten(spark, d):
    t = Tables(spark, d)
    ids = t.edges("source_id", "relation_type").where("relation_type = 'contradicts'").select("source_id")
    return store.forget(t.memories("id", "status", "updated_at"), t.edges(*EDGE_COLUMNS), ids, NOW)[0].select("id", "status")
