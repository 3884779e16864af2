"""Queries and SQL of the general problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.operators import fact_history, orphans
from tesserae.sources.tables import table


def p1_orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(*(table(spark, d, t) for t in ("edges", "facts", "memories", "memory_deletions")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_orphans(spark, d).select("table_name", "row_id", "field_name", "period")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p1_orphans(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return fact_history.found(fact_history.fact_history(table(spark, d, "facts")))


def p3_as_of(spark: SparkSession, d: str) -> DataFrame:
    """What held at one moment: the nearest checkpoint of every attribute, and its patches up to there."""
    p = fact_history.patches(table(spark, d, "facts"))
    return fact_history.state_at(p, fact_history.checkpoints(p), "2024-07-15 12:00:00")


_ORPHANS = r"""
with live as (
  select lower(trim(id, ' ' || chr(9))) pid, min(loaded_at) load from memories
  where lower(trim(id, ' ' || chr(9))) not in (select lower(trim(memory_id, ' ' || chr(9))) from memory_deletions) group by 1),
e as (select id, source_id, target_id, created_at, min(loaded_at) load from edges group by all),
f as (select id, source_memory_id, created_at, min(loaded_at) load from facts group by all),
refs as (
  select 'edges' table_name, id row_id, 'source_id' field_name, source_id ref, created_at, load from e union all
  select 'edges', id, 'target_id', target_id, created_at, load from e union all
  select 'facts', id, 'source_memory_id', source_memory_id, created_at, load from f),
found as (
  select table_name, row_id, field_name, strftime(created_at, '%Y-%m') period,
    case when l.pid is null then 'missing' when l.load > r.load then 'late' end reason
  from refs r left join live l on l.pid = lower(trim(r.ref, ' ' || chr(9))) where trim(r.ref, ' ' || chr(9)) <> '')
"""

_HISTORY = r"""
with f as (
  select id, entity_id, lower(trim(predicate, ' ' || chr(9))) predicate, lower(trim(object, ' ' || chr(9))) object, valid_from,
    case when valid_to > valid_from then valid_to end until, min(loaded_at) load
  from facts where entity_id is not null and valid_from is not null group by all),
c as (select * from f where predicate <> '' and object <> ''
  qualify row_number() over (partition by entity_id, predicate, valid_from order by load desc, id desc) = 1),
s as (select *, least(until, lead(valid_from) over (partition by entity_id, predicate order by valid_from)) fin from c),
m as (select *, case when lag(object) over w = object and lag(fin) over w = valid_from then 0 else 1 end starts
  from s window w as (partition by entity_id, predicate order by valid_from)),
v as (select *, sum(starts) over (partition by entity_id, predicate order by valid_from) version from m)
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p3_found": p3_found, "p3_as_of": p3_as_of}

SQL = {
    "p1_found": _ORPHANS + "select table_name, row_id, field_name, period from found where reason is not null",
    "p1_report": _ORPHANS + "select table_name, field_name, period, reason, count(*) n from found where reason is not null group by all",
    "p3_found": _HISTORY + """select entity_id, predicate, object, epoch_us(min(valid_from)) // 1000000 from_s,
  case when max(case when fin is null then 1 else 0 end) = 1 then -1 else epoch_us(max(fin)) // 1000000 end to_s
from v group by entity_id, predicate, version, object
""",
    "p3_as_of": _HISTORY + "select entity_id, predicate, object from s where valid_from <= timestamp '2024-07-15 12:00:00' and (fin is null or fin > timestamp '2024-07-15 12:00:00')",
}
