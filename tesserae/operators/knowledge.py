"""Entities and their facts: supersession, current state, profiles, queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae import constants as C


def neighbours(df: DataFrame, key: list[str], order: list[str], segment: Column, before: dict[str, str], after: dict[str, str]) -> DataFrame:
    """``df`` with columns of the row before and after in its key's order, null at the ends: {new name: column}.

    As ``lag`` and ``lead`` over the key, but a key's rows are ordered within segments only (``segment`` must
    rise with ``order``); the segments' first and last rows, one each, are ordered across. So a key with a
    third of all rows is spread over its segments.
    """
    cut = df.withColumn("_seg", segment)
    w = Window.partitionBy(*key, "_seg").orderBy(*order)
    row = F.struct(*order, F.struct(*(F.col(c).alias(f"b{i}") for i, c in enumerate(before.values())), *(F.col(c).alias(f"a{i}") for i, c in enumerate(after.values()))).alias("_v"))
    ends = cut.groupBy(*key, "_seg").agg(F.min(row).alias("_first"), F.max(row).alias("_last"))
    across = Window.partitionBy(*key).orderBy("_seg")
    ends = ends.select(*key, "_seg", F.lag("_last._v").over(across).alias("_prev"), F.lead("_first._v").over(across).alias("_next"))
    inner = {f"_in_{n}": F.lag(c).over(w) for n, c in before.items()} | {f"_in_{n}": F.lead(c).over(w) for n, c in after.items()}
    inside = cut.withColumns(inner | {"_at_start": F.row_number().over(w) == 1, "_at_end": F.lead(F.lit(1)).over(w).isNull()}).join(ends, [*key, "_seg"])
    out = {n: F.when(F.col("_at_start"), F.col(f"_prev.b{i}")).otherwise(F.col(f"_in_{n}")) for i, n in enumerate(before)}
    out |= {n: F.when(F.col("_at_end"), F.col(f"_next.a{i}")).otherwise(F.col(f"_in_{n}")) for i, n in enumerate(after)}
    return inside.withColumns(out).select(*df.columns, *out)


def supersede(stream: DataFrame, order: list[str], key: list[str], period: str = "month") -> DataFrame:
    """Facts as they come in (key columns, object, at, ...), with validity and conflicts; ``order`` begins with ``at``.

    A fact equal to the one before it (letter case aside) is dropped; another one ends it. Adds
    ``valid_to`` (null while current) and ``superseded`` (the object it replaced, or null). Rows with a null
    key or time take no part.
    """
    segment = F.date_trunc(period, F.col("at")).cast("timestamp_ntz")
    known = stream.where(" and ".join(f"`{c}` is not null" for c in [*key, "at"]))
    seen = neighbours(known, key, order, segment, {"_prev": "object"}, {})
    kept = seen.where(F.col("_prev").isNull() | (F.lower("_prev") != F.lower("object"))).drop("_prev")
    return neighbours(kept, key, order, segment, {"superseded": "object"}, {"valid_to": "at"})


def conflicts(history: DataFrame) -> DataFrame:
    return history.where(F.col("superseded").isNotNull())


def current(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("valid_to").isNull())


def history(facts: DataFrame, include_ended: bool = True) -> DataFrame:
    """The facts of every entity, its latest first (ties by id); ended ones too unless told otherwise.

    The order is global over (entity_id, created_at), so the facts of a hot entity are spread over ranges.
    """
    return (facts if include_ended else current(facts)).orderBy("entity_id", F.desc("created_at"), "id")


def facts_by_memory(facts: DataFrame, memory_ids: DataFrame | None = None) -> DataFrame:
    """The facts with a source memory, or with one of ``memory_ids`` (one column)."""
    known = facts.where(F.col("source_memory_id").isNotNull())
    return known if memory_ids is None else known.join(memory_ids.select(F.col(memory_ids.columns[0]).alias("source_memory_id")).distinct(), "source_memory_id", "left_semi").select(*facts.columns)


def entities_sharing_names(entities: DataFrame) -> DataFrame:
    """(id, name, same_name): each named entity with how many have its name, letter case aside, itself included."""
    e = entities.where("name is not null")
    n = e.groupBy(F.lower("name").alias("_k")).agg(F.count(F.lit(1)).alias("same_name"))
    return e.join(n, F.lower("name") == F.col("_k")).select("id", "name", "same_name")


def entity_by_name(entities: DataFrame, name: str | Column) -> DataFrame:
    return entities.where(F.lower("name") == F.lower(name if isinstance(name, Column) else F.lit(name)))


def profiles(entities: DataFrame, facts: DataFrame, most: int | None = None, most_facts: int = C.MAX_FACTS) -> DataFrame:
    """(id, name, entity_type, n_facts, facts): entities with a current fact, by name, with their ``most_facts`` latest.

    Of entities with one name (letter case aside) the smallest id stands, before the test for facts.
    The latest facts are kept by a rank per entity, so an entity with very many is no hot group.
    """
    once = entities.withColumn("_r", F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("id"))).where("_r = 1").select("id", "name", "entity_type")
    now = current(facts)
    n = now.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_facts"))
    latest = now.withColumn("_r", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("created_at"), "id"))).where(F.col("_r") <= most_facts)
    texts = latest.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("_r", F.concat_ws(": ", "predicate", "object").alias("t")))).alias("m")).select("entity_id", F.transform("m", lambda x: x["t"]).alias("facts"))
    out = once.join(n, F.col("id") == F.col("entity_id")).drop("entity_id").join(texts, F.col("id") == F.col("entity_id")).select("id", "name", "entity_type", "n_facts", "facts")
    return out.orderBy("name", "id").limit(most) if most else out


def sources(facts: DataFrame, memories: DataFrame) -> DataFrame:
    """(entity_id, memory_id): the memories, still there, from which an entity's facts come."""
    return facts.select("entity_id", F.col("source_memory_id").alias("memory_id")).distinct().join(memories.select(F.col("id").alias("memory_id")).distinct(), "memory_id", "left_semi")


def entity_query(entities: DataFrame, facts: DataFrame, memories: DataFrame, found: DataFrame, history: bool = False) -> DataFrame:
    """(id, name, n_facts, n_sources) of the found entities: their current facts, or all, and source memories."""
    mine = facts if history else current(facts)
    mine = mine.join(found.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    n = mine.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_facts"))
    s = sources(mine, memories).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_sources"))
    zero = F.lit(0).cast("bigint")
    return found.select(F.col("id").alias("entity_id"), "name").join(n, "entity_id", "left").join(s, "entity_id", "left").select(F.col("entity_id").alias("id"), "name", F.coalesce("n_facts", zero).alias("n_facts"), F.coalesce("n_sources", zero).alias("n_sources"))


def entity_answer(facts: DataFrame, memories: DataFrame, found: DataFrame, ended: bool = False) -> DataFrame:
    """(id, name, fact_id, predicate, object, valid_from, valid_to, source): the facts of the found entities, and the memory each comes from where that is still there.

    Current facts, or with ``ended`` all; an entity without facts has one row of nulls.
    """
    here = memories.select(F.col("id").alias("source_memory_id"), F.col("id").alias("source")).distinct()
    mine = (facts if ended else current(facts)).join(found.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi").join(here, "source_memory_id", "left")
    rows = mine.select("entity_id", F.col("id").alias("fact_id"), "predicate", "object", "valid_from", "valid_to", "source", "created_at")
    both = found.select(F.col("id").alias("entity_id"), "name").distinct().join(rows, "entity_id", "left")
    return both.orderBy("entity_id", F.desc("created_at"), "fact_id").select(F.col("entity_id").alias("id"), "name", "fact_id", "predicate", "object", "valid_from", "valid_to", "source")
