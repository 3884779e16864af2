"""Lifecycle: decay, archive, prune, and the gates that trigger runs."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae import constants as C
from tesserae.functions import decay as D
from tesserae.operators.graph import centrality
from tesserae.operators.store import archive_edges, delete_edges, live_edges, update


def assessed(memories: DataFrame, edges: DataFrame, now: str) -> DataFrame:
    """(id, status, ..., centrality, half_life, effective, idle_days, action): every memory's decayed confidence and what a single look decides."""
    m = memories.select("id", "status", "memory_type", "confidence", "access_count", "pinned", "last_accessed_at").distinct().join(centrality(live_edges(edges)).select("id", "centrality"), "id", "left")
    m = m.withColumn("centrality", F.coalesce("centrality", F.lit(0.0)))
    m = m.withColumns(
        {
            "half_life": D.half_life(F.col("memory_type"), F.col("access_count"), F.col("centrality")),
            "effective": D.decayed(F.col("confidence"), F.col("pinned"), F.col("memory_type"), F.col("access_count"), F.col("centrality"), F.col("last_accessed_at"), now),
            "idle_days": D.days_between(F.col("last_accessed_at"), now),
        }
    )
    return m.withColumn("action", D.action(F.col("status"), F.col("pinned"), F.col("centrality"), F.col("effective"), F.col("idle_days")))


def run_lifecycle(memories: DataFrame, edges: DataFrame, now: str) -> DataFrame:
    """(id, before, after, decayed): the status of every memory after a run, in closed form.

    Active memories may be archived; those and earlier archived ones are pruned in the same run once idle
    long enough. Stored confidence never changes; ``decayed`` tells whether it would by more than 0.001. A
    memory delivered twice is assessed once.
    """
    a = assessed(memories, edges, now)
    archived = (F.col("status") == "active") & (F.col("action") == "archive")
    pruned = ((F.col("status") == "archived") | archived) & (F.col("idle_days") >= C.PRUNE_DAYS)
    after = F.when(pruned, "pruned").when(archived, "archived").otherwise(F.col("status"))
    return a.select("id", F.col("status").alias("before"), after.alias("after"), ((F.col("status") == "active") & (F.abs(F.col("effective") - F.col("confidence")) > 0.001)).alias("decayed"))


def apply_lifecycle(memories: DataFrame, edges: DataFrame, outcome: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """The state after a run: new statuses, edges of archived memories archived, those of pruned ones deleted."""
    moved = outcome.where(F.col("before") != F.col("after"))
    gone, laid = moved.where("after = 'pruned'").select("id"), moved.where("after = 'archived'").select("id")
    return update(memories, moved.select("id", F.col("after").alias("status")), now), archive_edges(delete_edges(edges, gone), laid)


def counts(outcome: DataFrame) -> DataFrame:
    """(decayed, archived, pruned) of a run; a memory archived and pruned at once counts in both."""
    archived = (F.col("before") == "active") & F.col("after").isin("archived", "pruned")
    return outcome.agg(F.count_if("decayed").alias("decayed"), F.count_if(archived).alias("archived"), F.count_if((F.col("after") == "pruned") & (F.col("before") != "pruned")).alias("pruned"))


def should_run(last_run: datetime | None, latest_memory: datetime | None, now: datetime, hours: float = C.LIFECYCLE_FALLBACK_HOURS) -> bool:
    """Never run before, something newer than the last run, or the last run too long ago."""
    return last_run is None or (latest_memory is not None and latest_memory > last_run) or (now - last_run).total_seconds() >= hours * 3600


def should_prune(sessions: int, active: int, active_at_last: int = 0) -> bool:
    """Enough sessions since the last outside pruning, or enough more active memories than then."""
    return sessions >= C.PRUNE_SESSIONS or active >= max(C.PRUNE_MEMORIES, math.ceil(C.PRUNE_GROWTH * active_at_last))


def apply_decisions(memories: DataFrame, edges: DataFrame, decided: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Memories that an outside judge wants pruned (id, reason) archived with their edges; pinned and unknown ids are left alone."""
    ids = memories.where((F.col("status") == "active") & ~F.col("pinned")).select("id").join(decided.select("id").distinct(), "id", "left_semi")
    return update(memories, ids.withColumn("status", F.lit("archived")), now), archive_edges(edges, ids)
