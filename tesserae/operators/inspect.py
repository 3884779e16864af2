"""Counts over the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae import constants as C


def _filled(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts of ``column`` over all of ``values``, 0 where absent."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return every.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def by_type(memories: DataFrame) -> DataFrame:
    return _filled(memories, "memory_type", C.MEMORY_TYPES)


def by_scope(memories: DataFrame) -> DataFrame:
    return _filled(memories, "scope", C.SCOPES)


def pending_vectors(memories: DataFrame) -> DataFrame:
    """(pending): rows without either vector."""
    return memories.agg(F.count_if(F.col("embedding").isNull() & F.col("local_embedding").isNull()).alias("pending"))


def telemetry(memories: DataFrame, edges: DataFrame, entities: DataFrame, facts: DataFrame) -> DataFrame:
    """(measure, n): totals of the store."""
    m = memories.agg(
        F.count(F.lit(1)).alias("memories"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "archived").alias("archived"),
        F.count_if("pinned").alias("pinned"), F.count_if(F.col("embedding").isNull() & F.col("local_embedding").isNull()).alias("pending"),
    )
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("status") == "suggested").alias("suggested"))
    n = entities.agg(F.count(F.lit(1)).alias("entities"))
    f = facts.agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.col("valid_to").isNull()).alias("current_facts"))
    long = lambda df: df.unpivot([], df.columns, "measure", "n")
    return long(m).unionByName(long(e)).unionByName(long(n)).unionByName(long(f))


def staleness(memories: DataFrame, now: str) -> DataFrame:
    """(session_id, hours): hours since each session's last memory."""
    hours = F.timestamp_diff("MICROSECOND", F.max("created_at"), F.lit(now).cast("timestamp_ntz")) / F.lit(3600e6)
    return memories.groupBy(F.col("source_session").alias("session_id")).agg(F.round(hours, 6).alias("hours"))
