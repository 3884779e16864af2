"""Time decay, ranking and lifecycle decisions as column expressions; ``now`` is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae import constants as C


def days_between(since: Column, now: str) -> Column:
    """Fractional days from a timestamp without zone to ``now``, at least 0."""
    micros = F.timestamp_diff("MICROSECOND", since, F.lit(now).cast("timestamp_ntz"))
    return F.greatest(F.lit(0.0), micros / F.lit(86_400e6))


def half_life(memory_type: Column, access_count: Column, centrality: Column) -> Column:
    """Half-life in days, longer for what is used and central; null for stable types."""
    base = F.try_element_at(F.create_map(*[F.lit(x) for kv in C.HALF_LIVES.items() for x in (kv[0], float(kv[1]))]), memory_type)
    return base * (1 + 0.3 * F.log2(1.0 + access_count)) * (1 + centrality)


def decayed(confidence: Column, pinned: Column, memory_type: Column, access_count: Column, centrality: Column, last_accessed: Column, now: str) -> Column:
    """Confidence halved each half-life since last access; unchanged for pinned and stable ones."""
    h = half_life(memory_type, access_count, centrality)
    return F.when(pinned | h.isNull(), confidence).otherwise(confidence * F.pow(F.lit(0.5), days_between(last_accessed, now) / h))


def action(status: Column, pinned: Column, centrality: Column, effective: Column, idle_days: Column) -> Column:
    """prune, archive, exempt or none, in the order in which the rules apply (archived first, so even pinned ones are pruned)."""
    return (
        F.when((status == "archived") & (idle_days >= C.PRUNE_DAYS), "prune")
        .when(status != "active", "none")
        .when(pinned | (centrality > C.HUB_ABOVE), "exempt")
        .when((effective < C.ARCHIVE_BELOW) & (idle_days >= C.ARCHIVE_DAYS), "archive")
        .otherwise("none")
    )


def branch_of(source_context: Column) -> Column:
    """The branch in a JSON context; null where the JSON is broken or has none."""
    return F.get_json_object(source_context, "$.branch")


def rank(confidence: Column, priority: Column, centrality: Column, access_count: Column, max_access_log: Column, source_context: Column, pinned: Column, last_accessed: Column, branch: str | None, now: str) -> Column:
    """Weighted sum of stored confidence, priority, centrality and use, with a boost for the branch and recency, within 0..1."""
    used = F.when(max_access_log > 0, F.ln(access_count + 1.0) / max_access_log * C.W_ACCESS).otherwise(0.0)
    base = confidence * C.W_CONFIDENCE + priority / 10 * C.W_PRIORITY + F.coalesce(centrality, F.lit(0.0)) * C.W_CENTRALITY + used
    if branch:
        base = base + F.when(branch_of(source_context) == branch, C.BRANCH_BOOST).otherwise(0.0)
    recent = F.when(pinned, base).otherwise(base / (1 + days_between(last_accessed, now) / C.RECENCY_DAYS))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), recent))
