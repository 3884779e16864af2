"""Composite ranking and selection under line and token budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae import constants as C
from tesserae.functions import decay as D
from tesserae.functions.text import estimate_lines, estimate_tokens


def ranked(memories: DataFrame, centrality: DataFrame, branch: str | None, now: str) -> DataFrame:
    """Memories other than code with ``centrality`` (0 where unknown) and ``rank``; use is scaled by the most used one."""
    pool = memories.where(F.col("memory_type") != "code")
    most = pool.agg(F.greatest(F.max(F.ln(F.col("access_count") + 1.0)), F.lit(1.0))).scalar()
    known = pool.join(centrality.select("id", "centrality"), "id", "left").withColumn("centrality", F.coalesce("centrality", F.lit(0.0)))
    value = D.rank(F.col("confidence"), F.col("priority"), F.col("centrality"), F.col("access_count"), most, F.col("source_context"), F.col("pinned"), F.col("last_accessed_at"), branch, now)
    return known.withColumn("rank", F.round(value, 12))


def select_for_surface(rows: DataFrame, target: int = C.SURFACE_TARGET, most: int = C.SURFACE_MAX) -> DataFrame:
    """The rows (id, memory_type, summary, rank) picked within the budgets, with ``pass`` 1 or 2, best first.

    Every stop of the greedy selection is a bound on a running total, so both passes are windows. Lines
    per category bound pass 1 and tokens bound pass 2, so each category first keeps about as many rows as
    its line budget and the whole its best ``most`` rows; only those meet in one partition.
    """
    w = Window.partitionBy("memory_type").orderBy(F.desc("rank"), "id")
    sized = rows.select("id", "memory_type", "summary", "rank", estimate_lines(F.col("summary")).alias("lines"), F.greatest(estimate_tokens(F.col("summary")), F.lit(0)).alias("tokens"))
    budget = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in C.LINE_BUDGETS.items() for x in kv]), F.col("memory_type")), F.lit(0))
    eligible = (
        sized.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(C.LINE_BUDGETS.values()) + 1)
        .withColumn("_before", F.coalesce(F.sum("lines").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .where(F.col("_before") < budget)
    )
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("rank"), "id")
    total = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = eligible.withColumn("_t", total).where((F.col("_t") - F.col("tokens") < target) & (F.col("_t") <= most)).select("id", "memory_type", "summary", "rank", "lines", "tokens")
    used = F.coalesce(first.agg(F.sum("tokens")).scalar(), F.lit(0))
    rest = sized.join(first.select("id"), "id", "left_anti")
    running = rest.where("tokens > 0").orderBy(F.desc("rank"), "id").limit(most + 1).withColumn("_t", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) + used)
    fields = ["id", "memory_type", "summary", "rank", "lines", "tokens"]
    second = running.where((F.col("_t") - F.col("tokens") < target) & (F.col("_t") <= most)).select(*fields)
    # empty summaries cost nothing: all that stand before the row at which the pass ends
    last = running.where((F.col("_t") >= target) | (F.col("_t") > most)).agg(F.min(F.struct((-F.col("rank")).alias("r"), "id"))).scalar()
    free = rest.where("tokens = 0").withColumn("_last", last).where(F.col("_last").isNull() | (F.struct((-F.col("rank")).alias("r"), "id") < F.col("_last")))
    second = second.unionByName(free.where(used < target).select(*fields))
    return first.withColumn("pass", F.lit(1)).unionByName(second.withColumn("pass", F.lit(2))).orderBy(F.desc("rank"), "id")


def allocate_budget(rows: DataFrame, budgets: dict[str, int] | None = None, overflow: bool = True) -> DataFrame:
    """(id, memory_type, rank, pass): rows within each category's line budget, then the best others that fit what is left.

    A category takes its best rows until one would exceed its budget. The lines left over by all
    categories go to the remaining rows by rank, skipping those that do not fit. At most that many lines
    can be given out and every row has at least one; rows are read in rank order, and only up to the
    point where nothing more fits, by one task over the sorted remainder.
    """
    budgets = budgets or C.LINE_BUDGETS
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv]), F.col("memory_type")), F.lit(0))
    w = Window.partitionBy("memory_type").orderBy(F.desc("rank"), "id")
    sized = rows.select("id", "memory_type", "rank", estimate_lines(F.col("summary")).alias("lines"))
    # rows have at least one line, so the first budget + 1 of a category decide its pass
    near = sized.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(budgets.values()) + 1)
    first = near.withColumn("_t", F.sum("lines").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_t") <= limit).select("id", "memory_type", "rank", "lines")
    picked = first.select("id", "memory_type", "rank", F.lit(1).alias("pass"))
    if not overflow:
        return picked
    left = F.lit(sum(budgets.values())) - F.coalesce(first.agg(F.sum("lines")).scalar(), F.lit(0))
    # a category wholly taken has no others; one with a budget of 0 offers all of its rows
    others = sized.join(first.select("id"), "id", "left_anti").where(F.col("memory_type").isin(list(budgets))).withColumn("_left", left)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        room = None
        for b in batches:
            room = int(b["_left"].iloc[0]) if room is None and len(b) else room
            keep = []
            for n in b["lines"]:
                fits = bool(room) and n <= room
                room = room - int(n) if fits else room
                keep.append(fits)
            yield b.loc[keep, ["id", "memory_type", "rank"]].assign(**{"pass": 2})
            if not room:
                return

    # within one line count only the best rows can be taken: at most the total budget of each
    short = others.withColumn("_n", F.row_number().over(Window.partitionBy("lines").orderBy(F.desc("rank"), "id"))).where((F.col("_n") <= sum(budgets.values())) & (F.col("lines") <= F.col("_left")))
    second = short.repartition(1).sortWithinPartitions(F.desc("rank"), "id").select("id", "memory_type", "rank", "lines", "_left").mapInPandas(fill, "id string, memory_type string, rank double, pass int")
    return picked.unionByName(second)
