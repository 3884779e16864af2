"""Streams of facts and of accesses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tesserae.operators.store import hit_access


def supersede_stream(facts: DataFrame) -> DataFrame:
    """A stream of facts (id, entity_id, predicate, object, at) as it changes what is known.

    Rows: (entity_id, predicate, id, object, at, superseded); a fact equal to the current one (letter case
    aside) gives none. The state of an attribute is its current object alone. Within a micro-batch facts
    apply in order of (at, id); a fact older than the current one comes too late and is dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, since = state.get if state.exists else (None, None)
        out = []
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        for r in rows.itertuples():
            if since is not None and r.at.value < since:
                continue
            if current is None or current.lower() != r.object.lower():
                out.append((key[0], key[1], r.id, r.object, r.at, current))
                current = r.object
            since = r.at.value
        if current is not None:
            state.update((current, since))
        yield pd.DataFrame(out, columns=["entity_id", "predicate", "id", "object", "at", "superseded"])

    clean = facts.where("entity_id is not null and predicate is not null and object is not null and at is not null").select("entity_id", F.lower("predicate").alias("predicate"), "id", "object", F.col("at").cast("timestamp").alias("at"))
    return clean.groupBy("entity_id", "predicate").applyInPandasWithState(
        step, "entity_id string, predicate string, id string, object string, at timestamp, superseded string", "object string, since bigint", "append", GroupStateTimeout.NoTimeout
    )


def arrivals(records: DataFrame, late: str = "7 days", width: str = "1 day") -> DataFrame:
    """Records (created_at) per window of creation, final once the watermark has passed."""
    t = records.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    return t.groupBy(F.window("created_at", width)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("since"), "n")


def access_writer(load: Callable[[], DataFrame], save: Callable[[DataFrame, int], None], now: Callable[[], str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that counts accesses (one id column): loads the state, applies the batch, saves it under the batch's number."""

    def write(batch: DataFrame, number: int) -> None:
        save(hit_access(load(), batch, now()), number)

    return write
