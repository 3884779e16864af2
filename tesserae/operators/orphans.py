"""References to records that do not exist (problem 1).

Parent ids become integers within a *family* (what stands before the trailing digits, and their
number). Live parent keys are compressed into runs of consecutive integers. A reference is matched
as of its key to the run that starts last before it; it dangles if there is none or if it lies beyond
that run's end. A run carries the load times of its members, so that a parent that arrived later than
its reference is told apart.

Runs are cut at multiples of ``BLOCK`` keys: a reference and the run before it then share
``(family, block)``, and the as-of match is an equi-join with a range condition that Spark can sort,
spill and split. One parent may receive any share of all references: the runs (small, compressed)
are repeated over ``SALTS`` and references spread over them by row, and AQE splits what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.sources.tables import first_loads, norm_id

BLOCK = 64
SALTS = 8
#: Trailing digits that fit a bigint; longer numbers leave their front to the family.
DIGITS = 17


def _family(i: Column) -> Column:
    tail = F.regexp_extract(i, f"([0-9]{{1,{DIGITS}}})$", 1)
    return F.concat_ws("|", F.length(tail).cast("string"), F.substr(i, F.lit(1), F.length(i) - F.length(tail)))


def _key(i: Column) -> Column:
    return F.coalesce(F.try_to_number(F.regexp_extract(i, f"([0-9]{{1,{DIGITS}}})$", 1), F.lit("9" * DIGITS)).cast("bigint"), F.lit(0).cast("bigint"))


def keyed(df: DataFrame, id_col: str) -> DataFrame:
    """``df`` with ``family``, ``key`` and ``block`` of a normalised id; equal ids and only they agree in the first two."""
    return df.withColumn("family", _family(F.col(id_col))).withColumn("key", _key(F.col(id_col))).withColumn("block", F.floor(F.col("key") / BLOCK))


def parent_runs(parents: DataFrame, deletions: DataFrame) -> DataFrame:
    """Runs of consecutive live keys: (family, block, start, stop, next_start, loads).

    ``parents``: (id, loaded_at); ``deletions``: (memory_id). ``next_start`` bounds the as-of match,
    ``loads`` has the members' earliest load times in key order. Groups hold at most ``BLOCK`` keys.
    """
    live = (
        parents.select(norm_id(F.col("id")).alias("pid"), "loaded_at")
        .where(F.col("pid").isNotNull())
        .groupBy("pid")
        .agg(F.min("loaded_at").alias("load"))
        .join(deletions.select(norm_id(F.col("memory_id")).alias("pid")).distinct(), "pid", "left_anti")
    )
    w = Window.partitionBy("family", "block").orderBy("key")
    return (
        keyed(live, "pid")
        .withColumn("island", F.col("key") - F.row_number().over(w))
        .groupBy("family", "block", "island")
        .agg(F.min("key").alias("start"), F.max("key").alias("stop"), F.sort_array(F.collect_list(F.struct("key", "load"))).alias("m"))
        .select(
            "family",
            "block",
            "start",
            "stop",
            F.lead("start").over(Window.partitionBy("family", "block").orderBy("start")).alias("next_start"),
            F.col("m.load").alias("loads"),
        )
    )


def references(rows: DataFrame, table_name: str, fields: list[str]) -> DataFrame:
    """(table_name, row_id, field_name, period, ref, load): one row per record and non-blank reference."""
    once = first_loads(rows, "id", [*fields, "created_at"])
    return once.select(
        F.lit(table_name).alias("table_name"),
        F.col("id").alias("row_id"),
        F.date_format("created_at", "yyyy-MM").alias("period"),
        F.col("loaded_at").alias("load"),
        F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), norm_id(F.col(f)).alias("ref")) for f in fields))).alias("r"),
    ).select("table_name", "row_id", "r.field_name", "period", "r.ref", "load").where(F.col("ref").isNotNull())


def dangling(refs: DataFrame, runs: DataFrame) -> DataFrame:
    """The references without a live parent that was loaded by then, with ``reason`` missing or late.

    Nulls: a blank or null reference is none; an unknown load time on either side is never late; an
    unknown ``created_at`` gives a null period. No parents at all make every reference dangle.
    """
    salted = runs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    r = keyed(refs, "ref").withColumn("salt", F.pmod(F.xxhash64("row_id", "field_name"), F.lit(SALTS)).cast("int")).alias("r")
    s = salted.alias("s")
    as_of = (
        (F.col("r.family") == F.col("s.family"))
        & (F.col("r.block") == F.col("s.block"))
        & (F.col("r.salt") == F.col("s.salt"))
        & (F.col("s.start") <= F.col("r.key"))
        & (F.col("s.next_start").isNull() | (F.col("r.key") < F.col("s.next_start")))
    )
    beyond = F.col("s.start").isNull() | (F.col("r.key") > F.col("s.stop"))
    late = F.get(F.col("s.loads"), (F.col("r.key") - F.col("s.start")).cast("int")) > F.col("r.load")
    return (
        r.join(s, as_of, "left")
        .withColumn("reason", F.when(beyond, "missing").when(late, "late"))
        .where(F.col("reason").isNotNull())
        .select("table_name", "row_id", "field_name", "period", "reason")
    )


def orphan_references(edges: DataFrame, facts: DataFrame, memories: DataFrame, deletions: DataFrame) -> DataFrame:
    """All dangling references of both tables to ``memories``."""
    refs = references(edges, "edges", ["source_id", "target_id"]).unionByName(references(facts, "facts", ["source_memory_id"]))
    return dangling(refs, parent_runs(memories.select("id", "loaded_at"), deletions))


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts of dangling references per table, field, period and reason."""
    return found.groupBy("table_name", "field_name", "period", "reason").agg(F.count(F.lit(1)).alias("n"))
