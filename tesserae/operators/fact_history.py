"""History of changing entity attributes (problem 3), as checkpoints and patches.

*Patches* are the attribute changes themselves, one per (entity, predicate, valid_from). *Checkpoints*
hold the full version of an attribute at the start of each period in which it changes: the version
carried in, how many versions precede it, and where the next period's first change lies. Validity
rows come from folding a period's patches forward from its checkpoint, so no fold sees more than one
period of one attribute, however many changes an entity or predicate has gathered; only the
per-period summaries (one row per attribute and period) are ordered across periods.

*Stored* (``write_history``), the changes lie in a partition for each period, and every ``EVERY`` periods there is
a full version of all attributes: the last patch of each before that moment. New facts are folded in
(``append_history``) by reading only the periods that they touch and the full versions after those; a moment
(``stored_state_at``) is the nearest full version with the patches from there on, and whatever the store holds
can be read back as patches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.sources.tables import cut, epoch_s, trimmed

ATTRIBUTE = ["entity_id", "predicate"]
PERIOD = "month"


def clean(c: Column) -> Column:
    t = F.lower(trimmed(c))
    return F.when(t != "", t)


def patches(facts: DataFrame, period: str = PERIOD) -> DataFrame:
    """(entity_id, predicate, period, valid_from, object, until): one change per instant.

    Rows with null or blank predicate or object or null valid_from or entity are left out. Of facts
    with equal attribute and instant the latest loaded id holds (ties: the largest id). ``until`` is
    valid_to where that lies after valid_from.
    """
    return _holding(changes(facts, period)).drop("load", "id")


def changes(facts: DataFrame, period: str = PERIOD) -> DataFrame:
    """(entity_id, predicate, period, valid_from, id, object, until, load): every fact once, with its load time.

    The first shuffle is by (attribute, period), which all later grouping and folding here reuses.
    """
    f = (
        facts.select(
            "entity_id",
            clean(F.col("predicate")).alias("predicate"),
            clean(F.col("object")).alias("object"),
            "id",
            "valid_from",
            F.when(F.col("valid_to") > F.col("valid_from"), F.col("valid_to")).alias("until"),
            "loaded_at",
        )
        .where("entity_id is not null and predicate is not null and object is not null and valid_from is not null")
        .withColumn("period", F.date_trunc(period, F.col("valid_from").cast("timestamp_ntz")).cast("timestamp_ntz"))
        .repartition(*ATTRIBUTE, "period")
    )
    return f.groupBy(*ATTRIBUTE, "period", "valid_from", "id", "object", "until").agg(F.min("loaded_at").alias("load"))


def _holding(p: DataFrame) -> DataFrame:
    """Of the patches of one attribute and instant the one that holds."""
    m = p.groupBy(*ATTRIBUTE, "period", "valid_from").agg(F.max(F.struct("load", "id", "object", "until")).alias("m"))
    return m.select(*ATTRIBUTE, "period", "valid_from", *(F.col(f"m.{c}").alias(c) for c in ("object", "until", "load", "id")))


def _span(next_from: Column) -> Column:
    """End of a change: its own until, but no later than the next change; null while open."""
    return F.least(F.col("until"), next_from)


def _starts(prev_object: Column, prev_end: Column) -> Column:
    """Whether a version begins here: no previous one, another object, or a gap."""
    same = (prev_object == F.col("object")) & (prev_end == F.col("valid_from"))
    return F.when(same, 0).otherwise(1)


def checkpoints(p: DataFrame) -> DataFrame:
    """(entity_id, predicate, period, carried, carried_end, versions_before, next_from).

    The full version of an attribute when a period begins: the object of the last change before it,
    that change's end, and the number of versions begun in earlier periods.
    """
    inner = Window.partitionBy(*ATTRIBUTE, "period").orderBy("valid_from")
    marks = (
        p.withColumn("end", _span(F.lead("valid_from").over(inner)))
        .withColumn("inner_start", F.when(F.lag("valid_from").over(inner).isNull(), 0).otherwise(_starts(F.lag("object").over(inner), F.lag("end").over(inner))))
        .groupBy(*ATTRIBUTE, "period")
        .agg(
            F.min(F.struct("valid_from", "object")).alias("first"),
            F.max(F.struct("valid_from", "object", "until")).alias("last"),
            F.sum("inner_start").alias("inner_starts"),
        )
    )
    outer = Window.partitionBy(*ATTRIBUTE).orderBy("period")
    ordered = marks.withColumn("next_from", F.lead("first.valid_from").over(outer)).withColumn("prev", F.lag("last").over(outer))
    carried_end = F.least(F.col("prev.until"), F.col("first.valid_from"))
    begins = F.when((F.col("prev.object") == F.col("first.object")) & (carried_end == F.col("first.valid_from")), 0).otherwise(1)
    return (
        ordered.withColumn("carried", F.col("prev.object"))
        .withColumn("carried_end", F.when(F.col("prev").isNotNull(), carried_end))
        .withColumn("begun", begins + F.col("inner_starts"))
        .withColumn("versions_before", F.coalesce(F.sum("begun").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(*ATTRIBUTE, "period", "carried", "carried_end", "versions_before", "next_from")
    )


def reconstruct(p: DataFrame, c: DataFrame) -> DataFrame:
    """Validity rows (entity_id, predicate, object, valid_from, valid_to): each period's patches folded from its checkpoint.

    valid_to is null for a version still open. Neighbouring changes with equal object and no gap make
    one version, across periods too.
    """
    w = Window.partitionBy(*ATTRIBUTE, "period").orderBy("valid_from")
    folded = (
        p.join(c, [*ATTRIBUTE, "period"])
        .withColumn("end", _span(F.coalesce(F.lead("valid_from").over(w), F.col("next_from"))))
        .withColumn("prev_object", F.coalesce(F.lag("object").over(w), F.col("carried")))
        .withColumn("prev_end", F.coalesce(F.lag("end").over(w), F.col("carried_end")))
        .withColumn("starts", F.when(F.col("prev_object").isNull(), 1).otherwise(_starts(F.col("prev_object"), F.col("prev_end"))))
        .withColumn("version", F.col("versions_before") + F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    )
    return (
        folded.groupBy(*ATTRIBUTE, "version", "object")
        .agg(F.min("valid_from").alias("valid_from"), F.max(F.struct("valid_from", "end")).alias("l"))
        .select(*ATTRIBUTE, "object", "valid_from", F.col("l.end").alias("valid_to"))
    )


def fact_history(facts: DataFrame, period: str = PERIOD) -> DataFrame:
    """The whole history of ``facts`` by way of checkpoints and patches."""
    p = patches(facts, period)
    return reconstruct(p, checkpoints(p))


def state_at(p: DataFrame, c: DataFrame, at: str, period: str = PERIOD) -> DataFrame:
    """(entity_id, predicate, object) as of ``at``: nearest checkpoint, then the patches up to ``at``."""
    moment = F.lit(at).cast("timestamp_ntz")
    near = (
        c.where(F.col("period") <= F.date_trunc(period, moment).cast("timestamp_ntz"))
        .groupBy(*ATTRIBUTE)
        .agg(F.max(F.struct("period", "carried", "carried_end")).alias("c"))
        .select(*ATTRIBUTE, F.col("c.period").alias("period"), F.col("c.carried").alias("carried"), F.col("c.carried_end").alias("carried_end"))
    )
    last = p.where(F.col("valid_from") <= moment).groupBy(*ATTRIBUTE, "period").agg(F.max(F.struct("valid_from", "object", "until")).alias("m"))
    state = near.join(last, [*ATTRIBUTE, "period"], "left")
    end = F.when(F.col("m").isNotNull(), F.col("m.until")).otherwise(F.col("carried_end"))
    held = F.coalesce("m.object", "carried")
    return state.where(held.isNotNull() & (end.isNull() | (end > moment))).select(*ATTRIBUTE, held.alias("object"))


#: Months from one stored full version to the next.
EVERY = 6
_LAST = ["valid_from", "load", "id", "object", "until"]


def _names(df: DataFrame) -> DataFrame:
    """Stored patches: the period as a directory name."""
    return df.withColumn("period", F.date_format("period", "yyyy-MM"))


def _last(p: DataFrame) -> DataFrame:
    m = p.groupBy(*ATTRIBUTE).agg(F.max(F.struct(*_LAST)).alias("m"))
    return m.select(*ATTRIBUTE, *(F.col(f"m.{c}").alias(c) for c in _LAST))


def _marks(first: str, last: str) -> list[str]:
    """The beginnings of the stored full versions after period ``first``, up to the one after ``last``."""
    number = lambda p: int(p[:4]) * 12 + int(p[5:7]) - 1
    return [f"{k // 12:04d}-{k % 12 + 1:02d}" for k in range((number(first) // EVERY + 1) * EVERY, number(last) + EVERY + 1, EVERY)]


def _write(df: DataFrame, path: str, by: str) -> None:
    """Replaces only the partitions that ``df`` has rows for."""
    df.repartition(by, F.pmod(F.xxhash64("entity_id"), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_history(facts: DataFrame, path: str) -> None:
    """A new store of the facts at ``path``: ``patches`` by period and ``versions`` by the moment they hold at."""
    every_fact = cut(_names(changes(facts, "month")))
    _write(every_fact, f"{path}/patches", "period")
    p = _holding(every_fact)
    ends = p.agg(F.min("period").alias("a"), F.max("period").alias("b")).first()
    if ends.a is None:
        return
    every = p.sparkSession.createDataFrame([(m,) for m in _marks(ends.a, ends.b)], "at string")  # a row for each half year
    held = p.groupBy(*ATTRIBUTE, "period").agg(F.max(F.struct(*_LAST)).alias("m"))  # at most one row a period
    before = held.join(F.broadcast(every), F.col("period") < F.col("at")).groupBy(*ATTRIBUTE, "at").agg(F.max("m").alias("m"))
    _write(before.select(*ATTRIBUTE, "at", *(F.col(f"m.{c}").alias(c) for c in _LAST)), f"{path}/versions", "at")


def append_history(facts: DataFrame, path: str) -> list[str]:
    """Folds new facts, late ones too, into the store; the periods whose patches were read and written again.

    Of the stored patches only those periods are read, of the full versions those after the first of them.
    """
    spark = facts.sparkSession
    new = cut(_names(changes(facts, "month")))
    touched = sorted(r.period for r in new.select("period").distinct().collect())  # months
    if not touched:
        return []
    old = spark.read.parquet(f"{path}/patches").withColumn("period", F.col("period").cast("string"))
    stored = old.agg(F.min("period").alias("a"), F.max("period").alias("b")).first()  # of the directories' names
    again = old.where(F.col("period").isin(touched)).select(*new.columns).unionByName(new)
    both = cut(again.groupBy(*[c for c in new.columns if c != "load"]).agg(F.min("load").alias("load")))
    _write(both, f"{path}/patches", "period")
    versions = spark.read.parquet(f"{path}/versions").withColumn("at", F.col("at").cast("string")).select(*ATTRIBUTE, *_LAST, "at")
    marks = _marks(touched[0], max(touched[-1], stored.b))
    have = {r["at"] for r in versions.select("at").distinct().collect()}  # half years
    last = max(have, default=None)
    # what a full version took from periods outside of these stands; a moment that has none yet begins as the latest one
    versions = versions.where(~F.date_format("valid_from", "yyyy-MM").isin(touched))
    begun = [versions.where(F.col("at") == (m if m in have else last)).withColumn("at", F.lit(m)) for m in marks if last and (m in have or m > last)]
    added = _holding(both).select(*ATTRIBUTE, *_LAST, "period").join(F.broadcast(spark.createDataFrame([(m,) for m in marks], "at string")), F.col("period") < F.col("at")).drop("period")
    for b in begun:
        added = added.unionByName(b)
    m = added.groupBy(*ATTRIBUTE, "at").agg(F.max(F.struct(*_LAST)).alias("m"))
    _write(cut(m.select(*ATTRIBUTE, "at", *(F.col(f"m.{c}").alias(c) for c in _LAST))), f"{path}/versions", "at")
    return touched


def stored_patches(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The patches of the periods (yyyy-MM) from ``first`` to ``last``; other partitions are not read."""
    p = spark.read.parquet(f"{path}/patches").withColumn("period", F.col("period").cast("string"))
    p = p.where(F.col("period") >= first) if first else p
    p = p.where(F.col("period") <= last) if last else p
    return _holding(p).withColumn("period", F.to_timestamp_ntz(F.concat("period", F.lit("-01")), F.lit("yyyy-MM-dd")))


def stored_state_at(spark: SparkSession, path: str, at: str) -> DataFrame:
    """(entity_id, predicate, object) as of ``at``, from the nearest full version and the patches after it."""
    moment = F.lit(at).cast("timestamp_ntz")
    versions = spark.read.parquet(f"{path}/versions").withColumn("at", F.col("at").cast("string"))
    near = versions.where(F.col("at") <= at[:7]).agg(F.max("at")).first()[0]  # of the directories' names
    later = stored_patches(spark, path, near, at[:7]).where(F.col("valid_from") <= moment).select(*ATTRIBUTE, *_LAST)
    whole = later if near is None else later.unionByName(versions.where(F.col("at") == near).select(*ATTRIBUTE, *_LAST))
    return _last(whole).where(F.col("until").isNull() | (F.col("until") > moment)).select(*ATTRIBUTE, "object")


def found(history: DataFrame) -> DataFrame:
    """The history in whole seconds since 1970; -1 for an open end."""
    return history.select(
        "entity_id", "predicate", "object", epoch_s(F.col("valid_from")).alias("from_s"), F.coalesce(epoch_s(F.col("valid_to")), F.lit(-1)).cast("bigint").alias("to_s")
    )
