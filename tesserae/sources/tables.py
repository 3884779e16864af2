"""Reading the knowledge tables, and cutting long lineages."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of ``sf_dir``; pruning and pushdown are left to the parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset a temporary one is made if
    all runs on this machine (tests); on a cluster, whose executors would each write to a disk of their
    own, it is an error. Lost executors cannot lose the data.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def trimmed(c: Column) -> Column:
    """Without blanks and tabs at both ends."""
    return F.btrim(c, F.lit(" \t"))


def norm_id(c: Column) -> Column:
    """An id as compared: trimmed and lower-cased, null where blank."""
    t = F.lower(trimmed(c))
    return F.when(t != "", t)


def epoch_s(c: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone (floor), whatever the session's zone."""
    return (
        F.unix_date(c.cast("date")).cast("bigint") * 86400
        + F.hour(c) * 3600
        + F.minute(c) * 60
        + F.second(c)
    )


def first_loads(df: DataFrame, id_col: str = "id", keep: list[str] | None = None) -> DataFrame:
    """One row per record: rows delivered again fall together, ``loaded_at`` becomes the earliest.

    The repeated rows of an id carry equal values, so grouping by the values too keeps the aggregate
    a hash aggregate with map-side combining.
    """
    cols = keep if keep is not None else [c for c in df.columns if c not in (id_col, "loaded_at")]
    return df.groupBy(id_col, *cols).agg(F.min("loaded_at").alias("loaded_at"))


def records(df: DataFrame, id_col: str = "id") -> DataFrame:
    """One row per id with all its columns: of a record delivered again any copy (they are equal), ``loaded_at`` the earliest.

    Null ids fall together, as one record of no name would. One shuffle by id, combined map-side.
    """
    others = [c for c in df.columns if c not in (id_col, "loaded_at")]
    load = [F.min("loaded_at").alias("loaded_at")] if "loaded_at" in df.columns else []
    return df.groupBy(id_col).agg(*(F.first(c).alias(c) for c in others), *load).select(*df.columns)
