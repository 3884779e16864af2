"""The typed graph between memories: centrality, bounded breadth-first traversal, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae import constants as C
from tesserae.sources.tables import cut


def centrality(edges: DataFrame) -> DataFrame:
    """(id, in_degree, centrality): incoming edges over the most that any memory has; memories without any are absent.

    Counting combines map-side, so a target with a third of all edges is no hot key.
    """
    degree = edges.where(F.col("target_id").isNotNull()).groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    most = degree.agg(F.max("in_degree")).scalar()
    return degree.withColumn("centrality", F.col("in_degree") / most)


def steps(edges: DataFrame, types: list[str] | None = None, direction: str = "both", least: float = 0.0) -> DataFrame:
    """(from, to, dir, edge_id): the moves a traversal may make; ``dir`` 0 along, 1 against an edge. Null strengths count as 0."""
    e = edges.where(F.coalesce("strength", F.lit(0.0)) >= least)
    if types is not None:
        e = e.where(F.col("relation_type").isin(types))
    out = e.select(F.col("source_id").alias("from"), F.col("target_id").alias("to"), F.lit(0).alias("dir"), F.col("id").alias("edge_id"))
    back = e.select(F.col("target_id").alias("from"), F.col("source_id").alias("to"), F.lit(1).alias("dir"), F.col("id").alias("edge_id"))
    moves = out if direction == "outgoing" else back if direction == "incoming" else out.unionByName(back)
    return moves.where(F.col("from").isNotNull() & F.col("to").isNotNull())


def traverse(edges: DataFrame, starts: DataFrame, depth: int = C.TRAVERSAL_DEPTH, types: list[str] | None = None, direction: str = "both", least: float = 0.0, paths: bool = True) -> DataFrame:
    """(root, id, depth[, path]): what each start (one id column) reaches within ``depth`` moves, at its least depth, the start excluded.

    All starts advance together, a level being one join of the frontier with the moves. Of several ways to
    a node in one level, the one whose path of (direction, edge) comes first is kept: as a queue would reach it
    that takes out-edges before in-edges and each in order of their ids. A self-loop leads nowhere. Without
    ``paths`` only pairs of ids move. Levels are checkpointed, the frontier joins as it is.
    """
    moves = steps(edges, types, direction, least)
    if not paths:
        moves = moves.select("from", "to").distinct()  # parallel edges lead to the same place
    begin = starts.select(F.col(starts.columns[0]).alias("root")).where(F.col("root").isNotNull()).distinct()
    order = F.array().cast("array<struct<dir:int,edge_id:string>>").alias("path")
    seen = frontier = begin.select("root", F.col("root").alias("id"), F.lit(0).alias("depth"), *([order] if paths else []))
    for level in range(1, depth + 1):
        ahead = frontier.join(moves, frontier["id"] == moves["from"])
        if paths:
            best = ahead.select("root", F.col("to").alias("id"), F.concat("path", F.array(F.struct("dir", "edge_id"))).alias("path")).groupBy("root", "id").agg(F.min("path").alias("path"))
        else:
            best = ahead.select("root", F.col("to").alias("id")).distinct()
        frontier = cut(best.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("depth", F.lit(level)).select(*seen.columns))
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    found = seen.where("depth > 0")
    return found.select("root", "id", "depth", F.transform("path", lambda p: p["edge_id"]).alias("path")) if paths else found.select("root", "id", "depth")


def by_depth(reached: DataFrame, memories: DataFrame) -> DataFrame:
    """(root, depth, n): how many existing memories are reached at each depth."""
    return reached.join(memories.select("id").distinct(), "id", "left_semi").groupBy("root", "depth").agg(F.count(F.lit(1)).alias("n"))


def source_code(edges: DataFrame, memories: DataFrame, hits: DataFrame) -> DataFrame:
    """(root, id): the code rows that prose memories are the source of, one move along ``source_of``."""
    e = edges.where(F.col("relation_type") == "source_of").select(F.col("source_id").alias("root"), F.col("target_id").alias("id"))
    code = memories.where(F.col("memory_type") == "code").select("id").distinct()
    return e.join(hits.select(F.col(hits.columns[0]).alias("root")).distinct(), "root", "left_semi").join(code, "id", "left_semi").distinct()


def related(edges: DataFrame, hits: DataFrame, memories: DataFrame, depth: int = C.TRAVERSAL_DEPTH) -> DataFrame:
    """(id, related): for each hit, the ids of code it is the source of, then of what it reaches, nearest first; missing memories left out."""
    linked = edges.where(F.col("relation_type") == "source_of").select(F.col("source_id").alias("root"), F.col("target_id").alias("id"), F.lit(0).alias("depth"))
    linked = linked.join(hits.select(F.col(hits.columns[0]).alias("root")).distinct(), "root", "left_semi")
    reached = traverse(edges, hits, depth, paths=False)
    known = linked.unionByName(reached).join(memories.select("id").distinct(), "id", "left_semi")
    nearest = known.groupBy("root", "id").agg(F.min("depth").alias("depth"))
    return nearest.groupBy("root").agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "id"))), lambda x: x["id"]).alias("related")).withColumnRenamed("root", "id")


def endpoint_report(edges: DataFrame, memories: DataFrame, relation: str = "relates_to") -> DataFrame:
    """(whole, skipped): edges of a relation with both ends present, and those without."""
    here = memories.select("id").distinct()
    e = edges.where(F.col("relation_type") == relation).select("id", "source_id", "target_id")
    s = here.select(F.col("id").alias("source_id"), F.lit(1).alias("_s"))
    t = here.select(F.col("id").alias("target_id"), F.lit(1).alias("_t"))
    both = e.join(s, "source_id", "left").join(t, "target_id", "left")
    ok = F.col("_s").isNotNull() & F.col("_t").isNotNull()
    return both.agg(F.count_if(ok).alias("whole"), F.count_if(~ok).alias("skipped"))


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """``df`` with the number of its batch of ``size`` rows.

    Numbering is within range partitions, continued across them from their counts (one small aggregate),
    so no task sees all rows.
    """
    parts = cut(df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()))
    before = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    i = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1 + F.col("_before")
    return parts.join(F.broadcast(before.select("_p", "_before")), "_p").withColumn("batch", F.floor(i / size)).drop("_p", "_before")  # one row a partition
