"""All pairs of records with strongly overlapping tag sets (problem 5).

Multi-index binary sketches. Every distinct set gets one code of ``tables * width`` one-bit minhashes: bit j is
the lowest bit of the smallest hash of the set's members under hash function j, so two sets of Jaccard
similarity J agree in a bit with probability (1 + J) / 2. The code is cut into ``tables`` segments; sets that
agree in a whole segment meet in an equi-join on (segment, value) and stay if the first 128 bits of their
codes lie within the Hamming radius.

By the pigeonhole principle codes that differ in fewer bits than there are segments always meet. At the
threshold a fifth of the bits differ, so a guarantee for all of the radius would need segments of fewer than five
bits, whose values any two sets share; what holds for every pair instead is a probability, and all numbers are
calibrated for pairs exactly at the threshold:

* ``width`` grows with log2 of the number of distinct sets, so that unrelated sets meet in a bounded
  number per set at any size;
* ``tables`` is the least number with which a pair at the threshold shares a segment with the wanted
  recall; pairs above it do so more surely;
* ``radius`` is the binomial quantile of the distance at the threshold.

Survivors are verified on the original sets. Equal sets are collapsed before and expanded at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.sources.tables import cut, trimmed

THRESHOLD = 0.6
RECALL = 0.999
CODE_BITS = 128
MIN_TAGS = 3


def tag_sets(memories: DataFrame, min_tags: int = MIN_TAGS) -> DataFrame:
    """(id, tags): distinct tags of a record, trimmed, lower-cased and sorted; null and blank ones left out.

    Rows with fewer than ``min_tags`` tags or a null id take no part; rows delivered again fall together.
    """
    clean = F.transform("tags", lambda t: F.lower(trimmed(t)))
    kept = F.array_sort(F.array_distinct(F.filter(clean, lambda t: t.isNotNull() & (t != ""))))
    return memories.select("id", kept.alias("tags")).where(F.col("id").isNotNull() & (F.size("tags") >= min_tags)).distinct()


def calibrate(n_sets: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int, int]:
    """(width, tables, radius) for ``n_sets`` distinct sets; half of the allowed loss goes to each filter."""
    agree, loss = (1 + threshold) / 2, (1 - recall) / 2
    width = max(6, math.ceil(math.log2(max(2, n_sets))) - 5)
    tables = max(math.ceil(math.log(loss) / math.log(1 - agree**width)), -(-CODE_BITS // width))
    tail, radius = 0.0, -1
    while tail < 1 - loss:
        radius += 1
        tail += math.comb(CODE_BITS, radius) * (1 - agree) ** radius * agree ** (CODE_BITS - radius)
    return width, tables, radius


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch_bits(values: np.ndarray, starts: np.ndarray, n_bits: int) -> np.ndarray:
    """One-bit minhashes, (sets, n_bits) booleans. ``values``: 64-bit member hashes, set after set from ``starts``."""
    seeds = _mix(np.arange(1, n_bits + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct, index = np.unique(values, return_inverse=True)
    out = np.empty((len(starts), n_bits), dtype=bool)
    for j in range(0, n_bits, 64):
        hashed = (_mix(distinct[:, None] ^ seeds[None, j : j + 64]) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        out[:, j : j + 64] = np.minimum.reduceat(hashed[index], starts, axis=0) & np.uint32(1)
    return out


def _sketcher(width: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(width, dtype=np.int64))[None, None, :]
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                lists = part.column(1)
                offsets = lists.offsets.to_numpy()
                values = lists.flatten().to_numpy().view(np.uint64)
                bits = sketch_bits(values, (offsets[:-1] - offsets[0]).astype(np.int64), tables * width)
                keys = (bits.reshape(-1, tables, width) * weights).sum(axis=2)
                keys += np.arange(tables, dtype=np.int64)[None, :] << width
                code = np.packbits(bits[:, :CODE_BITS], axis=1).view(np.int64)
                n = part.num_rows
                key_list = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets).astype(np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in code.T), key_list], names=["sid", "n", "c1", "c2", "keys"])

    return run


def candidate_pairs(sets: DataFrame, n_sets: int, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(sid_a, sid_b) with sid_a < sid_b: sets that share a code segment and lie within the Hamming radius.

    A segment value shared by very many sets is a skewed join key, which AQE may split on both sides; pairs
    beyond the radius or the size bound are dropped inside the join. ``sid`` is a 64-bit hash: sets that share one
    are told apart when the pairs are verified.
    """
    width, tables, radius = calibrate(n_sets, threshold, recall)
    sketched = sets.select("sid", F.transform("tags", lambda t: F.xxhash64(t)).alias("h")).mapInArrow(_sketcher(width, tables), "sid bigint, n int, c1 bigint, c2 bigint, keys array<bigint>")
    rows = sketched.select("sid", "n", "c1", "c2", F.explode("keys").alias("key"))
    a, b = rows.alias("a"), rows.alias("b")
    apart = [F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in ("c1", "c2")]
    near = apart[0] + apart[1] <= radius
    sized = (F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n")) & (F.col("a.sid") < F.col("b.sid"))
    return a.join(b, (F.col("a.key") == F.col("b.key")) & sized & near).select(F.col("a.sid").alias("sid_a"), F.col("b.sid").alias("sid_b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(gid_a, gid_b, jaccard) with gid_a < gid_b: the candidate pairs whose original sets reach the threshold."""
    side = lambda x: sets.select(F.col("sid").alias(f"sid_{x}"), F.col("gid").alias(f"gid_{x}"), F.col("tags").alias(f"tags_{x}"))
    common = F.size(F.array_intersect("tags_a", "tags_b"))
    jaccard = common / (F.size("tags_a") + F.size("tags_b") - common)
    near = pairs.join(side("a"), "sid_a").join(side("b"), "sid_b").withColumn("jaccard", jaccard).where(F.col("jaccard") >= threshold)
    return near.select(F.least("gid_a", "gid_b").alias("gid_a"), F.greatest("gid_a", "gid_b").alias("gid_b"), "jaccard")


def similar_sets(memories: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, min_tags: int = MIN_TAGS) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (id, gid) of each record's distinct set, and (gid_a, gid_b, jaccard) of similar distinct sets.

    Ties at the threshold count as similar. Empty input gives empty results.
    """
    text = F.concat_ws("\u0001", "tags")
    members = cut(tag_sets(memories, min_tags).withColumns({"sid": F.xxhash64(text), "gid": F.unhex(F.md5(text))}))
    sets = cut(members.groupBy("sid", "gid").agg(F.first("tags").alias("tags")))
    clash = sets.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("sid").alias("sid_a"), F.col("sid").alias("sid_b"))
    candidates = candidate_pairs(sets, sets.count(), threshold, recall).unionByName(clash)
    return members.select("id", "gid"), verified(candidates, sets, threshold).where("gid_a < gid_b").dropDuplicates(["gid_a", "gid_b"])


def similar_pairs(memories: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, min_tags: int = MIN_TAGS) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of all similar records: similar sets and equal ones, expanded to their members."""
    members, pairs = similar_sets(memories, threshold, recall, min_tags)
    a = members.select(F.col("gid").alias("gid_a"), F.col("id").alias("x"))
    b = members.select(F.col("gid").alias("gid_b"), F.col("id").alias("y"))
    across = pairs.join(a, "gid_a").join(b, "gid_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    equal = a.join(b, (F.col("gid_a") == F.col("gid_b")) & (F.col("x") < F.col("y"))).select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    return across.unionByName(equal)


def similarity_classes(memories: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id, links): a record's class of equal sets and the number of other classes similar to it."""
    members, pairs = similar_sets(memories, threshold)
    links = pairs.select(F.explode(F.array("gid_a", "gid_b")).alias("gid")).groupBy("gid").agg(F.count(F.lit(1)).alias("links"))
    classes = members.groupBy("gid").agg(F.min("id").alias("class_id"))
    return members.join(classes.join(links, "gid", "left"), "gid").select("id", "class_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
