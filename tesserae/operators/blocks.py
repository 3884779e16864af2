"""A stated set of queries against all rows, compared block against block.

Both sides are hashed into blocks of a bounded number of rows. One query block is broadcast (its size is
checked by count); more of them are packed, a row each, and meet the row blocks in a product of partitions,
each pair in a task of its own. Either way each side is read once and written to disk no more often than a
block needs to be put together, however many blocks it meets; nothing passes the driver but that one bounded
block, and a task holds two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae import constants as C
from tesserae.functions.text import token_set
from tesserae.sources.worker import one_core

#: Queries, and rows, in a block.
QUERIES_AT_ONCE, ROWS_AT_ONCE = 2048, 16_384
#: Rows found that a task passes on at once.
_SENT = 131_072


def compare(queries: DataFrame, rows: DataFrame, score: Callable[[pa.Table, pa.Table], Iterator[pa.Table]], schema: str, at_once: int | None = None) -> DataFrame:
    """What ``score(block of queries, block of rows)`` gives, in parts, for all blocks; both sides have an ``id``."""
    size = at_once or QUERIES_AT_ONCE
    n = max(1, -(-queries.count() // size))
    if n == 1:
        shipped = queries.sparkSession.sparkContext.broadcast(queries.toArrow())  # at most one block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one_core()
            for b in batches:
                if b.num_rows:
                    for found in score(shipped.value, pa.Table.from_batches([b])):
                        yield from found.to_batches(_SENT)

        return rows.mapInArrow(run, schema)
    m = max(1, -(-rows.count() // ROWS_AT_ONCE))
    met = _packed(queries, n, "_x").hint("shuffle_replicate_nl").crossJoin(_packed(rows, m, "_y"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_core()
        for b in batches:
            for k in range(b.num_rows):
                for found in score(*(pa.ipc.open_stream(b[c][k].as_buffer()).read_all() for c in ("_x", "_y"))):
                    yield from found.to_batches(_SENT)

    return met.mapInArrow(meet, schema)


def _packed(df: DataFrame, k: int, name: str) -> DataFrame:
    """(name): ``df`` in ``k`` blocks by ``id``, each a row of its own, in a partition of its own.

    Packed blocks are shuffled once; a product of their partitions reads them where they are, as often as it needs.
    """
    own = df.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")).repartitionById(k, F.col("_b"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(found).combine_chunks() if (found := list(batches)) else None
        if block and block.num_rows:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, (rows := block.drop_columns(["_b"])).schema) as out:
                out.write_table(rows)
            yield pa.record_batch([block["_b"].combine_chunks()[:1], pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["_b", name])

    return own.mapInArrow(pack, f"_b int, {name} binary").repartitionById(k, F.col("_b")).select(name)


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """The rows of a list column without nulls as float64 vectors."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if len(column) else np.empty((0, dim))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def usable(v: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` finite numbers, not all of them zero."""
    return v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)


def nearest(queries: DataFrame, rows: DataFrame, dim: int, k: int, least: float = -1.0) -> DataFrame:
    """(query_id, id, rank, score): the ``k`` nearest rows of every query, exactly; both sides are (id, v array<double>).

    Tasks keep the best ``k`` of their rows for each query, and only those are shuffled. A row is not its own
    neighbour; rows delivered again count once. Vectors of another length, null or with NaN take no part;
    ties go to the smaller id.
    """

    def best(q: pa.Table, r: pa.Table) -> Iterator[pa.Table]:
        names, own = np.array(q["id"].to_pylist(), dtype=str), np.array(r["id"].to_pylist(), dtype=str)
        s = np.round(_unit(matrix(r["v"], dim)) @ _unit(matrix(q["v"], dim)).T, 9)
        found = []
        for j, name in enumerate(names):
            keep = np.flatnonzero((s[:, j] >= least) & (own != name))
            if len(keep) > 4 * k:
                edge = np.partition(s[keep, j], len(keep) - 2 * k)[len(keep) - 2 * k]  # copies of a row may stand among them
                keep = keep[s[keep, j] >= edge]
            found.append((np.full(len(keep), j), keep, s[keep, j]))
        j, i, x = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))
        yield pa.table([pa.array(names[j], pa.string()), pa.array(own[i], pa.string()), pa.array(x, pa.float64())], names=["query_id", "id", "score"])

    side = lambda df: df.where(usable(F.col("v"), dim)).select("id", "v").dropDuplicates(["id"])
    top = compare(side(queries), side(rows), best, "query_id string, id string, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return top.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "rank", "score")


#: Rows of a block whose words are laid out at once.
_WORD_ROWS = 2048


def _overlaps(q: pa.Table, r: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, Jaccard similarities of some rows with all queries), by products of incidence matrices over the queries' words."""
    asked = q["tokens"].combine_chunks()
    words = pc.unique(asked.flatten())
    size = pc.list_value_length(asked).fill_null(0).to_numpy(zero_copy_only=False).astype(np.float32)

    def incidence(lists: pa.ListArray) -> np.ndarray:
        m = np.zeros((len(lists), len(words)), np.float32)
        code = pc.index_in(lists.flatten(), words)
        row = pc.list_parent_indices(lists)
        known = pc.is_valid(code)
        m[row.filter(known).to_numpy(), code.filter(known).to_numpy()] = 1
        return m

    a = incidence(asked)
    for lo in range(0, r.num_rows, _WORD_ROWS):
        part = r["tokens"].slice(lo, _WORD_ROWS).combine_chunks()
        n = pc.list_value_length(part).fill_null(0).to_numpy(zero_copy_only=False).astype(np.float32)
        common = (incidence(part) @ a.T).astype(np.float64)
        union = n[:, None] + size[None, :] - common
        yield lo, np.where(union > 0, common / np.maximum(union, 1), 1.0)


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as SQL does, halves away from zero."""
    return np.trunc(x * 10.0**digits + np.copysign(0.5, x)) / 10.0**digits


def hybrid_scores(q: pa.Table, r: pa.Table, least: float, digits: int | None = None) -> Iterator[pa.Table]:
    """(cid, id, score) of two blocks of (id, tokens, v), in parts; a row is not compared with itself, nor with queries named in its ``without``."""
    names, own = q["id"].combine_chunks(), r["id"].combine_chunks()
    known = pc.unique(names)
    code, same = (pc.index_in(c, known).fill_null(-1).to_numpy() for c in (names, own))
    lengths = [pc.list_value_length(t["v"]).fill_null(0).to_numpy() for t in (q, r)]
    unit = [[(at := np.flatnonzero(n == d), _unit(matrix(t["v"].take(pa.array(at)), d))) for n, t in zip(lengths, (q, r), strict=True)] for d in set(lengths[0].tolist()) & set(lengths[1].tolist()) - {0}]
    out = np.empty((0, 2), int)
    if "without" in r.column_names:
        lists = r["without"].combine_chunks()
        out = np.column_stack([pc.list_parent_indices(lists).to_numpy(), pc.index_in(lists.flatten(), names).fill_null(-1).to_numpy()])
        out = out[out[:, 1] >= 0]
    for lo, s in _overlaps(q, r):
        s[s < C.DIFFERENT_BELOW] = 0
        for (qi, qv), (ri, rv) in unit:
            here = (ri >= lo) & (ri < lo + len(s))
            s[np.ix_(ri[here] - lo, qi)] = rv[here] @ qv.T
        s[same[lo : lo + len(s), None] == code[None, :]] = -2
        mine = out[(out[:, 0] >= lo) & (out[:, 0] < lo + len(s))]
        s[mine[:, 0] - lo, mine[:, 1]] = -2
        i, j = np.nonzero(s >= least)
        score = s[i, j] if digits is None else _rounded(s[i, j], digits)
        yield pa.table([names.take(pa.array(j)), own.take(pa.array(i + lo)), pa.array(score)], names=["cid", "id", "score"])


def hybrid(queries: DataFrame, rows: DataFrame, least: float, vectors: bool = True, without: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(cid, id, score): rows of hybrid similarity ``least`` or more to a query; both sides are (id, summary, content, v array<double>).

    Where both have a vector ``v`` of one length, its cosine alone counts; else the Jaccard similarity of
    their words, and one below the lower bucket's bound is none. Null vectors have none; vectors with NaN
    count as none too, all-zero ones as cosine 0. A row is not compared with itself.
    ``without``: (id, other), pairs of a query and a row left out. They travel with the row, as many as there
    are queries at most, so that what is found needs no join to leave them out.
    ``digits``: to which scores that are at least ``least`` are rounded, in the tasks that find them.
    """

    def side(df: DataFrame) -> DataFrame:
        v = F.col("v") if vectors else F.lit(None).cast("array<double>")
        fine = F.when((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)), v)
        return df.select("id", F.coalesce(token_set(F.concat_ws(" ", "summary", "content")), F.array().cast("array<string>")).alias("tokens"), fine.alias("v")).dropDuplicates(["id"])

    asked, against = side(queries), side(rows)
    if without is not None:
        own = without.join(queries.select("id"), "id", "left_semi").groupBy("other").agg(F.collect_set("id").alias("without"))
        against = against.join(own.withColumnRenamed("other", "id"), "id", "left")
    return compare(asked, against, lambda q, r: hybrid_scores(q, r, least, digits), "cid string, id string, score double", at_once=512)
