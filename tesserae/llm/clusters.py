"""Grouping records into similarity clusters (problem 4).

Reciprocal-nearest-neighbour average linkage. A cluster is kept as the sum of its members' unit
vectors and their number; the average cosine between two clusters is then
``dot(sum_a, sum_b) / (n_a * n_b)``, exactly, without visiting members. In a round all pairs of
clusters that are each other's best partner merge at once; rounds go on until no pair of mutual best
partners reaches the threshold. Average linkage is reducible, so the result is that of merging the best
pair of all over and over.

1. *Sparse graph.* An index of several tables brings vectors together, as one byte a number. In each table a vector
   is turned over (its numbers permuted, their signs flipped, in a way of the table's own) and goes to the
   cell of the pivot then nearest; pivots are a bounded, deterministic sample, and every vector is indexed.
   A cell's vectors are compared block against block; of the pairs that may reach the threshold, allowing
   for what the bytes lost, each block task emits a forest: as many edges as it has vectors, however dense
   they lie.
2. *Components.* Two clusters of average cosine at the threshold have members that reach it, so no merge ever
   leaves a connected component of that graph, and every best partner lies inside.
3. *Rounds.* A component that fits a task has all its rounds there, on its full similarity matrix. Larger
   ones have theirs on the cluster: per round cells emit each cluster's best partner, the best of
   all cells are compared, and only pairs that are mutual over all of them merge.

The number of tables is calibrated for pairs exactly at the threshold and the number of pivots, so that recall
does not fall as the data grow; pairs above it, and pairs of a cluster of more than two, meet more surely.
Vectors move as 16-bit numbers, which changes a cosine by less than 0.0001. Exact copies of a vector are collapsed before and count once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.components import stars
from tesserae.sources.tables import cut
from tesserae.sources.worker import one_core

THRESHOLD = 0.72
DIM = 128
#: Vectors of a cell compared at once in a task, and distinct vectors of a component that has its rounds in one task.
BLOCK, WHOLE = 8192, 12_000
#: Vectors of small components in one group, about.
TOGETHER = 4000
#: Rows of a similarity matrix held at once.
STRIP = 1024
#: Most pivots, and from how many on they are searched in two levels.
MAX_PIVOTS, FLAT = 65_536, 2048
#: Part of the lone pairs exactly at the threshold that must share a cell.
RECALL = 0.97
TYPICAL = 3
#: Members of a cluster ranked in one part.
PART = 20_000

_NODE = "cid binary, n bigint, v binary"


def usable(memories: DataFrame, dim: int = DIM, column: str = "embedding") -> DataFrame:
    """(id, e) of records whose vector has ``dim`` finite numbers, not all zero; other rows take no part."""
    e = F.col(column).cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    return memories.select("id", e.alias("e")).where(F.col("id").isNotNull() & (F.size("e") == dim) & fine)


def _rows(column: pa.Array | pa.ChunkedArray, dim: int, kind: type) -> np.ndarray:
    """The rows of a binary column as vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return np.empty((0, dim), kind)
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], kind, count=len(column) * dim, offset=int(start)).reshape(-1, dim)


def _binary(m: np.ndarray) -> pa.Array:
    """Rows as a binary column."""
    m = np.ascontiguousarray(m)
    offsets = np.arange(len(m) + 1, dtype=np.int32) * (m.shape[1] * m.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(m)])


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def _vectors(b: pa.RecordBatch, dim: int) -> tuple[np.ndarray, list[bytes]]:
    """Unit vectors of a batch of (id, e), and their 128-bit digests, by which equal ones are known."""
    m = b.column(1).flatten().to_numpy().reshape(-1, dim)
    v = _unit(m / np.abs(m).max(axis=1, keepdims=True)).astype(np.float32)  # scaled first, so that squares neither over- nor underflow
    return v, [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in v]


def _short(h: list[bytes]) -> pa.Array:
    """The first eight bytes of digests. Components are found by them: two vectors that share them only share a component."""
    return pa.array(np.frombuffer(b"".join(x[:8] for x in h), np.int64))


def _packed(v: np.ndarray, kind: type) -> pa.Array:
    """Unit vectors as whole numbers of ``kind``, after the step of each and the length of what rounding lost."""
    scale = (np.abs(v).max(axis=1) / np.iinfo(kind).max).astype(np.float32)
    q = np.rint(v / scale[:, None]).astype(kind)
    lost = np.linalg.norm(v - q * scale[:, None], axis=1).astype(np.float32)
    head = np.stack([scale, lost], axis=1).view(np.uint8)
    return _binary(np.concatenate([head, np.ascontiguousarray(q).view(np.uint8)], axis=1))


def _unpacked(column: pa.Array | pa.ChunkedArray, dim: int, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(step, lost, numbers as floats) of ``_packed``."""
    raw = _rows(column, 8 + dim * np.dtype(kind).itemsize, np.uint8)
    head = np.ascontiguousarray(raw[:, :8]).view(np.float32)
    return head[:, 0], head[:, 1], np.ascontiguousarray(raw[:, 8:]).view(kind).astype(np.float32)


def _unit_of(column: pa.Array | pa.ChunkedArray, dim: int, kind: type) -> np.ndarray:
    scale, _, q = _unpacked(column, dim, kind)
    return q * scale[:, None]


def _sketcher(dim: int):
    """(id, e) to (id, h, k, q): a digest, its beginning and the bytes of a vector; ``q`` is null for a copy of one that the partition had before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            if not b.num_rows:
                continue
            v, h = _vectors(b, dim)
            new = []
            for x in h:
                new.append(x not in seen)
                seen.add(x)
            qs = pa.compute.if_else(pa.array(new), _packed(v, np.int8), pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h, pa.binary()), _short(h), qs], names=["id", "h", "k", "q"])

    return run


def tables(pivots: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The number of tables in which a lone pair of cosine ``threshold``, far from all pivots, shares a cell with probability ``recall``.

    Simulated: similarities to unrelated pivots are correlated as the pair is similar.
    """
    rng = np.random.default_rng(7)
    trials = int(min(4000, max(200, 8_000_000 // pivots)))
    a, b = rng.standard_normal((2, trials, pivots), np.float32)
    same = np.mean(a.argmax(axis=1) == (threshold * a + (1 - threshold**2) ** 0.5 * b).argmax(axis=1))
    return int(np.ceil(np.log(1 - recall) / np.log(1 - min(same, 0.999)))) if pivots > 1 else 1


class Pivots:
    """Pivots, and which is nearest to a vector; beyond ``FLAT`` of them by way of the nearest ones of a coarser set."""

    def __init__(self, unit: np.ndarray):
        self.unit = unit
        self.coarse = None
        if len(unit) > FLAT:
            self.coarse = unit[: int(len(unit) ** 0.5)]
            home = np.concatenate([(unit[lo : lo + 8192] @ self.coarse.T).argmax(axis=1) for lo in range(0, len(unit), 8192)])
            self.members = [np.flatnonzero(home == c) for c in range(len(self.coarse))]

    def nearest(self, m: np.ndarray) -> np.ndarray:
        """Pivot numbers."""
        if self.coarse is None:
            return (m @ self.unit.T).argmax(axis=1)
        homes = np.argpartition(-(m @ self.coarse.T), 8, axis=1)[:, :8]
        best, who = np.full(len(m), -2.0, np.float32), np.zeros(len(m), np.int64)
        for c in np.unique(homes):
            mine, at = self.members[c], np.flatnonzero((homes == c).any(axis=1))
            if len(mine):
                s = m[at] @ self.unit[mine].T
                top = s.argmax(axis=1)
                val = s[np.arange(len(at)), top]
                better = val > best[at]
                best[at[better]], who[at[better]] = val[better], mine[top[better]]
        return who


def _cells(nodes: DataFrame, units, sample: np.ndarray, n_tables: int, key: str) -> DataFrame:
    """``nodes`` once for each of their cells and each block that they meet there: with ``cell``, ``pair`` of blocks and ``side`` of the pair (2: both).

    ``units(batch)`` are the rows' unit vectors. Cells of more than ``BLOCK`` rows are split by ``key``; every two
    of their blocks meet. The driver holds a count for each cell, the tasks the pivots: both bounded.
    """
    sc = nodes.sparkSession.sparkContext
    shipped = sc.broadcast(sample)

    def assign(splits):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one_core()
            pivots = Pivots(shipped.value)
            rng = np.random.default_rng(11)
            turns = [(rng.permutation(sample_dim), rng.choice(np.array([-1, 1], np.float32), sample_dim)) for _ in range(n_tables)]
            for b in batches:
                if not b.num_rows:
                    continue
                m = units(b).astype(np.float32)
                cell = np.stack([t * size + pivots.nearest(m[:, order] * sign) for t, (order, sign) in enumerate(turns)], axis=1).ravel()
                if splits is None:
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32))], names=["cell"])
                    continue
                row = np.repeat(np.arange(len(m)), n_tables)
                n = splits.value[cell]
                keys = b.column(key)
                mixed = keys.to_numpy() & 0x7FFFFFFF if pa.types.is_integer(keys.type) else np.array([int.from_bytes(x[:4], "little") for x in keys.to_pylist()], np.int64)
                part = mixed[row] % n
                other = np.concatenate([np.arange(x) for x in n])
                row, cell, n, part = np.repeat(row, n), np.repeat(cell, n), np.repeat(n, n), np.repeat(part, n)
                pair = np.minimum(part, other) * n + np.maximum(part, other)
                side = np.where(part == other, 2, part > other)
                columns = [*b.take(pa.array(row)).columns, *(pa.array(x.astype(np.int32)) for x in (cell, pair, side))]
                yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "cell", "pair", "side"])

        return run

    size, sample_dim = sample.shape
    counts = nodes.mapInArrow(assign(None), "cell int").groupBy("cell").agg(F.count(F.lit(1)).alias("c")).toArrow()  # at most one row for each pivot and table
    splits = np.ones(size * n_tables, np.int64)
    splits[counts["cell"].to_numpy()] = -(-counts["c"].to_numpy() // BLOCK)
    fields = ", ".join(f"{c} {t}" for c, t in nodes.dtypes)
    return nodes.mapInArrow(assign(sc.broadcast(splits)), f"{fields}, cell int, pair int, side int")


def _joined(near: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Component numbers of the rows and of the columns of a boolean adjacency, -1 for those alone; ``same``: rows and columns are the same vectors.

    A component is found by going back and forth from one of its vectors; every row and column is read once.
    """
    rows, columns = np.full(near.shape[0], -1), np.full(near.shape[1], -1)
    turned = near if same else np.ascontiguousarray(near.T)
    for k, seed in enumerate(np.flatnonzero(np.count_nonzero(near, axis=1) > int(same))):
        if rows[seed] >= 0:
            continue
        ahead = np.array([seed])
        while len(ahead):
            rows[ahead] = k
            met = np.flatnonzero(near[ahead].any(axis=0) & (columns < 0))
            columns[met] = k
            ahead = met[rows[met] < 0] if same else np.flatnonzero(turned[met].any(axis=0) & (rows < 0))
    return rows, columns


def _forest(dim: int, threshold: float):
    """Edges (a, b) that join what may be similar within two blocks of a cell, as a star for each of their components.

    ``q``: two floats, a step and what was lost, then a byte a number.
    """

    def run(_key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        one_core()
        k = group["k"].to_numpy()
        order = np.argsort(k, kind="stable")  # stars have their least key in the middle, the same in every table
        k, side = k[order], group["side"].to_numpy()[order]
        scale, err, q = (c[order] for c in _unpacked(group["q"], dim, np.int8))
        v, one = q * scale[:, None], np.ones((len(k), 1), np.float32)
        x, y = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        # what rounding lost is added by two more numbers of each vector
        left, right = np.hstack([v, err[:, None], one])[x], np.hstack([v, one, err[:, None]])[y].T
        near, same = np.empty((len(x), len(y)), bool), bool(len(side)) and side[0] == 2
        for lo in range(0, len(x), STRIP):
            begin = lo if same else 0  # within a block one half of the matrix is the other one turned
            np.greater_equal(left[lo : lo + STRIP] @ right[:, begin:], np.float32(threshold - 1e-4), out=near[lo : lo + STRIP, begin:])
            if same:
                near[lo + STRIP :, lo : lo + STRIP] = near[lo : lo + STRIP, lo + STRIP :].T
        rows, columns = _joined(near, same)
        at, part = np.concatenate([x, y]), np.concatenate([rows, columns])
        at, part = at[part >= 0], part[part >= 0]
        by = np.lexsort((at, part))
        at, part = at[by], part[by]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(at) else np.empty(0, np.int64)
        head = np.repeat(at[first], np.diff(np.append(first, len(at))))
        moved = at != head
        return pa.table([pa.array(k[at[moved]]), pa.array(k[head[moved]])], names=["a", "b"])

    return run


def merge_rounds(sums: np.ndarray, n: np.ndarray, threshold: float) -> np.ndarray:
    """Average linkage of a group by rounds of mutual best pairs: a label for each row, the index of its cluster's first row. ``threshold`` is above 0.

    An average with a merged cluster never exceeds the better of those with its parts. So a cluster's best partner
    stays the best until it is merged itself, and even then while the new average is no less than what the
    cluster had as second best; only otherwise all of its partners are looked at again. Ties go to the lower
    index; should rounding keep near ties from being mutual, the best pair of all merges alone.
    """
    label = np.arange(len(n))
    alive = np.arange(len(n))
    sums, n = sums.astype(np.float64), n.astype(np.float64)
    mean = (sums / n[:, None]).astype(np.float32)
    best, stale = np.zeros(len(n), np.int64), np.arange(len(n))
    s, second = (np.full(len(n), -2.0, np.float32) for _ in range(2))

    def look(at: np.ndarray, strip: np.ndarray) -> None:
        """Best and second best of the rows ``at``, whose similarities with all rows are ``strip``."""
        k = np.arange(len(at))
        strip[k, at] = -2
        best[at] = strip.argmax(axis=1)
        s[at] = strip[k, best[at]]
        strip[k, best[at]] = -2
        second[at] = strip.max(axis=1)

    while len(alive) > 1:
        for lo in range(0, len(stale), STRIP):
            at = stale[lo : lo + STRIP]
            look(at, mean[at] @ mean.T)
        rows = np.arange(len(alive))
        pair = (best[best] == rows) & (rows < best) & (s >= threshold)
        if pair.any():
            a, b = rows[pair], best[pair]
        elif s.max() >= threshold:
            a, b = (np.array([f(s.argmax(), best[s.argmax()])]) for f in (min, max))
        else:
            break
        to = np.arange(len(label))
        to[alive[b]] = alive[a]
        label = to[label]
        sums[a] += sums[b]
        n[a] += n[b]
        mean[a] = sums[a] / n[a][:, None]
        mean[b], s[b], second[b] = 0, -2, -2  # gone: an average of 0 is below any threshold
        place = np.arange(len(alive))
        place[b] = a
        merged = np.zeros(len(alive), bool)
        merged[a] = True
        partner = place[best]
        waiting = np.flatnonzero(merged[partner] & ~merged & (s > -2))  # their partner has become another cluster
        fresh = np.empty(len(waiting), np.float32)
        for lo in range(0, len(a), STRIP):
            part = a[lo : lo + STRIP]
            strip = mean[part] @ mean.T
            at = np.searchsorted(part, partner[waiting])
            mine = (at < len(part)) & (part[np.minimum(at, len(part) - 1)] == partner[waiting])
            fresh[mine] = strip[at[mine], waiting[mine]]
            look(part, strip)
        still = fresh >= second[waiting]
        best[waiting[still]], s[waiting[still]] = partner[waiting[still]], fresh[still]
        stale = waiting[~still]
        # a cluster with no partner in reach will have none: averages of its present similarities do not rise
        keep = s >= threshold
        keep[stale] = True
        if keep.sum() < 0.7 * len(keep):
            where = np.cumsum(keep) - 1
            best, stale = where[best][keep], where[stale]
            alive, sums, n, mean, s, second = alive[keep], sums[keep], n[keep], mean[keep], s[keep], second[keep]
    return label


_FOUND = "h binary, cid binary, s double"


def _link(dim: int, threshold: float):
    """Whole components (root, h, v) to (h, cid, s): their clusters, and each vector's cosine with its cluster's mean."""

    def run(_key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        one_core()
        group = group.sort_by([("root", "ascending"), ("h", "ascending")]).combine_chunks()
        h, root = group["h"].to_pylist(), group["root"].to_numpy()
        once = np.flatnonzero([k == 0 or x != h[k - 1] for k, x in enumerate(h)])  # copies that several partitions held
        v, root = _unit_of(group["v"], dim, np.int16)[once], root[once]
        label = np.arange(len(v))
        ends = np.append(np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]])), len(root))
        for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if hi - lo > 2:
                label[lo:hi] = lo + merge_rounds(v[lo:hi], np.ones(hi - lo), threshold)
            elif hi - lo == 2 and v[lo] @ v[lo + 1] >= threshold:
                label[lo + 1] = lo
        sums = np.zeros((len(v), dim))
        np.add.at(sums, label, v)
        s = np.einsum("ij,ij->i", v, _unit(sums)[label])
        hs = pa.array([h[k] for k in once], pa.binary())
        return pa.table([hs, hs.take(pa.array(label)), pa.array(np.round(s, 6))], names=["h", "cid", "s"])

    return run


def _best(dim: int, threshold: float):
    """(a, b, s): of each cluster in two blocks of a cell its best partner there, if that reaches the threshold."""

    def run(_key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        one_core()
        group = group.sort_by([("cid", "ascending")]).combine_chunks()
        side, n = group["side"].to_numpy(), group["n"].to_numpy().astype(np.float64)
        v = (_rows(group["v"], dim, np.float32) / n[:, None]).astype(np.float32)
        both = (np.flatnonzero(side != 1), np.flatnonzero(side != 0))
        a, b, t = [], [], []
        for one, two in (both, both[::-1])[: 1 if len(side) and side[0] == 2 else 2]:
            for lo in range(0, len(one) if len(two) else 0, STRIP):
                strip = one[lo : lo + STRIP]
                s = v[strip] @ v[two].T
                s[strip[:, None] == two[None, :]] = -2
                at = s.argmax(axis=1)
                val = np.round(s[np.arange(len(strip)), at].astype(np.float64), 6)
                keep = val >= threshold
                a.append(strip[keep])
                b.append(two[at[keep]])
                t.append(val[keep])
        a, b, t = (np.concatenate(z) if z else np.empty(0, int) for z in (a, b, t))
        cid = group["cid"].combine_chunks()
        return pa.table([cid.take(pa.array(a, pa.int64())), cid.take(pa.array(b, pa.int64())), pa.array(t, pa.float64())], names=["a", "b", "s"])

    return run


def _mutual(best: DataFrame) -> DataFrame:
    """(child, cid): of pairs that are each other's best, the larger id joins the smaller; equal pairs in order of their ids."""
    pairs = best.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("s").alias("s"))
    order = F.struct((-F.col("s")).alias("s"), "a", "b")
    both = pairs.select(F.explode(F.array("a", "b")).alias("e"), order.alias("o")).groupBy("e").agg(F.min("o").alias("o"))
    return both.groupBy(F.col("o.a").alias("cid"), F.col("o.b").alias("child")).agg(F.count(F.lit(1)).alias("k")).where("k = 2").select("child", "cid")


def _add(dim: int):
    def run(_key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        total = _rows(group["v"], dim, np.float32).astype(np.float64).sum(axis=0, keepdims=True).astype(np.float32)
        return pa.table([group["cid"].slice(0, 1).combine_chunks(), pa.array([sum(group["n"].to_pylist())], pa.int64()), _binary(total)], names=["cid", "n", "v"])

    return run


def _sample(vectors: DataFrame, count: int, dim: int, unit) -> np.ndarray:
    """Pivots: the vectors of the smallest digests, at most ``MAX_PIVOTS``; cells hold some thousands of vectors, slowly more as those grow."""
    size = int(min(MAX_PIVOTS, max(2, count**0.75 / 90)))
    table = vectors.orderBy(vectors.columns[0]).limit(size).toArrow().combine_chunks()
    return unit(table)


def distributed_rounds(nodes: DataFrame, dim: int, threshold: float, spread: int | None = None) -> DataFrame:
    """(h, cid, s) of components too large for a task; ``nodes``: (cid, n, v), one for each distinct vector.

    A round: cells give each cluster's best partner, mutual ones merge.
    """
    unit = lambda b: _unit(_rows(b.column("v"), dim, np.float32))
    active = start = cut(nodes)
    label = cut(active.select(F.col("cid").alias("h"), "cid"))
    every = False
    while True:  # a third of the tables while they give pairs, then all of them until they give none
        count = active.count()
        if count < 2:
            break
        sample = _sample(active.select("cid", "v"), count, dim, lambda t: _unit(_rows(t["v"], dim, np.float32)))
        n = spread or tables(len(sample), threshold)
        cells = _cells(active, unit, sample, n if every else -(-n // 3), "cid")
        best = cut(cells.groupBy("cell", "pair").applyInArrow(_best(dim, threshold), "a binary, b binary, s double"))
        to = cut(_mutual(best))
        if to.isEmpty():
            if every:
                break
            every = True
            continue
        placed = active.join(to.withColumnRenamed("cid", "y"), F.col("cid") == F.col("child"), "left")
        moved = placed.select(F.coalesce("y", "cid").alias("cid"), "n", "v")
        active = cut(moved.groupBy("cid").applyInArrow(_add(dim), _NODE))
        label = cut(label.join(to.select(F.col("child").alias("x"), F.col("cid").alias("y")), F.col("cid") == F.col("x"), "left").select("h", F.coalesce("y", "cid").alias("cid")))
    def nearness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = np.einsum("ij,ij->i", _rows(b.column("own"), dim, np.float32), _unit(_rows(b.column("v"), dim, np.float32)))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("h", "cid")), pa.array(np.round(s.astype(np.float64), 6))], names=["h", "cid", "s"])

    own = start.select(F.col("cid").alias("h"), F.col("v").alias("own"))
    return label.join(active.select("cid", "v"), "cid").join(own, "h").select("h", "cid", "own", "v").mapInArrow(nearness, _FOUND)


def clusters(memories: DataFrame, threshold: float = THRESHOLD, dim: int = DIM, column: str = "embedding", whole: int | None = None, spread: int | None = None) -> DataFrame:
    """(id, cid, first_id, s): every record with a usable vector, its cluster, that cluster's smallest id, and the cosine with its mean.

    Rows delivered again fall together; no usable vector at all gives no rows. ``whole`` and ``spread`` stand
    in for ``WHOLE`` and the calibrated number of tables.
    """
    rows = usable(memories, dim, column)
    sketches = cut(rows.mapInArrow(_sketcher(dim), "id string, h binary, k bigint, q binary"))
    ids = sketches.select("id", "h")
    nodes = sketches.where("q is not null").select("k", "q")
    count = nodes.count()
    unit = lambda b: _unit_of(b.column("q"), dim, np.int8)
    if count < 2:
        return _named(ids.distinct().select("id", F.col("h").alias("cid"), F.lit(1.0).alias("s")))
    sample = _sample(nodes, count, dim, lambda t: _unit(_unit_of(t["q"], dim, np.int8)))
    cells = _cells(nodes, unit, sample, spread or tables(len(sample), threshold), "k")
    root = cut(stars(cells.groupBy("cell", "pair").applyInArrow(_forest(dim, threshold), "a bigint, b bigint")))
    sizes = root.groupBy("root").agg(F.count(F.lit(1)).alias("c"))
    tied = root.join(sizes, "root").select(F.col("node").alias("k"), "root", "c")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            if b.num_rows:
                v, h = _vectors(b, dim)
                new = [k for k, x in enumerate(h) if x not in seen and not seen.add(x)]
                yield pa.RecordBatch.from_arrays([pa.array([h[k] for k in new], pa.binary()), _short([h[k] for k in new]), _packed(v[new], np.int16)], names=["h", "k", "v"])

    vectors = rows.mapInArrow(full, "h binary, k bigint, v binary")
    limit = whole or WHOLE
    fits = F.col("c") <= limit
    total = sizes.agg(F.sum(F.when(fits, F.col("c"))).alias("n"), F.count_if(~fits).alias("large")).first()
    # a group holds many small components, some thousands of vectors
    bucket = F.pmod(F.xxhash64("root"), F.lit(-(-(total.n or 1) // TOGETHER))).alias("bucket")
    small = vectors.join(tied.where(fits), "k").select(bucket, "root", "h", "v")
    found = small.groupBy("bucket").applyInArrow(_link(dim, threshold), _FOUND)
    if total.large:
        def floats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.ones(b.num_rows, np.int64)), _binary(_unit_of(b.column(1), dim, np.int16))], names=["cid", "n", "v"])

        large = vectors.join(tied.where(~fits), "k").dropDuplicates(["h"]).select("h", "v").mapInArrow(floats, _NODE)
        found = found.unionByName(distributed_rounds(large, dim, threshold, spread))
    # who is in no component is a cluster alone
    known = ids.distinct().join(found, "h", "left")
    members = cut(known.select("id", F.coalesce("cid", "h").alias("cid"), F.coalesce("s", F.lit(1.0)).alias("s")))
    return _named(members)


def _named(members: DataFrame) -> DataFrame:
    """(id, cid, first_id, s) with the smallest id of each cluster."""
    return members.join(members.groupBy("cid").agg(F.min("id").alias("first_id")), "cid").select("id", "cid", "first_id", "s")


def summary(memories: DataFrame, threshold: float = THRESHOLD, dim: int = DIM, column: str = "embedding", typical: int = TYPICAL) -> DataFrame:
    """(first_id, size, typical): each cluster's number of records and its ``typical`` members nearest the mean (ties: smaller ids).

    The nearest members are first picked within parts of a cluster, then among those.
    """
    members = cut(clusters(memories, threshold, dim, column))
    sizes = members.groupBy("cid").agg(F.count(F.lit(1)).alias("size"))
    near = members.join(sizes, "cid").withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / PART)))
    order = [F.desc("s"), "id"]
    for by in (["cid", "salt"], ["cid"]):
        near = near.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r") <= typical)
    best = near.groupBy("cid", "first_id", "size").agg(F.sort_array(F.collect_list(F.struct("r", "id"))).alias("m"))  # `typical` rows each
    return best.select("first_id", "size", F.col("m.id").alias("typical"))


def found(members: DataFrame) -> DataFrame:
    """(first_id, memory_id): each member but the smallest of its cluster."""
    return members.where(F.col("id") != F.col("first_id")).select("first_id", F.col("id").alias("memory_id"))
