"""Duplicate detection: set-similarity joins, best matches, first-fit selection, merges.

Set joins are exact. One avoids comparing everything: tokens are ordered by how rare they are, and two
sets of Jaccard similarity t or more must share a token among the rarest ``n - ceil(t n) + 1`` of either
(prefix filtering). Equal sets are collapsed before and count as one; common words are hardly ever in a
prefix. Pairs that meet are tested before they leave the join: each set carries a bitmap of its tokens, and
the bits in which two bitmaps differ bound their symmetric difference from below, hence their overlap from
above, exactly. Only pairs that pass are verified on the sets.

Where even the rarest tokens are common, as in texts made from templates, most sets meet most others so, and
each again for every token they share. Within a collection the other join then lays blocks of sets against each
other in separate tasks, and there bitmaps of those that share a rare token: how far into a set that token may
stand depends on the size of the other, and costs a few instructions a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae import constants as C
from tesserae.functions import similarity as S
from tesserae.functions.text import token_set
from tesserae.operators import blocks
from tesserae.sources.tables import cut


def compared_text(_df: DataFrame | None = None) -> Column:
    """The tokens by which memories are compared."""
    return token_set(F.concat_ws(" ", "summary", "content"))


def set_classes(df: DataFrame, tokens: Column, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(members, classes): (id, sid) and (sid, tokens) of the distinct non-empty token sets."""
    rows = df.select(F.col(id_col).alias("id"), F.array_sort(tokens).alias("tokens")).where(F.size("tokens") > 0).distinct()
    hashed = cut(rows.withColumn("sid", F.unhex(F.md5(F.concat_ws(" ", "tokens")))))  # 128 bits: no two sets of any collection share it
    return hashed.select("id", "sid"), hashed.select("sid", "tokens").dropDuplicates(["sid"])


def rarity(classes: DataFrame) -> DataFrame:
    """(token, df): in how many classes a token is."""
    return classes.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


WORDS = 4


def _bitmap() -> list[Column]:
    """Tokens hashed to single bits, in ``WORDS`` columns of 64."""
    return [F.expr(f"aggregate(filter(transform(tokens, t -> pmod(xxhash64(t), {64 * WORDS})), h -> h div 64 = {w}), 0L, (a, h) -> a | shiftleft(1L, cast(h % 64 as int)))").alias(f"b{w}") for w in range(WORDS)]


def prefixes(classes: DataFrame, df: DataFrame, threshold: float) -> DataFrame:
    """(sid, n, b0..., token): the rarest tokens of each class that a similar one must share, with its size and bitmap. Ties in rarity go by token."""
    each = classes.select("sid", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(df, "token")
    r = F.row_number().over(Window.partitionBy("sid").orderBy("df", "token"))
    length = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    rare = each.withColumn("_r", r).where(F.col("_r") <= length).select("sid", "n", "token")
    return rare.join(classes.select("sid", *_bitmap()), "sid")


def set_join(a: DataFrame, b: DataFrame, threshold: float, itself: bool = False) -> DataFrame:
    """(sid_a, sid_b, jaccard) of classes of two collections with Jaccard similarity ``threshold`` or more.

    ``itself``: both are the same collection, and only sid_a < sid_b is given. Equal sets of two collections match.
    A token in very many prefixes is a skewed key; the join is left to Spark, so that AQE may split it.
    """
    both = a if itself else a.unionByName(b).dropDuplicates(["sid"])
    df = cut(rarity(both))
    left = prefixes(a, df, threshold)
    x, y = left.alias("x"), (left if itself else prefixes(b, df, threshold)).alias("y")
    total = F.col("x.n") + F.col("y.n")
    apart = sum((F.bit_count(F.col(f"x.b{w}").bitwiseXOR(F.col(f"y.b{w}"))) for w in range(1, WORDS)), F.bit_count(F.col("x.b0").bitwiseXOR(F.col("y.b0"))))
    enough = total - apart >= F.lit(2 * threshold / (1 + threshold)) * total - 1e-9
    sized = F.least("x.n", "y.n") >= F.lit(threshold) * F.greatest("x.n", "y.n")
    once = F.col("x.sid") < F.col("y.sid") if itself else F.lit(True)
    near = x.join(y, (F.col("x.token") == F.col("y.token")) & sized & once & enough).select(F.col("x.sid").alias("sid_a"), F.col("y.sid").alias("sid_b")).distinct()
    first = a.select(F.col("sid").alias("sid_a"), F.col("tokens").alias("_a"))
    second = b.select(F.col("sid").alias("sid_b"), F.col("tokens").alias("_b"))
    return near.join(first, "sid_a").join(second, "sid_b").withColumn("jaccard", S.jaccard(F.col("_a"), F.col("_b"))).where(F.col("jaccard") >= threshold).select("sid_a", "sid_b", "jaccard")


#: Classes in a block of a sweep at most, and blocks into which fewer are cut for the sake of the cores.
SWEPT, SWEEPS = 131_072, 6
#: Rows and columns of bitmaps compared at once.
_ROWS, _COLUMNS = 64, 2048
#: Tokens of two classes that one word of bits still tells apart.
_SMALL = 48


class _Side:
    """A block of classes in order of size: ``n``, bitmaps, and where their tokens are in ``codes``."""

    def __init__(self, n: np.ndarray, codes: np.ndarray, starts: np.ndarray, bits: list[np.ndarray], rows: np.ndarray):
        self.rows = rows[np.argsort(n[rows], kind="stable")]
        self.n, self.starts, self.codes, self.bits = n[self.rows], starts[self.rows], codes, [b[self.rows] for b in bits]
        self.two = [self.bits[0] ^ self.bits[2], self.bits[1] ^ self.bits[3]]  # folded, bitmaps differ in no more bits than before
        self.one = [self.two[0] ^ self.two[1]]

    def tokens(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``at``, code) of all tokens of the classes ``at``."""
        n = self.n[at]
        ends = np.cumsum(n)
        which = np.repeat(np.arange(len(at)), n)
        return which, self.codes[np.repeat(self.starts[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


class _Postings:
    """Rarest tokens of a side's classes by token, size and reach: the size up to which a set may be similar that meets the class there first."""

    def __init__(self, side: _Side, words: int, threshold: float):
        row, token = side.tokens(np.arange(len(side.n)))
        n = side.n[row]
        rest = n - (np.arange(len(row)) - (np.cumsum(side.n) - side.n)[row])  # tokens from this one on
        reach = np.floor(rest * (1 + threshold) / threshold - n + 1e-9).astype(np.int64)
        kept = np.flatnonzero(reach >= threshold * n - 1e-9)
        kept = kept[np.lexsort((reach[kept], n[kept], token[kept]))]
        self.row, self.n, self.reach = row[kept].astype(np.int32), n[kept].astype(np.int32), reach[kept].astype(np.int32)
        self.at = np.concatenate([[0], np.cumsum(np.bincount(token[kept], minlength=words))])


#: Pairs of a token's postings that are laid out at once with those of other tokens; pairs passed on, or laid out, at once.
_LITTLE, _PAIRS = 2048, 1 << 19


def _near(x: _Side, y: _Side, words: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, token) by batches: classes of ``x`` and ``y`` that share one of ``words`` tokens, whose sizes, bitmaps and its place allow ``threshold``; within one block i < j.

    A pair that is similar comes at the first token, in order, that it shares, and may come at later ones.
    """
    share = (1 - threshold) / (1 + threshold)  # of both sizes, what similar sets may have apart
    p = _Postings(x, words, threshold)
    q = p if x is y else _Postings(y, words, threshold)

    def fine(a: np.ndarray, b: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok = (q.n[b] <= p.reach[a]) & (p.n[a] <= q.reach[b])
        if x is y:
            ok &= a < b
        a, b, token = a[ok], b[ok], token[ok]
        i, j = p.row[a], q.row[b]
        bits = sum(np.bitwise_count(u[i] ^ v[j]).astype(np.int64) for u, v in zip(x.bits, y.bits, strict=True))
        ok = bits <= share * (p.n[a] + q.n[b]) + 1e-9
        i, j = i[ok].astype(np.int64), j[ok].astype(np.int64)
        return *((np.minimum(i, j), np.maximum(i, j)) if x is y else (i, j)), token[ok]

    times, across = np.diff(p.at), np.diff(q.at)
    pairs = times * across
    little = np.flatnonzero((pairs > 0) & (pairs <= _LITTLE))
    ends = np.cumsum(pairs[little])
    first = 0
    while first < len(little):
        last = max(first + 1, np.searchsorted(ends, (ends[first - 1] if first else 0) + _PAIRS, "right"))
        token = little[first:last]
        which = np.repeat(np.arange(len(token)), pairs[token])
        k = np.arange(len(which)) - (np.cumsum(pairs[token]) - pairs[token])[which]
        own = token[which]
        yield fine(p.at[own] + k // across[own], q.at[own] + k % across[own], own)
        first = last
    spaces = [np.empty(_ROWS * _COLUMNS, kind) for kind in (np.uint64, np.uint8, np.uint8, bool)]  # fresh memory each time would take longer than the work
    found, size = [], 0
    for token in np.flatnonzero(pairs > _LITTLE).tolist():
        (p0, p1), (q0, q1) = p.at[token : token + 2].tolist(), q.at[token : token + 2].tolist()
        sizes, reach = q.n[q0:q1], q.reach[q0:q1]
        folds = [[(u[p.row[p0:p1]], v[q.row[q0:q1]]) for u, v in zip(f, g, strict=True)] for f, g in ((x.one, y.one), (x.two, y.two))]
        for lo in range(0, p1 - p0, _ROWS):
            rows = slice(lo, min(lo + _ROWS, p1 - p0))
            least, most, far = int(p.n[p0 + lo]), int(p.n[p0 + rows.stop - 1]), int(p.reach[p0 + lo : p0 + rows.stop].max())
            start = max(int(np.searchsorted(sizes, threshold * least - 1e-9)), lo if x is y else 0)
            stop = int(np.searchsorted(sizes, min(most / threshold, far) + 1e-9, "right"))
            every = start + np.flatnonzero(reach[start:stop] >= least)
            for at in range(0, len(every), _COLUMNS):
                cols = every[at : at + _COLUMNS]
                total = sizes[cols] + most
                limit = np.minimum(share * total + 1e-9, 255).astype(np.uint8)
                shape = rows.stop - lo, len(cols)
                word, apart, second, hit = (space[: shape[0] * shape[1]].reshape(shape) for space in spaces)
                folded = folds[0 if total[-1] <= _SMALL else 1]
                for k, (u, v) in enumerate(folded):
                    np.bitwise_count(np.bitwise_xor(u[rows, None], v[cols], out=word), out=second if k else apart)
                if len(folded) > 1:
                    np.add(apart, second, out=apart)
                met = np.flatnonzero(np.less_equal(apart, limit, out=hit))
                if len(met):
                    found.append((p0 + lo + met // shape[1], q0 + cols[met % shape[1]], np.full(len(met), token)))
                    size += len(met)
            if size >= _PAIRS:
                yield fine(*map(np.concatenate, zip(*found, strict=True)))
                found, size = [], 0
    if found:
        yield fine(*map(np.concatenate, zip(*found, strict=True)))


def _similar(x: _Side, y: _Side, words: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, jaccard) by batches: similar classes of ``x`` and ``y``, each pair once; within one block i < j."""
    step = max(1, min(256, (1 << 25) // max(1, words)))
    marks = np.zeros((step, words), np.uint8)
    for i, j, token in _near(x, y, words, threshold):
        order = np.lexsort((token, j, i))
        i, j, token = i[order], j[order], token[order]
        new = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])])[: len(i)])
        i, j, token = i[new], j[new], token[new]
        at = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])[: len(i)])
        for k in range(0, len(at), step):
            part = slice(at[k], at[k + step] if k + step < len(at) else len(i))
            a, b = i[part], j[part]
            own, local = np.unique(a, return_inverse=True)
            mark = x.tokens(own)
            marks[mark] = 1
            which, code = y.tokens(b)
            hit = marks[local[which], code]
            marks[mark] = 0
            common = np.bincount(which, hit, len(b))
            seen = np.bincount(which, hit & (code < token[part][which]), len(b))  # such a pair comes at an earlier token too
            jaccard = common / (x.n[a] + y.n[b] - common)
            near = np.flatnonzero((jaccard >= threshold) & (seen == 0))
            yield a[near], b[near], jaccard[near]


def swept(classes: DataFrame, n: int, threshold: float, counted: bool = False) -> DataFrame:
    """(sid_a, sid_b, class_a, class_b, jaccard): what ``set_join`` gives for one collection of ``n`` classes (sid, class_id, tokens), by comparing bitmaps of all that share a rare token.

    Classes fall into blocks of a bounded number; a task holds two of them and verifies on the sets what their bitmaps leave.
    ``counted``: (sid, links) instead, in how many pairs of a task a class is, so that pairs need not leave the tasks.
    """
    m = max(1, -(-n // SWEPT), min(SWEEPS, -(-n // 1024)))
    packed = classes.select("sid", *([] if counted else ["class_id"]), F.concat_ws(" ", "tokens").alias("text"), F.pmod(F.xxhash64("sid"), F.lit(m)).cast("int").alias("part"))
    spread = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        part, names = group["part"].to_numpy(), group.select(["sid"] if counted else ["sid", "class_id"])
        lists = pc.split_pattern(group["text"], " ").combine_chunks()
        del group
        n = pc.list_value_length(lists).to_numpy().astype(np.int64)
        tokens = lists.flatten().dictionary_encode()
        del lists
        words = len(tokens.dictionary)
        codes = tokens.indices.to_numpy()
        rank = np.empty(words, np.int64)
        rank[np.argsort(np.bincount(codes, minlength=words), kind="stable")] = np.arange(words)  # rarest tokens first, here
        codes = np.repeat(np.arange(len(n)) * words, n) + rank[codes]
        codes.sort()
        codes = (codes % words).astype(np.int32)
        starts, bit = np.cumsum(n) - n, np.left_shift(np.uint64(1), (codes % 64).astype(np.uint64))
        bits = [np.bitwise_or.reduceat(np.where(codes // 64 % WORDS == w, bit, np.uint64(0)), starts) for w in range(WORDS)]
        del bit
        x, y = (_Side(n, codes, starts, bits, np.flatnonzero(part == k.as_py())) for k in key)
        y = x if key[0] == key[1] else y
        links = np.zeros(len(n), np.int64)
        for i, j, jaccard in _similar(x, y, words, threshold) if len(x.n) and len(y.n) else ():
            a, b = x.rows[i], y.rows[j]
            if counted:
                np.add.at(links, a, 1)
                np.add.at(links, b, 1)
                continue
            p, q = (names.take(pa.array(rows)) for rows in (a, b))
            turned = pc.less(p["sid"], q["sid"])
            ends = [pc.if_else(turned, f[c], g[c]) for c in ("sid", "class_id") for f, g in ((p, q), (q, p))]
            yield from pa.table([*ends, pa.array(jaccard)], names=["sid_a", "sid_b", "class_a", "class_b", "jaccard"]).to_batches()
        if counted:
            some = np.flatnonzero(links)
            yield from pa.table([names["sid"].take(pa.array(some)), pa.array(links[some])], names=["sid", "links"]).to_batches()

    schema = "sid binary, links bigint" if counted else "sid_a binary, sid_b binary, class_a string, class_b string, jaccard double"
    return spread.groupBy(F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).applyInArrow(run, schema)


#: Classes that are swept in any case; classes whose rarest tokens tell how often all would meet; pairs swept in the time of one that meets.
_FEW, _SEEN, _SWEPT_A_MEETING = 16_384, 4096, 16


def _meetings(classes: DataFrame, n: int, threshold: float) -> float:
    """About how often two of ``n`` classes meet in ``set_join``, told from a part of them; it chooses between joins of equal results."""
    k = max(1, n // _SEEN)
    part = classes.where(F.pmod(F.xxhash64("sid"), F.lit(k)) == 0)
    met = prefixes(part, rarity(part), threshold).groupBy("token").agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.expr("c * (c - 1) / 2")))
    return (met.first()[0] or 0) * float(k) ** 2


def _sweeps(classes: DataFrame, n: int, threshold: float) -> bool:
    """Whether the sweep is the cheaper join for one collection of ``n`` classes."""
    return n <= _FEW or _meetings(classes, n, threshold) * _SWEPT_A_MEETING >= n * (n - 1) / 2


def self_join(members: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(sid_a, sid_b, class_a, class_b, jaccard): similar classes of one collection and the smallest ids of their members, by the join that is cheaper for it."""
    named = members.groupBy("sid").agg(F.min("id").alias("class_id"))
    n = classes.count()
    if _sweeps(classes, n, threshold):
        return swept(classes.join(named, "sid"), n, threshold)
    a, b = (named.select(F.col("sid").alias(f"sid_{x}"), F.col("class_id").alias(f"class_{x}")) for x in "ab")
    return set_join(classes, classes, threshold, itself=True).join(a, "sid_a").join(b, "sid_b").select("sid_a", "sid_b", "class_a", "class_b", "jaccard")


def similar_texts(memories: DataFrame, threshold: float = C.CONSOLIDATION) -> DataFrame:
    """(id, class_id, links): each memory's class of equal token sets and how many other classes are similar to it."""
    members, classes = set_classes(memories, compared_text(memories))
    n = classes.count()
    if _sweeps(classes, n, threshold):
        each = swept(classes, n, threshold, counted=True)
    else:
        each = set_join(classes, classes, threshold, itself=True).select(F.explode(F.array("sid_a", "sid_b")).alias("sid"), F.lit(1).alias("links"))
    named = members.groupBy("sid").agg(F.min("id").alias("class_id"))
    links = each.groupBy("sid").agg(F.sum("links").alias("links"))
    return members.join(named.join(links, "sid", "left"), "sid").select("id", "class_id", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def similar_classes(memories: DataFrame, threshold: float = C.CONSOLIDATION) -> DataFrame:
    """(class_a, class_b, jaccard): similar classes by the smallest ids of their members."""
    members, classes = set_classes(memories, compared_text(memories))
    return self_join(members, classes, threshold).select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b"), F.round("jaccard", 6).alias("jaccard"))


def hybrid_pairs(asked: DataFrame, memories: DataFrame, threshold: float = C.CONSOLIDATION) -> DataFrame:
    """(id_a, id_b, score), id_a < id_b: pairs of a memory of ``asked`` and any other of hybrid similarity ``threshold`` or more, most similar first.

    Both are memories; the vector compared is ``embedding``, or ``local_embedding`` where that is null.
    """
    v = F.coalesce(*(F.col(c).cast("array<double>") for c in ("embedding", "local_embedding"))).alias("v")
    sides = (df.select("id", "summary", "content", v) for df in (asked, memories))
    pairs = blocks.hybrid(*sides, threshold).select(F.least("cid", "id").alias("id_a"), F.greatest("cid", "id").alias("id_b"), F.round("score", 6).alias("score"))
    return pairs.dropDuplicates(["id_a", "id_b"]).orderBy(F.desc("score"), "id_a", "id_b")


def first_duplicates(candidates: DataFrame, existing: DataFrame, threshold: float = C.DEDUP) -> DataFrame:
    """(cid, id): for each candidate the first existing memory, by id, of the same text; lexical only.

    A memory is no duplicate of itself. Of each class of equal texts only the two smallest ids are looked at,
    so a text that very many memories share costs no more than another.
    """
    cm, cc = set_classes(candidates, compared_text(candidates))
    em, ec = set_classes(existing, compared_text(existing))
    two = lambda df, by: df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("id"))).where("_r <= 2").select(by, "id")
    least = two(em, "sid").withColumnRenamed("sid", "sid_b")
    met = set_join(cc, ec, threshold).join(least, "sid_b").select("sid_a", "id").distinct()
    best = two(met, "sid_a").groupBy("sid_a").agg(F.min("id").alias("one"), F.max("id").alias("two"))
    hit = F.when(F.col("one") != F.col("cid"), F.col("one")).when(F.col("two") != F.col("cid"), F.col("two"))
    return cm.select(F.col("id").alias("cid"), F.col("sid").alias("sid_a")).join(best, "sid_a").select("cid", hit.alias("id")).where("id is not null")


def _with_vector(df: DataFrame, column: str, dim: int) -> DataFrame:
    """(id, summary, content, v) with vectors of ``dim`` numbers only."""
    return df.select("id", "summary", "content", F.when(F.size(column) == dim, F.col(column).cast("array<double>")).alias("v"))


BLOCK = 512


def batch_pairs(candidates: DataFrame, column: str, dim: int, threshold: float) -> DataFrame:
    """(a, b): candidates of one batch, a before b in order (``ord``, then id), of hybrid similarity ``threshold`` or more.

    A batch is compared block against block in separate tasks, so its size is bounded by none, and only similar pairs leave.
    """
    n = candidates.groupBy("batch").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_n"))
    words = F.coalesce(compared_text(candidates), F.array().cast("array<string>")).alias("tokens")
    rows = candidates.select("batch", "id", "ord", words, F.when(F.size(column) == dim, F.col(column).cast("array<double>")).alias("v")).join(n, "batch")
    spread = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        part = group["part"].to_numpy()
        x, y = (group.take(pa.array(np.flatnonzero(part == k))) for k in (i, j))
        found = pa.concat_tables(blocks.hybrid_scores(x, y, threshold))
        at = {k: (o, k) for k, o in zip(group["id"].to_pylist(), group["ord"].to_pylist(), strict=True)}
        ends = [sorted(p, key=at.__getitem__) for p in zip(found["cid"].to_pylist(), found["id"].to_pylist(), strict=True)]
        return pa.table([pa.array([e[k] for e in ends], pa.string()) for k in (0, 1)], names=["a", "b"])

    return spread.groupBy("batch", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).applyInArrow(run, "a string, b string").distinct()


def first_fit(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, kept): in order, an item is kept unless an earlier kept one is similar. ``pairs`` (a, b) has a before b.

    Decided in rounds: undecided items without undecided earlier neighbours are settled at once. The number
    of rounds is the longest chain of similar items, not the number of items.
    """
    undecided = cut(items.select("id").distinct())
    links = cut(pairs)
    kept = dropped = None
    while not undecided.isEmpty():
        blocked = links.select(F.col("b").alias("id")).distinct()
        now = cut(undecided.join(blocked, "id", "left_anti"))
        kept = now if kept is None else kept.unionByName(now)
        out = cut(links.join(now.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct())
        dropped = out if dropped is None else dropped.unionByName(out)
        gone = now.unionByName(out)
        undecided = cut(undecided.join(gone, "id", "left_anti"))
        links = cut(links.join(gone.select(F.col("id").alias("a")), "a", "left_anti").join(gone.select(F.col("id").alias("b")), "b", "left_anti"))
    if kept is None:
        return items.select("id").withColumn("kept", F.lit(True)).limit(0)
    return kept.withColumn("kept", F.lit(True)).unionByName(dropped.withColumn("kept", F.lit(False)))


def deduplicate(candidates: DataFrame, existing: DataFrame, column: str = "local_embedding", dim: int = 32) -> DataFrame:
    """(id, decision, match): what becomes of each candidate (id, batch, ord, summary, content, vector).

    ``skip`` if an existing memory is all but equal, ``merge`` into the best one if similar, ``skip`` if an
    earlier kept candidate of its batch is similar, else ``keep``. Ties go to the smaller id.
    """
    found = blocks.hybrid(_with_vector(candidates, column, dim), _with_vector(existing, column, dim), C.DEDUP).withColumn("score", F.round("score", 9))
    best = found.groupBy("cid").agg(F.max(F.struct("score")).alias("m"), F.min_by("id", F.struct((-F.col("score")).alias("s"), "id")).alias("match"))
    hit = cut(best.select(F.col("cid").alias("id"), F.col("m.score").alias("score"), "match"))
    free = cut(candidates.join(hit.select("id"), "id", "left_anti"))
    fit = first_fit(free, batch_pairs(free, column, dim, C.INTRA_BATCH))
    none = F.lit(None).cast("string")
    judged = hit.select("id", F.when(F.col("score") >= C.MERGE_CEILING, "skip").otherwise("merge").alias("decision"), F.when(F.col("score") < C.MERGE_CEILING, F.col("match")).alias("match"))
    return judged.unionByName(fit.select("id", F.when(F.col("kept"), "keep").otherwise("skip").alias("decision"), none.alias("match")))


def auto_edges(candidates: DataFrame, existing: DataFrame, edges: DataFrame, least: float = C.IGNORE_BELOW, column: str = "local_embedding", dim: int = 32) -> DataFrame:
    """(source_id, target_id, strength, status): ``relates_to`` edges from new to similar existing memories, where there is none yet.

    By hybrid similarity from ``least`` up: the cosine of ``column`` where both have one of ``dim`` numbers, else
    shared words. Scores from ``RELATE_BELOW`` to ``SUGGEST_TO`` are suggested, others active.
    """
    taken = edges.where("relation_type = 'relates_to'").select(F.col("source_id").alias("id"), F.col("target_id").alias("other"))
    found = blocks.hybrid(_with_vector(candidates, column, dim), _with_vector(existing, column, dim), least, without=taken, digits=6)
    named = found.select(F.col("cid").alias("source_id"), F.col("id").alias("target_id"), F.col("score").alias("strength"))
    return named.withColumn("status", F.when(S.classify(F.col("strength")) == "suggest", "suggested").otherwise("active"))
