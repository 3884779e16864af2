"""Evaluation texts leaking into training text (problem 7).

A distributed positional inverted index answers phrase queries. The queries are all windows of
``WINDOW`` consecutive words of the test items. In this order:

1. The corpus is counted once for the words of the test items, pre-aggregated within tasks. A window
   with a word the corpus lacks cannot occur and is dropped.
2. Each remaining window is asked by its two rarest words. Only their postings are stored, (term,
   document, position) with the words around the position as payload: common words, which may fill a
   third of the corpus, are never posted unless a window has nothing rarer.
3. A posting is laid against the windows of its word, and stays where the payload holds the window's phrase
   around it; nothing else leaves the task.
4. The two lists of a window are intersected after subtracting each word's offset in the window: both words
   stand at the right distance in the same place of the same document.

Proximity asks for a share of a window's words within a stretch of text a little longer than the window, in any
order, with words put in, left out or replaced. Of n distinct words at most n - need are missing, so two of the
n - need + 2 rarest are there, words that the corpus lacks counted among them: windows are asked by those,
by position within the stretch instead of at exact offsets.

Every document is read in whole, twice; nothing but counts and the postings of rare test words moves.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.sources.tables import cut

WINDOW = 12
#: Test words held by a task at once; beyond that the corpus is read again for the next part of them.
TERMS_AT_ONCE = 500_000
SALTS = 8
#: Words that a near match may have beside those of its window.
SLACK = 4
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The longest runs of letters and digits, lower-cased."""
    return [w.lower() for w in _WORD.findall(text)] if text else []


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, words) of items long enough to hold a window; repeated rows fall together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([words(t) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], names=["item_id", "words"])

    return items.select("item_id", "text").distinct().mapInArrow(run, "item_id bigint, words array<string>").where(F.size("words") >= WINDOW)


def _parts(terms: DataFrame) -> Iterator[frozenset[str]]:
    """The terms in parts of about ``TERMS_AT_ONCE``."""
    n = max(1, -(-terms.count() // TERMS_AT_ONCE))
    for k in range(n):
        yield frozenset(r[0] for r in terms.where(F.pmod(F.xxhash64(terms.columns[0]), F.lit(n)) == k).collect())


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def term_counts(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences in the whole corpus of the given terms (one string column); absent terms have no row."""
    sc = documents.sparkSession.sparkContext

    def counter(part: frozenset[str]):
        shipped = sc.broadcast(part)  # at most TERMS_AT_ONCE words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted, total = shipped.value, Counter()
            for b in batches:
                for t in b.column(0).to_pylist():
                    total.update(w for w in words(t) if w in wanted)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

        return documents.select("text").mapInArrow(run, "term string, n bigint")

    return _union([counter(p) for p in _parts(terms)]).groupBy("term").agg(F.sum("n").alias("n"))


def postings(documents: DataFrame, terms: DataFrame, reach: int = WINDOW - 1) -> DataFrame:
    """(term, doc_id, pos, before, around): each occurrence of the given terms, with up to ``reach`` words on either side.

    ``before`` is the number of words of ``around`` that precede the term.
    """
    sc = documents.sparkSession.sparkContext

    def poster(part: frozenset[str]):
        shipped = sc.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = shipped.value
            for b in batches:
                rows: list[tuple] = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    w = words(text)
                    if wanted.isdisjoint(w):
                        continue
                    for i, x in enumerate(w):
                        if x in wanted:
                            lo = max(0, i - reach)
                            rows.append((x, doc, i, i - lo, w[lo : i + reach + 1]))
                    if len(rows) > 20_000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

        return documents.select("doc_id", "text").mapInArrow(run, "term string, doc_id bigint, pos int, before int, around array<string>")

    return _union([poster(p) for p in _parts(terms)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()))
    cols = zip(*rows, strict=True) if rows else ([],) * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["term", "doc_id", "pos", "before", "around"])


def windows(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, start, phrase, t1, o1, t2, o2): the windows that can occur, with their rarest and next rarest word and offsets.

    t2 is null for a window of one repeated word. Ties go to the earlier offset.
    """
    starts = items.select("item_id", "words", F.explode(F.sequence(F.lit(0), F.size("words") - window)).alias("start"))
    phrases = starts.select("item_id", "start", F.slice("words", F.col("start") + 1, window).alias("phrase")).distinct()
    each = phrases.select("item_id", "start", "phrase", F.posexplode("phrase").alias("o", "term"))
    ranked = each.join(counts, "term").groupBy("item_id", "start", "phrase").agg(F.sort_array(F.collect_list(F.struct("n", "o", "term"))).alias("m"))
    possible = ranked.where(F.size("m") == window)
    first = F.col("m")[0]
    second = F.get(F.filter("m", lambda x: x["term"] != first["term"]), F.lit(0))
    return possible.select("item_id", "start", "phrase", first["term"].alias("t1"), first["o"].alias("o1"), second["term"].alias("t2"), second["o"].alias("o2"))


def _asked(index: DataFrame, asked: DataFrame, term: str, offset: str) -> DataFrame:
    """Postings of a window's word, as places where the window would begin. A hot term is spread over salts."""
    w = asked.where(F.col(term).isNotNull()).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    p = index.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int"))
    return p.join(w, (F.col("term") == F.col(term)) & (p["salt"] == w["salt"])).withColumn("begin", F.col("pos") - F.col(offset))


def _exact(offset: str) -> Column:
    """Whether the payload holds the window's phrase at its place."""
    at = F.col("before") - F.col(offset)
    return (at >= 0) & (F.slice("around", F.greatest(at, F.lit(0)) + 1, F.size("phrase")) == F.col("phrase"))


def places(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, begin, item_id, start): where a window of an item stands in a document."""
    tokens = cut(item_words(items))
    vocabulary = tokens.select(F.explode("words").alias("term")).distinct()
    asked = cut(windows(tokens, term_counts(documents, vocabulary), window))
    terms = asked.select(F.explode(F.array("t1", "t2")).alias("term")).where("term is not null").distinct()
    index = cut(postings(documents, terms, window - 1))
    place = ["item_id", "start", "doc_id", "begin"]
    one = _asked(index, asked, "t1", "o1").where(_exact("o1")).select(*place, "t2")
    two = _asked(index, asked, "t2", "o2").where(_exact("o2")).select(*place)
    both = one.where("t2 is not null").join(two, place, "left_semi")
    return both.unionByName(one.where("t2 is null")).select(*place)  # a window of one repeated word has one list


def leaked(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id): documents that hold ``window`` or more consecutive words of the item.

    Null and empty texts hold nothing; items shorter than a window cannot leak; copies of a document are each reported.
    """
    return places(documents, items, window).select("doc_id", "item_id").distinct()


def _rare_words(items: DataFrame, counts: DataFrame, window: int, share: float) -> DataFrame:
    """(item_id, term, mates): the words that an item's windows are asked by, with all the words that any such window is asked by."""
    each = items.select("item_id", F.explode(F.sequence(F.lit(0), F.size("words") - window)).alias("start"), "words")
    distinct = each.select("item_id", "start", F.array_distinct(F.slice("words", F.col("start") + 1, window)).alias("w"))
    terms = distinct.select("item_id", "start", F.size("w").alias("n"), F.explode("w").alias("term")).join(counts.withColumnRenamed("n", "df"), "term", "left")
    rank = F.row_number().over(Window.partitionBy("item_id", "start").orderBy(F.coalesce("df", F.lit(0)), "term"))
    rare = terms.withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(F.lit(share) * F.col("n") - 1e-9) + 2)
    asked = rare.groupBy("item_id", "start").agg(F.collect_set("term").alias("mates"))  # a window's words
    # one of the n - need + 1 rarest is there, so the commonest of these words needs no postings
    here = rare.where((F.col("r") <= F.col("n") - F.ceil(F.lit(share) * F.col("n") - 1e-9) + 1) & F.col("df").isNotNull()).select("item_id", "start", "term").join(asked, ["item_id", "start"])
    return here.groupBy("item_id", "term").agg(F.array_distinct(F.flatten(F.collect_set("mates"))).alias("mates"))  # of the windows over one word


class _Item:
    """An item's words as bits, and the windows over each word as sets of bits with their number of words."""

    def __init__(self, words_: list[str], window: int):
        self.bit = {w: 1 << k for k, w in enumerate(dict.fromkeys(words_))}
        bits = [self.bit[w] for w in words_]
        self.over: dict[int, set[tuple[int, int]]] = {}
        for lo in range(len(bits) - window + 1):
            mine = set(bits[lo : lo + window])
            for x in mine:
                self.over.setdefault(x, set()).add((sum(mine), len(mine)))

    def best(self, around: list[str], at: int, reach: int, share: float) -> float:
        """The largest share, at least ``share``, of a window's words in a stretch of ``reach`` words that holds position ``at``; else 0."""
        bits = [self.bit.get(w, 0) for w in around]
        whole = reduce(or_, bits)
        windows = [(w, n) for w, n in self.over.get(bits[at], ()) if (w & whole).bit_count() >= share * n - 1e-9]
        if not windows:
            return 0.0
        stretches = {reduce(or_, bits[lo : lo + reach]) for lo in range(max(0, at - reach + 1), at + 1)}
        best = max((w & s).bit_count() / n for w, n in windows for s in stretches)
        return best if best >= share - 1e-9 else 0.0


def near_leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, share: float = 0.75, slack: int = SLACK) -> DataFrame:
    """(doc_id, item_id, share): proximity matches: the best share of a window's distinct words within ``window + slack`` words of the document, at least ``share``.

    Windows with words that the corpus lacks are asked too. Items shorter than a window have none.
    """
    tokens = cut(item_words(items))
    counts = term_counts(documents, tokens.select(F.explode("words").alias("term")).distinct())
    asked = cut(_rare_words(tokens, cut(counts), window, share))
    reach = window + slack
    index = postings(documents, asked.select("term").distinct(), reach - 1)
    w = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("term", "asked")
    p = index.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int"))
    met = p.join(w, (F.col("term") == F.col("asked")) & (p["salt"] == w["salt"])).where(F.size(F.array_intersect("around", "mates")) >= 2)
    texts = tokens.select("item_id", F.array_join("words", " ").alias("words"))
    near = met.select("doc_id", "item_id", "before", F.array_join("around", " ").alias("around")).join(texts, "item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, _Item] = {}
        for b in batches:
            best: dict[tuple[int, int], float] = {}
            words_ = b.column("words")
            for k, (doc, item, at, around) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_id", "item_id", "before", "around")), strict=True)):
                if best.get((doc, item), 0) < 1:
                    if item not in known:
                        if len(known) > 10_000:
                            known.clear()
                        known[item] = _Item(words_[k].as_py().split(" "), window)
                    x = known[item].best(around.split(" "), at, reach, share)
                    if x > best.get((doc, item), 0):
                        best[doc, item] = x
            cols = list(zip(*((d, i, x) for (d, i), x in best.items()), strict=True)) if best else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["doc_id", "item_id", "share"])

    return near.mapInArrow(run, "doc_id bigint, item_id bigint, share double").groupBy("doc_id", "item_id").agg(F.round(F.max("share"), 6).alias("share"))


def leak_report(found: DataFrame) -> DataFrame:
    """(item_id, documents): how many documents each leaked item is in."""
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
