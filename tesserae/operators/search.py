"""Lexical and vector search, fusion, and recall.

A full-text query reads the texts once: each row counts its phrases, and only those numbers are shuffled and
written (``occurrences``). From them one small aggregate gives the corpus statistics of BM25, and the
scored rows end in a bounded top-k, whose texts alone are looked up again. For many queries at once
``postings`` gives the inverted index.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae import constants as C
from tesserae.functions import similarity as S
from tesserae.functions.decay import branch_of
from tesserae.functions.text import padded_tokens, search_tokens, token_set
from tesserae.operators.graph import related
from tesserae.operators.store import live_edges
from tesserae.sources.tables import cut

SEARCHED = ("content", "summary", "tags")


def _tokens(df: DataFrame) -> dict[str, Column]:
    """The token lists of the searched columns; tags are read as one text, so a phrase may span two of them."""
    return {c: F.coalesce(search_tokens(t), F.array().cast("array<string>")) for c, t in _texts(df).items()}


def _texts(df: DataFrame) -> dict[str, Column]:
    return {c: F.array_join(c, " ") if dict(df.dtypes)[c].startswith("array") else F.col(c) for c in SEARCHED if c in df.columns}


def _length(padded: Column) -> Column:
    """The number of tokens of a padded text."""
    return F.when(padded == "", 0).otherwise(F.try_divide(F.length(padded) - F.length(F.replace(padded, F.lit("  "), F.lit(""))), F.lit(2)) + 1)


def _phrase(padded: Column, phrase: list[str]) -> Column:
    """How often a phrase stands in a padded text, where every token has blanks of its own.

    Repeats that overlap themselves ("a b a" in "a b a b a") are counted one by one at each start.
    """
    pattern = " " + "  ".join(phrase) + " "
    if any(phrase[:k] == phrase[-k:] for k in range(1, len(phrase))):
        tokens = F.split(F.trim(F.replace(padded, F.lit("\n"), F.lit(" \n "))), " +")
        at = F.sequence(F.lit(0), F.greatest(F.size(tokens) - len(phrase), F.lit(0)))
        return F.size(F.filter(at, lambda i: reduce(lambda x, y: x & y, [F.coalesce(F.get(tokens, i + k) == w, F.lit(False)) for k, w in enumerate(phrase)])))
    return ((F.length(padded) - F.length(F.replace(padded, F.lit(pattern), F.lit("")))) / len(pattern)).cast("int")


def phrases_of(query: str) -> list[list[str]]:
    """A query's blank-separated parts as phrases of tokens; parts without tokens are dropped."""
    import re
    import unicodedata

    def tokens(part: str) -> list[str]:
        bare = "".join(c for c in unicodedata.normalize("NFD", part.lower()) if not unicodedata.combining(c))
        return re.findall(r"[^\W_]+", bare)

    return [t for part in query.split() if (t := tokens(part))]


def occurrences(docs: DataFrame, phrases: list[list[str]], **also: Column) -> DataFrame:
    """(id, status, scope, also..., _f0, ..., _len): how often each phrase stands in each record, and its number of tokens.

    The texts are read once and left behind: only these numbers are shuffled, so that records delivered
    again fall together, and written for the aggregates and rankings that follow.
    """
    # one text a row, its columns apart, so that no phrase spans two; exploding the single element keeps
    # the optimizer from repeating the normalisation for every phrase
    one = F.concat_ws("\n", *(padded_tokens(t) for t in _texts(docs).values()))
    lengths = F.aggregate(F.split("_d", "\n"), F.lit(0.0), lambda n, t: n + _length(t))
    keep = [c for c in ("id", "status", "scope") if c in docs.columns]
    counted = docs.withColumn("_d", F.explode(F.array(one))).select(*keep, *(v.alias(k) for k, v in also.items()), *(_phrase(F.col("_d"), p).alias(f"_f{i}") for i, p in enumerate(phrases)), lengths.alias("_len"))
    return cut(counted.distinct())


def bm25(counted: DataFrame, which: list[int], every: bool, keep: Column | None = None, store: str | None = None) -> DataFrame:
    """The records of ``occurrences`` that match, with ``score`` (higher is better): all phrases of ``which``, or any of them.

    Statistics (number of rows, mean length, rows with a phrase) are over all records, or with ``store`` over
    each value of that column (of a few) by itself; ``keep`` then restricts the answer. No phrases match nothing.
    """
    others = [c for c in counted.columns if not c.startswith("_")]
    if not which:
        return counted.where(F.lit(False)).select(*others, F.lit(0.0).alias("score"))
    measures = [F.count(F.lit(1)).cast("double").alias("rows"), F.avg("_len").alias("mean"), *(F.count_if(F.col(f"_f{i}") > 0).cast("double").alias(f"n{i}") for i in which)]
    match = reduce((lambda x, y: x & y) if every else (lambda x, y: x | y), [F.col(f"_f{i}") > 0 for i in which])
    if store is None:
        mine = counted.agg(*measures).select(F.struct("*")).scalar()
    else:
        each = counted.where(F.col(store).isNotNull()).groupBy(F.col(store).alias("_store")).agg(*measures)
        mine = F.try_element_at(each.agg(F.map_from_entries(F.collect_list(F.struct("_store", F.struct(*[c for c in each.columns if c != "_store"]))))).scalar(), F.col(store))  # one entry a scope
    s = counted.where(match & (keep if keep is not None else F.lit(True))).withColumn("_s", mine)

    def part(i: int) -> Column:
        idf = F.ln((F.col("_s.rows") - F.col(f"_s.n{i}") + 0.5) / (F.col(f"_s.n{i}") + 0.5))
        idf = F.when(idf > 0, idf).otherwise(1e-6)
        f = F.col(f"_f{i}")
        return idf * f * (C.BM25_K1 + 1) / (f + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * F.col("_len") / F.col("_s.mean")))

    return s.withColumn("score", reduce(lambda x, y: x + y, [part(i) for i in which])).select(*others, "score")


def keyword_search(memories: DataFrame, query: str, limit: int, every: bool = True) -> DataFrame:
    """(id, status, scope, score): the ``limit`` best active memories for a query's phrases (ties by id)."""
    phrases = phrases_of(query)
    return bm25(occurrences(memories, phrases), list(range(len(phrases))), every, F.col("status") == "active").orderBy(F.desc("score"), "id").limit(limit)


def store_search(counted: DataFrame, which: list[int], every: bool, limit: int) -> DataFrame:
    """The ``limit`` best active memories of each scope, with ``score`` and ``place`` (from 1; ties by id), from the ``occurrences`` of all scopes."""
    best = bm25(counted, which, every, F.col("status") == "active", "scope")
    return best.withColumn("place", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("score"), "id"))).where(F.col("place") <= limit)


def search_entities(entities: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Entities whose name or aliases hold any phrase of the query, by id."""
    texts = [padded_tokens(t) for t in (F.col("name"), F.array_join("aliases", " "))]
    phrases = phrases_of(query)
    if not phrases:
        return entities.where(F.lit(False))
    return entities.where(reduce(lambda x, y: x | y, [_phrase(t, p) > 0 for t in texts for p in phrases])).orderBy("id").limit(limit)


def postings(docs: DataFrame, id_col: str = "id") -> DataFrame:
    """(term, id, column, positions): the inverted index of the searched columns, one row per term, record and column."""
    each = F.array(*(F.struct(F.lit(c).alias("column"), t.alias("tokens")) for c, t in _tokens(docs).items()))
    cells = docs.select(id_col, F.explode(each).alias("x")).select(id_col, "x.column", F.posexplode("x.tokens").alias("pos", "term"))
    return cells.groupBy("term", id_col, "column").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def term_statistics(index: DataFrame, id_col: str = "id") -> DataFrame:
    """(term, rows, occurrences) of an inverted index."""
    return index.groupBy("term").agg(F.countDistinct(id_col).alias("rows"), F.sum(F.size("positions")).alias("occurrences"))


def position_scores(results: DataFrame, order: list[Column], partition: list[str] | None = None) -> DataFrame:
    """Scores from 1 for the first to 0.5 for the last of an ordered, bounded result."""
    w = Window.partitionBy(*(partition or [F.lit(0)]))
    n, i = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(*order)) - 1
    return results.withColumn("score", F.when(n == 1, 1.0).otherwise(1 - i / F.greatest(n - 1, F.lit(1)) * 0.5))


def merge_results(results: DataFrame, limit: int) -> DataFrame:
    """Results (id, score, source) of both stores: one per id with the project's first, best scores first."""
    own = F.when(F.col("source") == "project", 0).otherwise(1)
    w = Window.partitionBy("id").orderBy(own, F.desc("score"))
    once = results.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return once.orderBy(F.desc("score"), own, "id").limit(limit)


def vector_search(memories: DataFrame, column: str, query: list[float], limit: int, least: float = 0.0) -> DataFrame:
    """The rows nearest a query vector by cosine (``score``), at least ``least``; other lengths and nulls take no part."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = memories.where(F.size(column) == len(query)).withColumn("score", S.cosine(F.col(column), q))
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(limit)


def scored(memories: DataFrame, column: str, query: list[float]) -> DataFrame:
    """(id, score, action) of every memory with a vector of the query's length: its cosine and what that calls for, best first."""
    q = F.array(*(F.lit(float(x)) for x in query))
    each = memories.where(F.size(column) == len(query)).select("id", S.cosine(F.col(column), q).alias("score"))
    return each.withColumn("action", S.classify(F.col("score"))).orderBy(F.desc("score"), "id")


def fused_search(memories: DataFrame, column: str, query: list[float], text: str, limit: int, least: float = C.MIN_COSINE) -> DataFrame:
    """As ``vector_search``, the cosine raised by words shared with summary and tags."""
    return fused_scores(memories, column, query, text, least).orderBy(F.desc("score"), "id").limit(limit)


def fused_scores(memories: DataFrame, column: str, query: list[float], text: str, least: float = C.MIN_COSINE) -> DataFrame:
    """Rows of a cosine of at least ``least`` with their fused ``score``."""
    q = F.array(*(F.lit(float(x)) for x in query))
    words = token_set(F.concat_ws(" ", "summary", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")))
    cos = memories.where(F.size(column) == len(query)).withColumn("cosine", S.cosine(F.col(column), q)).where(F.col("cosine") >= least)
    return cos.withColumn("score", S.fused(F.col("cosine"), token_set(F.lit(text)), words))


def unigrams_of(prompt: str) -> list[str]:
    """The meaningful words of one prompt, as ``functions.text.unigrams`` gives them."""
    import re

    parts = re.sub(r"[^A-Za-z0-9_\s.\-]", " ", prompt.lower()).split()
    return list(dict.fromkeys(t for t in parts if len(t) > 1 and t not in C.STOP_WORDS))


def tag_only(words: list[str]) -> Column:
    """Whether none of the words stands anywhere in content or summary; no words: false."""
    text = F.lower(F.concat_ws(" ", "content", "summary"))
    return ~reduce(lambda x, y: x | y, [F.contains(text, F.lit(w)) for w in words]) if words else F.lit(False)


def prompt_recall(memories: DataFrame, prompt: str, surface: str | None = None, limit: int = C.PROMPT_LIMIT) -> DataFrame:
    """(place, id, memory_type, summary): memories for a prompt; all words in the project, then globally, then any word or neighbouring pair.

    Each tier gives at most ``limit`` rows; hits by tag only, and those the surface shows already, are dropped after.
    """
    words = unigrams_of(prompt)
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)][:10]
    if len(words) + len(pairs) < C.PROMPT_MIN_TOKENS:
        return memories.where(F.lit(False)).select(F.lit(1).alias("place"), "id", "memory_type", "summary")
    parts = [[x for w in p.split() for ph in phrases_of(w) for x in ph] for p in words + pairs]
    known = [i for i, p in enumerate(parts) if p]
    whole = [i for i in known if i < len(words)]
    counted = occurrences(memories, [p or [" "] for p in parts], shown=~tag_only(words))
    scope = F.when(F.col("scope") == C.SCOPES[0], 0).otherwise(1)
    tiers = []
    for t, (which, every) in enumerate(((whole, True), (known, False))):
        if every and not C.AND_MIN <= len(words) <= C.AND_MAX:
            continue
        hits = store_search(counted, which, every, limit).where(F.col("scope").isin(C.SCOPES))
        tiers.append(hits.select("id", "shown", (1000 * (2 * t + scope) + F.col("place")).alias("_p")))
    first = reduce(lambda x, y: x.unionByName(y), tiers).where("shown").groupBy("id").agg(F.min("_p").alias("_p"))
    # at most `limit` hits for each tier and scope
    kept = memories.select("id", "memory_type", "summary").join(F.broadcast(first), "id").dropDuplicates(["id"])
    if surface:
        kept = kept.where(~F.contains(F.lit(surface), F.col("summary")))
    return kept.orderBy("_p").limit(limit).select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_p")).alias("place"), "id", "memory_type", "summary")


def prompt_recall_with_fallback(memories: DataFrame, prompt: str, query: list[float] | None, column: str = "embedding", surface: str | None = None) -> DataFrame:
    """As ``prompt_recall``; if that is empty, the prompt long enough and its vector given, the nearest memories of any status."""
    found = prompt_recall(memories, prompt, surface)
    if query is None or len(unigrams_of(prompt)) < C.FALLBACK_MIN_UNIGRAMS or not found.isEmpty():
        return found
    near = vector_search(memories.select("id", "memory_type", "summary", column).dropDuplicates(["id"]), column, query, C.FALLBACK_LIMIT, C.FALLBACK_COSINE)
    kept = near.where(~F.contains(F.lit(surface), F.col("summary"))) if surface else near
    return kept.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")).alias("place"), "id", "memory_type", "summary")


def recall(memories: DataFrame, edges: DataFrame, query: str, vector: list[float] | None = None, column: str = "embedding", limit: int = C.RECALL_LIMIT, branch: str | None = None) -> DataFrame:
    """(id, score, source, related): the best memories of both stores for a query, each with what it is linked to.

    With a query vector: the best ``PREFILTER_LIMIT`` lexical hits per store (or all rows, if none) ranked
    by fused cosine; else keyword hits with position scores. The branch filter applies after the limit.
    """
    phrases = phrases_of(query)
    counted = occurrences(memories, phrases)
    if vector is not None:
        pre = cut(store_search(counted, list(range(len(phrases))), False, C.PREFILTER_LIMIT).select("id", "scope"))
        with_hits = [r.scope for r in pre.select("scope").distinct().collect()]  # the scopes, of which there are two
        rows = memories.select("id", "scope", "summary", "tags", column)
        pool = rows.join(F.broadcast(pre.select("id").distinct()), "id", "left_semi").unionByName(rows.where(~F.col("scope").isin(with_hits)))  # PREFILTER_LIMIT a scope
        near = fused_scores(pool, column, vector, query).select("id", "scope", "score").distinct()
        best = near.withColumn("_n", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("score"), "id"))).where(F.col("_n") <= limit)
    else:
        best = position_scores(store_search(counted, list(range(len(phrases))), True, limit), [F.asc("place")], ["scope"])
    few = best.where(F.col("scope").isin(C.SCOPES)).select("id", "score", F.col("scope").alias("source"))
    stores = memories.select("id", "source_context").join(F.broadcast(few), "id").dropDuplicates(["id", "source"])  # `limit` a scope
    merged = cut(merge_results(stores, limit))
    if branch:
        merged = merged.where(branch_of(F.col("source_context")) == branch)
    linked = related(live_edges(edges), merged.select("id"), memories.select("id"))
    return merged.join(linked, "id", "left").select("id", "score", "source", F.coalesce("related", F.array().cast("array<string>")).alias("related"))
