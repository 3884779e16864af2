"""Text scalars as column expressions; all stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae import constants as C


def token_set(text: Column) -> Column:
    """Distinct lower-case runs of ASCII letters, digits and ``_``, in order of first appearance; null for null."""
    parts = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9_]+", " "), " ")
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def unigrams(prompt: Column) -> Column:
    """Distinct meaningful words of a prompt: dots and hyphens kept, single characters and stop words dropped."""
    parts = F.split(F.regexp_replace(F.regexp_replace(F.lower(prompt), r"[^A-Za-z0-9_\s.\-]", " "), r"\s+", " "), " ")
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(*C.STOP_WORDS)))


def bigrams(words: Column) -> Column:
    """The first ten pairs of neighbouring words."""
    n = F.size(words)
    pairs = F.transform(F.sequence(F.lit(1), F.least(n - 1, F.lit(10))), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>"))


def keywords(prompt: Column) -> Column:
    """Unigrams, then bigrams."""
    u = unigrams(prompt)
    return F.concat(u, bigrams(u))


def _accents() -> tuple[str, str]:
    """Accented letters of the Latin blocks and their bases, by decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for b in ((0xC0, 0x250), (0x1E00, 0x1F00)) for c in range(*b)]
    kept = [(a, b) for a, b in pairs if a != b and a == a.lower()]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


_FROM, _TO = _accents()


def _bare(text: Column) -> Column:
    """Lower case, Latin accents and combining marks stripped."""
    return F.regexp_replace(F.translate(F.lower(text), _FROM, _TO), r"[\x{300}-\x{36f}]", "")


def search_tokens(text: Column) -> Column:
    """Full-text tokens: lower-case runs of letters and digits of any script, Latin accents stripped."""
    return F.regexp_extract_all(_bare(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def padded_tokens(text: Column) -> Column:
    """The full-text tokens as one text in which each has a blank of its own on either side; empty without tokens."""
    inner = F.trim(F.regexp_replace(_bare(text), r"[^\p{L}\p{N}]+", "  "))
    return F.coalesce(F.when(inner != "", F.concat(F.lit(" "), inner, F.lit(" "))).otherwise(F.lit("")), F.lit(""))


def strip_blocks(text: Column, start: str, end: str) -> Column:
    """Without the blocks between two markers; a start without an end stays."""
    return F.regexp_replace(text, rf"(?s)\Q{start}\E.*?\Q{end}\E", "")


def fenced_json(text: Column) -> Column:
    """The first fenced JSON block, or the whole text, trimmed."""
    block = F.regexp_extract(text, r"(?s)```json\s*(.*?)\s*```", 1)
    return F.btrim(F.when(block != "", block).otherwise(text), F.lit(" \t\r\n"))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("bigint")


def estimate_lines(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1)).cast("bigint")


def capitalised(category: Column) -> Column:
    """``code_description`` to ``Code Description``."""
    words = F.split(category, "_")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def summary_of(content: Column, most: int = 200) -> Column:
    """The content itself, or its beginning with dots, in at most ``most`` characters."""
    return F.when(F.length(content) <= most, content).otherwise(F.concat(F.substring(content, 1, most - 3), F.lit("...")))


def line_range(content: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last``, counted from 1, both included."""
    return F.array_join(F.slice(F.split(content, "\n", -1), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def embedding_text(memory_type: Column, summary: Column, project: str) -> Column:
    return F.concat(F.lit("["), memory_type, F.lit(f"] [project:{project}] "), summary)


def query_embedding_text(query: Column, project: str | None = None) -> Column:
    """A query as it is embedded, in the form of memories' texts."""
    return F.concat(F.lit(f"[query] [project:{project}] " if project else "[query] "), F.trim(query))


def cache_key(branch: Column, cwd: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", branch, cwd), 256), 1, 16)


def project_name(path: Column) -> Column:
    """The last part of a path, or ``unknown``."""
    last = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.when(last != "", last).otherwise(F.lit("unknown"))
