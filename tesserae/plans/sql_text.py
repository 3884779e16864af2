"""Pieces of SQL shared by the oracles."""

from __future__ import annotations

NOW = "2026-01-01 00:00:00"

# The values the SQL asks for, written out here and not taken from the library, so that the two are compared.
MEMORY_TYPES = "'architecture', 'decision', 'pattern', 'gotcha', 'context', 'progress', 'code_description', 'code'"
MEMORY_STATUSES = "'active', 'superseded', 'archived', 'pruned'"
SCOPES = "'project', 'global'"
SOURCE_TYPES = "'extraction', 'manual', 'code_index'"
RELATIONS = "'relates_to', 'derived_from', 'contradicts', 'exemplifies', 'refines', 'supersedes', 'source_of'"
EDGE_STATUSES = "'active', 'suggested', 'archived'"
ENTITY_TYPES = "'person', 'project', 'tool', 'concept', 'org', 'other'"
RELATION_OF = (
    "case word when 'relates_to' then 'relates_to' when 'derived_from' then 'derived_from' when 'contradicts' then 'contradicts' when 'exemplifies' then 'exemplifies' when 'refines' then 'refines'"
    " when 'supersedes' then 'supersedes' when 'source_of' then 'source_of' when 'related' then 'relates_to' when 'derives' then 'derived_from' when 'contradict' then 'contradicts'"
    " when 'example' then 'exemplifies' when 'refine' then 'refines' when 'supersede' then 'supersedes' when 'source' then 'source_of' end"
)
LINE_BUDGET = "case memory_type when 'architecture' then 25 when 'decision' then 25 when 'pattern' then 25 when 'gotcha' then 20 when 'progress' then 30 when 'context' then 15 when 'code_description' then 10 else 0 end"
HALF_LIFE = "case memory_type when 'pattern' then 60.0 when 'gotcha' then 45.0 when 'context' then 30.0 when 'progress' then 7.0 end"
STOP_WORDS = (
    "'a','an','the','this','that','these','those','i','me','my','we','our','you','your','he','she','it','its','they','them','their','in','on','at','to','for','of','with','by','from','up','about',"
    "'into','through','during','before','after','above','below','between','under','over','and','but','or','nor','so','yet','both','either','neither','is','are','was','were','be','been','being',"
    "'have','has','had','do','does','did','will','would','could','should','may','might','shall','can','please','help','want','need','like','just','also','very','really','actually','basically',"
    "'tell','show','explain','describe','give','make','let','get','know','think','see','look','find','use','how','what','where','when','why','which','who','whom','not','no','yes','all','each',"
    "'every','any','some','more','most','other','than','if','then','else','only','own','same','such','too','here','there','now'"
)


def memories(*columns: str) -> str:
    """The distinct memories over some columns."""
    return f"(select distinct {', '.join(columns)} from memories)"


def edges(*columns: str) -> str:
    return f"(select distinct {', '.join(columns)} from edges)"


def tokens(text: str) -> str:
    """The distinct tokens of a text."""
    return f"list_distinct(list_filter(string_split(regexp_replace(lower({text}), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: x <> ''))"


def search_tokens(text: str) -> str:
    return f"coalesce(regexp_extract_all(strip_accents(lower({text})), '[\\p{{L}}\\p{{N}}]+'), [])"


def jaccard(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    return f"(case when len({a}) + len({b}) - {common} = 0 then 1.0::double else {common}::double / (len({a}) + len({b}) - {common}) end)"


def cosine(a: str, b: str) -> str:
    """Written out: the built-in one refuses lists that a CASE has emptied elsewhere."""
    length = lambda v: f"sqrt(list_sum(list_transform({v}, lambda x: x * x)))"
    return f"coalesce(list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])) / nullif({length(a)} * {length(b)}, 0), 0)"


def json_at(column: str, key: str) -> str:
    return f"(case when json_valid({column}) then json_extract_string({column}, '$.{key}') end)"


def days(column: str, now: str = NOW) -> str:
    return f"greatest(0.0::double, (epoch_us(timestamp '{now}') - epoch_us({column}))::double / 86400e6)"


_STATS_COLUMNS = ("content", "summary", "tags")


def bm25(phrases: list[list[str]], every: bool, where: str = "true", source: str | None = None) -> str:
    """CTEs ending in ``scored`` (id, score, ...) of the active memories that match."""
    base = source or memories("id", "status", "scope", "memory_type", *_STATS_COLUMNS)

    def count(column: str, p: list[str]) -> str:
        same = " and ".join(f"{column}[i + {k}] = '{w}'" for k, w in enumerate(p))
        return f"len(list_filter(range(1, len({column}) - {len(p) - 2}), lambda i: {same}))"

    f = ", ".join(f"{' + '.join(count(c, p) for c in ('tc', 'ts', 'tg'))} f{i}" for i, p in enumerate(phrases))
    n = ", ".join(f"count(*) filter (f{i} > 0)::double n{i}" for i in range(len(phrases)))
    idf = [f"(case when ln((rws - n{i} + 0.5) / (n{i} + 0.5)) > 0 then ln((rws - n{i} + 0.5) / (n{i} + 0.5)) else 1e-6 end)" for i in range(len(phrases))]
    score = " + ".join(f"{idf[i]} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / mean))" for i in range(len(phrases)))
    match = (" and " if every else " or ").join(f"f{i} > 0" for i in range(len(phrases)))
    return f"""toks as (select *, {search_tokens('content')} tc, {search_tokens('summary')} ts, {search_tokens("array_to_string(tags, ' ')")} tg from {base} where {where}),
counted as (select *, len(tc) + len(ts) + len(tg) dl, {f} from toks),
stats as (select count(*)::double rws, avg(dl) mean, {n} from counted),
scored as (select * exclude (tc, ts, tg), {score} score from counted, stats where ({match}) and status = 'active')"""
