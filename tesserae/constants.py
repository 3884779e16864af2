"""Fixed values of the data model and its operators."""

MEMORY_TYPES = ["architecture", "decision", "pattern", "gotcha", "context", "progress", "code_description", "code"]
MEMORY_STATUSES = ["active", "superseded", "archived", "pruned"]
SCOPES = ["project", "global"]
SOURCE_TYPES = ["extraction", "manual", "code_index"]
RELATIONS = ["relates_to", "derived_from", "contradicts", "exemplifies", "refines", "supersedes", "source_of"]
EDGE_STATUSES = ["active", "suggested", "archived"]
ENTITY_TYPES = ["person", "project", "tool", "concept", "org", "other"]

#: Other spellings of relations.
RELATION_ALIASES = {
    "related": "relates_to", "derives": "derived_from", "contradict": "contradicts", "example": "exemplifies",
    "refine": "refines", "supersede": "supersedes", "source": "source_of",
}

#: Similarity buckets.
IGNORE_BELOW, RELATE_BELOW, SUGGEST_TO = 0.1, 0.4, 0.5
SIMILAR_ABOVE, DIFFERENT_BELOW = 0.6, 0.1
DEDUP, INTRA_BATCH, MERGE_CEILING, CONSOLIDATION = 0.75, 0.75, 0.85, 0.5

#: Search and recall.
PREFILTER_LIMIT, MIN_COSINE, KEYWORD_OVERLAP_WEIGHT, RECALL_LIMIT, TRAVERSAL_DEPTH = 100, 0.25, 0.3, 10, 2
PROMPT_MIN_TOKENS, PROMPT_LIMIT, AND_MIN, AND_MAX = 2, 5, 2, 6
FALLBACK_MIN_UNIGRAMS, FALLBACK_COSINE, FALLBACK_LIMIT = 4, 0.65, 3
BM25_K1, BM25_B = 1.2, 0.75

#: Ranking and surface.
W_CONFIDENCE, W_PRIORITY, W_CENTRALITY, W_ACCESS, BRANCH_BOOST, RECENCY_DAYS = 0.5, 0.2, 0.15, 0.15, 0.1, 14.0
LINE_BUDGETS = {"architecture": 25, "decision": 25, "pattern": 25, "gotcha": 20, "progress": 30, "context": 15, "code_description": 10, "code": 0}
SURFACE_TARGET, SURFACE_MAX, RENDER_MAX = 1300, 1800, 2000

#: Decay and lifecycle, in days.
HALF_LIVES = {"pattern": 60, "gotcha": 45, "context": 30, "progress": 7}
ARCHIVE_BELOW, ARCHIVE_DAYS, PRUNE_DAYS, VACUUM_DAYS, HUB_ABOVE = 0.3, 14, 30, 90, 0.5
LIFECYCLE_FALLBACK_HOURS = 2.0
PRUNE_SESSIONS, PRUNE_MEMORIES, PRUNE_GROWTH, PRUNE_LEAST, PRUNE_BATCH = 5, 50, 1.25, 8, 80
EMBED_BATCH, CLASSIFY_BATCH = 100, 10
TRANSCRIPT_BYTES = 100_000
MAX_ENTITIES, MAX_FACTS, KNOWN_ENTITIES = 5, 3, 20

#: Words that carry no meaning in a prompt.
STOP_WORDS = """
a an the this that these those
i me my we our you your he she it its they them their
in on at to for of with by from up about into through during before after above below between under over
and but or nor so yet both either neither
is are was were be been being have has had do does did will would could should may might shall can
please help want need like just also very really actually basically
tell show explain describe give make let get know think see look find use
how what where when why which who whom
not no yes all each every any some more most other than
if then else only own same such too here there now
""".split()
