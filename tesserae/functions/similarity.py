"""Set and vector similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae import constants as C


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of equal length; 0 if either is all zero, null if null or of unequal length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norms == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), norms)))


def jaccard(a: Column, b: Column) -> Column:
    """Common share of two sets; two empty sets are equal (1), one empty set has nothing in common (0)."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(F.try_divide(common.cast("double"), union))


def hybrid(tokens_a: Column, tokens_b: Column, vector_a: Column, vector_b: Column) -> Column:
    """Cosine where both sides have vectors of one length, else Jaccard with low scores as 0."""
    j = jaccard(tokens_a, tokens_b)
    both = vector_a.isNotNull() & vector_b.isNotNull() & (F.size(vector_a) == F.size(vector_b))
    return F.when(both, cosine(vector_a, vector_b)).when(j < C.DIFFERENT_BELOW, F.lit(0.0)).otherwise(j)


def classify(score: Column) -> Column:
    """ignore, relate, suggest or consolidate."""
    return F.when(score < C.IGNORE_BELOW, "ignore").when(score < C.RELATE_BELOW, "relate").when(score <= C.SUGGEST_TO, "suggest").otherwise("consolidate")


def prefilter(score: Column) -> Column:
    """definitely_similar, definitely_different or maybe."""
    return F.when(score > C.SIMILAR_ABOVE, "definitely_similar").when(score < C.DIFFERENT_BELOW, "definitely_different").otherwise("maybe")


def fused(cos: Column, query_tokens: Column, tokens: Column, weight: float = C.KEYWORD_OVERLAP_WEIGHT) -> Column:
    """A cosine raised by the share of common words."""
    return cos * (1 + weight * jaccard(query_tokens, tokens))
