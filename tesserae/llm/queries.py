"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import clusters, encoding, garbled, leaks, names, tagsets
from tesserae.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(names.variants(table(spark, d, "entities")))


def p2_variants(spark: SparkSession, d: str) -> DataFrame:
    return names.variants(table(spark, d, "entities"))


def p2_rarities(spark: SparkSession, d: str) -> DataFrame:
    return names.rarities(table(spark, d, "entities"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.found(clusters.clusters(table(spark, d, "memories")))


def p4_summary(spark: SparkSession, d: str) -> DataFrame:
    return clusters.summary(table(spark, d, "memories"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return tagsets.similar_pairs(table(spark, d, "memories"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"))


def p6_offsets(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"), offsets=True)


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return encoding.decode(encoding.encode(table(spark, d, "documents")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_report(p7_found(spark, d))


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    return leaks.near_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.scan(table(spark, d, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.scan(table(spark, d, "documents"))


QUERIES = {"p2_found": p2_found, "p2_variants": p2_variants, "p2_rarities": p2_rarities, "p4_found": p4_found, "p4_summary": p4_summary, "p5_found": p5_found, "p6_ids": p6_ids, "p6_offsets": p6_offsets, "p6_round_trip": p6_round_trip, "p7_found": p7_found, "p7_report": p7_report, "p7_near": p7_near, "p8_found": p8_found, "p8_restored": p8_restored}

_TAGS = r"""
with t as (select distinct id, lower(trim(x, ' ' || chr(9))) tag from (select id, unnest(tags) x from memories) where x is not null and trim(x, ' ' || chr(9)) <> ''),
n as (select id, count(*) n from t group by id having count(*) >= 3)
"""

_LEAKS = r"""
with w as (select doc_id id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) w from documents),
i as (select item_id id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) w from eval_items),
g as (select distinct id, array_to_string(w[k:k + 11], ' ') p from i, unnest(range(1, len(w) - 10)) t(k)),
h as (select id, array_to_string(w[k:k + 11], ' ') p from w, unnest(range(1, len(w) - 10)) t(k)),
found as (select distinct h.id doc_id, g.id item_id from h join g using (p))
"""

SQL = {
    "p7_found": _LEAKS + "select doc_id, item_id from found",
    "p7_report": _LEAKS + "select item_id, count(*) documents from found group by 1",
    "p6_round_trip": "select doc_id, coalesce(text, '') as text from documents",
    "p5_found": _TAGS
    + """, c as (select a.id id_a, b.id id_b, count(*) k from t a join t b on a.tag = b.tag and a.id < b.id
  where a.id in (select id from n) and b.id in (select id from n) group by all)
select id_a, id_b from c join n x on x.id = id_a join n y on y.id = id_b where k >= 0.6 * (x.n + y.n - k)""",
}
