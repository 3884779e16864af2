"""Resumable transcript ingest: byte-budgeted chunks, parsing and validation of extracted candidates."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tesserae import constants as C
from tesserae.functions.text import fenced_json, strip_blocks
from tesserae.operators.store import sanitise_relation

_CANDIDATE = "struct<content:string,summary:string,memory_type:string,scope:string,confidence:double,priority:double,tags:array<string>>"
_FACT = "struct<entity_name:string,entity_type:string,predicate:string,object:string>"


def lines(transcripts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, first, bytes, text): the lines of each transcript, with the byte at which each begins; the line break counts to its line."""
    raw = transcripts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n", -1)).alias("line", "text"), F.size(F.split(text_col, "\n", -1)).alias("_n"))
    sized = raw.withColumn("bytes", F.octet_length("text") + F.when(F.col("line") < F.col("_n") - 1, 1).otherwise(0)).drop("_n")
    w = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("first", F.coalesce(F.sum("bytes").over(w), F.lit(0)))


def next_chunk(transcripts: DataFrame, id_col: str = "id", text_col: str = "text", cursor_col: str = "cursor", budget: int = C.TRANSCRIPT_BYTES) -> DataFrame:
    """(id, chunk, new_cursor): what each transcript offers after its byte cursor, in whole lines within the budget.

    All in bytes. A first line longer than the budget is cut to it (at a character), so that reading always
    advances. A row is handled by itself: no shuffle.
    """
    data = F.encode(F.col(text_col), "UTF-8")
    total = F.octet_length(F.col(text_col))
    start = F.least(F.coalesce(F.col(cursor_col), F.lit(0)), total)
    rest = F.substr(data, (start + 1).cast("int"), F.lit(2**31 - 1))
    head = F.substr(data, (start + 1).cast("int"), F.lit(budget))
    text = F.try_validate_utf8(head.cast("string"))
    # drop up to three bytes of a character cut at the end
    whole = F.coalesce(text, *(F.try_validate_utf8(F.substr(head, F.lit(1), F.octet_length(head) - k).cast("string")) for k in (1, 2, 3)))
    upto = F.length(whole) - F.length(F.substring_index(whole, "\n", -1))
    chunk = F.when(F.octet_length(rest) <= budget, rest.cast("string")).when(upto > 0, F.substr(whole, F.lit(1), upto.cast("int"))).otherwise(whole)
    return transcripts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), chunk.alias("chunk"), (start + F.octet_length(chunk)).cast("bigint").alias("new_cursor"))


def every_chunk(transcripts: DataFrame, id_col: str = "id", text_col: str = "text", budget: int = C.TRANSCRIPT_BYTES) -> DataFrame:
    """(id, number, first, last): the chunks of each transcript from its start to its end, as reading on from cursor to cursor gives them.

    ``first`` and ``last`` are byte cursors; null and empty transcripts have no chunk. A row is handled by itself: no shuffle.
    """

    def ends(data: bytes) -> list[int]:
        out, at = [], 0
        while at < len(data):
            stop = at + budget
            if stop < len(data):
                line = data.rfind(b"\n", at, stop)
                if line >= 0:
                    stop = line + 1
                else:  # a line beyond the budget is cut at a character
                    while stop > at + 1 and data[stop] & 0xC0 == 0x80:
                        stop -= 1
            at = min(stop, len(data))
            out.append(at)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [ends(t.encode()) if t else [] for t in b.column(1).to_pylist()]
            n = np.array([len(e) for e in found], np.int64)
            last = np.array([x for e in found for x in e], np.int64)
            first = np.array([x for e in found for x in [0, *e[:-1]][: len(e)]], np.int64)
            number = np.concatenate([np.arange(k) for k in n]) if len(n) else n
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(number, pa.int32()), pa.array(first), pa.array(last)], names=["id", "number", "first", "last"])

    kind = dict(transcripts.dtypes)[id_col]
    return transcripts.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, number int, first bigint, last bigint")


def clean_transcript(text: Column, start: str, end: str) -> Column:
    """Without blocks that were injected between two markers."""
    return strip_blocks(text, start, end)


_REQUEST = """Read the session transcript below and note what is worth remembering.

Answer with one JSON object: {"memories": [...], "entities": [...]}; empty lists if there is nothing.
A memory has content, summary (one or two sentences), memory_type, scope, confidence, priority and tags.
- memory_type: %s
- scope: global if it holds in other projects too and is all but certain, else project
- confidence: 0 to 1; priority: a whole number from 1 to 10; tags: a list of words
An entity entry has entity_name, entity_type (%s), predicate and object, and states a fact, not an impression."""


def known_entities(profiles: list[Row], most: int = C.KNOWN_ENTITIES, most_facts: int = C.MAX_FACTS) -> str:
    """The lines of a prompt that name entities already known (name, entity_type, facts), and how to treat their facts."""
    lines = [f"- {p.name} ({p.entity_type}): {'; '.join(f.replace(': ', ' → ', 1) for f in p.facts[:most_facts])}" for p in profiles if p.facts][:most]
    return "\n".join(["Known already:", *lines, "Leave these facts out unless the transcript says otherwise; a contradicting fact is to be given."]) if lines else ""


def extraction_prompts(chunks: DataFrame, project: str, branch: str, markers: tuple[str, str], commits: list[str] = (), files: list[str] = (), known: str = "") -> DataFrame:
    """(id, prompt) of transcript chunks (id, chunk): the request, where the work stands, what is known, and the chunk without the blocks between ``markers``."""
    about = [f"Project: {project}", f"Branch: {branch}"]
    about += ["Recent commits:", *(f"  - {c}" for c in commits)] if commits else []
    about += ["Changed files:", *(f"  - {f}" for f in files)] if files else []
    head = "\n\n".join(p for p in (_REQUEST % (", ".join(C.MEMORY_TYPES), ", ".join(C.ENTITY_TYPES)), "\n".join(about), known, "Transcript:\n") if p)
    return chunks.select("id", F.concat(F.lit(head), clean_transcript(F.col("chunk"), *markers)).alias("prompt"))


def source_context(branch: str, commits: list[str] = (), files: list[str] = ()) -> str:
    """The JSON context of an extracted memory: branch, the first three commits, the first ten files."""
    return json.dumps({"branch": branch, "commits": list(commits[:3]), "files": list(files[:10])})


def parse_response(responses: DataFrame, text_col: str = "response") -> DataFrame:
    """Each model response with ``memories`` and ``entities``: valid candidates only; anything unreadable gives empty lists.

    Both forms are read: a plain list of memories, and an object with both lists. Confidence must lie in 0..1
    and priority be a whole number from 1 to 10.
    """
    text = fenced_json(F.col(text_col))
    opts = {"mode": "PERMISSIVE"}
    plain = F.from_json(text, f"array<{_CANDIDATE}>", opts)
    both = F.from_json(text, f"struct<memories:array<{_CANDIDATE}>,entities:array<{_FACT}>>", opts)
    is_list = F.substring(text, 1, 1) == "["
    valid = F.filter(
        F.when(is_list, plain).otherwise(both["memories"]),
        lambda m: F.coalesce(
            m["content"].isNotNull() & m["summary"].isNotNull() & m["memory_type"].isin(C.MEMORY_TYPES) & m["scope"].isin(C.SCOPES) & m["confidence"].between(0, 1) & m["priority"].between(1, 10) & (m["priority"] == F.floor(m["priority"])),
            F.lit(False),
        ),
    )
    facts = F.filter(
        F.when(~is_list, both["entities"]),
        lambda e: F.coalesce((F.trim(e["entity_name"]) != "") & e["entity_type"].isin(C.ENTITY_TYPES) & (F.trim(e["predicate"]) != "") & (F.trim(e["object"]) != ""), F.lit(False)),
    )
    trimmed = F.transform(facts, lambda e: F.struct(F.trim(e["entity_name"]).alias("entity_name"), e["entity_type"].alias("entity_type"), F.trim(e["predicate"]).alias("predicate"), F.trim(e["object"]).alias("object")))
    return responses.withColumn("memories", F.coalesce(valid, F.array().cast(f"array<{_CANDIDATE}>"))).withColumn("entities", F.coalesce(trimmed, F.array().cast(f"array<{_FACT}>")))


def parse_classified(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    """(…, source_id, target_id, relation_type, strength, ord): edge classifications in model answers, in their order.

    Anything unreadable gives none; an entry counts if its relation can be read and its strength lies in 0..1.
    """
    kind = "array<struct<source_id:string,target_id:string,relation_type:string,strength:double>>"
    others = [c for c in answers.columns if c != answer_col]
    each = answers.select(*others, F.posexplode(F.from_json(fenced_json(F.col(answer_col)), kind)).alias("ord", "c"))
    said = each.select(*others, "c.source_id", "c.target_id", sanitise_relation(F.col("c.relation_type")).alias("relation_type"), "c.strength", "ord")
    return said.where("relation_type is not null and strength between 0 and 1")


def parse_decisions(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    """(id, reason): the memories a judge wants archived, from answers that hold a JSON list, fenced or not; entries without id or reason are dropped."""
    bare = F.btrim(F.regexp_replace(F.col(answer_col), r"(?i)```json\s*|```\s*", ""), F.lit(" \t\r\n"))
    each = answers.select(F.explode(F.from_json(bare, "array<struct<id:string,reason:string>>")).alias("d"))
    return each.select("d.id", "d.reason").where("id is not null and reason is not null")


def with_embeddings(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], id_col: str, text_col: str, dim: int, batch: int = C.EMBED_BATCH) -> DataFrame:
    """(id, vector, error): an outside embedder called in batches inside tasks; a failing batch fails its rows only, wrong lengths are errors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), batch):
                part = f.iloc[lo : lo + batch]
                try:
                    vectors = embed([str(t) for t in part[text_col]])
                    errors = [None if len(v) == dim else f"{len(v)} numbers, not {dim}" for v in vectors]
                    vectors = [v if e is None else None for v, e in zip(vectors, errors, strict=True)]
                except Exception as e:  # an outside service may fail in any way
                    vectors, errors = [None] * len(part), [str(e)] * len(part)
                yield pd.DataFrame({id_col: part[id_col], "vector": vectors, "error": errors})

    return rows.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, vector array<double>, error string")


def with_answers(prompts: DataFrame, ask: Callable[[str], str], id_col: str, prompt_col: str) -> DataFrame:
    """(id, answer, error): an outside model asked inside tasks, each failure kept with its row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            answers, errors = [], []
            for p in f[prompt_col]:
                try:
                    answers.append(ask(p))
                    errors.append(None)
                except Exception as e:
                    answers.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({id_col: f[id_col], "answer": answers, "error": errors})

    return prompts.select(id_col, prompt_col).mapInPandas(run, f"`{id_col}` {dict(prompts.dtypes)[id_col]}, answer string, error string")
