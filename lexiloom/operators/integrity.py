"""Checks over the model's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.vectors import fault
from ..schema import FOREIGN_KEYS
from ..sources.tables import written


def orphans(tables: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """``child, column, id`` of rows whose foreign key has no parent, over all keys between the given tables.

    Of a table that several keys concern its keys alone are computed, once, and written.
    """
    keys, parts, narrow = [fk for fk in FOREIGN_KEYS if fk.child in tables and fk.parent in tables], [], {}
    for name in {n for fk in keys for n in (fk.child, fk.parent)}:
        own = tables[name].select(key, *[fk.column for fk in keys if fk.child == name])
        narrow[name] = written(own, "keys") if sum(name in (fk.child, fk.parent) for fk in keys) > 1 else own
    for fk in keys:
        lost = narrow[fk.child].join(narrow[fk.parent].select(F.col(key).alias(fk.column)), fk.column, "left_anti")
        parts.append(lost.select(F.lit(fk.child).alias("child"), F.lit(fk.column).alias("column"), F.col(key).alias("id")))
    return reduce(DataFrame.unionByName, parts)


def bad_vectors(df: DataFrame, dim: int, key: str = "id", column: str = "embedding") -> DataFrame:
    """``id, fault`` of rows whose vector is missing, has another dimension, holds a nan or is zero."""
    return df.select(F.col(key).alias("id"), fault(F.col(column), dim).alias("fault")).filter("fault is not null")


def duplicate_keys(df: DataFrame, column: str) -> DataFrame:
    """``key, n`` of values that several rows share without regard to case."""
    return df.groupBy(F.lower(column).alias("key")).agg(F.count("*").alias("n")).filter("n > 1")


def chunk_order(chunks: DataFrame) -> DataFrame:
    """``document_id, chunk_index, fault``: gap, duplicate, start (the first isn't 0), page (it goes back)."""
    by = Window.partitionBy("document_id").orderBy("chunk_index", "id")
    seen = chunks.select("document_id", "chunk_index", F.lag("chunk_index").over(by).alias("before"), (F.col("page_number") < F.lag("page_number").over(by)).alias("back"))
    step = F.col("chunk_index") - F.col("before")
    faults = F.array_compact(
        F.array(
            F.when(F.col("before").isNull() & (F.col("chunk_index") != 0), "start"),
            F.when(step == 0, "duplicate"),
            F.when(step > 1, "gap"),
            F.when(F.col("back"), "page"),
        )
    )
    return seen.select("document_id", "chunk_index", F.explode(faults).alias("fault"))


def citations_out_of_scope(citations: DataFrame, messages: DataFrame, sessions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations of a chunk that isn't of the session's document."""
    wide = citations.select(F.col("id").alias("citation_id"), "message_id", "chunk_id")
    wide = wide.join(messages.select(F.col("id").alias("message_id"), "session_id"), "message_id")
    wide = wide.join(sessions.select(F.col("id").alias("session_id"), F.col("document_id").alias("session_document")), "session_id")
    wide = wide.join(chunks.select(F.col("id").alias("chunk_id"), F.col("document_id").alias("cited_document")), "chunk_id")
    return wide.filter("session_document <> cited_document").select("citation_id", "session_id", "session_document", "cited_document")


def graph_faults(entities: DataFrame, edges: DataFrame, totals: Observation | None = None) -> DataFrame:
    """``check, id``: blank (name or type), dangling, loop, confidence (outside 0 to 1, or nan), parallel, deleted end.

    ``entities``: id, name, entity_type, is_deleted; ``edges``: id, source_entity_id, target_entity_id, relation_type,
    confidence_score. Of parallel edges all but the one with the least id are faults. An entity that several rows
    describe is blank or deleted if one of them says so. Each fault of an id comes once; ``totals`` is given the number
    of each kind when the result is computed.

    Edges and entities are computed once and written, narrow; one pass over the joined edges then finds all their
    faults as an array. Both sides of its joins are plain exchanges, so the edges of a hot entity are split at run time.
    """
    blank = (F.trim("name") == "") | (F.trim("entity_type") == "")
    known = written(entities.groupBy("id").agg(F.bool_or(F.coalesce("is_deleted", F.lit(False))).alias("gone"), F.bool_or(F.coalesce(blank, F.lit(True))).alias("blank")), "entities")
    alike = ["source_entity_id", "target_entity_id", "relation_type"]
    held = written(edges.select("id", *alike, "confidence_score"), "edges")
    first = written(held.groupBy(*alike).agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "parallel")
    joined = held
    for end in ("source", "target"):
        joined = joined.join(known.select(F.col("id").alias(f"{end}_entity_id"), F.col("gone").alias(f"{end}_gone")), f"{end}_entity_id", "left")
    first = first.select(*[F.col(c).alias(f"__{c}") for c in alike], "first")
    joined = joined.join(first, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in alike]), "left")
    score = F.col("confidence_score")
    kinds = {
        "dangling": F.col("source_gone").isNull() | F.col("target_gone").isNull(),
        "deleted": F.coalesce("source_gone", F.lit(False)) | F.coalesce("target_gone", F.lit(False)),
        "loop": F.col("source_entity_id") == F.col("target_entity_id"),
        "confidence": score.isNull() | F.isnan(score) | (score < 0) | (score > 1),
        "parallel": F.col("id") != F.col("first"),
    }
    faults = F.array_compact(F.array(*[F.when(condition, name) for name, condition in kinds.items()]))
    of_edges = joined.select(F.explode(faults).alias("check"), "id").distinct()
    out = known.filter("blank").select(F.lit("blank").alias("check"), "id").unionByName(of_edges)
    return out if totals is None else out.observe(totals, *[F.count_if(F.col("check") == name).alias(name) for name in ("blank", *kinds)])
