"""Sessions, messages and citations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import nearest
from ..sources.tables import written
from .graph import at_place, pairs, relations_among
from .ingest import around


def history(messages: DataFrame, last: int | None = None) -> DataFrame:
    """Messages with their ``turn`` in the session, from 1, by time and id; only the ``last`` ones if given."""
    by = Window.partitionBy("session_id").orderBy("created_at", "id")
    out = messages.withColumn("turn", F.row_number().over(by))
    if last is None:
        return out
    back = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    return out.withColumn("__back", F.row_number().over(back)).filter(F.col("__back") <= last).drop("__back")


def top_citations(citations: DataFrame, k: int) -> DataFrame:
    """The ``k`` most relevant citations of each message with their ``rank``; ties by chunk."""
    by = Window.partitionBy("message_id").orderBy(F.desc("relevance_score"), "chunk_id")
    return citations.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def latest_sessions(sessions: DataFrame) -> DataFrame:
    """The newest session of each user and document; ties by id."""
    newest = sessions.groupBy("user_id", "document_id").agg(F.max(F.struct("created_at", "id")).alias("m"))
    return newest.select("user_id", "document_id", F.col("m.id").alias("session_id"), F.col("m.created_at").alias("created_at"))


def session_stats(messages: DataFrame) -> DataFrame:
    """Messages by role, first and last time of each session."""
    roles = [F.count_if(F.col("role") == r).alias(f"n_{r.lower()}") for r in ("User", "Assistant", "System")]
    return messages.groupBy("session_id").agg(*roles, F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def citation_stats(citations: DataFrame, chunks: DataFrame, per: str = "chunk_id") -> DataFrame:
    """n, distinct messages and mean relevance by ``chunk_id`` or ``document_id``."""
    wide = citations.select("message_id", "chunk_id", "relevance_score")
    if per != "chunk_id":
        wide = wide.join(chunks.select(F.col("id").alias("chunk_id"), "document_id"), "chunk_id")
    return wide.groupBy(per).agg(F.count("*").alias("n"), F.count_distinct("message_id").alias("messages"), F.avg("relevance_score").alias("avg_relevance"))


#: Chunks of one matrix product.
AT_ONCE = 512


def cite(messages: DataFrame, sessions: DataFrame, chunks: DataFrame, k: int = 3, role: str = "Assistant", dim: int = 1536, block: int = 256) -> DataFrame:
    """``message_id, chunk_id, relevance_score``: the ``k`` nearest chunks of the session's document for each message.

    ``messages`` and ``chunks`` have ``buckets``, a text's token buckets (hashed_buckets()). The cosine of their counts
    comes from whole-number sums and is rounded to 6 digits before ranking, ties by chunk. A message that shares no
    bucket with its document has no citation. The chunks' other whole-number columns document_id and chunk_index come
    along where there are any.

    Messages meet their document's chunks as a product of two count matrices in one group. A document with more than
    ``block`` messages is dealt to several groups, about ``block`` messages each, with its chunks in each of them. Only
    what can be among the ``k`` best goes out.
    """
    asked = messages.filter(F.col("role") == role).select(F.col("id").alias("message_id"), "session_id", "buckets")
    asked = asked.join(sessions.select(F.col("id").alias("session_id"), "document_id"), "session_id").drop("session_id")
    groups = written(asked.groupBy("document_id").agg(F.ceil(F.count("*") / F.lit(float(block))).cast("int").alias("groups")), "groups")
    place = [c for c in ("chunk_index",) if c in chunks.columns]
    left = asked.join(groups, "document_id").withColumn("group", F.pmod(F.xxhash64("message_id"), F.col("groups")).cast("int")).drop("groups")
    right = chunks.select(F.col("id").alias("chunk_id"), "document_id", *place, "buckets").join(groups, "document_id")
    right = right.select("*", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group")).drop("groups")

    def nearest_chunks(asking: pa.Table, held: pa.Table) -> pa.Table:
        m = _counts(asking["buckets"], dim)
        m2, parts = (m * m).sum(axis=1), []
        for at in range(0, held.num_rows, AT_ONCE):
            c = _counts(held["buckets"].slice(at, AT_ONCE), dim)
            c2, dots = (c * c).sum(axis=1), m @ c.T
            parts.append((dots, dots / np.maximum(np.sqrt(m2)[:, None] * np.sqrt(c2), 1), c2))
        parts = parts or [(np.zeros((len(m), 0)), np.zeros((len(m), 0)), np.zeros(0))]
        dots, scores, c2 = (np.concatenate([p[i] for p in parts], axis=-1) for i in range(3))
        if scores.shape[1] > k:
            # a score that rounding can raise to the k-th
            least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None] - 2e-6
        else:
            least = -1.0
        row, column = np.nonzero((scores >= least) & (dots > 0))
        out = {"message_id": asking["message_id"].take(row), **{n: held[n].take(column) for n in ("chunk_id", "document_id", *place)}}
        return pa.table(out | {"dot": dots[row, column].astype(np.int64), "m2": m2[row].astype(np.int64), "c2": c2[column].astype(np.int64)})

    kinds = {**dict(left.dtypes), **dict(right.dtypes)}
    columns = ["message_id", "chunk_id", "document_id", *place]
    schema = ", ".join([*[f"{n} {kinds[n]}" for n in columns], "dot long, m2 long, c2 long"])
    near = left.groupBy("document_id", "group").cogroup(right.groupBy("document_id", "group")).applyInArrow(nearest_chunks, schema)
    score = F.round(F.col("dot") / (F.sqrt("m2") * F.sqrt("c2")), 6)
    return top_citations(near.select(*columns, score.alias("relevance_score")), k)


def _counts(buckets: pa.ChunkedArray, dim: int) -> np.ndarray:
    """How often each text (a row) has each bucket."""
    held = buckets.combine_chunks()
    rows = np.repeat(np.arange(len(held)), pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False))
    values = held.flatten().to_numpy(zero_copy_only=False)
    return np.bincount(rows * dim + values, minlength=len(held) * dim).reshape(len(held), dim).astype(np.float64)


def lineage(citations: DataFrame, messages: DataFrame, sessions: DataFrame, chunks: DataFrame, docs: DataFrame, users: DataFrame) -> DataFrame:
    """Each citation with its message, session and user, and its chunk, page and document.

    Citations that say where their chunk stands (document_id, chunk_index) meet it there: chunks that are laid out by
    that place aren't moved.
    """
    out = citations.join(messages.select(F.col("id").alias("message_id"), "session_id"), "message_id")
    out = out.join(sessions.select(F.col("id").alias("session_id"), "user_id"), "session_id")
    out = out.join(users.select(F.col("id").alias("user_id"), "username"), "user_id")
    place = at_place(citations)
    out = out.drop("document_id").join(chunks.select(F.col("id").alias("chunk_id"), "document_id", "chunk_index", "page_number"), "chunk_id") if not place else out.join(chunks.select(*place, "page_number"), place)
    return out.join(docs.select(F.col("id").alias("document_id"), "title", "file_path"), "document_id")


def groundedness(messages: DataFrame, citations: DataFrame, least: float) -> DataFrame:
    """For each session: assistant messages, those without citation, those with none from ``least`` up, grounded share."""
    best = citations.groupBy("message_id").agg(F.max("relevance_score").alias("best"))
    said = messages.filter("role = 'Assistant'").select("session_id", F.col("id").alias("message_id")).join(best, "message_id", "left")
    out = said.groupBy("session_id").agg(F.count("*").alias("answers"), F.count_if(F.col("best").isNull()).alias("uncited"), F.count_if(F.col("best") < least).alias("weak"))
    return out.withColumn("grounded", 1 - (F.col("uncited") + F.col("weak")) / F.col("answers"))


def prompts(messages: DataFrame, sessions: DataFrame, citations: DataFrame, chunks: DataFrame, *, system: str, last: int, cited: int) -> DataFrame:
    """``session_id, prompt``: the system text, the chunks its messages cite best, and its last turns in order."""
    turns = history(messages, last).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "content").alias("said")))).alias("turns"))
    of = citations.join(messages.select(F.col("id").alias("message_id"), "session_id"), "message_id").groupBy("session_id", "chunk_id").agg(F.max("relevance_score").alias("score"))
    best = of.withColumn("rank", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("score"), "chunk_id"))).filter(F.col("rank") <= cited)
    texts = best.join(chunks.select(F.col("id").alias("chunk_id"), "content"), "chunk_id").groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("rank", "content"))).alias("facts"))
    wide = sessions.select(F.col("id").alias("session_id")).join(turns, "session_id").join(texts, "session_id", "left")
    facts = F.concat(F.array(F.lit(system)), F.coalesce(F.col("facts.content"), F.array().cast("array<string>")), F.col("turns.said"))
    return wide.select("session_id", F.array_join(facts, "\n").alias("prompt"))


def ground(hits: DataFrame, chunks: DataFrame, found: DataFrame, width: int = 1) -> DataFrame:
    """What answers rest on: ``hits`` (chunk_id) widened to ``width`` chunks either side, each with its graph facts.

    ``found``: mentions (chunk_id, name). Returns document_id, chunk_index, page_number, content and facts, the number
    of concepts; a chunk near several hits comes once. Hits may come from any search.
    """
    at = hits.select("chunk_id").distinct().join(chunks.select(F.col("id").alias("chunk_id"), "document_id", "chunk_index"), "chunk_id")
    facts = found.groupBy(F.col("chunk_id").alias("id")).agg(F.count("name").alias("facts"))
    wide = around(at, chunks, width).join(facts, "id", "left")
    return wide.select("document_id", "chunk_index", "page_number", "content", F.coalesce("facts", F.lit(0)).alias("facts"))


def retrieve(questions: DataFrame, chunks: DataFrame, k: int = 5, width: int = 1, vectors: DataFrame | None = None) -> DataFrame:
    """``question_id, rank, chunk_id, document_id, chunk_index, page_number, content``: the context of each question.

    ``questions``: question_id, embedding; ``chunks`` with id and embedding. The ``k`` nearest of all chunks, widened to
    ``width`` chunks either side; a chunk near several hits comes once, under the best one's rank. A question without
    a usable vector has no rows. ``vectors``: id and embedding of the chunks, where ``chunks`` itself has none.
    """
    hits = written(nearest(questions, chunks if vectors is None else vectors, k, query_id="question_id", vector_id="id"), "hits")
    at = hits.join(chunks.select(F.col("id").alias("vec_id"), "document_id", "chunk_index"), "vec_id")
    near = F.explode(F.sequence(F.col("chunk_index") - width, F.col("chunk_index") + width)).alias("chunk_index")
    wanted = at.select(F.col("query_id").alias("question_id"), "rank", "document_id", near).groupBy("question_id", "document_id", "chunk_index").agg(F.min("rank").alias("rank"))
    return chunks.join(wanted, ["document_id", "chunk_index"]).select("question_id", "rank", F.col("id").alias("chunk_id"), "document_id", "chunk_index", "page_number", "content")


def pairs_of_context(context: DataFrame, found: DataFrame) -> DataFrame:
    """``question_id, source, target``: names that stand in one chunk of a question's context, each pair once.

    ``found``: mentions (chunk_id, name). Pairs are made inside one chunk's own names.
    """
    named = context.select("question_id", "chunk_id").join(found.select("chunk_id", "name"), "chunk_id")
    lists = named.groupBy("question_id", "chunk_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return lists.select("question_id", F.explode(pairs("names")).alias("p")).select("question_id", "p.source", "p.target").distinct()


def facts(context: DataFrame, found: DataFrame, edges: DataFrame) -> DataFrame:
    """``question_id`` and the columns of ``edges`` (source, target): those whose ends stand in one chunk of its context."""
    return pairs_of_context(context, found).join(edges, ["source", "target"])


def facts_of(context: DataFrame, found: DataFrame) -> DataFrame:
    """As facts(), where no edges are stored: only the context's own pairs are counted over all mentions."""
    asked = written(pairs_of_context(context, found), "asked")
    return asked.join(relations_among(found, asked), ["source", "target"])
