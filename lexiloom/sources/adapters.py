"""The model's tables from the test tables, and the same in DuckDB SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..jobs import chat, graph, ingest
from .tables import laid_out, written

#: Where a chunk stands.
PLACE = ["document_id", "chunk_index"]

#: Documents of so many users.
USERS = 150
NOW = "2024-06-01 00:00:00"


class Model:
    """The tables of one folder; each is a query that hasn't run, but for ``named``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def users(self) -> DataFrame:
        email = F.concat(F.lit("User"), (F.col("c_custkey") % 97).cast("string"), F.lit("@example.com"))
        return self.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), email.alias("email"), F.lit("Customer").alias("role"))

    def documents(self) -> DataFrame:
        step = F.col("doc_id") % 20
        status = F.when(step == 0, "Failed").when(step == 1, "Pending").when(step == 2, "Chunking").when(step == 3, "Extracting").otherwise("Ready")
        created = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("doc_id") * 60)
        path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
        return self.raw("documents").select(
            F.col("doc_id").alias("id"), (F.col("doc_id") % USERS).alias("user_id"), F.col("source").alias("title"), path.alias("file_path"), status.alias("status"),
            (F.col("doc_id") % 17 == 0).alias("is_deleted"), created.alias("created_at"), (F.col("doc_id") % 7).alias("created_by"), "text",
        )

    def documents_with_audit(self) -> DataFrame:
        gone = F.col("is_deleted")
        at = F.when(gone, F.col("created_at") + F.expr("interval 1 day"))
        none = F.lit(None)
        return self.documents().drop("text").withColumns({"updated_at": F.col("created_at"), "updated_by": none.cast("long"), "deleted_at": at, "deleted_by": F.when(gone, F.lit(1).cast("long"))})

    def chunks(self) -> DataFrame:
        return with_id(ingest.chunk(self.documents()))

    def mentions(self) -> DataFrame:
        return graph.mentions(self.chunks())

    @cached_property
    def named(self) -> DataFrame:
        """``chunk_id, name`` of the mentions, written once: what the graph's jobs read of them, several times."""
        return written(self.mentions().select("chunk_id", "name"), "mentions")

    def entities(self) -> DataFrame:
        """One entity for each mention; a name is deleted if it starts with q."""
        key = F.concat_ws("#", F.col("chunk_id").cast("string"), "name")
        return self.mentions().select(key.alias("id"), "chunk_id", "document_id", "name", "entity_type", "description", F.col("name").startswith("q").alias("is_deleted"))

    def edges(self) -> DataFrame:
        """Relationships between canonical names."""
        found = graph.relations(self.named)
        return found.select(F.concat_ws("#", "source", "target").alias("id"), F.col("source").alias("source_entity_id"), F.col("target").alias("target_entity_id"), "relation_type", F.round("confidence", 6).alias("confidence_score"))

    def sessions(self) -> DataFrame:
        n = self.raw("documents").agg(F.count("*").alias("n_docs"))
        opened = self.raw("conversations").select("conv_id").distinct().crossJoin(F.broadcast(n))
        at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-03-01 00:00:00")) + F.col("conv_id") * 3600)
        return opened.select(F.col("conv_id").alias("id"), (F.col("conv_id") % USERS).alias("user_id"), (F.col("conv_id") % F.col("n_docs")).alias("document_id"), F.lit("New Chat").alias("title"), at.alias("created_at"))

    def messages(self) -> DataFrame:
        at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-03-01 00:00:00")) + F.col("conv_id") * 3600 + F.col("turn") * 60)
        return self.raw("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), F.initcap("role").alias("role"), F.col("text").alias("content"), at.alias("created_at"))

    def citations(self) -> DataFrame:
        messages = self.messages().withColumn("buckets", ingest.hashed_buckets(F.col("content")))
        chunks = self.chunks().withColumn("buckets", ingest.hashed_buckets(F.col("content")))
        found = chat.cite(messages, self.sessions(), chunks)
        return found.withColumn("id", F.concat_ws("#", F.col("message_id").cast("string"), F.col("chunk_id").cast("string")))

    def vectors(self) -> DataFrame:
        return self.raw("embeddings")


class LaidOut(Model):
    """The same tables; chunks, and the mentions in them, are cut once and written by where a chunk stands."""

    @cached_property
    def _chunks(self) -> DataFrame:
        return laid_out(super().chunks(), "chunks", *PLACE)

    @cached_property
    def _mentions(self) -> DataFrame:
        return laid_out(graph.mentions(self._chunks, keep=("chunk_index",)), "mentions", *PLACE, dealt=True)

    def chunks(self) -> DataFrame:
        return self._chunks

    def mentions(self) -> DataFrame:
        return self._mentions

    def entities(self) -> DataFrame:
        key = F.concat_ws("#", F.col("chunk_id").cast("string"), "name")
        return self.mentions().select(key.alias("id"), "chunk_id", *PLACE, "name", "entity_type", "description", F.col("name").startswith("q").alias("is_deleted"))


def with_id(chunks: DataFrame) -> DataFrame:
    """Whole-number ids, as the test tables have."""
    return chunks.withColumn("id", F.col("document_id") * 100000 + F.col("chunk_index"))


#: The same tables, as the beginning of a DuckDB query.
CTES = {
    "users": "users AS (SELECT c_custkey AS id, c_name AS username, 'User' || (c_custkey % 97) || '@example.com' AS email, 'Customer' AS role FROM customer)",
    "docs": """docs AS (SELECT doc_id AS id, doc_id % 150 AS user_id, source AS title, '/' || source || '/' || doc_id AS file_path,
        CASE doc_id % 20 WHEN 0 THEN 'Failed' WHEN 1 THEN 'Pending' WHEN 2 THEN 'Chunking' WHEN 3 THEN 'Extracting' ELSE 'Ready' END AS status,
        doc_id % 17 = 0 AS is_deleted, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at, doc_id % 7 AS created_by, text,
        TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS updated_at, NULL::BIGINT AS updated_by,
        CASE WHEN doc_id % 17 = 0 THEN TIMESTAMP '2024-01-02' + to_minutes(doc_id) END AS deleted_at, CASE WHEN doc_id % 17 = 0 THEN 1 END AS deleted_by FROM documents)""",
    "chunks": r"""chunks AS (SELECT doc_id * 100000 + i AS id, doc_id AS document_id, i AS chunk_index, (i * 800) // 3000 + 1 AS page_number, substr(t, i * 800 + 1, 1000) AS content
        FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) c, LATERAL (SELECT unnest(range(greatest(1, ceil((length(t) - 200) / 800.0)::BIGINT))) AS i)
        WHERE length(t) > 0)""",
    "mentions": r"""mentions AS (SELECT DISTINCT id AS chunk_id, document_id, lower(unnest(regexp_extract_all(content, '\p{Lu}\p{Ll}{3,}'))) AS name, 'TERM' AS entity_type,
        CASE WHEN length(content) > 120 THEN substr(content, 1, 120) || '...' ELSE content END AS description FROM chunks)""",
    "entities": "entities AS (SELECT chunk_id || '#' || name AS id, *, starts_with(name, 'q') AS is_deleted FROM mentions)",
    "relations": """relations AS (SELECT p.source, p.target, 'CO_OCCURS' AS relation_type, pair_chunks, pair_chunks / least(a.n, b.n) AS confidence FROM
        (SELECT x.name AS source, y.name AS target, count(*) AS pair_chunks FROM mentions x JOIN mentions y ON x.chunk_id = y.chunk_id AND x.name < y.name GROUP BY 1, 2) p
        JOIN (SELECT name, count(*) AS n FROM mentions GROUP BY 1) a ON a.name = p.source JOIN (SELECT name, count(*) AS n FROM mentions GROUP BY 1) b ON b.name = p.target)""",
    "edges": "edges AS (SELECT source || '#' || target AS id, source AS source_entity_id, target AS target_entity_id, relation_type, round(confidence, 6) AS confidence_score FROM relations)",
    "sessions": "sessions AS (SELECT conv_id AS id, conv_id % 150 AS user_id, conv_id % (SELECT count(*) FROM documents) AS document_id, 'New Chat' AS title, TIMESTAMP '2024-03-01' + to_hours(conv_id) AS created_at FROM (SELECT DISTINCT conv_id FROM conversations))",
    "messages": "messages AS (SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, upper(role[1]) || lower(role[2:]) AS role, text AS content, TIMESTAMP '2024-03-01' + to_hours(conv_id) + to_minutes(turn) AS created_at FROM conversations)",
    "citations": r"""mtok AS (SELECT id AS message_id, ('0x' || substr(md5(t), 1, 7))::BIGINT % 1536 AS bucket, count(*) AS n FROM (SELECT id, unnest(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+')) AS t FROM messages WHERE role = 'Assistant') WHERE t <> '' GROUP BY 1, 2),
        ctok AS (SELECT id AS chunk_id, document_id, ('0x' || substr(md5(t), 1, 7))::BIGINT % 1536 AS bucket, count(*) AS n FROM (SELECT id, document_id, unnest(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+')) AS t FROM chunks WHERE document_id IN (SELECT document_id FROM sessions)) WHERE t <> '' GROUP BY 1, 2, 3),
        dots AS (SELECT m.message_id, c.chunk_id, sum(m.n * c.n) AS dot FROM mtok m JOIN messages g ON g.id = m.message_id JOIN sessions s ON s.id = g.session_id JOIN ctok c ON c.document_id = s.document_id AND c.bucket = m.bucket GROUP BY 1, 2),
        scored AS (SELECT message_id, chunk_id, round(dot / (sqrt(m2) * sqrt(c2)), 6) AS relevance_score FROM dots JOIN (SELECT message_id, sum(n * n)::DOUBLE AS m2 FROM mtok GROUP BY 1) USING (message_id) JOIN (SELECT chunk_id, sum(n * n)::DOUBLE AS c2 FROM ctok GROUP BY 1) USING (chunk_id)),
        citations AS (SELECT message_id || '#' || chunk_id AS id, * FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY relevance_score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 3)""",
}
NEEDS = {"chunks": [], "mentions": ["chunks"], "entities": ["mentions"], "relations": ["mentions"], "edges": ["relations"], "citations": ["messages", "sessions", "chunks"]}


def sql(query: str, *tables: str) -> str:
    """``query`` in front of which stand the tables that it names, and those that these need."""
    names: list[str] = []

    def need(name: str) -> None:
        for other in NEEDS.get(name, []):
            need(other)
        if name not in names:
            names.append(name)

    for t in tables:
        need(t)
    return f"WITH {', '.join(CTES[n] for n in names)} {query}" if names else query
