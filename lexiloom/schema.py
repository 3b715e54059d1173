"""The model: tables, enums and foreign keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

DOCUMENT_STATUS = ["Pending", "Chunking", "Extracting", "Ready", "Failed"]
CHAT_ROLE = ["User", "Assistant", "System"]
#: Steps a document may take from one status to another.
STATUS_STEPS = [("Pending", "Chunking"), ("Chunking", "Extracting"), ("Extracting", "Ready"), ("Pending", "Failed"), ("Chunking", "Failed"), ("Extracting", "Failed")]
ZERO_ID = "00000000-0000-0000-0000-000000000000"
VECTOR_DIM = 1536

AUDIT = ["is_deleted", "created_at", "created_by", "updated_at", "updated_by", "deleted_at", "deleted_by"]


def _table(own: str, key: str = "string") -> T.StructType:
    """``own``: columns as DDL, in front of which stands the key and behind which the audit block."""
    audit = f"is_deleted boolean not null, created_at timestamp not null, created_by {key} not null, updated_at timestamp, updated_by {key}, deleted_at timestamp, deleted_by {key}"
    return T.StructType.fromDDL(f"id {key} not null, {own.replace('KEY', key)}, {audit}")


def tables(key: str = "string") -> dict[str, T.StructType]:
    """All tables. key: the type of ids, ``string`` or ``bigint``."""
    own = {
        "users": "username string not null, email string not null, hashed_password string not null, role string not null",
        "documents": "user_id KEY not null, title string not null, file_path string not null, status string not null",
        "document_chunks": "document_id KEY not null, chunk_index int not null, page_number int not null, content string not null, embedding array<float>",
        "extracted_entities": "chunk_id KEY not null, name string not null, entity_type string not null, description string not null",
        "extracted_relationships": "source_entity_id KEY not null, target_entity_id KEY not null, relation_type string not null, confidence_score float not null",
        "chat_sessions": "user_id KEY not null, document_id KEY not null, title string not null",
        "chat_messages": "session_id KEY not null, role string not null, content string not null",
        "message_citations": "message_id KEY not null, chunk_id KEY not null, relevance_score float not null",
    }
    return {name: _table(columns, key) for name, columns in own.items()}


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    rule: str


#: Child, column, parent, what a delete of the parent does.
FOREIGN_KEYS = [
    ForeignKey("documents", "user_id", "users", "cascade"),
    ForeignKey("chat_sessions", "document_id", "documents", "cascade"),
    ForeignKey("chat_sessions", "user_id", "users", "cascade"),
    ForeignKey("document_chunks", "document_id", "documents", "cascade"),
    ForeignKey("chat_messages", "session_id", "chat_sessions", "cascade"),
    ForeignKey("extracted_entities", "chunk_id", "document_chunks", "cascade"),
    ForeignKey("message_citations", "message_id", "chat_messages", "cascade"),
    ForeignKey("message_citations", "chunk_id", "document_chunks", "restrict"),
    ForeignKey("extracted_relationships", "source_entity_id", "extracted_entities", "restrict"),
    ForeignKey("extracted_relationships", "target_entity_id", "extracted_entities", "restrict"),
]
