"""Citations by matrix products against counting tokens by hand."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiloom.jobs import chat, ingest


def bucket(t, dim=1536):
    return int(hashlib.md5(t.encode()).hexdigest()[:7], 16) % dim


def brute(messages, sessions, chunks, k):
    out = []
    for mid, sid, role, text in messages:
        if role != "Assistant" or sid not in sessions:
            continue
        a, scored = Counter(map(bucket, text.lower().split())), []
        for cid, doc, content in chunks:
            b = Counter(map(bucket, content.lower().split()))
            dot = sum(n * b[t] for t, n in a.items())
            if doc == sessions[sid] and dot:
                scored.append((-round(dot / (math.sqrt(sum(n * n for n in a.values())) * math.sqrt(sum(n * n for n in b.values()))), 6), cid))
        out += [(mid, cid, -s, rank) for rank, (s, cid) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [256, 3])
def test_citations(spark, block):
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    text = lambda i, n: " ".join(words[(i * 7 + j * j) % 6] for j in range(n))
    sessions = {1: 10, 2: 10, 3: 11, 4: 99}
    messages = [(i, 1 + i % 5, "User" if i % 6 == 0 else "Assistant", text(i, i % 9)) for i in range(60)]
    # many equal chunks tie: the least ids count
    chunks = [(i, 10 if i % 3 else 11, text(i % 4, 5 + i % 2)) for i in range(40)] + [(100, 10, ""), (101, 10, "other words")]
    m = spark.createDataFrame(messages, "id long, session_id long, role string, content string").withColumn("buckets", ingest.hashed_buckets(F.col("content")))
    c = spark.createDataFrame(chunks, "id long, document_id long, content string").withColumn("buckets", ingest.hashed_buckets(F.col("content")))
    s = spark.createDataFrame(list(sessions.items()), "id long, document_id long")
    got = chat.cite(m, s, c, 3, block=block)
    assert sorted((r.message_id, r.chunk_id, r.relevance_score, r["rank"]) for r in got.collect()) == brute(messages, sessions, chunks, 3)
    assert chat.cite(m.limit(0), s, c).isEmpty() and chat.cite(m, s, c.limit(0)).isEmpty()


def test_the_chunks_of_a_document_are_taken_in_parts(spark, monkeypatch):
    m = spark.createDataFrame([(1, 1, "Assistant", [3, 3, 5])], "id long, session_id long, role string, buckets array<int>")
    c = spark.createDataFrame([(i, 7, i, [3, 5] if i == 700 else [3, 9]) for i in range(1200)], "id long, document_id long, chunk_index int, buckets array<int>")
    got = chat.cite(m, spark.createDataFrame([(1, 7)], "id long, document_id long"), c, 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.chunk_index, r.document_id) for r in got] == [(700, 700, 7), (0, 0, 7)]
