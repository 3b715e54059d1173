"""Exact search by cells: ids of any type, queries that share an id, and what the cells save."""

import numpy as np
import pytest

from lexiloom.functions import vectors
from lexiloom.jobs import chat


def brute(queries, rows, k):
    out = []
    for number, (q, a) in enumerate(queries):
        of = [(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)), i) for i, b in rows if len(b) == len(a)]
        best = sorted(of, key=lambda x: (-x[0], x[1]))[:k]
        out += [(number, q, i, round(s, 6), rank) for rank, (s, i) in enumerate(best, 1)]
    return sorted((str(q), str(i), s, rank) for _, q, i, s, rank in out)


def found(df):
    return sorted((str(r.query_id), str(r.vec_id), round(r.score, 6), r["rank"]) for r in df.collect())


def clustered(n, groups=8, dim=6, seed=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (groups, dim))
    return [(middle[i % groups] + rng.normal(0, 0.02, dim)).astype(np.float32).tolist() for i in range(n)]


@pytest.mark.parametrize("block", [None, 7])
@pytest.mark.parametrize("kind", ["string", "long"])
def test_equals_brute_force_and_skips_cells(spark, block, kind):
    rows = [(f"id-{i}" if kind == "string" else i, v) for i, v in enumerate(clustered(1500))]
    table = spark.createDataFrame(rows, f"vec_id {kind}, embedding array<float>").repartition(4)
    queries, read = rows[::60], []
    asked = spark.createDataFrame(queries, f"query_id {kind}, embedding array<float>")
    got = vectors.nearest(asked, table, 4, block=block, read=read)
    assert found(got) == brute(queries, rows, 4)
    compared, pairs = map(sum, zip(*read))
    assert compared < 0.4 * pairs


def test_every_row_is_a_query_of_its_own(spark):
    table = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), (None, [1.0, 1.0]), ("b", [0.1, 1.0])], "vec_id string, embedding array<float>")
    queries = [("q", [1.0, 0.1]), ("q", [0.0, 2.0]), (None, [1.0, 0.0])]
    got = found(vectors.nearest(spark.createDataFrame(queries, "query_id string, embedding array<float>"), table, 1))
    assert [(q, v, rank) for q, v, _, rank in got] == [("None", "a", 1), ("q", "a", 1), ("q", "b", 1)]


def test_a_condition_comes_with_the_search(spark):
    rows = [(i, v, i % 3) for i, v in enumerate(clustered(400))]
    index = vectors.cell_index(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), keep=("label",))
    asked = spark.createDataFrame([(i, v) for i, v, _ in rows[:5]], "query_id long, embedding array<float>")
    for label in (0, 2):
        got = vectors.search(asked, index, 3, where=f"label = {label}")
        assert found(got) == brute([(i, v) for i, v, _ in rows[:5]], [(i, v) for i, v, other in rows if other == label], 3)
    assert vectors.search(asked, index, 3, where="label = 9").isEmpty()


def test_questions_and_chunks_with_text_ids(spark):
    chunks = [(f"c{i}", "d", i, 1, "t", [1.0, float(i)]) for i in range(4)]
    table = spark.createDataFrame(chunks, "id string, document_id string, chunk_index int, page_number int, content string, embedding array<float>")
    asked = spark.createDataFrame([("x", [1.0, 0.0])], "question_id string, embedding array<float>")
    assert sorted((r.chunk_id, r["rank"]) for r in chat.retrieve(asked, table, 1).collect()) == [("c0", 1), ("c1", 1)]
