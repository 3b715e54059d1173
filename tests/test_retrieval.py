"""Questions to context and facts; hooks for extraction and missing vectors."""

import pytest
from pyspark.errors import PythonException

from lexiloom.jobs import chat, graph, ingest


def chunks(spark, rows):
    return spark.createDataFrame(rows, "id long, document_id long, chunk_index int, page_number int, content string, embedding array<float>")


def test_context_of_hits_comes_once_under_the_best_rank(spark):
    table = chunks(spark, [(i, 1, i, 1, f"t{i}", [1.0, 0.1 * i]) for i in range(5)] + [(9, 2, 0, 1, "far", [0.0, 1.0])])
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, None), (9, [0.0, 0.0])], "question_id long, embedding array<float>")
    got = {(r.question_id, r.chunk_id, r["rank"]) for r in chat.retrieve(asked, table, 2, 1).collect()}
    assert got == {(7, 0, 1), (7, 1, 1), (7, 2, 2)}
    assert chat.retrieve(asked, table.limit(0), 2, 1).count() == 0


def test_facts_are_edges_within_one_chunk(spark):
    context = spark.createDataFrame([(7, 1), (7, 2)], "question_id long, chunk_id long")
    found = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "a"), (2, "b"), (3, "d")], "chunk_id long, name string")
    edges = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.2), ("c", "d", 1.0)], "source string, target string, confidence double")
    got = sorted((r.source, r.target) for r in chat.facts(context, found, edges).collect())
    assert got == [("a", "b"), ("b", "c")]


def test_an_extractor_gives_each_name_and_type_once(spark):
    table = chunks(spark, [(1, 1, 0, 1, "x x y", None), (2, 1, 1, 1, None, None)])

    def letters(texts):
        return [[(w, "LETTER", w) for w in t.split()] for t in texts]

    got = sorted((r.chunk_id, r.name, r.entity_type) for r in graph.extract(table, letters).collect())
    assert got == [(1, "x", "LETTER"), (1, "y", "LETTER")]
    with pytest.raises(PythonException, match="lists of entities"):
        graph.extract(table, lambda texts: []).collect()


def test_relation_types_without_pairs_are_left_out(spark):
    found = spark.createDataFrame([(1, 1, "a", "T"), (1, 1, "b", "T"), (1, 1, "5", "N"), (1, 2, "c", "T"), (2, 3, "d", "T")], "document_id long, chunk_id long, name string, entity_type string")
    got = [tuple(r) for r in graph.relation_types(found, 5).orderBy("document_id", "rank").collect()]
    assert got == [(1, "N_T", 2, 1), (1, "T_T", 1, 2)]


def test_only_missing_vectors_are_embedded(spark):
    table = chunks(spark, [(1, 1, 0, 1, "held", [0.5]), (2, 1, 1, 1, "new", None), (3, 1, 2, 1, None, None)])
    got = {r.id: r.embedding for r in ingest.embed_missing(table, lambda texts: [[1.0] for t in texts if t != "held"]).collect()}
    assert got == {1: [0.5], 2: [1.0], 3: None}
