"""Quirks and edge cases on a few rows."""

import math

import pytest
from pyspark.sql import functions as F

from lexiloom import schema
from lexiloom.functions import scalars, vectors
from lexiloom.jobs import chat, graph, ingest
from lexiloom.operators import integrity, mutate, read
from lexiloom.sources import tables as io
from lexiloom.streaming import streams


@pytest.fixture(autouse=True)
def clock(spark):
    """Columns exist once there is a session."""
    global NOW, ACTOR
    NOW, ACTOR = F.lit("2024-06-01 00:00:00").cast("timestamp"), F.lit(9).cast("long")


def audited(spark, ids):
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, title string")
    return mutate.stamped(rows, F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit(1).cast("long"))


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_schemas_have_the_audit_block():
    for name, table in schema.tables().items():
        assert table.fieldNames()[0] == "id" and table.fieldNames()[-7:] == schema.AUDIT, name
    assert {fk.child for fk in schema.FOREIGN_KEYS} <= set(schema.tables())


def test_insert_stamps_both_times_but_no_updater(spark):
    row = mutate.add(audited(spark, []), spark.createDataFrame([(1, "a")], "id long, title string"), NOW, ACTOR).first()
    assert row.created_at == row.updated_at and row.created_by == 9 and row.updated_by is None and not row.is_deleted


def test_retried_insert_changes_nothing(spark):
    new = spark.createDataFrame([(2, "b"), (3, "c"), (3, "c")], "id long, title string")
    once = mutate.add_new(audited(spark, [1, 2]), new, NOW, ACTOR)
    assert values(mutate.add_new(once, new, NOW, ACTOR), "id", "title") == values(once, "id", "title") == [(1, "t1"), (2, "t2"), (3, "c")]
    assert values(mutate.collisions(audited(spark, [1, 2]), new), "id") == [(2,), (3,)]


def test_soft_deletes(spark):
    table = audited(spark, [1, 2, 3])
    ids = spark.createDataFrame([(1,), (1,), (77,)], "id long")
    one = mutate.soft_delete(table, ids, NOW, ACTOR, single=True).filter("id = 1").first()
    many = mutate.soft_delete(table, ids, NOW, ACTOR).filter("id = 1").first()
    assert one.updated_at == one.deleted_at and many.updated_at < many.deleted_at
    assert one.updated_by is None and many.deleted_by == 9
    again = mutate.soft_delete(mutate.soft_delete(table, ids, NOW, ACTOR), ids, F.lit("2025-01-01").cast("timestamp"), ACTOR)
    assert again.count() == 3 and again.filter("id = 1").first().deleted_at.year == 2025
    assert mutate.soft_delete(table, ids.limit(0), NOW, ACTOR).filter("is_deleted").count() == 0


def test_hard_delete_keeps_rows_of_a_null_condition(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id long, v string")
    assert values(mutate.hard_delete(df, F.col("v") == "a"), "id") == [(2,), (3,)]
    assert mutate.matched_count(df, F.col("v") == "a").first() == (1, True)
    assert mutate.matched_count(df, F.col("v") == "z").first() == (0, False)


def test_update_reports_unknown_keys(spark):
    table, lost = mutate.update(audited(spark, [1, 2]), audited(spark, [2, 5]).withColumn("title", F.lit("x")), NOW, ACTOR)
    assert values(table, "id", "title", "updated_by") == [(1, "t1", None), (2, "x", 9)] and values(lost, "id") == [(5,)]


def test_insert_then_delete_is_identity(spark):
    base = audited(spark, [1, 2])
    new = spark.createDataFrame([(3, "c")], "id long, title string")
    assert mutate.hard_delete_rows(mutate.add(base, new, NOW, ACTOR), new).exceptAll(base).isEmpty()
    assert read.live(base).count() + read.deleted(base).count() == base.count()


def test_pages(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "id long")
    last = read.page(df, 3, 3, "id").collect()
    assert [(r.id, r.total_pages, r.total_count, r.has_previous, r.has_next) for r in last] == [(6, 3, 7, True, False)]
    assert read.page(df, 4, 3, "id").isEmpty() and read.page(df.limit(0), 1, 3, "id").isEmpty()
    whole = [r.id for n in (1, 2, 3) for r in read.page(df, n, 3, "id").collect()]
    assert whole == list(range(7))
    with pytest.raises(ValueError):
        read.page(df, 1, 0, "id")
    assert values(read.page_after(df, "id", 4, 3), "id") == [(5,), (6,)]


def test_includes_never_multiply(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id long")
    a = spark.createDataFrame([(10, 1), (11, 1)], "id long, fk long")
    b = spark.createDataFrame([(20, 1), (21, 1), (22, 1)], "id long, fk long")
    out = {r.id: r for r in read.include_many(parents, [(a, "fk", "a", ["id"]), (b, "fk", "b", ["id"])]).collect()}
    assert [x.id for x in out[1].a] == [10, 11] and len(out[1].b) == 3 and out[2].a == [] == out[2].b


def store(spark):
    return {
        "users": spark.createDataFrame([(1,), (2,)], "id long"),
        "documents": spark.createDataFrame([(10, 1), (11, 2)], "id long, user_id long"),
        "document_chunks": spark.createDataFrame([(100, 10), (110, 11)], "id long, document_id long"),
        "extracted_entities": spark.createDataFrame([(1000, 100), (1100, 110)], "id long, chunk_id long"),
        "extracted_relationships": spark.createDataFrame([(5, 1000, 1100)], "id long, source_entity_id long, target_entity_id long"),
        "chat_sessions": spark.createDataFrame([(50, 1, 10), (51, 2, 10)], "id long, user_id long, document_id long"),
        "chat_messages": spark.createDataFrame([(60, 50), (61, 51)], "id long, session_id long"),
        "message_citations": spark.createDataFrame([(70, 60, 100), (71, 61, 110)], "id long, message_id long, chunk_id long"),
    }


def test_cascade_counts_a_row_on_two_paths_once(spark):
    out = values(mutate.cascade(store(spark), {"users": spark.createDataFrame([(1,)], "id long")}), "table", "id")
    assert out == sorted([("users", 1), ("documents", 10), ("document_chunks", 100), ("extracted_entities", 1000), ("chat_sessions", 50), ("chat_sessions", 51), ("chat_messages", 60), ("chat_messages", 61), ("message_citations", 70), ("message_citations", 71)])


def test_doomed_citations_dont_block_but_edges_do(spark):
    out = values(mutate.restricted(store(spark), {"documents": spark.createDataFrame([(10,)], "id long")}), "table", "id", "column")
    assert out == [("extracted_relationships", 5, "source_entity_id")]
    out = values(mutate.restricted(store(spark), {"document_chunks": spark.createDataFrame([(110,)], "id long")}), "table", "id", "column")
    assert out == [("extracted_relationships", 5, "target_entity_id"), ("message_citations", 71, "chunk_id")]


def test_vector_faults_and_ties(spark):
    rows = [(1, None), (2, [1.0]), (3, [math.nan, 1.0]), (4, [0.0, 0.0]), (5, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    assert values(integrity.bad_vectors(df, 2), "id", "fault") == [(1, "missing"), (2, "dimension"), (3, "nan"), (4, "zero")]
    tied = spark.createDataFrame([(i, [1.0, 0.0]) for i in (9, 3, 7)] + [(1, [0.0, 1.0]), (2, None), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(0, [2.0, 0.0])], "query_id long, embedding array<float>")
    assert [r.vec_id for r in vectors.nearest(queries, tied, 2).orderBy("rank").collect()] == [3, 7]
    assert vectors.nearest(queries.limit(0), tied, 2).isEmpty() and vectors.nearest(queries, tied.limit(0), 2).isEmpty()


def test_nearest_in_blocks_is_nearest(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<float>")
    queries = df.filter("vec_id < 9").withColumnRenamed("vec_id", "query_id")
    assert values(vectors.nearest(queries, df, 4), "query_id", "vec_id", "rank") == values(vectors.nearest(queries, df, 4, block=2), "query_id", "vec_id", "rank")


def test_responses(spark):
    bodies = ['{"embedding": {"values": [1.0, 2.0]}}', "{}", '{"embedding": {}}', "no json", None]
    ok, bad = io.parse_embeddings(spark.createDataFrame(list(enumerate(bodies)), "id int, body string"), "body")
    assert values(ok, "id") == [(0,)] and values(bad, "id") == [(1,), (2,), (3,), (4,)]
    df = spark.createDataFrame([('a"b',)], "t string")
    assert df.select(io.embedding_request(F.col("t"))).first()[0] == '{"content":{"parts":[{"text":"a\\"b"}]}}'


def test_ids(spark):
    rows = [("ABCDEF01-2345-6789-ABCD-EF0123456789",), ("",), ("x",), (None,)]
    out = [r[0] for r in spark.createDataFrame(rows, "s string").select(scalars.parse_id(F.col("s"))).collect()]
    assert out == ["abcdef01-2345-6789-abcd-ef0123456789", *[schema.ZERO_ID] * 3]
    made = spark.range(1).select(scalars.id_from(F.lit(1), F.lit("a"))).first()[0]
    assert len(made) == 36 and made == spark.range(1).select(scalars.parse_id(scalars.id_from(F.lit(1), F.lit("a")))).first()[0]


def test_chunks_without_overlap_are_the_text(spark):
    texts = [(1, "Ünïcode  text\n" * 300), (2, ""), (3, None), (4, "short"), (5, " \n ")]
    df = spark.createDataFrame(texts, "id long, text string")
    out = ingest.chunk(df, size=100, overlap=0).orderBy("chunk_index").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("c"))
    assert {r.document_id: "".join(x.content for x in r.c) for r in out.collect()} == {1: ("Ünïcode text " * 300).strip(), 4: "short"}


def test_embedding_is_in_order_once_a_text_and_all_or_nothing(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bb", "a", None, "ccc"])], "id int, content string")
    out = {r.id: r.embedding for r in ingest.embed(df, lambda ts: [[float(len(t))] for t in ts], batch=2).collect()}
    assert out == {0: [1.0], 1: [2.0], 2: [1.0], 3: None, 4: [3.0]}
    with pytest.raises(Exception, match="vectors"):
        ingest.embed(df, lambda ts: [[1.0]] * (len(ts) - 1)).collect()


def test_dense_is_sparse(spark):
    counts = spark.createDataFrame([(1, 0, 3), (1, 2, 4)], "k int, bucket long, n long")
    assert [round(x, 6) for x in ingest.dense(counts, "k", 4).first().embedding] == [0.6, 0.0, 0.8, 0.0]


def test_chunk_order_faults(spark):
    rows = [(1, 1, 1, 1), (2, 1, 1, 1), (3, 1, 4, 3), (4, 1, 5, 2), (5, 2, 0, 1)]
    df = spark.createDataFrame(rows, "id long, document_id long, chunk_index int, page_number int")
    assert values(integrity.chunk_order(df), "chunk_index", "fault") == [(1, "duplicate"), (1, "start"), (4, "gap"), (5, "page")]


def edges(spark, rows):
    return spark.createDataFrame(rows, "id long, source_entity_id long, target_entity_id long, relation_type string, confidence_score double")


def test_hops_on_a_cycle_end(spark):
    cycle = edges(spark, [(1, 1, 2, "r", 0.5), (2, 2, 3, "r", 0.5), (3, 3, 1, "r", 0.5), (4, 4, 4, "r", 0.5)])
    start = spark.createDataFrame([(1,), (4,)], "node long")
    assert values(graph.k_hop(cycle, start, 9, direction="out"), "start", "node", "hop") == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (4, 4, 0)]


def test_graph_faults(spark):
    entities = spark.createDataFrame([(1, "a", "T", False), (2, " ", "T", False), (3, "c", "T", True)], "id long, name string, entity_type string, is_deleted boolean")
    bad = edges(spark, [(1, 1, 2, "r", math.nan), (2, 1, 2, "r", 1.1), (3, 1, 1, "r", -0.1), (4, 1, 9, "r", 0.5), (5, 1, 3, "r", None)])
    wanted = {("blank", 2), ("parallel", 2), ("loop", 3), ("dangling", 4), ("deleted", 5), *(("confidence", i) for i in (1, 2, 3, 5))}
    assert set(values(integrity.graph_faults(entities, bad), "check", "id")) == wanted
    assert graph.degrees(bad).agg(F.sum("degree")).first()[0] == 2 * bad.count()


def test_history_ties_and_few_turns(spark):
    t = "2024-01-01 00:00:00"
    df = spark.createDataFrame([(2, 1, t), (1, 1, t), (3, 2, t)], "id long, session_id long, created_at string")
    assert values(chat.history(df, 5), "id", "turn") == [(1, 1), (2, 2), (3, 1)] and values(chat.history(df, 1), "id") == [(2,), (3,)]


def test_enums(spark):
    df = spark.createDataFrame([("User",), ("user",), (None,)], "role string")
    assert values(io.invalid_enum(df, "role", schema.CHAT_ROLE).filter("role is not null"), "role") == [("user",)]
    assert io.invalid_enum(df, "role", schema.CHAT_ROLE).count() == 2


def test_commit_switches_all_tables_at_once(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert io.manifest(spark, root) == {}
    io.commit(spark, root, {"a": spark.range(3), "b": spark.range(1)})
    first = io.manifest(spark, root)
    assert values(io.commit(spark, root, {"a": spark.range(5)}), "table", "rows") == [("a", 5)]
    now = io.manifest(spark, root)
    assert spark.read.parquet(now["a"]).count() == 5 and now["b"] == first["b"] and spark.read.parquet(first["a"]).count() == 3


def test_ingest_again_adds_only_what_is_new(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    rows = "doc_id long, text string"
    spark.createDataFrame([(1, "one"), (2, "two")], rows).coalesce(1).write.parquet(src)
    run = lambda: streams.ingest(streams.read_files(spark, src, spark.createDataFrame([], rows).schema), out, mark)
    run()
    spark.createDataFrame([(2, "two"), (3, "three")], rows).coalesce(1).write.mode("append").parquet(src)
    run()
    assert values(spark.read.parquet(out), "document_id") == [(1,), (2,), (3,)]
    streams.ingest(streams.read_files(spark, src, spark.createDataFrame([], rows).schema), out, f"{mark}-lost")
    assert values(spark.read.parquet(out), "document_id") == [(1,), (2,), (3,)]


def test_a_lost_checkpoint_loses_no_documents(spark, tmp_path):
    """The files come in another order the second time."""
    import os

    src, out, seen = str(tmp_path / "src"), str(tmp_path / "out"), set()
    for i, seconds in ((1, 100), (2, 200)):
        spark.createDataFrame([(i, f"text of {i}")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
        for f in set((tmp_path / "src").glob("*.parquet")) - seen:
            seen.add(f)
            os.utime(f, (seconds, seconds))
    schema = spark.read.parquet(src).schema
    run = lambda mark: streams.ingest(streams.read_files(spark, src, schema, per_batch=1), out, str(tmp_path / mark))
    run("first")
    assert values(spark.read.parquet(out), "document_id") == [(1,), (2,)]
    for f in (tmp_path / "src").glob("*.parquet"):
        os.utime(f, (300 - os.stat(f).st_mtime,) * 2)
    run("second")
    assert values(spark.read.parquet(out), "document_id") == [(1,), (2,)]


def test_update_with_a_key_twice_keeps_the_key(spark):
    table = spark.createDataFrame([(1, "a", None, None), (2, "x", None, None)], "id long, name string, updated_at timestamp, updated_by long")
    rows = spark.createDataFrame([(1, "b", None, None), (1, "c", None, None), (9, "d", None, None)], table.schema)
    new, unmatched = mutate.update(table, rows, F.lit("2024-01-01").cast("timestamp"), F.lit(7).cast("long"))
    assert values(new, "id", "name") == [(1, "c"), (2, "x")] and values(unmatched, "id") == [(9,)]


def test_shared_folder_on_a_cluster_must_be_given():
    from types import SimpleNamespace

    from lexiloom.sources.tables import shared_dir

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(session)
