"""Ingestion by keyed state: retries, changes, null keys and lost checkpoints; sessions at the end of a stream."""

import shutil

import pytest
from pyspark.sql import functions as F

from lexiloom.streaming import streams

ROW = "doc_id long, text string"


class Arrivals:
    def __init__(self, spark, folder):
        self.spark, self.src, self.out, self.bad, self.mark = spark, *(str(folder / n) for n in ("src", "out", "bad", "mark"))
        self.schema = spark.createDataFrame([], ROW).schema

    def come(self, *rows, mark=None):
        self.spark.createDataFrame(list(rows), ROW).coalesce(1).write.mode("append").parquet(self.src)
        self.run(mark)

    def run(self, mark=None):
        streams.ingest(streams.read_files(self.spark, self.src, self.schema), self.out, mark or self.mark, rejected=self.bad)

    def held(self):
        return sorted((r.document_id, r.content) for r in streams.current(self.spark.read.parquet(self.out)).collect())


@pytest.fixture
def arrivals(spark, tmp_path):
    return Arrivals(spark, tmp_path)


def test_known_texts_are_left_out_and_changed_ones_are_versions(arrivals):
    arrivals.come((1, "one"), (2, "two"), (2, "two"))
    arrivals.come((1, "one"), (2, "zwei"), (2, "two"), (3, "three"))
    assert arrivals.held() == [(1, "one"), (2, "zwei"), (3, "three")]
    arrivals.come((2, "b"), (2, "a"), (1, None), (4, ""))
    assert arrivals.held() == [(2, "a"), (3, "three")]
    rows = sorted((r.document_id, r.version, r.chunk_index) for r in arrivals.spark.read.parquet(arrivals.out).collect())
    assert rows == [(1, 0, 0), (1, 1, -1), (2, 0, 0), (2, 1, 0), (2, 2, 0), (3, 0, 0), (4, 0, -1)]
    assert arrivals.spark.read.parquet(arrivals.out).select("id").distinct().count() == 7


def test_documents_without_a_key_are_set_aside_once(arrivals):
    arrivals.come((None, "x"), (1, "one"))
    arrivals.come((None, "y"))
    assert arrivals.held() == [(1, "one")]
    assert sorted(r.text for r in arrivals.spark.read.parquet(arrivals.bad).collect()) == ["x", "y"]


def test_a_lost_checkpoint_begins_with_what_the_target_has(arrivals, tmp_path):
    arrivals.come((1, "one"), (2, "two"), (3, ""))
    arrivals.come((2, "zwei"))
    shutil.rmtree(arrivals.mark)
    arrivals.come((4, "four"))
    # the old text of 2 comes again, and before it the new one is known
    assert {i for i, _ in arrivals.held()} == {1, 2, 4}
    assert arrivals.spark.read.parquet(arrivals.out).filter("document_id in (1, 3, 4)").count() == 3


def test_a_batch_reads_nothing_of_the_target(arrivals, spark):
    arrivals.come(*[(i, f"text {i}") for i in range(20)])
    # what was written before could be gone: the state alone knows it
    shutil.move(arrivals.out, arrivals.out + "-moved")
    arrivals.come((3, "text 3"), (30, "new"))
    assert [r.document_id for r in spark.read.parquet(arrivals.out).collect()] == [30]


def test_open_sessions_are_read_at_the_end(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:20:00"), (2, "2024-01-01 00:05:00"), (1, "2024-01-01 05:00:00"), (2, "2024-01-01 05:10:00")]
    events = spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    values = lambda df: sorted((r.user_id, str(r.first_at), str(r.last_at), r.events) for r in df.collect())

    def run():
        stream = streams.activity_sessions(streams.read_files(spark, src, events.schema))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out).unionByName(streams.open_sessions(spark, mark))

    events.coalesce(1).write.parquet(src)
    assert values(run()) == values(streams.activity_sessions(events)) and len(values(run())) == 4
    more = spark.createDataFrame([(1, "2024-01-01 05:25:00"), (3, "2024-01-01 09:00:00")], "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    more.coalesce(1).write.mode("append").parquet(src)
    assert values(run()) == values(streams.activity_sessions(events.unionByName(more)))
