"""Incremental jobs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, GroupedData, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import clean_text, id_from
from ..jobs.ingest import chunk


def read_files(spark: SparkSession, path: str, schema: T.StructType, per_batch: int = 100) -> DataFrame:
    """A stream of the parquet files that arrive in ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


class Newest(StatefulProcessor):
    """For each key the digest and the version of the text that came last; what is new or changed comes out.

    Keys have a row or two each in a batch, so rows come one by one: a data frame for each would cost far more.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "digest string, version int")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.seen.update((initialState["digest"], initialState["version"]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known, version = self.seen.get() or (None, -1)
        # a batch's texts of one document, of which only the least new one is held
        least = None
        for row in rows:
            if row["digest"] != known and (least is None or row["text"] < least[1]):
                least = row["digest"], row["text"]
        if least:
            self.seen.update((least[0], version + 1))
            yield Row(key=key[0], text=least[1], digest=least[0], version=version + 1)

    def close(self) -> None:
        pass


def ingest(stream: DataFrame, target: str, checkpoint: str, *, key: str = "doc_id", text: str = "text", rejected: str | None = None) -> None:
    """Chunk the documents that have arrived and append the chunks to ``target``, each once, however often it is retried.

    What is known of a document is its digest and version, in the stream's keyed state: a batch looks up its own keys and
    reads nothing of ``target``, so its work doesn't grow with what was ingested before.

    - A text that is known is left out. A changed text is a new version of its document; current() has the newest.
      Of several new texts of one document in a batch the least counts. A null text is empty; an empty one has a single
      row with chunk_index -1 and no content, so that it replaces what was there.
    - A document without a key can't be known again, so it isn't chunked; with ``rejected`` it is written there, once.
    - A batch has a folder of its own, named by the checkpoint's id and the batch's number, that a retry overwrites.
    - With a new checkpoint over a ``target`` that has rows, the state begins with these, read once and narrow, so a
      lost checkpoint neither doubles nor loses anything.

    Chunks have ids that depend on document, version and index alone. ``target`` has the columns of chunk(), ``version``,
    ``digest`` and ``id``.
    """
    spark = stream.sparkSession
    if rejected:
        lost = stream.filter(F.col(key).isNull()).writeStream.format("parquet").option("path", rejected).option("checkpointLocation", f"{checkpoint}-rejected")
        lost.trigger(availableNow=True).start().awaitTermination()
    rows = stream.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
    kind = rows.schema["key"].dataType.simpleString()

    def append(batch: DataFrame, number: int) -> None:
        run = spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]
        # one pass of the state, not one for the chunks and one for the empty texts
        batch = batch.persist(StorageLevel.DISK_ONLY)
        named = F.struct(F.col("key").alias("document_id"), "version", "digest")
        cut = chunk(batch.select(named.alias("doc"), "text"), key="doc").select("document_id.*", "chunk_index", "page_number", "content")
        blank = batch.filter(F.length(clean_text(F.col("text"))) == 0).select(F.col("key").alias("document_id"), "version", "digest", F.lit(-1).alias("chunk_index"), F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("string").alias("content"))
        own = F.when(F.col("version") == 0, id_from(F.col("document_id"), F.col("chunk_index"))).otherwise(id_from(F.col("document_id"), F.col("version"), F.col("chunk_index")))
        cut.unionByName(blank).withColumn("id", own).write.mode("overwrite").parquet(f"{target}/run={run}/batch={number}")
        batch.unpersist()

    begin = None if _exists(spark, f"{checkpoint}/metadata") or not _exists(spark, target) else _known(spark, target, kind)
    with _rocks(spark):
        fresh = rows.groupBy("key").transformWithState(Newest(), f"key {kind}, text string, digest string, version int", "append", "none", begin)
        fresh.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _known(spark: SparkSession, target: str, kind: str) -> GroupedData:
    """``key, digest, version`` of every document in ``target``: one row of each version is read."""
    first = spark.read.option("basePath", target).parquet(target).filter("chunk_index <= 0")
    newest = first.groupBy(F.col("document_id").cast(kind).alias("key")).agg(F.max(F.struct("version", "digest")).alias("m"))
    return newest.select("key", "m.digest", "m.version").groupBy("key")


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """Keyed state of this kind needs the store that keeps it on disk."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def current(chunks: DataFrame) -> DataFrame:
    """The chunks of each document's newest version in a target of ingest()."""
    newest = chunks.filter("version > 0").groupBy("document_id").agg(F.max("version").alias("newest"))
    held = chunks.join(newest, "document_id", "left")
    return held.filter("chunk_index >= 0 and version = coalesce(newest, 0)").drop("newest", "version", "digest", "run", "batch")


def first_inserts(stream: DataFrame, key: str, time: str, wait: str) -> DataFrame:
    """Rows of a stream whose key hasn't come within ``wait``: inserts stay unique under retries, with bounded state."""
    return stream.withWatermark(time, wait).dropDuplicatesWithinWatermark([key])


def activity_sessions(events: DataFrame, *, user: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``user_id, first_at, last_at, events``: runs of activity with no pause over ``gap``; the same for batch and stream.

    In a stream rows later than ``late`` are dropped, and a session comes out once the watermark has passed it.
    """
    seen = events.select(F.col(user).alias("user_id"), F.col(time).cast("timestamp").alias("at"))
    seen = seen.withWatermark("at", late) if events.isStreaming else seen
    out = seen.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("events"))
    return out.select("user_id", "first_at", "last_at", "events")


def open_sessions(spark: SparkSession, checkpoint: str, *, user: str = "user_id") -> DataFrame:
    """The sessions that a stopped stream of activity_sessions() still holds, in the same columns, read from its state.

    With what the stream has written they are all sessions of all events so far (but for those that came too late).
    Reading changes nothing: if the stream goes on, they come out once they are over, with what was added to them.
    """
    held = spark.read.format("statestore").option("path", checkpoint).load().select("value.*")
    return held.select(F.col(user).alias("user_id"), F.col("min").alias("first_at"), F.col("max").alias("last_at"), F.col("count").alias("events"))
