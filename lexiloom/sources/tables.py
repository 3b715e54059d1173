"""Reading and committing the model's tables, and JSON at the edges."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A parquet table with its fixed schema; nothing is inferred where one is given."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def load_jdbc(spark: SparkSession, url: str, table: str, key: str, parts: int, *, lower=None, upper=None, **options) -> DataFrame:
    """A table of a relational store, read in ``parts`` ranges of ``key`` (a number, date or timestamp).

    Ranges lie between ``lower`` and ``upper``, by default the least and the greatest key, which the store is asked for.
    They only deal the rows out: the first and the last range are open, and rows without a key are in the first. Where
    no row has a key there is one range. Filters on the result are sent to the store. The driver jar is the caller's;
    ``options`` are those of Spark's source.
    """
    reader = spark.read.format("jdbc").options(url=url, **options)
    if lower is None or upper is None:
        name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
        least, greatest = reader.option("query", f"SELECT MIN({name}) AS a, MAX({name}) AS b FROM {table}").load().first()
        lower, upper = (given if given is not None else found for given, found in ((lower, least), (upper, greatest)))
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if lower is None:
        return reader.load()
    return reader.options(partitionColumn=key, lowerBound=str(lower), upperBound=str(upper), numPartitions=parts).load()


def pages(spark: SparkSession, path: str, document_id: str, page_number: str, text: str) -> DataFrame:
    """Extracted page texts as ``document_id, page_number, text``, one row a page."""
    return spark.read.parquet(path).select(F.col(document_id).alias("document_id"), F.col(page_number).alias("page_number"), F.col(text).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors see; where unset, a new local folder, if Spark runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage is cut and lost executors don't matter."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, below the application's id, that nobody has used; within scratch() below its folder."""
    folder = _SCRATCH.get() or f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """What written() makes in this block is deleted at its end, so nothing that it returns lazily may rest on it.

    Gives a function like written() whose tables outlive the block.
    """
    outer, folder = _SCRATCH.get(), new_folder(spark, name)

    def lasting(df: DataFrame, name: str) -> DataFrame:
        inner = _SCRATCH.set(outer)
        try:
            return written(df, name)
        finally:
            _SCRATCH.reset(inner)

    token = _SCRATCH.set(folder)
    try:
        yield lasting
    finally:
        _SCRATCH.reset(token)
        path, files = _files(spark, folder)
        files.delete(path, True)


def laid_out(df: DataFrame, name: str, *keys: str, parts: int | None = None, dealt: bool = False) -> DataFrame:
    """``df`` written once as a table bucketed and sorted by ``keys``: joins and groups on these keys move no row of it.

    There is a file for each of ``parts`` buckets (Spark's number of shuffle partitions by default). ``dealt``: the rows
    come from such a table and lie in its buckets already. The table lasts as long as the application's catalog.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df if dealt else df.repartition(parts, *keys)
    own = f"{name}_{uuid.uuid4().hex}"
    rows.write.bucketBy(parts, *keys).sortBy(*keys).option("path", new_folder(spark, name)).saveAsTable(own)
    return spark.table(own)


class Conflict(RuntimeError):
    """Another commit has switched one of the tables since the commit's base was read."""


def commit(spark: SparkSession, root: str, changed: dict[str, DataFrame], base: dict[str, str] | None = None) -> DataFrame:
    """Write every changed table to a new version below ``root``, then switch the manifest to all of them at once.

    Returns ``table, rows`` for each written table, counted while it is written. A reader follows the newest manifest,
    so a commit that dies on the way changes nothing. Manifests are numbered files, and the next number is created only
    if nobody has: of two commits one loses, reads what the other made and tries the number after. Commits of different
    tables are all kept that way. If the other one switched a table that this one changes, counted from ``base`` (the
    manifest its rows come from, by default the newest when commit() begins), Conflict is raised and nothing is
    switched; transact() computes the change anew instead.
    """
    base = manifest(spark, root) if base is None else base
    version, counts, fresh = uuid.uuid4().hex, [], {}
    for name, df in sorted(changed.items()):
        fresh[name] = f"{root}/{name}/{version}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(fresh[name])
        counts.append((name, seen.get["rows"]))
    while True:
        number, now = _newest(spark, root)
        lost = [name for name in fresh if now.get(name) != base.get(name)]
        if lost:
            raise Conflict(f"changed by another commit: {', '.join(lost)}")
        if _create(spark, f"{root}/_manifests", f"{number + 1:012d}.json", json.dumps(now | fresh)):
            return spark.createDataFrame(counts, "table string, rows long")


def transact(spark: SparkSession, root: str, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], attempts: int = 10) -> DataFrame:
    """commit() what ``change`` makes of the current tables; after a Conflict it is applied to the tables as they are then."""
    for left in reversed(range(attempts)):
        base = manifest(spark, root)
        try:
            return commit(spark, root, change({name: spark.read.parquet(path) for name, path in base.items()}), base)
        except Conflict:
            if not left:
                raise


def manifest(spark: SparkSession, root: str) -> dict[str, str]:
    """The path of each table's current version: the newest manifest alone is read, never the tables."""
    return _newest(spark, root)[1]


def _newest(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    path, files = _files(spark, f"{root}/_manifests")
    if not files.exists(path):
        return 0, {}
    names = sorted(f.getPath().getName() for f in files.listStatus(path) if f.getPath().getName().endswith(".json"))
    if not names:
        return 0, {}
    stream = files.open(spark._jvm.org.apache.hadoop.fs.Path(path, names[-1]))
    try:
        return int(names[-1].removesuffix(".json")), json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def _files(spark: SparkSession, folder: str):
    """``folder`` as a path, and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _create(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Make a whole file that isn't there yet; False if it is. Of several that try at once one succeeds."""
    path, files = _files(spark, folder)
    jvm = spark._jvm
    files.mkdirs(path)
    made, wanted = jvm.org.apache.hadoop.fs.Path(path, f".{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(path, name)
    stream = files.create(made, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if files.getScheme() == "file":
            # a local rename would overwrite; a second name for the file can't
            jvm.java.nio.file.Files.createLink(*[jvm.java.io.File(p.toUri().getPath()).toPath() for p in (wanted, made)])
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration()).rename(made, wanted, options)
    except Py4JJavaError as e:
        if not files.exists(wanted):
            raise
        if "AlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        files.delete(made, False)
    return True


def invalid_enum(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose ``column`` is null or isn't one of the enum's names."""
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(allowed))


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def to_json_rows(df: DataFrame, key: str = "id") -> DataFrame:
    """``key, body``: each row as JSON with camel-case keys; nulls are kept."""
    return df.select(key, F.to_json(F.struct(*[F.col(c).alias(camel(c)) for c in df.columns]), {"ignoreNullFields": "false"}).alias("body"))


def embedding_request(text: Column) -> Column:
    """The body that asks for one text's vector."""
    parts = F.array(F.struct(text.alias("text")))
    return F.to_json(F.struct(F.struct(parts.alias("parts")).alias("content")), {"ignoreNullFields": "false"})


def parse_embeddings(df: DataFrame, body: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their vector in ``embedding``, rows whose response has none)."""
    parsed = df.withColumn("embedding", F.from_json(body, "embedding struct<values: array<float>>")["embedding"]["values"])
    return parsed.filter("embedding is not null"), parsed.filter("embedding is null").drop("embedding")
