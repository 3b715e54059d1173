"""Filtered reads, includes and pages: the generic data-access operators."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import total_pages
from ..sources.tables import new_folder


def where(df: DataFrame, condition: Column | str | None = None) -> DataFrame:
    """Rows that meet the condition; all rows without one. Deleted rows are rows too."""
    return df if condition is None else df.filter(condition)


def by_id(df: DataFrame, value, key: str = "id") -> DataFrame:
    return df.filter(F.col(key) == value).limit(1)


def first_match(df: DataFrame, condition: Column | str, key: str = "id") -> DataFrame:
    """One row or none: the match with the least key."""
    return df.filter(condition).orderBy(key).limit(1)


def compose(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Steps on a query that hasn't run."""
    for step in steps:
        df = df.transform(step)
    return df


def live(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_deleted"))


def deleted(df: DataFrame) -> DataFrame:
    return df.filter("is_deleted")


def of_user(df: DataFrame, user, column: str = "user_id") -> DataFrame:
    return df.filter(F.col(column) == user)


def with_status(df: DataFrame, *statuses: str, column: str = "status") -> DataFrame:
    return df.filter(F.col(column).isin(*statuses))


def scored_at_least(df: DataFrame, least: float, column: str) -> DataFrame:
    return df.filter(F.col(column) >= least)


def include_parent(df: DataFrame, fk: str, parent: DataFrame, prefix: str, key: str = "id") -> DataFrame:
    """The parent's columns beside each row, under ``prefix``. Foreign keys aren't null, so the join is inner."""
    named = parent.select(*[F.col(c).alias(f"{prefix}_{c}") for c in parent.columns])
    return df.join(named, df[fk] == named[f"{prefix}_{key}"])


def include_children(df: DataFrame, child: DataFrame, fk: str, name: str, fields: list[str], key: str = "id") -> DataFrame:
    """The children of each row as a sorted list of structs in ``name``; an empty list where there is none.

    For collections with a bound; join the flat child table where a parent may have very many.
    """
    lists = child.groupBy(F.col(fk).alias("__fk")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    empty = F.array().cast(lists.schema[name].dataType)
    return df.join(lists, df[key] == lists["__fk"], "left").drop("__fk").withColumn(name, F.coalesce(name, empty))


def include_many(df: DataFrame, includes: list[tuple[DataFrame, str, str, list[str]]], key: str = "id") -> DataFrame:
    """Several collections (child, fk, name, fields); each is gathered by itself, so they never multiply."""
    for child, fk, name, fields in includes:
        df = include_children(df, child, fk, name, fields, key)
    return df


def by_ids(df: DataFrame, ids: DataFrame, key: str = "id", id_column: str = "id") -> DataFrame:
    """Rows whose key is among ``ids``, however many these are; repeats and unknown ids don't matter."""
    return df.join(ids.select(F.col(id_column).alias(key)), key, "left_semi")


def page(df: DataFrame, number: int, size: int, *order: str) -> DataFrame:
    """Page ``number`` (from 1) in the given order, with the page's place on each row.

    Adds current_page, total_pages, total_count, has_previous, has_next. A page past the end has no rows.
    """
    if number < 1 or size < 1:
        raise ValueError("pages count from 1 and hold one row at least")
    total = df.agg(F.count("*").alias("total_count")).withColumn("total_pages", total_pages(F.col("total_count"), size))
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    # one row of totals
    out = rows.crossJoin(F.broadcast(total)).withColumn("current_page", F.lit(number).cast("long"))
    return out.withColumns({"has_previous": F.lit(number > 1), "has_next": F.lit(number) < F.col("total_pages")})


def counted(df: DataFrame, size: int) -> DataFrame:
    """One row ``total, pages``: how many rows there are and how many pages of ``size`` they fill."""
    return df.agg(F.count("*").alias("total")).withColumn("pages", total_pages(F.col("total"), size))


def status_counts(df: DataFrame, *by: str, status: str = "status") -> DataFrame:
    """``by, status, n``: rows of each status for each owner; null is a value like any other."""
    return df.groupBy(*by, status).agg(F.count("*").alias("n"))


def activity(df: DataFrame, unit: str = "day") -> DataFrame:
    """What each actor created in each ``unit`` of time, and how much of it has been deleted since."""
    groups = df.groupBy(F.date_trunc(unit, "created_at").alias(unit), F.col("created_by").alias("actor"))
    return groups.agg(F.count("*").alias("created"), F.count_if("is_deleted").alias("deleted"))


def page_after(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The ``size`` rows that follow key ``after``; nothing before them is sorted."""
    return (df if after is None else df.filter(F.col(key) > after)).orderBy(key).limit(size)


@dataclass(frozen=True)
class By:
    """A column to order by. Nulls come first in ascending and last in descending order, unless ``nulls_last`` says otherwise."""

    column: str
    descending: bool = False
    nulls_last: bool | None = None

    @property
    def last(self) -> bool:
        return self.descending if self.nulls_last is None else self.nulls_last

    def reversed(self) -> By:
        return By(self.column, not self.descending, not self.last)

    def sort(self) -> Column:
        way = ("desc" if self.descending else "asc") + ("_nulls_last" if self.last else "_nulls_first")
        return getattr(F.col(self.column), way)()

    def after(self, value, *, same: bool = False) -> Column:
        """Rows whose column comes after ``value``, or with it if ``same``."""
        c = F.col(self.column)
        if value is None:
            follows = F.lit(False) if self.last else c.isNotNull()
            return follows | c.isNull() if same else follows
        follows = (c <= value if same else c < value) if self.descending else (c >= value if same else c > value)
        return follows | c.isNull() if self.last else follows


def _order(order: tuple[By | str, ...]) -> list[By]:
    return [By(o) if isinstance(o, str) else o for o in order]


def keyset(df: DataFrame, order: list[By | str], size: int, *, after: dict | None = None, before: dict | None = None) -> DataFrame:
    """The ``size`` rows that follow ``after``, or those that come just ahead of ``before``, in the given order.

    ``after`` and ``before``: the order's columns of the last row of the page before, or of the first row of the page
    behind. The order should end with a unique column; then pages neither repeat nor lose rows, whatever ties and nulls
    there are. Each task keeps ``size`` rows and nothing else is sorted; the first column's bound reaches the scan.
    """
    ways, edge = _order(tuple(order)), after
    if before is not None:
        ways, edge = [w.reversed() for w in ways], before
    if edge is not None:
        steps = [reduce(Column.__and__, [*[F.col(w.column).eqNullSafe(F.lit(edge[w.column])) for w in ways[:i]], ways[i].after(edge[ways[i].column])]) for i in range(len(ways))]
        df = df.filter(ways[0].after(edge[ways[0].column], same=True)).filter(reduce(Column.__or__, steps))
    rows = df.orderBy(*[w.sort() for w in ways]).limit(size)
    return rows if before is None else rows.orderBy(*[w.reversed().sort() for w in ways])


@dataclass(frozen=True)
class PageIndex:
    """``table`` in range partitions (column ``__part``) of ``counts`` rows, in the order of ``order``."""

    table: DataFrame
    order: list[By]
    counts: list[int]

    def page(self, number: int, size: int) -> DataFrame:
        """As page(), but only the partitions that hold the page's rows are read and sorted."""
        if number < 1 or size < 1:
            raise ValueError("pages count from 1 and hold one row at least")
        ends, total, start = list(accumulate(self.counts)), sum(self.counts), (number - 1) * size
        first = bisect_right(ends, start)
        last = bisect_right(ends, min(start + size, total) - 1)
        offset = start - (ends[first - 1] if first else 0)
        rows = self.table.filter(F.col("__part").isin(list(range(first, last + 1)))).drop("__part")
        rows = rows.orderBy(*[w.sort() for w in self.order]).offset(offset).limit(size)
        pages = -(-total // size)
        places = {"current_page": number, "total_pages": pages, "total_count": total}
        return rows.withColumns({n: F.lit(v).cast("long") for n, v in places.items()} | {"has_previous": F.lit(number > 1), "has_next": F.lit(number < pages)})


def page_index(df: DataFrame, *order: By | str, parts: int | None = None) -> PageIndex:
    """Sort ``df`` once into range partitions in the shared folder, with the rows of each, for any number of pages.

    ``order`` should end with a unique column: equal rows share a partition. ``parts`` is Spark's number of shuffle
    partitions by default; their counts, and nothing else, come to the driver.
    """
    ways = _order(order)
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_folder(spark, "pages")
    df.repartitionByRange(parts, *[w.sort() for w in ways]).withColumn("__part", F.spark_partition_id()).write.partitionBy("__part").parquet(path)
    table = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("__part", T.IntegerType())])).parquet(path)
    held = {r["__part"]: r["count"] for r in table.groupBy("__part").count().collect()}
    return PageIndex(table, ways, [held.get(i, 0) for i in range(max(held, default=-1) + 1)])
