"""Mergeable sketches against exact counts; a relational store that is really read; batches that fail."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiloom.jobs import catalog, ingest, sketches
from lexiloom.sources import tables as io

from .conftest import DATA


@pytest.fixture(scope="module")
def found(spark):
    return spark.range(60_000).select((F.col("id") % 40).alias("document_id"), F.concat(F.lit("n"), F.floor(F.sqrt(F.col("id") * 7))).alias("name"))


def test_merged_sketches_are_near_and_merge_in_any_order(spark, found):
    kept = sketches.document_sketches(found).withColumn("user", F.col("document_id") % 4)
    at_once = sketches.estimates(sketches.merged(kept)).first()
    in_steps = sketches.estimates(sketches.merged(sketches.merged(kept, "user"))).first()
    exact = found.select("name").distinct().count()
    assert at_once["distinct"] == in_steps["distinct"] and abs(at_once["distinct"] - exact) < 0.05 * exact
    for r in sketches.estimates(sketches.merged(kept, "user")).collect():
        wanted = found.filter(f"document_id % 4 = {r.user}").select("name").distinct().count()
        assert abs(r.distinct - wanted) < 0.05 * wanted


def test_few_names_are_counted_exactly(spark):
    rows = [(i % 6, "abcdefg"[(i * i) % 7]) for i in range(300)] + [(1, None)]
    kept = sketches.document_sketches(spark.createDataFrame(rows, "document_id long, name string"))
    got = {x["item"]: x["count"] for x in sketches.estimates(sketches.merged(kept), 10).first()["top"]}
    assert got == dict(Counter(n for _, n in rows if n))


def test_a_changed_document_renews_its_own_sketch(spark):
    columns = "document_id long, name string"
    old = sketches.document_sketches(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], columns))
    fresh = sketches.document_sketches(spark.createDataFrame([(1, "x"), (4, "c")], columns))
    now = sketches.renewed(old, fresh, spark.createDataFrame([(3,)], "document_id long"))
    top = {x["item"] for x in sketches.estimates(sketches.merged(now), 9).first()["top"]}
    assert top == {"x", "c"} and now.count() == 3


def test_concepts_of_users_are_near(spark):
    sf = f"{DATA}/sf0.001"
    exact = {r[0]: r[1] for r in catalog.Model(spark, sf).mentions().groupBy((F.col("document_id") % 150)).agg(F.count_distinct("name")).collect()}
    got = {r.user_id: r.distinct for r in catalog.QUERIES["a8_concepts_of_users"](spark, sf).collect()}
    assert got.keys() == exact.keys() and all(abs(got[u] - exact[u]) <= max(2, 0.05 * exact[u]) for u in got)


URL = "jdbc:derby:memory:lexiloom;create=true"


def test_a_table_of_a_store_in_ranges_of_its_key(spark):
    rows = [(i, f"v{i % 3}") for i in range(1, 101)] + [(None, "v9"), (None, "v0")]
    spark.createDataFrame(rows, "id long, v string").write.option("createTableColumnTypes", "v VARCHAR(20)").jdbc(URL, "many", mode="overwrite")
    df = io.load_jdbc(spark, URL, "many", "id", 4)
    assert sorted((r.id or 0, r.v) for r in df.collect()) == sorted((i or 0, v) for i, v in rows)
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()]
    assert len(sizes) == 4 and max(sizes) < 40
    # bounds only deal the rows out
    assert io.load_jdbc(spark, URL, "many", "id", 3, lower=40, upper=60).count() == 102
    few = df.filter("v = 'v1' and id > 50")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(v,v1)" in plan and "GreaterThan(id,50)" in plan
    assert few.count() == sum(v == "v1" and i > 50 for i, v in rows if i)


def test_a_table_without_keys_is_one_range(spark):
    schema = "id long, v string"
    for rows in ([], [(None, "x")]):
        spark.createDataFrame(rows, schema).write.jdbc(URL, "bare", mode="overwrite")
        assert [tuple(r) for r in io.load_jdbc(spark, URL, "bare", "id", 4).collect()] == rows


def test_batches_that_fail_are_set_aside(spark):
    texts = ["a", "bb", "a", None, "bad", "ccc", "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string").coalesce(1)

    def embedder(some):
        if "bad" in some:
            raise RuntimeError("refused")
        return [[float(len(t))] for t in some if t != "short"]

    out, failed = ingest.embed_what_works(df, embedder, batch=3)
    assert {r.id: r.embedding for r in out.collect()} == {0: [1.0], 1: [2.0], 2: [1.0], 3: None, 4: None, 5: [3.0], 6: None}
    errors = {r.text: r.error for r in failed.collect()}
    assert errors.keys() == {"bad", "short"} and "refused" in errors["bad"] and "0 vectors" in errors["short"]
    with pytest.raises(Exception, match="refused"):
        ingest.embed(df, embedder).collect()
