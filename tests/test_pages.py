"""Pages by index and by keyset against sorting everything; deletes over any graph of keys; faults in one pass."""

import itertools
import random
import re

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lexiloom.operators import integrity, mutate, read
from lexiloom.operators.read import By
from lexiloom.schema import FOREIGN_KEYS, ForeignKey

ROWS = [(i, random.Random(i).choice([None, "a", "b", "c"]), random.Random(i + 99).choice([None, 1.0, 2.0, float("nan")])) for i in range(60)]


def rank(v, way):
    null = (v is None) == way.last
    if v is None:
        return (null, 0)
    v = {"a": 1, "b": 2, "c": 3}.get(v, v)
    v = 1e9 if v != v else v
    return (null, -v if way.descending else v)


def ordered(ways):
    columns = {"id": 0, "name": 1, "score": 2}
    return [r[0] for r in sorted(ROWS, key=lambda r: [rank(r[columns[w.column]], w) for w in ways])]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id long, name string, score double").repartition(5)


ORDERS = [[By("name", d1, n1), By("score", d2, n2), By("id", d1)] for d1, n1, d2, n2 in itertools.product((False, True), (None, True, False), (False, True), (True, False))]


@pytest.mark.parametrize("ways", ORDERS[::5] + [[By("id")]])
def test_keyset_pages_forward_and_back(table, ways):
    wanted, edge, got = ordered(ways), None, []
    while rows := read.keyset(table, ways, 13, after=edge).collect():
        got += [r.id for r in rows]
        edge = rows[-1].asDict()
    assert got == wanted
    edge, got = None, []
    last = read.keyset(table, [w.reversed() for w in ways], 1).first().asDict()
    rows = read.keyset(table, ways, 13, before=last).collect()
    assert [r.id for r in rows] == wanted[-14:-1]
    rows = read.keyset(table, ways, 13, before=rows[0].asDict()).collect()
    assert [r.id for r in rows] == wanted[-27:-14]


def test_indexed_pages_read_their_partitions(spark, table):
    ways = ORDERS[3]
    index, wanted = read.page_index(table, *ways, parts=6), ordered(ways)
    assert sum(index.counts) == 60 and len(index.counts) > 3
    for size in (7, 60, 100):
        pages = [[r.id for r in index.page(n, size).collect()] for n in range(1, 60 // size + 3)]
        assert [i for p in pages for i in p] == wanted and all(len(p) <= size for p in pages)
    row = index.page(2, 25).first()
    assert (row.current_page, row.total_pages, row.total_count, row.has_previous, row.has_next) == (2, 3, 60, True, True)
    plan = index.page(2, 5)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*__part", plan) and "rangepartitioning" not in plan
    assert read.page_index(table.limit(0), *ways).page(1, 5).isEmpty()
    with pytest.raises(ValueError):
        index.page(0, 5)


def test_the_first_columns_bound_reaches_the_scan(spark, tmp_path):
    spark.range(10).withColumn("v", F.col("id") % 3).write.parquet(str(tmp_path / "t"))
    out = read.keyset(spark.read.parquet(str(tmp_path / "t")), ["v", "id"], 3, after={"v": 1, "id": 4})
    assert "GreaterThanOrEqual(v,1)" in out._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in out.collect()] == [7, 2, 5]


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def test_deletes_follow_self_references_and_cycles(spark):
    keys = [ForeignKey("comments", "parent_id", "comments", "cascade"), ForeignKey("a", "b_id", "b", "cascade"), ForeignKey("b", "a_id", "a", "cascade"), ForeignKey("notes", "a_id", "a", "cascade"), ForeignKey("notes", "b_id", "b", "restrict")]
    tables = {
        "comments": spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, None), (6, 6)], "id long, parent_id long"),
        "a": spark.createDataFrame([(1, 10), (2, 11), (3, 12)], "id long, b_id long"),
        "b": spark.createDataFrame([(10, 2), (11, 1), (12, None)], "id long, a_id long"),
        "notes": spark.createDataFrame([(100, 1, 12), (101, 3, 10), (102, 2, 11)], "id long, a_id long, b_id long"),
    }
    got = {(r.table, r.id) for r in mutate.cascade(tables, {"comments": ids(spark, 1, 6), "b": ids(spark, 10)}, keys=keys).collect()}
    assert got == {*(("comments", i) for i in (1, 2, 3, 4, 6)), ("b", 10), ("a", 1), ("b", 11), ("a", 2), ("notes", 100), ("notes", 102)}
    held = {(r.table, r.id, r.column) for r in mutate.restricted(tables, {"b": ids(spark, 10)}, keys=keys).collect()}
    assert held == {("notes", 101, "b_id")}


def test_parents_come_before_children():
    order = mutate.delete_order({t for fk in FOREIGN_KEYS for t in (fk.child, fk.parent)}, FOREIGN_KEYS)
    place = {t: i for i, group in enumerate(order) for t in group}
    assert all(place[fk.parent] < place[fk.child] for fk in FOREIGN_KEYS if fk.rule == "cascade") and all(len(g) == 1 for g in order)
    diamond = [ForeignKey("b", "a", "a", "cascade"), ForeignKey("c", "a", "a", "cascade"), ForeignKey("d", "b", "b", "cascade"), ForeignKey("d", "c", "c", "cascade"), ForeignKey("c", "b", "b", "cascade")]
    assert mutate.delete_order({"a", "b", "c", "d"}, diamond) == [["a"], ["b"], ["c"], ["d"]]


def test_faults_in_one_pass_with_totals(spark):
    entities = spark.createDataFrame([(1, "a", "T", False), (1, "a", "T", None), (2, None, "T", False), (3, "c", "T", True)], "id long, name string, entity_type string, is_deleted boolean")
    edges = spark.createDataFrame([(1, 1, 2, None, 0.5), (2, 1, 2, None, 0.5), (3, 3, 3, "r", 2.0), (3, 3, 3, "r", 2.0), (4, 1, None, "r", 0.1)], "id long, source_entity_id long, target_entity_id long, relation_type string, confidence_score double")
    totals = Observation()
    got = sorted((r.check, r.id) for r in integrity.graph_faults(entities, edges, totals).collect())
    assert got == [("blank", 2), ("confidence", 3), ("dangling", 4), ("deleted", 3), ("loop", 3), ("parallel", 2)]
    assert totals.get == {"blank": 1, "dangling": 1, "deleted": 1, "loop": 1, "confidence": 1, "parallel": 1}
