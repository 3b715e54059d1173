"""What the jobs compute and move once only; more than once it grew beyond the limits on large tables."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lexiloom.functions import vectors
from lexiloom.jobs import catalog, graph, ingest
from lexiloom.operators import integrity
from lexiloom.sources.adapters import Model
from lexiloom.streaming.streams import Newest

from .conftest import DATA
from .test_plans import plan

SF = f"{DATA}/sf0.001"


@pytest.fixture
def model(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return Model(spark, SF)


def test_a_text_is_cleaned_and_searched_once(model):
    assert plan(model.chunks()).count("regexp_replace(") == 1
    assert plan(model.mentions()).count("regexp_extract_all(") == 1


def test_pairs_meet_no_table(model):
    lines = plan(graph.relations(model.named)).splitlines()
    pairs = next(at for at, line in enumerate(lines) if "Generate explode" in line)
    assert not any("Join" in line for line in lines[:pairs]) and any("Join" in line for line in lines[pairs:])


def test_neighbours_of_all_nodes_join_nothing(spark, model):
    assert "documents.parquet" not in plan(model.edges())
    assert "Join" not in plan(graph.neighbours(spark.createDataFrame([("a", "b", "X", 1.0)], "source_entity_id string, target_entity_id string, relation_type string, confidence_score double")))


def test_tokens_are_counted_in_their_row(spark):
    rows = spark.createDataFrame([(1, "b a b, B c"), (2, ""), (3, None), (4, "x"), (5, " , ")], "k long, t string")
    out = ingest.hashed_counts(rows, "k", "t", 4, unique=True)
    assert "Exchange" not in plan(out) and "Python" not in plan(out)
    general = ingest.hashed_counts(rows, "k", "t", 4)
    assert out.schema.simpleString() == general.schema.simpleString()
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, general.collect())) != []


def test_keys_of_a_table_are_computed_once(model):
    assert "conversations.parquet" not in plan(integrity.orphans(catalog._broken(model)))


class Held:
    def __init__(self, value=None):
        self.value = value

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_state_takes_rows_without_data_frames():
    newest = Newest()
    newest.seen = Held()
    rows = lambda *texts: iter([Row(key=1, text=t, digest=t.upper()) for t in texts])
    assert [tuple(r) for r in newest.handleInputRows((1,), rows("b", "a"), None)] == [(1, "a", "A", 0)]
    assert not list(newest.handleInputRows((1,), rows("a"), None)) and newest.seen.value == ("A", 0)
    assert [r.version for r in newest.handleInputRows((1,), rows("a", "c"), None)] == [1]


def test_hops_by_tiles_are_those_of_a_search(spark, monkeypatch):
    for name, value in {"FEW": 0, "STARTS": 3, "NODES": 5, "MANY": 4}.items():
        monkeypatch.setattr(graph, name, value)
    edges = sorted({(f"n{i}", f"n{(i * i + 3 * j) % 40}") for i in range(40) for j in range(i % 4)} | {("n0", f"n{i}") for i in range(1, 12)})
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    starts, wanted = [f"n{i}" for i in range(0, 40, 3)] + ["alone"], set()
    for s in starts:
        front = known = {s}
        for hop in range(4):
            wanted |= {(s, n, hop) for n in front}
            front = {b for a in front for b in near.get(a, ())} - known
            known = known | front
    table = spark.createDataFrame([(a, b, "X", 1.0) for a, b in edges], "source_entity_id string, target_entity_id string, relation_type string, confidence_score double")
    out = [tuple(r) for r in graph.k_hop(table, spark.createDataFrame([(s,) for s in starts], "node string"), 3).collect()]
    assert len(out) == len(set(out)) and set(out) == wanted
    assert "FlatMapGroupsInArrow" in plan(graph.k_hop(table, spark.createDataFrame([(s,) for s in starts], "node string"), 3))


def test_equal_queries_are_searched_for_once(spark):
    rows = [(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(60)]
    held = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(i, [float(i % 3 + 1), 2.0, 1.0]) for i in range(30)], "query_id long, embedding array<float>")
    read, one = [], []
    got = {(r.query_id, r["rank"]): r.vec_id for r in vectors.nearest(asked, held, 4, read=read).collect()}
    vectors.nearest(asked.filter("query_id < 3"), held, 4, read=one)
    assert read == one and len(got) == 120
    assert all(got[i, n] == got[i % 3, n] for i in range(30) for n in range(1, 5))


def test_vectors_are_computed_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def embedding(i):
        calls.add(1)
        return [float(i % 7 + 1), float(i % 5)]

    vectors.cell_index(spark.range(50).select(F.col("id").alias("vec_id"), F.col("id").alias("i")).repartition(2).select("vec_id", embedding("i").alias("embedding")))
    assert calls.value <= 100


@pytest.mark.parametrize("direction", ["in"])
def test_hops_by_tiles_are_those_by_joins(spark, monkeypatch, direction):
    rows = [(i, (7 * i * i + 3 * j) % 50, "X", 1.0) for i in range(45) for j in range(i % 5)] + [(3, 3, "X", 1.0), (4, 9, "Y", 1.0), (4, 9, "X", 1.0), (None, 5, "X", 1.0), (6, None, "X", 1.0)]
    edges = spark.createDataFrame(rows, "source_entity_id long, target_entity_id long, relation_type string, confidence_score double")
    start = spark.createDataFrame([(i,) for i in [*range(0, 50, 4), 900, None, 4]], "node long")
    for hops in (1, 5):
        joined = sorted(map(str, graph.k_hop(edges, start, hops, direction=direction).collect()))
        with monkeypatch.context() as m:
            for name, value in {"FEW": 0, "STARTS": 7, "NODES": 20}.items():
                m.setattr(graph, name, value)
            assert sorted(map(str, graph.k_hop(edges, start, hops, direction=direction).collect())) == joined


def test_links_go_to_tiles_packed(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW", 0)
    nodes = spark.range(100).select(F.concat(F.lit("n"), "id").alias("node"))
    edges = nodes.crossJoin(nodes.withColumnRenamed("node", "other")).select(F.col("node").alias("source_entity_id"), F.col("other").alias("target_entity_id"), F.lit("X").alias("relation_type"), F.lit(1.0).alias("confidence_score"))
    out = graph.k_hop(edges, nodes, 2)
    assert len(out.collect()) == 100 * 100
    leaves, moved = out._jdf.queryExecution().executedPlan().finalPhysicalPlan().collectLeaves(), 0
    for at in range(leaves.size()):
        if leaves.apply(at).getClass().getSimpleName() == "ShuffleQueryStageExec":
            moved += leaves.apply(at).plan().metrics().get("shuffleRecordsWritten").get().value()
    assert 0 < moved < 10_000


def test_packed_pairs_come_back():
    a, b = np.array([5, 0, 5, 1 << 40, 5]), np.array([1, 6, 0, 3, 1])
    n, data = graph._packed(a, b, 7)
    assert [list(map(int, x)) for x in graph._unpacked(data, n, 7)] == [[0, 5, 5, 1 << 40], [6, 0, 1, 3]]
    ordered = np.arange(100_000)
    assert len(graph._packed(ordered // 1000, ordered % 1000, 1000)[1]) < len(ordered) / 50


def test_the_driver_holds_slices_of_distances(monkeypatch):
    rng = np.random.default_rng(3)
    points = vectors._unit(rng.normal(size=(20_000, 8)))
    tracemalloc.start()
    centres = vectors._centres(points, 600, 1)
    cells = vectors.Cells(np.arange(600), centres, np.full(600, 0.2), rng.integers(1, 9, 600).astype(float))
    first = cells.first(points, 4)
    second = cells.second(points, np.full(20_000, 0.1), first)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000 * 600 * 8
    least, wanted = cells.wanted(points, 4)
    bits = lambda masks: np.unpackbits(masks, axis=0, count=20_000).view(bool)
    assert (bits(first) == wanted).all() and (bits(second) == ((least**2 <= 0.1) & ~wanted)).all()
    monkeypatch.setattr(vectors, "HELD", 5000)
    assert (cells.first(points[:1003], 4) == np.packbits(wanted[:1003], axis=0)).all()


def test_a_sample_for_the_centres_is_cut_in_the_tasks(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(vectors, "_matrices", lambda rows, column, f=vectors._matrices: taken.append(rows.num_rows) or f(rows, column))
    rows = [(i, [float(i % 97 + 1), float(i % 31), 1.0]) for i in range(4000)] + [(i, [2.0, 2.0, 2.0]) for i in range(4000, 6000)]
    held = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    plans = []
    monkeypatch.setattr(type(held), "toArrow", lambda self, f=type(held).toArrow: plans.append(plan(self)) or f(self))
    index = vectors.cell_index(held, sample=300)
    assert taken == [300] and "xxhash64(vec_id" in plans[0] and "Filter" in plans[0]
    asked = spark.createDataFrame(rows[::500], "query_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in vectors.search(asked, index, 3, block=5).collect()}
    matrix = np.array([v for _, v in rows])
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    for i, _ in rows[::500]:
        best = np.lexsort((np.arange(6000), -np.round(unit @ unit[i], 12)))[:3]
        assert [got[i, n] for n in (1, 2, 3)] == best.tolist()
