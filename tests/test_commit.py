"""Commits that overlap."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from lexiloom.jobs import ingest
from lexiloom.sources import tables as io


def rows(spark, root):
    return {name: spark.read.parquet(path).count() for name, path in io.manifest(spark, root).items()}


def test_of_two_overlapping_commits_both_tables_stay(spark, tmp_path):
    root = f"file://{tmp_path}"
    io.commit(spark, root, {"a": spark.range(3)})
    base = io.manifest(spark, root)
    io.commit(spark, root, {"b": spark.range(2)}, base)
    io.commit(spark, root, {"c": spark.range(5)}, base)
    assert rows(spark, root) == {"a": 3, "b": 2, "c": 5}


def test_two_commits_of_one_table_conflict_and_change_nothing(spark, tmp_path):
    root = f"file://{tmp_path}"
    io.commit(spark, root, {"a": spark.range(3)})
    base = io.manifest(spark, root)
    io.commit(spark, root, {"a": spark.range(4)}, base)
    with pytest.raises(io.Conflict, match="a"):
        io.commit(spark, root, {"a": spark.range(9), "b": spark.range(1)}, base)
    assert rows(spark, root) == {"a": 4}


def test_a_number_is_taken_once(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda i: io._create(spark, f"file://{tmp_path}/m", "1.json", str(i)), range(8)))
    assert sum(made) == 1 and (tmp_path / "m" / "1.json").read_text() == str(made.index(True))


def test_writers_at_once_lose_nothing(spark, tmp_path):
    root = f"file://{tmp_path}"
    io.commit(spark, root, {"a": spark.range(0)})
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: io.transact(spark, root, lambda now: {"a": now["a"].unionByName(spark.range(i, i + 1))}), range(4)))
        list(pool.map(lambda i: io.commit(spark, root, {f"t{i}": spark.range(i)}), range(4)))
    assert rows(spark, root) == {"a": 4, "t0": 0, "t1": 1, "t2": 2, "t3": 3}


def test_an_overlap_that_never_ends_is_refused(spark):
    df = spark.createDataFrame([(1, "x" * 5000)], "id long, text string")
    for size, overlap in ((1000, 1200), (1000, 1000), (10, -1)):
        with pytest.raises(ValueError):
            ingest.chunk(df, size=size, overlap=overlap)
