import math
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from lexiloom.llm.sharding import Shard, place, shard_of, topology


def test_placement(spark):
    rows = [(i, f"text {i % 50} é", "s") for i in range(4000)] + [(None, None, "s"), (None, "", "s"), (17, "twice", "s"), (17, "twice", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(7)
    out = place(df).collect()
    assert len(out) == len(rows)
    texts = Counter((i, 0 if t is None else zlib.crc32(t.encode()), 1 + len((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.text_crc32, r["size"]) for r in out) == texts
    for s in range(8):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots))) and 0.8 < len(slots) / 500 < 1.2
    assert all(r.grown_shard in (r.shard, 8) and r.law == "key" for r in out)
    assert 0.8 < sum(r.grown_shard == 8 for r in out) / (4000 / 9) < 1.2
    assert len({r.shard for r in out if r.doc_id == 17}) == 1
    assert place(df.limit(0)).isEmpty()


def drawn(key, nodes):
    """The descent of the weighted tree, drawn apart from Spark."""
    path, left = (), nodes
    for level in ("region", "rack", "shard"):
        draws = []
        for child in sorted({getattr(n, level) for n in left}):
            seed = xxhash.xxh64_intdigest("/".join(map(str, (*path, child))), 42)
            mixed = seed if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), seed)
            draws.append((-math.log(((mixed >> 11) + 0.5) / 2**53) / sum(n.weight for n in left if getattr(n, level) == child), child))
        won = min(draws)[1] if len(draws) > 1 else draws[0][1]
        path, left = (*path, won), [n for n in left if getattr(n, level) == won]
    return path[-1]


@pytest.mark.parametrize("built", [1, 2, 3, 5, 8])
def test_each_added_shard_takes_rows_only_into_itself(spark, built):
    keys = [*range(700), -5, 1 << 40, None]
    df = spark.createDataFrame([(k,) for k in keys], "id long")
    sizes = range(built, 22)
    got = df.select("id", *[shard_of(F.col("id"), topology(n, built=built)).alias(f"n{n}") for n in sizes]).collect()
    for n in sizes:
        nodes = topology(n, built=built)
        assert [r[f"n{n}"] for r in got] == [drawn(r.id, nodes) for r in got]
        if n > built:
            assert {r[f"n{n}"] for r in got if r[f"n{n}"] != r[f"n{n - 1}"]} == {n - 1}


def test_fewer_shards_than_the_tree_was_laid_out_for(spark):
    with pytest.raises(ValueError):
        topology(7)
    df = spark.createDataFrame([(i, "x" * (1_000_000 * (i == 3))) for i in range(40)], "doc_id long, text string")
    out = place(df, 3, built=2).collect()
    assert {r.shard for r in out} <= {0, 1, 2} and all(r.grown_shard in (r.shard, 3) for r in out)
    assert max(r["size"] for r in out) == 1_000_001


def test_a_change_of_weight_moves_rows_only_into_its_subtree(spark):
    old = [Shard(r, k, 4 * r + 2 * k + s) for r in range(2) for k in range(2) for s in range(2)]
    new = [Shard(n.region, n.rack, n.shard, 3.0 if n.shard == 5 else 1.0) for n in old]
    df = spark.range(8000).select(shard_of(F.col("id"), old).alias("a"), shard_of(F.col("id"), new).alias("b"))
    moved = Counter((r.a, r.b) for r in df.filter("a <> b").collect())
    region = lambda s: s // 4
    rack = lambda s: s // 2
    assert all(region(b) == 1 for _, b in moved) and sum(moved.values()) > 0
    assert all(b == 5 for a, b in moved if rack(a) == rack(5))
    share = df.groupBy("b").count().collect()
    assert abs(next(r["count"] for r in share if r.b == 5) / 8000 - 0.3) < 0.03
