"""Placement in shards by a weighted hash tree of regions, racks and shards.

At each level every child of the node reached so far draws ``-ln(u) / weight``, with u from a hash of the key and the
child, and the least draw wins. A draw depends on nothing but its own child, so a change of weights moves keys only
between subtrees whose weights change.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, *, built: int = 8, racks: int = 2, per_rack: int = 2) -> list[Shard]:
    """Shards 0 to ``shards - 1``. The first ``built`` fill regions of ``racks`` racks of ``per_rack`` shards.

    Each later shard is a region of its own, so that no older subtree changes its weight: it takes keys only into
    itself. That holds from ``built`` shards up, so there can't be fewer: a smaller tree is laid out with a smaller
    ``built``, and keeps it as it grows.
    """
    if not 1 <= built <= shards:
        raise ValueError(f"{shards} shards, but the tree is laid out for {built} from the start")
    per_region = racks * per_rack
    old = [Shard(s // per_region, s % per_region // per_rack, s) for s in range(built)]
    first = -(-built // per_region)
    return old + [Shard(first + s - built, 0, s) for s in range(built, shards)]


def _descend(key: Column, nodes: list[Shard], level: int, path: tuple[int, ...] = ()) -> Column:
    if level == 3:
        return F.lit(path[-1])
    name = ("region", "rack", "shard")[level]
    children = sorted({getattr(n, name) for n in nodes if n.weight > 0})
    under = {c: [n for n in nodes if getattr(n, name) == c and n.weight > 0] for c in children}
    if len(children) == 1:
        return _descend(key, under[children[0]], level + 1, (*path, children[0]))
    draws = []
    for child in children:
        mixed = F.xxhash64(F.lit("/".join(map(str, (*path, child)))), key)
        uniform = (F.shiftrightunsigned(mixed, 11).cast("double") + 0.5) / float(1 << 53)
        draws.append(F.struct((-F.ln(uniform) / F.lit(float(sum(n.weight for n in under[child])))).alias("draw"), F.lit(child).alias("child")))
    won = F.array_min(F.array(*draws))["child"]
    if level == 2:
        return won
    out = F.when(won == children[0], _descend(key, under[children[0]], level + 1, (*path, children[0])))
    for child in children[1:]:
        out = out.when(won == child, _descend(key, under[child], level + 1, (*path, child)))
    return out


def shard_of(key: Column, nodes: list[Shard]) -> Column:
    """The shard of ``key``. nodes: the tree's leaves, a stated list; weights over 0 count."""
    if not any(n.weight > 0 for n in nodes):
        raise ValueError("no shard has a weight")
    return _descend(key, nodes, 0)


def place(docs: DataFrame, shards: int = 8, **shape) -> DataFrame:
    """Place every row of ``docs`` (``doc_id``, ``text``) by the law ``key``: doc_id and the number of shards decide.

    Returns doc_id, size (bytes of the text and 1; a null text has none), text_crc32, law, shard, slot, grown_shard
    (with one shard more). Slots count from 0 in each shard without a gap: rows are numbered where they lie, and the
    numbers of the parts before are added, so no shard is gathered. A null doc_id is a key like any other; rows with
    equal doc_id share a shard and have slots of their own; an empty table gives no rows; other columns aren't read;
    a text of any length is one row's size and checksum. ``shape``: see topology(); its ``built`` must stay the same
    while shards are added.
    """
    text, key = F.col("text"), F.col("doc_id")
    rows = docs.select(
        key.cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        shard_of(key.cast("long"), topology(shards, **shape)).cast("int").alias("shard"),
        shard_of(key.cast("long"), topology(shards + 1, **shape)).cast("int").alias("grown_shard"),
    )

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen = TaskContext.get().partitionId(), np.zeros(shards, dtype=np.int64)
        for batch in batches:
            shard = batch["shard"].to_numpy()
            within = batch.groupby("shard").cumcount().to_numpy() + seen[shard]
            seen += np.bincount(shard, minlength=shards)
            yield batch.assign(doc_id=batch["doc_id"].astype("Int64"), part=part, within=within)

    schema = "doc_id long, size long, text_crc32 long, shard int, grown_shard int, part long, within long"
    placed = materialise(rows.mapInPandas(number, schema), "placed")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    slot = (F.col("start") + F.col("within")).alias("slot")
    return placed.join(starts, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")
