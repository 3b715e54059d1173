"""The knowledge graph: mentions, relationships, resolution, traversal, summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import preview
from ..sources.tables import written

NAME = r"(\p{Lu}\p{Ll}{3,})"


def at_place(table: DataFrame) -> list[str]:
    """The columns that say where a chunk stands, if ``table`` has them: its document and its index there."""
    place = ["document_id", "chunk_index"]
    return place if set(place) <= set(table.columns) else []


def mentions(chunks: DataFrame, pattern: str = NAME, entity_type: str = "TERM", keep: tuple[str, ...] = ()) -> DataFrame:
    """``chunk_id, document_id, name, entity_type, description``: the distinct names of each chunk, by rule; ``keep``: its columns that come along."""
    names = F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), F.lower))
    # outer and filtered after: a plain explode makes Spark look for the names twice
    found = chunks.select(F.col("id").alias("chunk_id"), "document_id", *keep, F.explode_outer(names).alias("name"), F.lit(entity_type).alias("entity_type"), preview(F.col("content")).alias("description"))
    return found.filter("name is not null")


def extract(chunks: DataFrame, extractor: Callable[[list[str]], list[list[tuple[str, str, str]]]]) -> DataFrame:
    """As ``mentions``, by any batch extractor: for each text its (name, type, description), the first of each name and type.

    Batches are Arrow batches; a null text is empty. An extractor that returns too few lists fails the job.
    """
    kinds = {c: chunks.schema[c].dataType.simpleString() for c in ("id", "document_id")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            named = extractor(rows["content"].fillna("").tolist())
            if len(named) != len(rows):
                raise ValueError(f"{len(rows)} texts, but {len(named)} lists of entities")
            out = [(c, d, *e) for c, d, es in zip(rows["chunk_id"], rows["document_id"], named) for e in es]
            yield pd.DataFrame(out, columns=["chunk_id", "document_id", "name", "entity_type", "description"]).drop_duplicates(["chunk_id", "name", "entity_type"])

    schema = f"chunk_id {kinds['id']}, document_id {kinds['document_id']}, name string, entity_type string, description string"
    return chunks.select(F.col("id").alias("chunk_id"), "document_id", "content").mapInPandas(run, schema)


def pairs(names: str) -> Column:
    """source and target of every pair of a sorted list, the source the lesser."""
    return F.flatten(F.transform(names, lambda a, i: F.transform(F.slice(names, i + 2, F.size(names)), lambda b: F.struct(a.alias("source"), b.alias("target")))))


def relations(found: DataFrame, relation: str = "CO_OCCURS") -> DataFrame:
    """``source, target, relation_type, pair_chunks, confidence``: names that share chunks, the source the lesser.

    Pairs are made inside each chunk's own sorted list of distinct names, which a chunk's size bounds. Confidence is the
    share of the rarer name's chunks that have both. Each name takes the number of its chunks along into the lists, so
    the pairs, the largest table here, are moved once, to be counted, and meet no other table. The numbers are written
    before their join, so that both of its sides are plain exchanges and hot names are split at run time. ``found`` is
    read twice.
    """
    often = written(found.groupBy("name").agg(F.count_distinct("chunk_id").alias("chunks")), "names")
    lists = found.select("chunk_id", "name").join(often, "name").groupBy("chunk_id").agg(F.array_sort(F.collect_set(F.struct("name", "chunks"))).alias("names"))
    p = lists.select(F.explode(pairs("names")).alias("p")).select(F.col("p.source.name").alias("source"), F.col("p.target.name").alias("target"), F.least("p.source.chunks", "p.target.chunks").alias("rarer"))
    n = p.groupBy("source", "target").agg(F.count("*").alias("pair_chunks"), F.max("rarer").alias("rarer"))
    return n.select("source", "target", F.lit(relation).alias("relation_type"), "pair_chunks", (F.col("pair_chunks") / F.col("rarer")).alias("confidence"))


def relations_among(found: DataFrame, wanted: DataFrame, relation: str = "CO_OCCURS") -> DataFrame:
    """The rows of relations() for the pairs ``wanted`` (source, target), without the others being counted.

    Only mentions of names in ``wanted`` are read into lists, and pairs that nobody asks for go before they are counted.
    """
    asked = written(wanted.select("source", "target").distinct(), "wanted")
    names = asked.select(F.explode(F.array("source", "target")).alias("name")).distinct()
    held = written(found.select("chunk_id", "name").join(names, "name", "left_semi").distinct(), "named")
    lists = held.groupBy("chunk_id").agg(F.array_sort(F.collect_list("name")).alias("names"))
    n = lists.select(F.explode(pairs("names")).alias("p")).select("p.*").join(asked, ["source", "target"], "left_semi").groupBy("source", "target").agg(F.count("*").alias("pair_chunks"))
    often = written(held.groupBy("name").agg(F.count("*").alias("chunks")), "names")
    a, b = (often.select(F.col("name").alias(x), F.col("chunks").alias(f"{x}_chunks")) for x in ("source", "target"))
    share = F.col("pair_chunks") / F.least("source_chunks", "target_chunks")
    return n.join(a, "source").join(b, "target").select("source", "target", F.lit(relation).alias("relation_type"), "pair_chunks", share.alias("confidence"))


def resolve(entities: DataFrame) -> DataFrame:
    """``name, entity_type, canonical_id, n``: one entity for each trimmed, lower-cased name and type."""
    return entities.groupBy(F.lower(F.trim("name")).alias("name"), "entity_type").agg(F.min("id").alias("canonical_id"), F.count("*").alias("n"))


def with_canonical(entities: DataFrame, resolved: DataFrame) -> DataFrame:
    """Each entity with its canonical_id. ``resolved`` is written first, so that hot names are split at run time."""
    named = written(resolved, "resolved").select(F.col("name").alias("__name"), F.col("entity_type").alias("__type"), "canonical_id")
    return entities.join(named, (F.lower(F.trim("name")) == F.col("__name")) & (F.col("entity_type") == F.col("__type"))).drop("__name", "__type")


def with_ends(edges: DataFrame, entities: DataFrame, fields: list[str]) -> DataFrame:
    """The edge list with fields of both end points, under source_ and target_."""
    for end in ("source", "target"):
        named = entities.select(F.col("id").alias(f"{end}_entity_id"), *[F.col(f).alias(f"{end}_{f}") for f in fields])
        edges = edges.join(named, f"{end}_entity_id")
    return edges


def adjacency(edges: DataFrame, direction: str = "both") -> DataFrame:
    """``node, neighbour, relation_type, confidence_score``; direction: out, in or both."""
    rest = ["relation_type", "confidence_score"]
    out = edges.select(F.col("source_entity_id").alias("node"), F.col("target_entity_id").alias("neighbour"), *rest)
    back = edges.select(F.col("target_entity_id").alias("node"), F.col("source_entity_id").alias("neighbour"), *rest)
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def neighbours(edges: DataFrame, nodes: DataFrame | None = None, direction: str = "both") -> DataFrame:
    """Neighbours of ``nodes`` (node), by default of every node with an edge, each pair once."""
    links = adjacency(edges, direction).select("node", "neighbour")
    return (links if nodes is None else links.join(nodes.select("node").distinct(), "node", "left_semi")).distinct()


#: Starts up to which a hop is a plain join: no more than so many rows for each link.
FEW = 64
#: Starts and nodes of a tile, about, and the links to its nodes.
STARTS, NODES, LINKS = 8192, 1 << 17, 1 << 24
#: Links in a tile from which a node's neighbours are kept as bits, at least.
MANY = 256
#: Pairs that are packed or given out at once.
AT_ONCE = 1 << 20


def k_hop(edges: DataFrame, start: DataFrame, hops: int, *, direction: str = "both") -> DataFrame:
    """``start, node, hop``: all nodes within ``hops`` steps of each start (column node), at their least distance.

    Each step but the last is written to the shared folder, so the plan stays short; a step without new nodes is the
    last. From many starts the same node is reached on many ways, so a join would make far more rows than there are
    results. Steps then go by tiles of starts and nodes, see _hops_by_tiles(): no way becomes a row.
    """
    seen = written(start.select(F.col("node").alias("start"), "node", F.lit(0).alias("hop")).distinct(), "hop")
    if seen.count() > FEW:
        return _hops_by_tiles(edges, seen, hops, direction)
    links = written(adjacency(edges, direction).select("node", "neighbour").filter("node is not null and neighbour is not null"), "links")
    front = seen
    for hop in range(1, hops + 1):
        fresh = front.join(links, "node").select("start", F.col("neighbour").alias("node")).distinct().join(seen, ["start", "node"], "left_anti")
        fresh = fresh.withColumn("hop", F.lit(hop))
        if hop == hops:
            return seen.unionByName(fresh)
        front = written(fresh, "hop")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def _hops_by_tiles(edges: DataFrame, seen: DataFrame, hops: int, direction: str) -> DataFrame:
    """k_hop() from many starts (``seen``: start, node, hop 0): products of two Boolean matrices by tiles.

    Nodes get numbers, in blocks of about NODES by hash. Pairs (node and neighbour, start and node) are kept as sorted
    numbers, packed, so that what is dealt to the tiles takes a few bytes a pair, and links aren't moved for each start. A
    tile is about STARTS starts and a block of nodes: one group, which holds the front of its starts, the links to its
    nodes and, in the last step, their names.
    """
    ends = edges.select(F.col("source_entity_id").alias("node"), F.col("target_entity_id").alias("neighbour"))
    ends = ends if direction != "in" else ends.select(F.col("neighbour").alias("node"), F.col("node").alias("neighbour"))
    ends = written(ends.filter("node is not null and neighbour is not null").distinct(), "links")
    nodes = written(ends.select(F.explode(F.array("node", "neighbour")).alias("name")).distinct(), "nodes")
    blocks = max(1, -(-nodes.count() // NODES), -(-ends.count() // LINKS))
    local = F.row_number().over(Window.partitionBy("j").orderBy("name")) - 1
    numbered = written(nodes.withColumn("j", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int")).withColumn("local", local), "numbers")
    width = (numbered.agg(F.max("local")).first()[0] or 0) + 1
    names = numbered.select("name", (F.col("j") * F.lit(width).cast("long") + F.col("local")).alias("number"))
    starts = written(seen.select(F.col("start").alias("name")).join(names, "name"), "starts")
    many = starts.count()
    if not hops or not many:
        return seen
    cores = edges.sparkSession.sparkContext.defaultParallelism
    tiles = max(1, -(-many // STARTS), min(many, -(-2 * cores // blocks)))

    a, b = (names.select(F.col("name").alias(c), F.col("number").alias(n)) for c, n in (("node", "a"), ("neighbour", "b")))
    links = written(ends.join(a, "node").join(b, "neighbour").select("a", "b").mapInArrow(_packer(width, direction == "both"), _PACKED), "links")
    front = written(starts.select(F.col("number").alias("a"), F.col("number").alias("b")).mapInArrow(_packer(width, False), _PACKED), "front")
    fronts, kind = [], dict(names.dtypes)["name"]
    every = {c: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c) for c, n in (("i", tiles), ("j", blocks))}

    def tiled(rows: DataFrame, what: int, **given) -> DataFrame:
        """``rows`` as rows of each tile that they belong to: in all of those that the columns i and j leave open."""
        there = {"what": F.lit(what), "part": F.lit(0), "hop": F.lit(0), "n": F.lit(0).cast("long"), "data": F.lit(None).cast("binary"), "number": F.lit(None).cast("long"), "name": F.lit(None).cast(kind)}
        rows = rows.select(*rows.columns, *[c.alias(n) for n, c in given.items()])
        for c in ("i", "j"):
            rows = rows if c in rows.columns else rows.select("*", every[c])
        return rows.select("i", "j", *[n if n in rows.columns else c.alias(n) for n, c in there.items()])

    def product(last: bool) -> DataFrame:
        """The step after the newest front."""
        at, one = len(fronts), {} if fronts else {"i": F.lit(0)}
        newest = (fronts[-1] if fronts else front).withColumnRenamed("j", "part")
        split = tiles if fronts else 1
        # in the first step the starts are few: each link goes to one tile
        parts = [tiled(newest, 0, **one), tiled(links, 1, **one)] + [tiled(f, 2, hop=F.lit(h)) for h, f in enumerate(fronts[:-1], 1)]
        if last:
            parts += [tiled(names, 3, j=F.floor(F.col("number") / width).cast("int"), **one), tiled(starts, 4, i=F.pmod("number", F.lit(split)).cast("int"))]
        rows = reduce(DataFrame.unionByName, parts).repartition(4 * split * blocks, "i", "j")
        schema = f"start {kind}, nodes array<{kind}>, hop int" if last else f"i int, {_PACKED}"
        return rows.groupBy("i", "j").applyInArrow(_reached(blocks, width, tiles, at, last), schema)

    for _ in range(hops - 1):
        fresh = written(product(False), "front")
        if fresh.isEmpty():
            break
        fronts.append(fresh)
    found = product(True).select("start", F.explode("nodes").alias("node"), "hop")
    return seen.unionByName(found)


#: Packed pairs: the block of their second numbers, how many there are, and _packed() bytes.
_PACKED = "j int, n long, data binary"


def _packed(a: np.ndarray, b: np.ndarray, width: int) -> tuple[int, bytes]:
    """How many different pairs there are (b below ``width``), and these: sorted, as differences, byte by byte."""
    keys = np.unique(a * width + b)
    return len(keys), pa.compress(np.diff(keys, prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.divmod(np.cumsum(np.ascontiguousarray(flat.reshape(8, n).T).view(np.int64)[:, 0]), width)


def _packer(width: int, both: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of numbers (a, b) to packed rows, one for each block of b; ``both``: the pairs (b, a) as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                a, b = batch["a"].to_numpy(), batch["b"].to_numpy()
                held += [(a, b), (b, a)] if both else [(a, b)]
                size += len(a)
            if size and (batch is None or size >= AT_ONCE):
                a, b = map(np.concatenate, zip(*held))
                j, b = np.divmod(b, width)
                out = [(int(x), *_packed(a[j == x], b[j == x], width)) for x in np.unique(j)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary()))], names=["j", "n", "data"])
                held, size = [], 0

    return run


def _lists(at: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of each of ``n`` lists: all of them, where each begins, how many it has."""
    number = np.bincount(at, minlength=n)
    return values[np.argsort(at, kind="stable")], np.cumsum(number) - number, number


def _reached(blocks: int, width: int, tiles: int, hop: int, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A tile's step after ``hop``: what is one link from its front and isn't seen.

    Rows are, by ``what``: packed pairs of start and node (0: the front, of all blocks; 2: seen before that), of node and
    neighbour (1), names of the block's nodes (3) and of the starts (4). Gives packed pairs of start and node, or, in the
    ``last`` step, ``start, nodes, hop`` by name, with those of the front and before.
    """

    def unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of all ``rows``, the second numbers with their block's."""
        pairs = [_unpacked(data, n, width) for n, data in zip(rows["n"].to_pylist(), rows["data"].to_pylist())]
        pairs = [(a, b + at * width) for at, (a, b) in zip(rows["part"].to_pylist(), pairs)]
        return tuple(map(np.concatenate, zip((np.zeros(0, dtype=np.int64),) * 2, *pairs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        block = rows["j"][0].as_py()
        front, links, older, names, named = (rows.filter(pc.equal(rows["what"], n)) for n in range(5))
        del rows
        before = {h: unpacked(older.filter(pc.equal(older["hop"], h))) for h in sorted(set(older["hop"].to_pylist()))}
        start, mid = unpacked(front)
        starts = np.unique(np.concatenate([start, *(a for a, _ in before.values())]))
        if not len(starts):
            return
        place = lambda numbers: np.searchsorted(starts, numbers)
        code = np.full(blocks * width, -1, dtype=np.int32)
        code[mid] = 0
        middle = np.flatnonzero(code == 0)
        code[middle] = np.arange(len(middle), dtype=np.int32)
        ways, first, number = _lists(place(start), code[mid], len(starts))
        own = mid // width == block
        before |= {hop: (start[own], mid[own] - block * width)} if hop else {}
        met = {h: _lists(place(a), b.astype(np.int32), len(starts)) for h, (a, b) in before.items()}
        del start, mid, own, before
        near = [(np.zeros(0, dtype=np.int32),) * 2]
        for n, data in zip(links["n"].to_pylist(), links["data"].to_pylist()):
            a, b = _unpacked(data, n, width)
            near.append((code[a][there := code[a] >= 0], b[there].astype(np.int32)))
        near, begins, degree = _lists(*map(np.concatenate, zip(*near)), len(middle))
        many = np.flatnonzero(degree >= max(MANY, width // 128))
        row = np.full(len(middle), -1)
        row[many] = np.arange(len(many))
        bits = np.zeros((len(many), -(-width // 8)), dtype=np.uint8)
        for at, m in enumerate(many):
            flags = np.zeros(width, dtype=bool)
            flags[near[begins[m] : begins[m] + degree[m]]] = True
            bits[at] = np.packbits(flags)

        def steps() -> Iterator[tuple[int, int, np.ndarray]]:
            """A start's place, a hop, and what it has at that hop in this block."""
            for s in range(len(starts)):
                mine = ways[first[s] : first[s] + number[s]]
                wide = row[mine]
                flags = np.zeros(width, dtype=bool)
                if (wide >= 0).any():
                    flags = np.unpackbits(np.bitwise_or.reduce(bits[wide[wide >= 0]], axis=0), count=width).view(bool)
                thin = mine[wide < 0]
                count = degree[thin]
                flags[near[np.repeat(begins[thin] - (np.cumsum(count) - count), count) + np.arange(count.sum())]] = True
                if starts[s] // width == block:
                    flags[starts[s] % width] = False
                for h, (values, begin, size) in met.items():
                    seen = values[begin[s] : begin[s] + size[s]]
                    flags[seen] = False
                    if last and len(seen):
                        yield s, h, seen
                if len(there := np.flatnonzero(flags)):
                    yield s, hop + 1, there

        if last:
            nodes = names["name"].combine_chunks().take(pa.array(np.argsort(names["number"].to_numpy())))
            order = np.argsort(named["number"].to_numpy())
            known = named["name"].combine_chunks().take(pa.array(order[np.searchsorted(named["number"].to_numpy()[order], starts)]))
        for some in _batched(steps()):
            at, hops, found = zip(*some)
            if last:
                held = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), nodes.take(pa.array(np.concatenate(found))))
                yield pa.RecordBatch.from_arrays([known.take(pa.array(at)), held, pa.array(hops, pa.int32())], names=["start", "nodes", "hop"])
            else:
                a, b = np.repeat(starts[list(at)], [len(x) for x in found]), np.concatenate(found)
                out = [(int(i), block, *_packed(a[a % tiles == i], b[a % tiles == i], width)) for i in np.unique(a % tiles)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["i", "j", "n", "data"])

    return run


def _batched(steps: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Steps that have about AT_ONCE nodes together."""
    some, size = [], 0
    for step in steps:
        some.append(step)
        size += len(step[2])
        if size >= AT_ONCE:
            yield some
            some, size = [], 0
    if some:
        yield some


def degrees(edges: DataFrame) -> DataFrame:
    """``id, out_degree, in_degree, degree`` of every node with an edge."""
    out = edges.groupBy(F.col("source_entity_id").alias("id")).agg(F.count("*").alias("out_degree"))
    back = edges.groupBy(F.col("target_entity_id").alias("id")).agg(F.count("*").alias("in_degree"))
    wide = out.join(back, "id", "full").na.fill(0, ["out_degree", "in_degree"])
    return wide.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def most_connected(edges: DataFrame, n: int) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(n)


def relation_stats(edges: DataFrame) -> DataFrame:
    score = "confidence_score"
    return edges.groupBy("relation_type").agg(F.count("*").alias("n"), F.avg(score).alias("avg_confidence"), F.min(score).alias("min_confidence"), F.max(score).alias("max_confidence"))


def merge_parallel(edges: DataFrame) -> DataFrame:
    """One edge for each source, target and type: how many there are and the best confidence."""
    return edges.groupBy("source_entity_id", "target_entity_id", "relation_type").agg(F.count("*").alias("n"), F.max("confidence_score").alias("confidence_score"))


def provenance(entities: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Each entity with its chunk, page and document.

    Entities that say where their chunk stands (document_id, chunk_index) meet it there: tables that are laid out by that
    place aren't moved.
    """
    place = at_place(entities)
    titles = docs.select(F.col("id").alias("document_id"), "title", "file_path")
    named = entities.select(F.col("id").alias("entity_id"), "chunk_id", "name", *place)
    if place:
        return named.join(chunks.select(*place, "page_number"), place).join(titles, "document_id")
    return named.join(chunks.select(F.col("id").alias("chunk_id"), "document_id", "chunk_index", "page_number"), "chunk_id").join(titles, "document_id")


def document_summary(found: DataFrame) -> DataFrame:
    """``document_id, entities, edges, density``: the graph that a document's own mentions make."""
    lists = found.groupBy("document_id", "chunk_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    edges = lists.select("document_id", F.explode(pairs("names")).alias("p")).distinct().groupBy("document_id").agg(F.count("*").alias("edges"))
    nodes = found.groupBy("document_id").agg(F.count_distinct("name").alias("entities"))
    wide = nodes.join(edges, "document_id", "left").na.fill(0, ["edges"])
    most = F.col("entities") * (F.col("entities") - 1) / 2
    return wide.withColumn("density", F.when(most > 0, F.col("edges") / most).otherwise(0.0))


def relation_types(found: DataFrame, k: int) -> DataFrame:
    """``document_id, relation_type, n, rank``: the ``k`` commonest pairs of entity types that share a document's chunks.

    ``n`` counts pairs of names by chunk. It comes from each chunk's number of names by type, so no pair is made.
    """
    per = found.groupBy("document_id", "chunk_id", "entity_type").agg(F.count_distinct("name").alias("n"))
    lists = per.groupBy("document_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("entity_type", "n"))).alias("types"))

    def pair(a: Column, b: Column) -> Column:
        within = F.shiftright(a["n"] * (a["n"] - 1), 1)
        return F.struct(F.concat_ws("_", a["entity_type"], b["entity_type"]).alias("relation_type"), F.when(a["entity_type"] == b["entity_type"], within).otherwise(a["n"] * b["n"]).alias("n"))

    two = F.flatten(F.transform("types", lambda a, i: F.transform(F.slice("types", i + 1, F.size("types")), lambda b: pair(a, b))))
    n = lists.select("document_id", F.explode(two).alias("p")).groupBy("document_id", "p.relation_type").agg(F.sum("p.n").alias("n"))
    by = Window.partitionBy("document_id").orderBy(F.desc("n"), "relation_type")
    return n.filter("n > 0").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def concept_map(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """``name, document_id, pages``: where each concept stands; one row for a name and document, so none grows with a hot name."""
    places = chunks.select(F.col("id").alias("chunk_id"), "page_number")
    return found.select("chunk_id", "document_id", "name").join(places, "chunk_id").groupBy("name", "document_id").agg(F.array_sort(F.collect_set("page_number")).alias("pages"))


def concepts_per_document(found: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct("name") if approximate else F.count_distinct("name")
    return found.groupBy("document_id").agg(count.alias("concepts"))
