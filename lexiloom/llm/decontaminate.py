"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

Test items are short and documents long, so the Jaccard similarity of the two says little. Items are therefore
partitioned by their number of shingles m into classes u/2 < m <= u (u: powers of two), and for each class documents
are cut into windows of 1.5 u shingles every u/2: an item that lies in a document lies whole in one window, with a
similarity of about a quarter at least. Windows and items are compared by the coordinates of their MinHash signatures.
A bit table for each class, of 1024 bits or more a coordinate, holds the items' coordinates; only documents whose windows of
a class meet two of them, in one window or in several, leave the scan: an item may lie in pieces far apart. Each of its shingles is in a window of at most
1.5 u, so a coordinate is met with a chance of m / (m + 1.5 u), a quarter at least, wherever the pieces lie and however
often shingles repeat. What meets an item in the join is verified by exact shingle containment over the
whole document.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

#: Coordinates of a signature: a document that holds an item misses it with a chance of about 2 in 100,000, one that
#: holds 0.8 of it in pieces with about 3 in 10,000.
HASHES = 48
#: The least and the greatest size of a class's table, as powers of two of bits: 512 kB to 128 MB. Beyond 20,000 items a
#: class more windows leave the scan by chance; what is found stays the same.
LEAST_BITS, MOST_BITS = 22, 30
#: Shingles whose hashes are held at once.
CHUNK = 1 << 14
#: Shingles of a block that is gone through one by one, all blocks of a document at a time.
SMALL = 64
_RNG = np.random.default_rng(20)
MULTIPLIERS = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COORDINATES = np.arange(HASHES, dtype=np.uint64)
PLACES = _RNG.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(text: Column) -> Column:
    """Lower-cased words between ASCII white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\t-\r ]+"), lambda w: w != "")


def shingles(of: Column, width: int) -> Column:
    """Distinct shingles; with fewer words the whole sequence is one; none without words."""
    n = F.size(of)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.array_join(F.slice(of, i, width), " "))
    return F.when(n > 0, F.array_distinct(many)).otherwise(F.array().cast("array<string>"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """A hash for each shingle of a lower-cased text, repeats included."""
    parts = text.encode().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    each = _mix(np.fromiter(map(crc32, parts), dtype=np.uint64, count=len(parts)) + np.uint64(1))
    n = max(1, len(parts) - width + 1)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(min(width, len(parts))):
        total += each[k : k + n] * PLACES[k % len(PLACES)]
    return _mix(total)


def block_minima(hashes: np.ndarray, block: int) -> np.ndarray:
    """The least of each hash function in each block of ``block`` shingles: blocks x HASHES."""
    out = []
    step = max(1, CHUNK // block) * block
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step]
        if block <= SMALL:
            # the k-th shingle of each block at once; the last block is filled up with its own last one
            held = np.concatenate([part, part[-1:].repeat(-len(part) % block)]).reshape(-1, block).T.copy()
            least = held[0] * MULTIPLIERS[:, None]
            for row in held[1:]:
                np.minimum(least, row * MULTIPLIERS[:, None], out=least)
            out.append(least.T)
            continue
        mixed = part[None, :] * MULTIPLIERS[:, None]
        out.append(np.minimum.reduceat(mixed, np.arange(0, len(part), block), axis=1).T)
    return np.concatenate(out)


def window_signatures(hashes: np.ndarray, classes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(class, signatures of its windows: windows x HASHES). classes: ascending powers of two from 2 up."""
    block, minima = classes[0] // 2, block_minima(hashes, classes[0] // 2)
    for u in classes:
        while block < u // 2:
            minima = np.minimum.reduceat(minima, np.arange(0, len(minima), 2), axis=0)
            block *= 2
        n = max(1, len(minima) - 2)
        found = minima[:n].copy()
        for k in (1, 2):
            rest = minima[k : k + n]
            np.minimum(found[: len(rest)], rest, out=found[: len(rest)])
        yield u, found


def _slots(signatures: np.ndarray) -> np.ndarray:
    """A place in the greatest table for each coordinate; smaller tables take its upper bits."""
    slots = signatures + _COORDINATES
    slots *= np.uint64(0xD6E8FEB86659FD93)
    slots >>= np.uint64(64 - MOST_BITS)
    return slots


def table_bits(coordinates: int) -> int:
    """The size, as a power of two, of a table for so many coordinates."""
    return min(MOST_BITS, max(LEAST_BITS, (1024 * coordinates - 1).bit_length()))


def _met(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which slots are set. table: bits, eight a byte, or a truth value for each."""
    if table.dtype == bool:
        return table.take((slots >> np.uint64(MOST_BITS - (len(table) - 1).bit_length())).view(np.int64))
    at = slots >> np.uint64(MOST_BITS - (8 * len(table) - 1).bit_length())
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _tables(signed: DataFrame) -> dict[int, np.ndarray]:
    """The bit table of each class; its slots come in pages of at most 2^16."""
    sizes = {r["class"]: 1 << table_bits(r["n"]) for r in signed.groupBy("class").agg(F.count("*").alias("n")).collect()}
    tables = {u: np.zeros(bits >> 3, dtype=np.uint8) for u, bits in sizes.items()}
    pages = signed.groupBy("class", F.shiftright("slot", 16).alias("page")).agg(F.collect_set("slot").alias("slots"))
    for r in pages.toLocalIterator():
        at = np.asarray(r["slots"], dtype=np.int64) >> (MOST_BITS - sizes[r["class"]].bit_length() + 1)
        np.bitwise_or.at(tables[r["class"]], at >> 3, (1 << (at & 7)).astype(np.uint8))
    return tables


def search(docs: DataFrame, items: DataFrame, *, width: int = 5, containment: float = 0.8) -> DataFrame:
    """``doc_id, item_id, containment`` where a document holds at least that share of an item's distinct shingles.

    ``docs``: doc_id, text; ``items``: item_id, text. A null or empty text has no shingles, contains nothing and is
    contained in nothing. Of repeated ids the best containment counts; null ids are kept as an id of their own. No
    documents or no items, no rows; other columns aren't read. Items may be many: they are broadcast by Spark only
    where their measured size allows, and the bit tables grow with them up to 128 MB for each of at most 30 classes.
    A document is cut into shingles once for all items that it may hold.
    """
    spark = docs.sparkSession
    wanted = items.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    wanted = materialise(wanted.select("item_id", F.array_join("words", " ").alias("text"), shingles(F.col("words"), width).alias("shingles")), "items")

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item_id, text, parts in zip(batch["item_id"].astype("Int64").array, batch["text"], batch["shingles"], strict=True):
                u = max(2, 1 << (len(parts) - 1).bit_length())
                least = block_minima(np.unique(shingle_hashes(text, width)), 1 << 62)[0] if len(parts) < CHUNK else block_minima(shingle_hashes(text, width), CHUNK).min(axis=0)
                yield pd.DataFrame({"item_id": pd.array([item_id] * HASHES, dtype="Int64"), "class": u, "place": np.arange(HASHES), "value": least.view(np.int64), "slot": _slots(least[None, :])[0].astype(np.int64)})

    signed = materialise(wanted.mapInPandas(sign, "item_id long, class int, place int, value long, slot long"), "signed")
    tables = _tables(signed)
    classes = sorted(tables)
    if classes:
        classes = [1 << k for k in range(classes[0].bit_length() - 1, classes[-1].bit_length())]
    packed = spark.sparkContext.broadcast(tables)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # up to 16 MB a class are held unpacked, as these are faster to look up
        held = {u: np.unpackbits(t, bitorder="little").view(bool) if len(t) <= 1 << 21 else t for u, t in packed.value.items()}
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].astype("Int64").array, batch["text"], strict=True):
                hashes = shingle_hashes(text, width)
                if not len(hashes) or not classes:
                    continue
                for u, signatures in window_signatures(hashes, classes):
                    if u not in held:
                        continue
                    met = _met(held[u], _slots(signatures))
                    # most windows meet nothing
                    if np.count_nonzero(met) >= 2 and np.count_nonzero(met.any(axis=0)) >= 2:
                        at, place = np.nonzero(met)
                        values = signatures[at, place].view(np.int64)
                        pairs = pd.DataFrame({"place": place, "value": values}).drop_duplicates()
                        out.append(pairs.assign(doc_id=pd.array([doc_id] * len(pairs), dtype="Int64"), **{"class": u}))
            if out:
                yield pd.concat(out)[["doc_id", "class", "place", "value"]]

    rows = docs.select(F.col("doc_id").cast("long"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    met = rows.mapInPandas(probe, "doc_id long, class int, place int, value long")
    pairs = met.join(signed.drop("slot"), ["class", "place", "value"]).groupBy("doc_id", "item_id").agg(F.count("*").alias("n")).select(F.col("doc_id").alias("held_by"), F.col("item_id").alias("item"))
    pairs = materialise(pairs, "candidates")
    # a document's items in one list, which their number bounds
    listed = materialise(pairs.groupBy("held_by").agg(F.collect_set(F.struct("item")).alias("items")), "listed")
    texts = docs.select("doc_id", "text").join(listed, F.col("doc_id").eqNullSafe(F.col("held_by")))
    # words are a column of their own: inside shingles() the text would be split for each shingle
    texts = texts.select("doc_id", words(F.col("text")).alias("words"), "items.item").select("doc_id", "item", shingles(F.col("words"), width).alias("held"))
    texts = texts.select("doc_id", "held", F.explode("item").alias("item"))
    both = texts.join(wanted.select("item_id", F.col("shingles").alias("wanted")), F.col("item").eqNullSafe(F.col("item_id")))
    share = F.size(F.array_intersect("wanted", "held")) / F.size("wanted")
    return both.select("doc_id", "item_id", share.alias("containment")).groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment")).filter(F.col("containment") >= containment)


def clean(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that hold none of ``items``, all columns kept; rows with a null doc_id are judged together."""
    # written first: its size is known then, and where it is small the documents aren't moved
    bad = materialise(search(docs, items, **settings).select(F.col("doc_id").alias("held_by")).distinct(), "bad")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["held_by"]), "left_anti")


def oracle(width: int = 5, containment: float = 0.8) -> str:
    """The result by brute force, in DuckDB SQL."""
    cut = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\t-\\r ]+'), lambda w: w <> '')"
    shingle = f"list_distinct(list_transform(range(1, greatest(len(w) - {width} + 1, 1) + 1), lambda i: array_to_string(w[i : i + {width} - 1], ' ')))"
    return f"""
    WITH d AS (SELECT DISTINCT doc_id, unnest({shingle}) AS s FROM (SELECT doc_id, {cut} AS w FROM documents) WHERE len(w) > 0),
    i AS (SELECT DISTINCT item_id, unnest({shingle}) AS s FROM (SELECT item_id, {cut} AS w FROM benchmark) WHERE len(w) > 0),
    n AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1)
    SELECT doc_id, item_id, count(*)::DOUBLE / any_value(n) AS containment
    FROM d JOIN i USING (s) JOIN n USING (item_id) GROUP BY 1, 2 HAVING count(*)::DOUBLE / any_value(n) >= {containment}
    """
