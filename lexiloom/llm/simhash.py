"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are cut into four blocks. Two of them within the radius of 2 agree on two blocks at least, so each
distinct fingerprint goes to one bucket for every pair of blocks. In a bucket the bits stand in vertical planes (one
long integer a bit, one position a fingerprint); a fingerprint is compared with all later ones at once by carry-save
counters, and given up as soon as every distance exceeds the radius. A bucket yields a star for each of its linked
groups, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import materialise, whole_text

SEED = 42
#: Differing bits up to which fingerprints are linked.
RADIUS = 2


def fingerprint(text: str, width: int = 3) -> int:
    """A bit is set where over half of the shingle hashes have it; unsigned. No words: zero."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(ends[:-width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, dtype=np.int64), len(starts)
    for at in range(0, n, 1 << 16):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at + width - 1 :].tolist(), strict=False)]
        hashes = np.array(part, dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def wide_fingerprint(hashes: np.ndarray, words: int) -> bytes:
    """A fingerprint of ``words`` times 64 bits: the first is that of the hashes themselves, the others of hashes of them."""
    counts, n = np.zeros((words, 64), dtype=np.int64), len(hashes)
    turns = np.arange(words, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, n, 1 << 12):
        mixed = hashes[at : at + (1 << 12)] + turns
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed[1:] = (mixed[1:] ^ (mixed[1:] >> np.uint64(shift))) * np.uint64(odd)
        mixed[1:] ^= mixed[1:] >> np.uint64(31)
        octets = mixed.astype("<u8").view(np.uint8).reshape(words, -1, 8)
        counts += np.unpackbits(octets, axis=2, bitorder="little").sum(axis=1, dtype=np.int64)
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").tobytes()


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, row by row. a, b: words of 64 bits."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fingerprint`` (long, the bits as a signed number) of each row of ``docs``."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fingerprint": found.view(np.int64)})

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInPandas(of, "doc_id long, fingerprint long")


def planes(prints: np.ndarray) -> list[int]:
    """64 integers; bit j of integer b is bit b of fingerprint j."""
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in np.packbits(bits.T, axis=1, bitorder="little")]


def near(sliced: list[int], query: int, alive: int, radius: int) -> int:
    """Of the positions in ``alive``, those within ``radius`` (0 to 2) of ``query``. sliced: planes."""
    ones = twos = over = 0
    for at, plane in enumerate(sliced):
        differs = (~plane if query >> at & 1 else plane) & alive
        carry = ones & differs
        ones ^= differs
        over |= twos & carry
        twos ^= carry
        if at & 7 == 7:
            past = over | (twos & ones if radius == 2 else twos if radius == 1 else twos | ones)
            alive &= ~past
            if not alive:
                break
            ones, twos, over = ones & alive, twos & alive, 0
    return alive


def stars(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(least, other) for each fingerprint that is linked in the bucket. prints: distinct, unsigned."""
    prints = np.sort(prints)
    sliced, root, values = planes(prints), list(range(len(prints))), prints.tolist()

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    later = (1 << len(values)) - 1
    for i, value in enumerate(values):
        later &= later - 1
        found = near(sliced, value, later, radius) if later else 0
        while found:
            j = (found & -found).bit_length() - 1
            found &= found - 1
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return [(values[t], values[i]) for i in range(len(values)) if (t := top(i)) != i]


def _masks(radius: int) -> list[int]:
    edges = [64 * i // (radius + 2) for i in range(radius + 3)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, largest: int = 4096) -> DataFrame:
    """Links ``a, b`` that join the distinct fingerprints ``fingerprint`` of ``prints`` just as all pairs would.

    A bucket with over ``largest`` fingerprints isn't held: each of them goes to its own value and to those with one
    free bit turned. Two within distance 2 meet at one of these, all that meet there are within 2 of each other, and
    at most 65 do; so that way is exact too.
    """
    masks = _masks(RADIUS)
    free = [[b for b in range(64) if not m >> b & 1] for m in masks]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, spread = None, [], False
        for batch in batches:
            out: list[tuple[int, int, bool]] = []
            prints_, tables = batch["fingerprint"].to_numpy().view(np.uint64), batch["slot"].to_numpy()
            keys = prints_ & np.array(masks, dtype=np.uint64)[tables]
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (tables[1:] != tables[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if (tables[a], keys[a]) != key:
                    out += _starred(held)
                    key, held, spread = (tables[a], keys[a]), [], False
                held.append(prints_[a:b])
                if spread or sum(map(len, held)) > largest:
                    out += [(v ^ turn, v, True) for v in np.concatenate(held).tolist() for turn in (0, *(1 << x for x in free[tables[a]]))]
                    held, spread = [], True
            yield _linked(out)
        yield _linked(_starred(held))

    slots = F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)]))
    rows = prints.select("fingerprint", slots.alias("at")).select("fingerprint", "at.slot", "at.key")
    rows = rows.repartition("slot", "key").sortWithinPartitions("slot", "key")
    found = materialise(rows.mapInPandas(compare, "a long, b long, meets boolean"), "links")
    meets = found.filter("meets")
    least = meets.groupBy("a").agg(F.min("b").alias("least"))
    return found.filter("not meets").select("a", "b").unionByName(meets.join(least, "a").filter("b <> least").select(F.col("least").alias("a"), "b"))


def _starred(held: list[np.ndarray]) -> list[tuple[int, int, bool]]:
    if sum(map(len, held)) < 2:
        return []
    return [(a, b, False) for a, b in stars(np.concatenate(held), RADIUS)]


def _linked(rows: list[tuple[int, int, bool]]) -> pd.DataFrame:
    a, b = (np.array([r[i] for r in rows], dtype=np.uint64).view(np.int64) for i in (0, 1))
    return pd.DataFrame({"a": a, "b": b, "meets": np.array([r[2] for r in rows], dtype=bool)})


def near_duplicates(docs: DataFrame, *, width: int = 3, largest: int = 4096) -> DataFrame:
    """Groups of near-duplicate documents: ``doc_id, fingerprint, component_id``, a row for each row of ``docs``.

    Texts are lower-cased (A to Z) and cut at ASCII white space into words; shingles of ``width`` words (repeats count)
    are hashed by XXH64. Fingerprints at most RADIUS bits apart are linked; component_id is the least doc_id
    reached. Null and empty texts have fingerprint zero and are linked like any other; a null doc_id is kept and never
    names a component (one of null ids alone has null); repeated rows stay; an empty table gives none. Other columns
    aren't read.
    """
    of = materialise(fingerprints(docs, width), "fingerprints")
    distinct = materialise(of.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "prints")
    linked = components(links(distinct.select("fingerprint"), largest))
    grouped = distinct.join(linked, distinct["fingerprint"] == linked["node"], "left")
    grouped = materialise(grouped.select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("group")), "grouped")
    names = materialise(grouped.groupBy("group").agg(F.min("least").alias("component_id")), "names")
    named = grouped.join(names, "group").select("fingerprint", "component_id")
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return of.join(named, "fingerprint").select("doc_id", digits.alias("fingerprint"), "component_id")
