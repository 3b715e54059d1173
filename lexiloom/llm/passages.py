"""Repeated passages by a sparse suffix array.

Retained are the suffixes that start at minimisers: of every ``window`` neighbouring seeds (short runs of words) the one
with the least hash. Nothing outside a window decides it, so equal passages of ``least`` words retain suffixes at equal
places: one of them in the first ``window`` words, which agrees in its first ``least - window + 1`` words, its head.

1. All retained suffixes are sorted by the hash of their head, over range partitions, and neighbours are compared: a
   suffix whose head no other text has leaves.
2. The others get the words that follow the head and those to the left of the suffix, ``window - 1`` of each, and are
   sorted word by word: head, words to the right, words to the left, text.
3. The common prefixes of neighbours, counted in words, cut that order into intervals of suffixes that agree in their
   first r words. For each r a match is extended to the left: members of an interval that agree in the ``least - r``
   words before them, and come from different texts, share a passage of ``least`` words. What a suffix shares is one
   span of words; a text's overlapping spans are joined, which gives the maximal repeats.

Range partitions end where the text says so, not only the words, so a frequent passage lies over many tasks. Tasks hold
blocks of the order. An interval at the edge of a block may go on in the next one. The suffixes of such heads are sorted
and compared once more with left and right exchanged; what lies at an edge in both orders is settled by minima and maxima
of texts by passage, which combine before the shuffle. No group is gathered, no pairs are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, whole_text

SEED_WORDS = 8
BASE = 0x9E3779B97F4A7C15
#: Characters of texts that a task holds at once, but for a longer text.
CHARACTERS = 1 << 20


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.full(n, b, dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Words:
    """The lower-cased words of some texts in one row, as codes from 1 up, and hashes of any runs of them.

    n: words of each text; first: where it begins; rest: words from each place to the end of its text.
    """

    def __init__(self, texts: list[str]):
        parts = [t.encode().lower().split() for t in texts]
        self.n = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        self.first = np.cumsum(self.n) - self.n
        total = int(self.n.sum())
        self.codes = np.maximum(np.fromiter(map(crc32, chain.from_iterable(parts)), dtype=np.uint64, count=total), np.uint64(1))
        up, self.down = _powers(1 << max(18, total.bit_length()))
        self.sums = np.append(np.uint64(0), np.cumsum(_mix(self.codes) * up[:total], dtype=np.uint64))
        self.rest = np.repeat(self.first + self.n, self.n) - np.arange(total)

    def runs(self, starts: np.ndarray, length: int) -> np.ndarray:
        return _mix((self.sums[starts + length] - self.sums[starts]) * self.down[starts])


def minimisers(words: Words, window: int, least: int) -> np.ndarray:
    """The places, ascending, that passages of ``least`` words retain: the first least seed of their first ``window``."""
    starts = np.flatnonzero(words.rest >= least)
    if not len(starts):
        return starts
    hashes = words.runs(np.arange(len(words.codes) - SEED_WORDS + 1), SEED_WORDS)
    at, width = np.arange(len(hashes)), 1
    while width < window:
        step = min(width, window - width)
        later = hashes[step:] < hashes[:-step]
        hashes, at = np.where(later, hashes[step:], hashes[:-step]), np.where(later, at[step:], at[:-step])
        width += step
    return np.unique(at[starts])


def context(words: Words, at: np.ndarray, head: int, reach: int) -> np.ndarray:
    """Codes of the ``reach`` words after the head of the suffixes ``at``, and of those before them, nearest first.

    One row each; 0 stands for what is beyond the text.
    """
    step = np.arange(reach)
    right, left = at[:, None] + head + step, at[:, None] - 1 - step
    begin = words.first[np.searchsorted(words.first, at, side="right") - 1][:, None]
    end = at[:, None] + words.rest[at][:, None]
    codes = words.codes.astype(np.uint32)
    inside = (right < end, left >= begin)
    return np.hstack([np.where(ok, codes[np.clip(x, 0, len(codes) - 1)], np.uint32(0)) for x, ok in zip((right, left), inside, strict=True)])


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Column k: a hash of the first k codes of each row."""
    out = np.zeros((len(codes), codes.shape[1] + 1), dtype=np.uint64)
    for k in range(codes.shape[1]):
        out[:, k + 1] = _mix(out[:, k] * np.uint64(BASE) + codes[:, k].astype(np.uint64))
    return out


def common_prefixes(head: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Words after the head that each suffix of the order shares with the one before; -1 where the heads differ."""
    shared = np.full(len(head), -1)
    same = np.logical_and.accumulate(right[1:] == right[:-1], axis=1).sum(axis=1)
    shared[1:] = np.where(head[1:] == head[:-1], same, -1)
    return shared


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start, and how long each is."""
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return start, np.diff(np.append(start, len(key)))


def compared(head: np.ndarray, codes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """Suffixes in their order (head, codes, text) compared at each depth k from 0 to ``reach``, the half of the codes.

    At depth k the common prefixes cut the order into intervals of suffixes that agree in head and the first k codes of
    the first half; members that agree in the first ``reach - k`` of the second half are a run. Returns, by row and
    depth, whether the run holds another text, and whether the interval lies at an edge of the block; and for each depth
    its rows in order of their runs: (row, run, whether its text is the run's first or last). Codes are those of context().
    """
    reach = codes.shape[1] // 2
    one, other = codes[:, :reach], codes[:, reach:]
    shared = common_prefixes(head, one)
    room_one, room_other = (np.logical_and.accumulate(x != 0, axis=1).sum(axis=1) for x in (one, other))
    beside = _prefixes(other)
    (met, edge), runs = np.zeros((2, len(head), reach + 1), dtype=bool), []
    for k in range(reach + 1):
        interval = np.cumsum(shared < k)
        rows = np.flatnonzero((room_one >= k) & (room_other >= reach - k))
        key = _mix(interval[rows].astype(np.uint64) * np.uint64(BASE) + beside[rows, reach - k])
        rows = rows[np.argsort(key, kind="stable")]
        if len(rows):
            start, size = _runs(np.sort(key))
            low, high = (np.repeat(f.reduceat(text[rows], start), size) for f in (np.minimum, np.maximum))
            met[rows, k] = low != high
            edge[rows, k] = (interval[rows] == interval[0]) | (interval[rows] == interval[-1])
            runs.append((rows, np.repeat(np.arange(len(start)), size), (text[rows] == low) | (text[rows] == high)))
        else:
            runs.append((rows, rows, rows.astype(bool)))
    return met, edge, runs


def reached(met: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with a repeated passage (met: by row and words to the left of it): the rows, the most and the fewest."""
    good = np.flatnonzero(met.any(axis=1))
    return good, met.shape[1] - 1 - met[good, ::-1].argmax(axis=1), met[good].argmax(axis=1)


def passage_keys(head: np.ndarray, codes: np.ndarray, rows: np.ndarray, before: int) -> np.ndarray:
    """A hash of the passages that begin ``before`` words left of the suffixes ``rows``. codes: left words first."""
    reach = codes.shape[1] // 2
    left, right = (_prefixes(x)[:, -1] for x in (codes[rows, :before], codes[rows, reach : 2 * reach - before]))
    return _mix(_mix(head[rows] + right) * np.uint64(BASE) + left + np.uint64(before))


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in parts of about CHARACTERS characters of ``text``."""
    for batch in batches:
        sizes = np.cumsum([len(t) for t in batch.column("text").to_pylist()])
        cuts = np.flatnonzero(np.diff(sizes // CHARACTERS, prepend=0)).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def _numbers(table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _none(n: int, kind: pa.DataType) -> pa.Array:
    return pa.nulls(n, kind)


def repeats(docs: DataFrame, *, least: int = 50, window: int = 20, block: int = 100_000) -> DataFrame:
    """The words of each text that lie in a passage of ``least`` words or more which another document has too.

    ``doc_id, n_words, n_repeated, spans`` for each row of ``docs`` (doc_id, text) with such words; spans are maximal
    runs ``start-end`` of word positions, end exclusive, comma-joined. Words stand between ASCII white space and are
    compared in lower case (A to Z). A text's passages count once however often it repeats them. Rows with equal texts
    are different documents, so a copied text of ``least`` words is repeated whole; repeated rows, and null ids too,
    count as documents. Null, empty and shorter texts have no rows; no documents, no rows; other columns aren't read.
    Texts and heads are told apart by 64-bit hashes, words by 32-bit codes. ``block``: suffixes that a task holds at once.
    """
    if least - window + 1 < SEED_WORDS:
        raise ValueError("window is too wide for passages that short")
    head, reach = least - window + 1, window - 1

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            words = Words(part.column("text").to_pylist())
            long, text_id = np.flatnonzero(words.n >= least), _numbers(part, "text_id")
            yield _batch(doc_id=part.column("doc_id").take(pa.array(long)), text_id=text_id[long], at=words.n[long].astype(np.int32), key=_none(len(long), pa.int64()))
            at = minimisers(words, window, least)
            of = np.searchsorted(words.first, at, side="right") - 1
            yield _batch(doc_id=_none(len(at), pa.int64()), text_id=text_id[of], at=(at - words.first[of]).astype(np.int32), key=words.runs(at, head).view(np.int64))

    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).withColumn("text_id", F.xxhash64("text"))
    rows = materialise(texts.mapInArrow(suffixes, "doc_id long, text_id long, at int, key long"), "suffixes")
    of_docs = rows.filter("key is null").select("doc_id", "text_id", F.col("at").alias("n_words"))

    def same_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _blocks(batches, block):
            key, text, at = (_numbers(held, c) for c in ("key", "text_id", "at"))
            start, size = _runs(key)
            met, edge = text[start] != text[start + size - 1], np.isin(np.arange(len(start)), [0, len(start) - 1])
            good, loose = np.repeat(met, size), np.repeat(edge & ~met, size)
            yield _batch(text_id=text[good], at=at[good], key=_none(int(good.sum()), pa.int64()))
            yield _batch(text_id=text[loose], at=at[loose], key=key[loose])
            seen = np.concatenate([start[edge & met], (start + size - 1)[edge & met]])
            yield _batch(text_id=text[seen], at=_none(len(seen), pa.int32()), key=key[seen])

    order = rows.filter("key is not null").select("key", "text_id", "at")
    order = order.repartitionByRange("key", "text_id").sortWithinPartitions("key", "text_id")
    same = materialise(order.mapInArrow(same_heads, "text_id long, at int, key long"), "heads")
    kept = same.filter("key is null").unionByName(_settled(same.filter("key is not null"), "at")).select("text_id", "at")
    kept = materialise(kept.groupBy("text_id").agg(F.collect_set("at").alias("ats")), "kept")

    def with_context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            words = Words(part.column("text").to_pylist())
            ats = part.column("ats")
            n = np.diff(ats.offsets.to_numpy())
            own = ats.flatten().to_numpy().astype(np.int64)
            at = own + np.repeat(words.first, n)
            raw = context(words, at, head, reach).astype(">u4").tobytes()
            width = 8 * reach
            yield _batch(text_id=np.repeat(_numbers(part, "text_id"), n), at=own.astype(np.int32), head=words.runs(at, head).view(np.int64), context=[raw[i : i + width] for i in range(0, width * len(at), width)] if width else pa.array([b""] * len(at)))

    # copies are one text before they meet in a task
    wanted = texts.groupBy("text_id").agg(F.first("text").alias("text")).join(kept, "text_id")
    found = materialise(wanted.select("text_id", "text", "ats").mapInArrow(with_context, "text_id long, at int, head long, context binary"), "contexts")

    def read(held: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        codes = np.frombuffer(b"".join(held.column("context").to_pylist()), dtype=">u4").astype(np.uint32)
        return _numbers(held, "head").view(np.uint64), codes.reshape(held.num_rows, 2 * reach), _numbers(held, "text_id"), _numbers(held, "at")

    def spans_of(text: np.ndarray, at: np.ndarray, met: np.ndarray) -> dict:
        good, most, fewest = reached(met)
        return {"text_id": text[good], "first": (at[good] - most).astype(np.int32), "stop": (at[good] - fewest + least).astype(np.int32)}

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _blocks(batches, block):
            head, codes, text, at = read(held)
            met, edge, _ = compared(head, codes, text)
            met, edge = met[:, ::-1], edge[:, ::-1]
            spans = spans_of(text, at, met)
            n = len(spans["text_id"])
            yield _batch(**spans, at=_none(n, pa.int32()), head=_none(n, pa.int64()), context=_none(n, pa.binary()), edge=_none(n, pa.binary()), open=_none(n, pa.binary()))
            some = np.flatnonzero((head == head[0]) | (head == head[-1]))
            turned = np.hstack([codes[some, reach:], codes[some, :reach]]).astype(">u4")
            n = len(some)
            yield _batch(
                text_id=text[some], first=_none(n, pa.int32()), stop=_none(n, pa.int32()), at=at[some], head=head[some].view(np.int64),
                context=[x.tobytes() for x in turned], edge=[x.tobytes() for x in edge[some]], open=[x.tobytes() for x in (edge & ~met)[some]],
            )

    def extend_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _blocks(batches, block):
            head, codes, text, at = read(held)
            was_edge, was_open = (np.frombuffer(b"".join(held.column(c).to_pylist()), dtype=bool).reshape(len(at), reach + 1) for c in ("edge", "open"))
            met, edge, runs = compared(head, codes, text)
            spans = spans_of(text, at, met)
            yield _batch(**spans, key=_none(len(spans["text_id"]), pa.int64()))
            for before, (rows, run, outer) in enumerate(runs):
                here = edge[rows, before] & was_edge[rows, before]
                rows, run, outer = rows[here], run[here], outer[here]
                unmet = was_open[rows, before] & ~met[rows, before]
                # a run's first and last text stand for what is settled in it
                _, once = np.unique(np.stack([run, text[rows]]), axis=1, return_index=True)
                seen = np.zeros(len(rows), dtype=bool)
                seen[once] = True
                for some, place in ((rows[unmet], True), (rows[seen & outer & ~unmet], False)):
                    first = (at[some] - before).astype(np.int32)
                    yield _batch(text_id=text[some], first=first if place else _none(len(some), pa.int32()), stop=first + np.int32(least), key=passage_keys(head, codes, some, before).view(np.int64))

    order = found.repartitionByRange("head", "context", "text_id").sortWithinPartitions("head", "context", "text_id")
    spans = materialise(order.mapInArrow(extend, "text_id long, first int, stop int, at int, head long, context binary, edge binary, open binary"), "spans")
    edges = spans.filter("first is null").select("text_id", "at", "head", "context", "edge", "open")
    order = edges.repartitionByRange("head", "context", "text_id").sortWithinPartitions("head", "context", "text_id")
    more = materialise(order.mapInArrow(extend_edges, "text_id long, first int, stop int, key long"), "spans")
    columns = ["text_id", "first", "stop"]
    spans = spans.filter("first is not null").select(columns).unionByName(more.filter("key is null").select(columns))
    spans = spans.unionByName(_settled(more.filter("key is not null"), "first").select(columns))

    copies = of_docs.groupBy("text_id").agg(F.count("*").alias("n")).filter("n > 1").select("text_id", F.lit(True).alias("copied"))
    found = materialise(joined(spans).join(copies, "text_id", "full"), "repeats")
    out = of_docs.join(found, "text_id")
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").alias("stop")))
    out = out.withColumn("spans", F.when(F.col("copied"), whole).otherwise(F.col("spans")))
    total = F.aggregate("spans", F.lit(0), lambda a, s: a + s["stop"] - s["first"])
    said = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["first"], s["stop"])), ",")
    return out.select("doc_id", "n_words", total.alias("n_repeated"), said.alias("spans"))


def _settled(edges: DataFrame, place: str) -> DataFrame:
    """The open rows of ``edges`` (key, text_id; ``place`` is null for witnesses) whose key another text has as well."""
    # written first: then both sides are plain exchanges, and hot keys are split at run time
    twice = edges.groupBy("key").agg(F.min("text_id").alias("a"), F.max("text_id").alias("b")).filter("a <> b").select("key")
    return edges.filter(F.col(place).isNotNull()).join(materialise(twice, "twice"), "key").select(*edges.columns)


def joined(spans: DataFrame) -> DataFrame:
    """``text_id, spans``: a text's spans (text_id, first, stop) in order, those that overlap or touch as one."""
    by = Window.partitionBy("text_id").orderBy("first", "stop")
    before = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.select("text_id", "first", "stop", F.when(F.col("first") <= before, 0).otherwise(1).alias("fresh"))
    fresh = fresh.withColumn("run", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = fresh.groupBy("text_id", "run").agg(F.min("first").alias("first"), F.max("stop").alias("stop"))
    return merged.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("first", "stop"))).alias("spans"))


def oracle(least: int = 50) -> str:
    """repeats() by brute force, in DuckDB SQL: every passage of ``least`` words of every document."""
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\t-\\r ]+'), lambda w: w <> '') AS w FROM documents),
    p AS (SELECT r, doc_id, len(w) AS n_words, i, md5(array_to_string(w[i + 1 : i + {least}], ' ')) AS passage FROM (SELECT *, unnest(range(len(w) - {least} + 1)) AS i FROM d WHERE len(w) >= {least})),
    twice AS (SELECT passage FROM p GROUP BY 1 HAVING count(DISTINCT r) > 1),
    s AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {least} THEN 0 ELSE 1 END AS fresh FROM p SEMI JOIN twice USING (passage)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM s),
    spans AS (SELECT r, doc_id, n_words, min(i) AS a, max(i) + {least} AS b FROM g GROUP BY r, doc_id, n_words, k)
    SELECT doc_id, n_words::INTEGER AS n_words, sum(b - a)::INTEGER AS n_repeated, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM spans GROUP BY r, doc_id, n_words
    """
