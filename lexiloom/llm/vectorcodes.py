"""Vector codes: product quantisation whose nearest entries are found by VA-file filtering.

A vector's components become integers and are cut into parts; each part is coded by the index of the nearest entry of
its codebook. The coordinates of a codebook's entries are quantised to a few bits: in each dimension an entry stands in
one of 2^bits cells. For a part to be coded, lookup tables hold the least and the greatest squared distance to every
cell of every dimension; an entry's lower and upper bound are sums over its cells, for all entries at once the product
of the tables with the cells' indicator matrix. Only entries whose lower bound reaches the least upper bound are
compared in integers, ties to the lower index, so codes are those of comparing all entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
BITS = 4
#: Integers must stay below this: then they are exact in 32-bit floats, and no distance leaves 64 bits.
LIMIT = 1 << 24
#: Above the rounding of sums in 32-bit floats.
SLACK = np.float32(1e-4)
#: Vectors that are coded at once.
BLOCK = 1024


class Cells:
    """The entries (a row each) of one codebook as a VA file."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        n, width = entries.shape
        self.entries, count = entries, 1 << bits
        # of each dimension's sorted coordinates equally many go to each cell, whose bounds are theirs
        cell = np.argsort(np.argsort(entries, axis=0, kind="stable"), axis=0) * count // n
        self.low, self.high = np.zeros((width, count), dtype=np.float32), np.zeros((width, count), dtype=np.float32)
        for c in range(count):
            held = cell == c
            if held.any():
                self.low[:, c] = np.where(held, entries, LIMIT).min(axis=0)
                self.high[:, c] = np.where(held, entries, -LIMIT).max(axis=0)
        self.indicator = np.zeros((width * count, n), dtype=np.float32)
        self.indicator[np.arange(width)[:, None] * count + cell.T, np.arange(n)] = 1

    def candidates(self, them: np.ndarray) -> np.ndarray:
        """For each row of ``them`` (integers) and each entry: can it be among the nearest?"""
        at = them.astype(np.float32)[:, :, None]
        below, above = self.low - at, at - self.high
        near = np.maximum(np.maximum(below, above), 0)
        far = np.maximum(-below, -above)
        np.abs(far, out=far)
        far = np.maximum(far, np.maximum(np.abs(below), np.abs(above)))
        rows = len(them)
        lower = (near * near).reshape(rows, -1) @ self.indicator
        upper = (far * far).reshape(rows, -1) @ self.indicator
        return lower * (1 - SLACK) <= upper.min(axis=1, keepdims=True) * (1 + SLACK)

    def nearest(self, them: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry for each row of ``them``."""
        row, entry = np.nonzero(self.candidates(them))
        apart = them[row] - self.entries[entry]
        distance = np.einsum("ij,ij->i", apart, apart)
        starts = np.searchsorted(row, np.arange(len(them)))
        best = np.minimum.reduceat(distance, starts)
        _, first = np.unique(row[hits := np.flatnonzero(distance == best[row])], return_index=True)
        return entry[hits[first]], best


@dataclass(frozen=True)
class Codebooks:
    """entries: parts x entries x width, whole numbers."""

    entries: np.ndarray

    @property
    def dim(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        """Of all components in decimal by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    @cached_property
    def cells(self) -> list[Cells]:
        return [Cells(e) for e in self.entries]

    def parts(self, them: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, part, its integers, codes, distances), in blocks of rows."""
        n, _, width = self.entries.shape
        for at in range(0, len(them), BLOCK):
            for p in range(n):
                some = them[at : at + BLOCK, p * width : (p + 1) * width]
                yield at, p, some, *self.cells[p].nearest(some)

    def encode(self, them: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (a byte for each part) and errors of the rows."""
        codes, error = np.zeros((len(them), len(self.entries)), dtype=np.uint8), np.zeros(len(them), dtype=np.int64)
        for at, p, _, code, distance in self.parts(them):
            codes[at : at + BLOCK, p] = code
            error[at : at + BLOCK] += distance
        return codes, error

    def sums(self, them: np.ndarray, count: np.ndarray, total: np.ndarray) -> None:
        """Add the rows to ``count`` (part, entry) and ``total`` (part, entry, position)."""
        for _, p, some, code, _ in self.parts(them):
            order = np.argsort(code, kind="stable")
            used, first = np.unique(code[order], return_index=True)
            count[p, used] += np.diff([*first, len(code)])
            total[p, used] += np.add.reduceat(some[order], first)


def usable(c: Column) -> Column:
    """Whether a vector has no null or non-finite component and none that leaves LIMIT."""
    return F.forall(c, lambda x: F.coalesce((x * SCALE < LIMIT) & (x * SCALE > -LIMIT), F.lit(False)))


def integers(column: pa.Array, dim: int) -> tuple[pa.Array, np.ndarray]:
    """(which vectors are usable and of ``dim``, the integers of those)."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    some = column.filter(fits)
    values = some.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    scaled = np.floor(values * SCALE)
    good = (np.abs(values * SCALE) < LIMIT).all(axis=1)
    keep = np.zeros(len(column), dtype=bool)
    keep[np.flatnonzero(fits.to_numpy(zero_copy_only=False))[good]] = True
    return pa.array(keep), scaled[good].astype(np.int64)


def fit(vectors: DataFrame, *, key: str = "vec_id", column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks from all usable vectors: the ``entries`` least keys at first, then ``rounds`` rounds of k-means.

    Components are floor(SCALE * x). Vectors with null or non-finite components (or beyond LIMIT / SCALE, 16384) are
    left out, and so are those whose length isn't the commonest one (of several the longest) that can be cut into equal
    parts. Null keys come last, of rows with one key the least vector first. Fewer vectors, fewer entries; no vectors,
    none. An entry without parts stays as it is. ``entries`` is at most 256.

    A round is one scan: each task adds up its own rows, and Spark adds the tasks' sums; the driver holds the codebooks.
    """
    held = vectors.select(F.col(key).alias("key"), F.col(column).alias("vector")).filter(usable(F.col("vector")))
    sizes = held.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).filter(f"dim > 0 and dim % {parts} = 0")
    common = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
    if not common:
        return Codebooks(np.zeros((parts, 0, 0), dtype=np.int64))
    dim = common["dim"]
    first = held.filter(F.size("vector") == dim).orderBy(F.asc_nulls_last("key"), "vector").limit(entries).collect()
    start = np.floor(np.array([r["vector"] for r in first], dtype=np.float64) * SCALE).astype(np.int64)
    books = Codebooks(np.stack([start[:, p * dim // parts : (p + 1) * dim // parts] for p in range(parts)]))
    for _ in range(rounds):
        books = _moved(held.select("vector"), books)
    return books


def _moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round; vectors: one column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(books.entries.shape[:2], dtype=np.int64), np.zeros(books.entries.shape, dtype=np.int64)
        for batch in batches:
            books.sums(integers(batch.column(0), books.dim)[1], count, total)
        part, entry = np.nonzero(count)
        out = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(out, ["part", "entry", "n", "sums"])

    sums = vectors.mapInArrow(run, "part int, entry int, n long, sums array<long>")
    each = sums.select("part", "entry", "n", F.posexplode("sums").alias("at", "v"))
    entries = books.entries.copy()
    # a row for each number of the codebooks
    for r in each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toLocalIterator():
        entries[r["part"], r["entry"], r["at"]] = r["v"] // r["n"]
    return Codebooks(entries)


def encode(vectors: DataFrame, books: Codebooks, *, column: str = "embedding", keep: list[str]) -> DataFrame:
    """``keep``, ``code`` and ``error`` of the vectors that fit() would take and that have the codebooks' length.

    code: two hex digits for each part; error: the squared distances to the entries, summed. Codebooks without entries
    give no rows.
    """
    held = vectors.select(*[F.col(c) for c in keep], F.col(column).alias("__vector"))
    schema = T.StructType([*held.schema.fields[:-1], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not books.dim:
        return vectors.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, them = integers(batch.column(len(keep)), books.dim)
            codes, error = books.encode(them)
            code = pa.array([c.tobytes().hex() for c in codes], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).filter(good) for i in range(len(keep))], code, pa.array(error)], [*keep, "code", "error"])

    return held.mapInArrow(run, schema)


def report(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of all usable rows of ``vectors`` (vec_id, embedding, label).

    See fit() for which rows and vectors count. label_error is the error of all rows with an equal label, null among
    them; rows that repeat a vec_id stay. A label's errors are added up before they are shuffled.
    """
    books = fit(vectors)
    coded = materialise(encode(vectors, books, keep=["vec_id", "label"]), "codes")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def oracle() -> str:
    """The same in DuckDB SQL, where vec_ids are unique and all vectors have 64 components."""
    width = 64 // PARTS

    def assigned(book: str) -> str:
        distance = f"(qq - 2 * list_dot_product(q, c) + list_dot_product(c, c))::BIGINT * {ENTRIES} + e"
        return f"(SELECT vec_id, p, any_value(q) AS q, min({distance}) AS m FROM cut JOIN {book} USING (p) GROUP BY 1, 2)"

    ctes = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cut AS MATERIALIZED (SELECT vec_id, p, v[p * {width} + 1 : p * {width} + {width}] AS q, list_dot_product(q, q) AS qq FROM kept, range({PARTS}) t(p))",
        f"book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, q AS c FROM cut WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY 1 LIMIT {ENTRIES}))",
    ]
    for r in range(ROUNDS):
        each = f"SELECT p, m % {ENTRIES} AS e, unnest(q) AS x, unnest(range({width})) AS i FROM {assigned(f'book{r}')}"
        ctes.append(f"mean{r} AS MATERIALIZED (SELECT p, e, list(x ORDER BY i) AS c FROM (SELECT p, e, i, floor(sum(x) / count(*)) AS x FROM ({each}) GROUP BY 1, 2, 3) GROUP BY 1, 2)")
        ctes.append(f"book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.c, o.c) AS c FROM book{r} o LEFT JOIN mean{r} n USING (p, e))")
    ctes.append(f"coded AS (SELECT vec_id, string_agg(format('{{:02x}}', (m % {ENTRIES})::BIGINT), '' ORDER BY p) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM {assigned(f'book{ROUNDS}')} GROUP BY 1)")
    ctes.append(f"digest AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS x, unnest(range({width})) AS i FROM book{ROUNDS}))")
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest"
