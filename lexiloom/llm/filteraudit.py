"""Interaction audit of quality filters: what each filter removes at each place of each order.

A document fails some of the filters: its mask. Documents are counted by part and mask first (the cells, at most 2^n a
part, whatever the table's size); only the cells are then laid out in long form against every step of every order.
There a running bit-or over the steps says whether a cell has gone before, conditional sums count it, and a window over
a part's filter adds up what the filter removes in all orders.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import whole_text


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _capitals(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))


#: Fixed values of the contract: when a text fails. Words are cut at ASCII white space, case counts.
FILTERS: dict[str, Callable[[Column], Column]] = {
    "A": lambda text: F.size(_words(text)) < 200,
    "B": lambda text: 100 * F.size(F.array_distinct(_words(text))) < 50 * F.size(_words(text)),
    "C": lambda text: 100 * _capitals(text) > 3 * F.length(text),
    "D": lambda text: text.rlike(r"[#$%&*|]"),
}
#: The filter that fails copies: every text that a lesser doc_id has too.
COPIES = "E"


def cells(docs: DataFrame, labels: DataFrame, *, filters: dict[str, Callable[[Column], Column]] = FILTERS, copies: str | None = COPIES, part: str = "lang") -> DataFrame:
    """``part, mask, n, good, toxic``: documents by part and by what they fail; bit i of the mask is filter i.

    ``docs``: doc_id, text and ``part`` (null: the empty string); ``labels``: doc_id, quality, toxic. Filters are
    conditions on the text (null: empty), counted in their order; with ``copies`` one more bit, the last, stands for
    texts that a lesser doc_id of any part has. Equal is equal by SHA-256. Rows with null doc_ids are copies of any row
    with an id, never of each other, and rows that repeat the least doc_id with the same text aren't copies. A document
    is good (toxic) if any label of its doc_id says 1; null ids have no labels. All other columns are left alone.

    Texts stay in the first stage. Copies combine before the shuffle, so that a text which a third of all rows have
    makes one row a task.
    """
    text = whole_text()
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        mask = mask + fails(text).cast("int") * (1 << i)
    seen = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), mask.alias("mask"))
    says = [F.max((F.col(c) == 1).cast("int")).alias(f"is_{c}") for c in ("quality", "toxic")]
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(*says)
    known = seen.join(marks, "doc_id", "left").na.fill(0, ["is_quality", "is_toxic"])
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    if not copies:
        counted = known.select("part", "mask", F.lit(1).alias("n"), F.col("is_quality").alias("good"), F.col("is_toxic").alias("toxic"))
        return counted.groupBy("part", "mask").agg(*sums)
    same = known.groupBy("doc_id", "key", "part", "mask").agg(F.count("*").alias("n"), F.sum("is_quality").alias("good"), F.sum("is_toxic").alias("toxic"))
    # the least doc_id of a text in a part, nulls last, and how many rows it has
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "n", "good", "toxic")).alias("first")
    texts = same.groupBy("key", "part", "mask").agg(first, *sums)
    least = F.min(F.struct("first.nameless", "first.doc_id")).over(Window.partitionBy("key"))
    original = least == F.struct("first.nameless", "first.doc_id")
    bit = 1 << len(filters)
    counts = ("n", "good", "toxic")
    two = F.array(
        F.struct(F.col("mask"), *[F.when(F.col("original"), F.col(f"first.{c}")).otherwise(0).alias(c) for c in counts]),
        F.struct((F.col("mask") + bit).alias("mask"), *[(F.col(c) - F.when(F.col("original"), F.col(f"first.{c}")).otherwise(0)).alias(c) for c in counts]),
    )
    split = texts.withColumn("original", F.coalesce(original, F.lit(False))).select("part", F.explode(two).alias("c")).select("part", "c.*").filter("n > 0")
    return split.groupBy("part", "mask").agg(*sums)


def audit(found: DataFrame, letters: str) -> DataFrame:
    """``part, filter_order, step`` and the metrics of each step of each order of ``letters``, for every part of ``found``.

    ``found``: cells(); letter i is bit i. Metrics: kept after the step, removed in it, redundant (fails the filter, but
    had gone), unique_fails (fails this filter only), good_lost and toxic_lost (removed here), shapley (what the filter
    removes, summed over all orders). There are as many orders as permutations, so use it for a few filters (5: 120).
    """
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    long = found.select("*", F.explode(orders).alias("filter_order")).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter")).filter("letter <> ''")
    bit = F.element_at(F.create_map(*[F.lit(v) for i, letter in enumerate(letters) for v in (letter, 1 << i)]), F.col("letter"))
    long = long.select("part", "mask", "n", "good", "toxic", "filter_order", "letter", (F.col("at") + 1).alias("step"), F.col("mask").bitwiseAND(bit).alias("fails"), bit.alias("bit"))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    here, gone = (F.col("fails") != 0) & (F.col("earlier") == 0), (F.col("fails") != 0) & (F.col("earlier") != 0)

    def total(condition: Column, name: str, of: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(of)).otherwise(0)).cast("long").alias(name)

    steps = long.groupBy("part", "filter_order", "step", "letter").agg(
        total((F.col("fails") == 0) & (F.col("earlier") == 0), "kept"),
        total(here, "removed"),
        total(gone, "redundant"),
        total(F.col("mask") == F.col("bit"), "unique_fails"),
        total(here, "good_lost", "good"),
        total(here, "toxic_lost", "toxic"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter")).alias("shapley")
    return steps.select("part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of FILTERS and copies over all documents, by language; an empty table has no rows."""
    return audit(cells(docs, labels), "".join(FILTERS) + COPIES)


def oracle() -> str:
    """The same in DuckDB SQL."""
    return r"""WITH base AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
    least AS (SELECT t, min(doc_id) AS m FROM base GROUP BY 1),
    doc AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (m IS NOT NULL AND coalesce(doc_id > m, true))::INT AS mask
        FROM base JOIN least USING (t) LEFT JOIN marks USING (doc_id)),
    cell AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM doc GROUP BY 1, 2),
    f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
    orders AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
    steps AS (SELECT filter_order, s::INT AS step, f.bit, (SELECT coalesce(sum(p.bit), 0) FROM f p WHERE instr(left(filter_order, s - 1), p.letter) > 0)::INT AS past FROM orders, range(1, 6) r(s), f WHERE f.letter = filter_order[s]),
    counted AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (past | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & past = 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & past <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & past = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & past = 0), 0)::BIGINT AS toxic_lost
        FROM cell, steps GROUP BY 1, 2, 3, 4)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM counted"""
