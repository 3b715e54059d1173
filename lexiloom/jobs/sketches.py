"""Concepts in mergeable sketches: kept for each document, merged for any group of documents, renewed document by document.

Distinct names are counted by HyperLogLog, the commonest names by a frequent-items sketch. Both are bounded in size and
merge in any order, so users, months or the whole corpus need no second pass over the mentions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2^12 registers: a standard error of about 1.6 %. Names that a frequent-items sketch tracks.
REGISTERS, TRACKED = 12, 1000


def document_sketches(found: DataFrame) -> DataFrame:
    """``document_id, concepts, names``: the sketches of each document's mentions (document_id, name); null names don't count."""
    named = found.filter("name is not null")
    return named.groupBy("document_id").agg(F.hll_sketch_agg("name", REGISTERS).alias("concepts"), F.expr(f"approx_top_k_accumulate(name, {TRACKED})").alias("names"))


def renewed(sketches: DataFrame, fresh: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """``sketches`` with those of ``fresh`` in place of their documents' old ones, and without the documents ``gone``."""
    out = fresh.select("document_id") if gone is None else fresh.select("document_id").unionByName(gone.select("document_id"))
    return sketches.join(out.distinct(), "document_id", "left_anti").unionByName(fresh)


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """The sketches of each group; merged ones merge again."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("concepts").alias("concepts"), F.expr(f"approx_top_k_combine(names, {TRACKED})").alias("names"))


def estimates(sketches: DataFrame, k: int = 5) -> DataFrame:
    """In place of the sketches ``distinct``, the number of names, and ``top``, the ``k`` commonest as structs (item, count).

    Counts are exact while a group has at most three quarters of TRACKED names; beyond that they are estimates.
    """
    rest = [c for c in sketches.columns if c not in ("concepts", "names")]
    return sketches.select(*rest, F.hll_sketch_estimate("concepts").alias("distinct"), F.expr(f"approx_top_k_estimate(names, {k})").alias("top"))
