"""Small helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import scratch, shared_dir, written

__all__ = ["materialise", "of_rows", "row_bits", "scratch", "shared_dir", "whole_text"]

#: A table written once to the shared folder and read back.
materialise = written


def whole_text(name: str = "text"):
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def row_bits(rows: DataFrame) -> DataFrame:
    """``block, bits`` of the row numbers ``row``: a bit for each of 32,768 numbers, so that a set of rows stays small."""
    return rows.groupBy(F.shiftright("row", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("row").bitwiseAND(32767)).alias("bits"))


def of_rows(df: DataFrame, bits: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``row`` is in ``bits``, the written result of row_bits().

    Its size is a bit a row and a little, so Spark broadcasts it where a table of the numbers would make it move ``df``.
    """
    there = bits.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))
    place = F.col("row").bitwiseAND(32767).cast("int")
    octet = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = df.join(there, F.shiftright("row", 15) == F.col("_block"))
    return found.filter(octet.bitwiseAND(F.pow(F.lit(2), place.bitwiseAND(7)).cast("int")) > 0).drop("_block", "_bits")
