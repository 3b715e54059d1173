"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ZERO_ID


def parse_id(c: Column) -> Column:
    """A 36-character id in lower case; the zero id for anything else."""
    return F.when(c.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lower(c)).otherwise(ZERO_ID)


def total_pages(count: Column, size: int) -> Column:
    if size < 1:
        raise ValueError("a page holds one row at least")
    return F.ceil(count / F.lit(float(size))).cast("long")


def clean_text(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def id_from(*key: Column) -> Column:
    """An id in uuid form that depends on the natural key alone, so that a retried insert finds its row."""
    return F.regexp_replace(F.md5(F.concat_ws("#", *[k.cast("string") for k in key])), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def preview(c: Column, length: int = 120) -> Column:
    """The first characters, with dots where the text goes on."""
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("..."))).otherwise(c)


def to_utc(c: Column, zone: str) -> Column:
    return F.to_utc_timestamp(c, zone)
