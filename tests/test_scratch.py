"""Tables that are deleted with the block they are made in."""

from pathlib import Path
from urllib.parse import urlparse

import pytest

from lexiloom.sources.tables import scratch, written


def folder(df):
    return Path(urlparse(df.inputFiles()[0]).path).parent


def test_tables_end_with_their_block(spark):
    rows = spark.range(5)
    with scratch(spark, "outer") as lasting:
        inner = written(rows, "inner")
        with scratch(spark, "within") as beyond:
            deeper = folder(written(rows, "deeper"))
            handed = beyond(rows, "handed")
        assert not deeper.exists() and folder(handed).exists() and folder(inner).exists()
        kept = lasting(inner.filter("id > 2").unionByName(handed), "kept")
    assert not folder(inner).exists() and not folder(handed).exists()
    assert kept.count() == 7
    assert folder(written(rows, "after")).exists()


def test_they_end_with_a_block_that_fails(spark):
    with pytest.raises(ZeroDivisionError), scratch(spark, "failing"):
        inner = folder(written(spark.range(5), "inner"))
        raise ZeroDivisionError
    assert not inner.exists()
    assert folder(written(spark.range(5), "after")).exists()
