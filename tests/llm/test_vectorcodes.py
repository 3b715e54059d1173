"""Vector codes against comparing every part with every entry."""

import hashlib
import math

import numpy as np
import pytest

from lexiloom.llm import queries, vectorcodes

from ..compare import duck, same
from ..conftest import DATA

ROW = "vec_id long, embedding array<float>, label int, code string"


def brute(rows, entries=256):
    """rows: (vec_id, vector, label), all usable; codes, errors and codebooks by the definition."""
    them = np.array([[math.floor(1024 * float(np.float32(x))) for x in v] for _, v, _ in rows], dtype=object)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    width = them.shape[1] // 4
    cuts = [them[:, p * width : (p + 1) * width] for p in range(4)]
    books = [cut[order].copy() for cut in cuts]

    def assign(cut, book):
        found = []
        for q in cut:
            distances = [sum((a - b) ** 2 for a, b in zip(q, e)) for e in book]
            found.append((distances.index(min(distances)), min(distances)))
        return found

    for _ in range(4):
        for cut, book in zip(cuts, books):
            codes = [c for c, _ in assign(cut, book)]
            for e in set(codes):
                of = cut[[i for i, c in enumerate(codes) if c == e]]
                book[e] = [sum(column) // len(of) for column in of.T]
    final = [assign(cut, book) for cut, book in zip(cuts, books)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out = [("".join(f"{f[i][0]:02x}" for f in final), sum(f[i][1] for f in final)) for i in range(len(rows))]
    total = {label: sum(e for (_, e), r in zip(out, rows) if r[2] == label) for label in {r[2] for r in rows}}
    return sorted((r[0], c, e, total[r[2]], digest) for r, (c, e) in zip(rows, out))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], ROW)


def collected(df):
    return sorted(tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def test_codes_are_those_of_comparing_all(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 8).astype(np.float32).tolist(), [None, 1, 2][i % 3]) for i in range(400)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(30)] + [(7, rows[9][1], 2), (2000, [-0.00001] * 8, None), (2001, [15000.0] * 8, 1)]
    dropped = [(-1, None, 1), (-2, [], 1), (-3, [0.1] * 7 + [None], 1), (-4, [math.nan] * 8, 1), (-5, [0.1] * 7 + [math.inf], 2), (-6, [0.1] * 12, 1), (-7, [0.1] * 3, 1)]
    wanted = brute(rows)
    assert collected(vectorcodes.report(frame(spark, rows + dropped))) == wanted


def test_few_rows_and_none(spark):
    assert collected(vectorcodes.report(frame(spark, []))) == []
    assert collected(vectorcodes.report(frame(spark, [(1, None, 1), (2, [0.1] * 5, 1)]))) == []
    rows = [(3, [1.0, 2.0, 3.0, 4.0], None), (1, [0.0, -0.5, 0.25, 9.0], None)]
    assert collected(vectorcodes.report(frame(spark, rows))) == brute(rows)
    assert [r[2] for r in brute(rows)] == [0, 0]


@pytest.mark.parametrize("spread", [1, 50, 1 << 23])
def test_bounds_hide_no_nearest_entry(spread):
    rng = np.random.default_rng(spread)
    entries = rng.integers(-spread, spread + 1, (256, 16))
    entries[7] = entries[200]
    them = np.concatenate([rng.integers(-spread, spread + 1, (500, 16)), entries])
    index, distance = vectorcodes.Cells(entries).nearest(them)
    every = ((them[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_most_entries_are_not_refined(spark):
    vectors = np.array([r["embedding"] for r in spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet").collect()], dtype=np.float64)
    them = np.floor(vectors * 1024).astype(np.int64)[:, :16]
    assert vectorcodes.Cells(them[:256]).candidates(them[256:]).mean() < 0.1


def test_query_equals_sql(spark):
    sf = f"{DATA}/sf0.01"
    got = queries.QUERIES["op13_vectorcodes"](spark, sf).toPandas()
    same(got, duck(sf).sql(queries.ORACLES["op13_vectorcodes"]).df())
    assert len(got) == 500 and got["codebooks_sha256"].nunique() == 1
