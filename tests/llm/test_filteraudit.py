"""The filter audit against counting document by document, order by order."""

import re
from collections import Counter
from itertools import permutations

from lexiloom.llm import filteraudit, queries

from ..compare import duck, same
from ..conftest import DATA

DOCS = "doc_id long, text string, lang string, mask int, quality string"


def fails(text, rows, doc_id):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    least = min((d for d, t, *_ in rows if (t or "") == text and d is not None), default=None)
    copy = least is not None and (doc_id is None or doc_id > least)
    found = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), copy]
    return {letter for letter, failed in zip("ABCDE", found) if failed}


def brute(rows, labels):
    docs = []
    for d, t, lang, *_ in rows:
        marks = [x for x in labels if d is not None and x[0] == d]
        docs.append((lang or "", fails(t or "", rows, d), any(x[1] == 1 for x in marks), any(x[2] == 1 for x in marks)))
    parts, out, shapley = {p for p, *_ in docs}, {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in parts:
            here = [d for d in docs if d[0] == part]
            for step, letter in enumerate(order, 1):
                past = set(order[: step - 1])
                removed = [d for d in here if letter in d[1] and not d[1] & past]
                kept = [d for d in here if not d[1] & (past | {letter})]
                gone = [d for d in here if letter in d[1] and d[1] & past]
                out[part, order, step] = [len(kept), len(removed), len(gone), sum(d[1] == {letter} for d in here), sum(d[2] for d in removed), sum(d[3] for d in removed)]
                shapley[part, letter] += len(removed)
    return {(p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_every_order_against_counting(spark):
    long = " ".join(f"w{i}" for i in range(220))
    rows = [
        (1, long, "en"), (2, long, "en"), (2, long, "de"), (3, long + " #", "en"), (4, "A B C", "en"), (5, "a a a a", None), (6, None, "en"), (7, "", ""), (None, "", "en"), (None, "x|y", "de"),
        (None, "x|y", "de"), (8, "same " * 300, "en"), (8, "same " * 300, "en"), (9, "same " * 300, "en"), (10, "É Z \x0b\x0c\r|", "fr"), (11, long.upper(), "fr"), (0, long, "fr"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (4, None, 1), (6, 1, 1), (8, 1, 0), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame([(*r, 7, "clash") for r in rows], DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {tuple(r) for r in filteraudit.report(docs, marks).collect()}
    assert got == brute(rows, labels)
    assert len(got) == 4 * 600


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.report(none, marks).isEmpty()
    one = spark.createDataFrame([(1, "a", "en", 0, "")], DOCS)
    assert filteraudit.report(one, marks).agg({"removed": "sum"}).first()[0] == 120


def test_other_filters_without_copies(spark):
    docs = spark.createDataFrame([(1, "aa", "x"), (2, "b", "x"), (3, "aa", "x")], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = filteraudit.cells(docs, marks, filters={"P": lambda t: t.contains("a"), "Q": lambda t: t.contains("b")}, copies=None, part="source")
    got = {(r.filter_order, r.step, r.kept, r.removed, r.shapley) for r in filteraudit.audit(found, "PQ").collect()}
    assert got == {("PQ", 1, 1, 2, 4), ("PQ", 2, 0, 1, 2), ("QP", 1, 2, 1, 2), ("QP", 2, 0, 2, 4)}


def test_query_equals_sql(spark):
    sf = f"{DATA}/sf0.01"
    got = queries.QUERIES["op11_filteraudit"](spark, sf).toPandas()
    same(got, duck(sf).sql(queries.ORACLES["op11_filteraudit"]).df())
    assert len(got) == 2400
    first = got.groupby(["part", "filter_order"])[["kept", "removed"]].agg({"kept": "min", "removed": "sum"}).sum(axis=1)
    assert len(set(first.groupby("part").nunique())) == 1
