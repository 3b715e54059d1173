from math import log

import corpus_pipeline

from lexiloom.llm import pii


def corpus(spark, copies):
    letters = [f"{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    rows = [(i, f"plain words about {x * 3} and {x * 2} here") for i, x in enumerate(letters)]
    said = ["the zorbafon project of bob@corp.com meets today", "again Zorbafon bob@corp.com went home", "so bob@corp.com wrote zorbafon down"]
    said += [f"{w} quuxible mail eve@corp.com today" for w in ("early", "late", "never")]
    rows += [(100 + i, t) for i, t in enumerate(said)] + [(99, "A Zorbafon alone."), (98, "A Quuxible alone.")]
    rows += [(200 + i, f"{i} again  ZORBAFON bob@corp.com went home!") for i in range(copies)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_copies_of_a_line_neither_hide_nor_add(spark):
    lines = 64 + 3 + 3 + 2
    share = round(log(3 * lines / (4 * 3)) / log(lines / 3), 6)
    for copies in (0, 9):
        said = {r.term: round(r.share, 6) for r in pii.disclosing(pii.detect(corpus(spark, copies)), distinct=True).collect()}
        # one neighbour on each side ("mail eve@corp.com today") is no want of evidence
        assert said["zorbafon"] == said["quuxible"] == share and set(said) <= {"zorbafon", "quuxible", "mail", "today"}
    two = corpus(spark, 9).filter("doc_id not in (100, 102)")
    assert "zorbafon" not in {r.term for r in pii.disclosing(pii.detect(two), distinct=True).collect()}


def test_the_stage_removes_a_term_that_copies_hid(spark):
    out = {r.doc_id: r.text for r in corpus_pipeline.without_personal_data(spark, corpus(spark, 9), "").collect()}
    assert out[99] == "A <TERM> alone." and out[98] == "A <TERM> alone."
