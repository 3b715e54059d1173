import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm.passages import CHARACTERS, Words, common_prefixes, compared, context, joined, minimisers, reached, repeats


def brute(rows, least):
    where, words = defaultdict(set), []
    for r, (_, t) in enumerate(rows):
        words.append((t or "").encode().lower().split())
        for a in range(len(words[r]) - least + 1):
            where[tuple(words[r][a : a + least])].add(r)
    out = []
    for r, (i, _) in enumerate(rows):
        spans = []
        for a in range(len(words[r]) - least + 1):
            if len(where[tuple(words[r][a : a + least])]) > 1:
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = a + least
                else:
                    spans.append([a, a + least])
        if spans:
            out.append((i, len(words[r]), sum(b - a for a, b in spans), ",".join(f"{a}-{b}" for a, b in spans)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,window,block", [(50, 20, 100_000), (50, 20, 40), (20, 13, 7), (30, 1, 500)])
def test_repeats_are_brute_force(spark, least, window, block):
    rng = random.Random(least)
    word = lambda: "".join(rng.choices("abcdef", k=rng.randint(1, 5)))
    shared = [[word() for _ in range(n)] for n in (least - 1, least, least + 1, 3 * least, 500)]
    rows = [(900, None), (901, ""), (902, "a b c"), (903, "x " * 400), (904, "x " * 300), (905, "Y " * 200)]
    for i in range(150):
        body = [word() for _ in range(rng.choice([0, 3, 60, 300]))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            part = rng.choice(shared)
            a = rng.randint(0, len(part) // 2)
            at = rng.randint(0, len(body))
            body = body[:at] + part[a : rng.randint(a, len(part))] + body[at:]
        rows.append((i, (" " if i % 2 else "\n").join(body)))
    rows += [rows[40], (None, rows[50][1]), (777, rows[60][1].upper()), (778, "one two " * least)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, at int").repartition(4)
    got = sorted(map(tuple, repeats(df, least=least, window=window, block=block).collect()), key=str)
    assert got == brute(rows, least) and len(got) >= 40
    assert repeats(df.limit(0)).isEmpty()


def test_a_passage_common_to_all(spark):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"a{i} b{i} {line} c{i}") for i in range(300)] + [(1000 + i, f"q{i} " * 70) for i in range(20)]
    out = repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.spans) for r in out} == {(i, "2-62") for i in range(300)}
    with pytest.raises(ValueError):
        repeats(spark.createDataFrame(rows, "doc_id long, text string"), least=20, window=20)


def suffixes_in_order(texts, least, window):
    """(head, codes, text, place, words from the suffix on) of each retained suffix, in the order of the job."""
    words, head, reach = Words(texts), least - window + 1, window - 1
    at = minimisers(words, window, least)
    of = np.searchsorted(words.first, at, side="right") - 1
    keys, codes = words.runs(at, head), context(words, at, head, reach)
    order = sorted(range(len(at)), key=lambda i: (int(keys[i]), codes[i].astype(">u4").tobytes(), int(of[i])))
    parts = [t.lower().split() for t in texts]
    return [(keys[i], codes[i], int(of[i]), int(at[i] - words.first[of[i]]), parts[of[i]]) for i in order]


def test_neighbours_share_the_longest_prefix_and_matches_extend_both_ways():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcd", k=rng.randint(1, 4)))
    shared = [word() for _ in range(90)]
    texts = []
    for _ in range(40):
        a, b = sorted(rng.sample(range(91), 2))
        texts.append(" ".join([word() for _ in range(rng.randint(0, 30))] + shared[a:b] + [word() for _ in range(rng.randint(0, 30))]))
    least, window = 30, 12
    rows, head, reach = suffixes_in_order(texts, least, window), least - window + 1, window - 1
    heads, codes, text = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])

    def common(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    tails = [r[4][r[3] :] for r in rows]
    before = common_prefixes(heads, codes[:, :reach])
    for i in range(1, len(rows)):
        real = common(tails[i - 1], tails[i])
        assert before[i] == (min(real - head, reach) if real >= head else -1) or (real >= head and min(len(tails[i]), len(tails[i - 1])) == real)
        # no suffix further away shares more than the neighbours do
        best = max(common(tails[i], tails[j]) for j in range(len(rows)) if j != i)
        near = max(common(tails[i], tails[j]) for j in (i - 1, i + 1) if 0 <= j < len(rows))
        assert min(best, least) == min(near, least) or best < head
    met, edge, _ = compared(heads, codes, text)
    good, most, fewest = reached(met[:, ::-1])
    far, close = np.full(len(rows), -1), np.full(len(rows), reach + 1)
    far[good], close[good] = most, fewest
    for i, (_, _, own, place, words) in enumerate(rows):
        starts = [a for a in range(max(0, place - reach), place + 1) if a + least <= len(words) and any(own != r[2] and r[4][max(0, r[3] - (place - a)) :][:least] == words[a : a + least] for r in rows)]
        assert (far[i], close[i]) == ((place - starts[0], place - starts[-1]) if starts else (-1, reach + 1))
    assert (far >= 0).sum() > 50 and edge.any()


def test_spans_are_joined_to_maximal_runs(spark):
    rows = [(1, 0, 50), (1, 10, 60), (1, 12, 55), (1, 60, 110), (1, 111, 161), (2, 5, 60), (2, 5, 60)]
    got = {r.text_id: [tuple(s) for s in r.spans] for r in joined(spark.createDataFrame(rows, "text_id long, first int, stop int")).collect()}
    assert got == {1: [(0, 110), (111, 161)], 2: [(5, 60)]}


def test_a_passage_of_all_documents_lies_over_many_tasks(spark):
    line = " ".join(f"w{i}" for i in range(70))
    df = spark.createDataFrame([(i, f"a{i} {line} c{i}") for i in range(4000)], "doc_id long, text string")
    out = repeats(df, block=300)
    assert out.filter("spans = '1-71'").count() == 4000
    order = spark.range(4000).select(F.lit(7).alias("head"), F.col("id").alias("text_id")).repartitionByRange(8, "head", "text_id")
    assert order.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 1000


def test_a_text_of_more_characters_than_are_taken_at_once(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    shared = [word() for _ in range(60)]
    long = [word() for _ in range(150_000)]
    long[140_000:140_000] = shared
    rows = [(1, " ".join(long)), (2, " ".join([word(), *shared, word()])), (3, " ".join(word() for _ in range(100)))]
    assert len(rows[0][1]) > CHARACTERS
    out = repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.spans) for r in out} == {(1, "140000-140060"), (2, "1-61")}
