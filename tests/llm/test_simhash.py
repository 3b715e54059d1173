import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from lexiloom.llm import simhash
from lexiloom.llm.components import components


def brute_fingerprint(text):
    cut = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        cut = cut.replace(c, " ")
    words = [w for w in cut.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in combinations(sorted(set(prints)), 2):
        if (a ^ b).bit_count() <= 2:
            root[max(top(a), top(b))] = min(top(a), top(b))
    return {p: top(p) for p in prints}


def near_prints(rng, n):
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(3 * n):
        p = rng.choice(out)
        for _ in range(rng.randint(1, 3)):
            p ^= 1 << rng.randrange(64)
        out.append(p)
    return list(dict.fromkeys(out))


def test_fingerprints_are_brute_force():
    rng = random.Random(2)
    texts = ["", " \t\n", "one", "One TWO", "ÀB cd\x0bef", "a\u00a0b c d e", "x " * 500] + [" ".join(rng.choices(["ab", "Cd", "é", "ß", "x\u2003y"], k=rng.randint(3, 60))) for _ in range(40)]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t), t


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_bit_slices_give_the_distances(radius):
    prints = np.array(near_prints(random.Random(radius), 30), dtype=np.uint64)
    sliced, everyone = simhash.planes(prints), (1 << len(prints)) - 1
    for q in prints.tolist():
        found = simhash.near(sliced, q, everyone, radius)
        assert [bool(found >> j & 1) for j in range(len(prints))] == [(q ^ p).bit_count() <= radius for p in prints.tolist()]


@pytest.mark.parametrize("largest", [4096, 2])
def test_groups_are_brute_force(spark, largest):
    rng = random.Random(5)
    prints = near_prints(rng, 40)
    dense = rng.getrandbits(64)
    prints += [dense ^ (1 << a) ^ (1 << b) for a, b in combinations(range(9), 2)]
    prints = list(dict.fromkeys(prints))
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    found = {r.node: r.component for r in components(simhash.links(df, largest)).collect()}
    wanted = brute_groups(prints)
    to_signed = dict(zip(prints, signed))
    groups = {}
    for p in prints:
        groups.setdefault(wanted[p], set()).add(to_signed[p])
    for members in groups.values():
        assert len({found.get(x, x) for x in members}) == 1
    assert len({found.get(x, x) for x in signed}) == len(groups)


def test_documents(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from all of the hounds"
    rows = [(5, base, "x"), (2, base.upper(), "y"), (9, None, "z"), (7, "", "z"), (None, base, "q"), (5, base, "x"), (11, "other words here", None), (None, "lonely text of null id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    out = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert len(out) == 8 and all(f == f"{brute_fingerprint(t):016x}" for f, t in ((out[2][1], base),))
    by = {}
    for d, f, c in out:
        by.setdefault(d, set()).add(c)
    assert by[5] == by[2] == {2} and by[9] == by[7] == {7} and by[-1] == {2, None} and by[11] == {11}
    assert simhash.near_duplicates(df.limit(0)).isEmpty()


def test_long_chains_of_edges(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 100), (200, 201), (201, 200), (300, 7)]
    out = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {out[i] for i in range(61)} == {0} and out[300] == 0 and out[201] == out[200] == 200 and 100 not in out
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_a_text_of_more_shingles_than_are_hashed_at_once():
    rng = random.Random(9)
    for n in (1 << 16, (1 << 16) + 2, (1 << 16) + 3, 140_000):
        text = " ".join(rng.choices(["alpha", "Beta", "c", "dd"], k=n))
        assert simhash.fingerprint(text) == brute_fingerprint(text)
