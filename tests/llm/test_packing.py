import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexiloom.llm.packing import Packer, WordTokens, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def words(rng, n):
    return " ".join("".join(rng.choices("abcdeéß.,!'", k=rng.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    texts = [None, "", " \n", "a", words(rng, 9000), *[words(rng, rng.randint(1, 700)) for _ in range(60)]]
    rows = [(i if i != 7 else None, t, "x", 1) for i, t in enumerate(texts)] + [(3, "a", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, length int").repartition(5).cache()


def test_word_tokens_are_the_tokenizers():
    whole = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    odd = ["a\x1cb \x85c\xa0d’s <|endoftext|>x it's İ Σας é e\u0301", "\x00a \u200b　日本語 ẞ ſ K ²³ª½ x_y A1B22", "a<|startoftext|>b", "x" * 5000 + " y"]
    texts = odd + [words(rng, 200) for _ in range(20)] + ["".join(map(chr, rng.choices(range(1, 0x3000), k=300))) for _ in range(50)]
    ours = WordTokens(PATH, most=50)
    for t in texts * 2:
        assert ours.encode(t) == np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(t)[:80]


@pytest.mark.parametrize("size,windows,fan_in", [(2048, 16, 64), (64, 2, 2), (100, 1, 3)])
def test_every_id_lies_in_one_piece(spark, docs, size, windows, fan_in):
    whole = Tokenizer.from_file(PATH)
    wanted = sorted(([*whole.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()), key=lambda x: (len(x), x))
    out = pack(docs, PATH, size=size, open_windows=windows, min_piece=4, fan_in=fan_in, keep_ids=True).toPandas()
    assert (out["ids"].map(len) == out["length"]).all() and (out["length"] > 0).all()
    assert all(zlib.crc32(np.asarray(i, dtype="<u4").tobytes()) == c for i, c in zip(out["ids"], out["ids_crc32"]))
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= size
    named = out[(out["doc_id"] != 3) & out["doc_id"].notna()]
    got = {d: g.sort_values("start") for d, g in named.groupby("doc_id")}
    ids = {d: [x for i in g["ids"] for x in i] for d, g in got.items()}
    for d, g in got.items():
        assert g["start"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and set(g["doc_tokens"]) == {len(ids[d])}
    rest = [list(i) for i in out[(out["doc_id"] == 3) | out["doc_id"].isna()].sort_values("start")["ids"]]
    assert sum(map(len, wanted)) == sum(map(len, ids.values())) + sum(map(len, rest))
    assert all(x in wanted for x in ids.values())
    full = out.groupby("sequence_id")["length"].sum()
    assert (full < size - 4).sum() <= 1 and 1 - full.sum() / (size * len(full)) < 0.1


def test_a_packer_is_best_fit():
    p = Packer(0, 10, 2, 3)
    for doc, n in enumerate((6, 3, 7, 3)):
        p.add(doc, 0, bytes(4 * n), n)
    done = [(d[0], d[2], d[5], d[6]) for d in p.done]
    assert done == [(2, 7, 0, 0), (3, 3, 0, 7)] and p.gaps == [1]


def plainly_packed(documents, size, most, min_piece):
    """The rule word by word: lists of (document, tokens) as windows; the sequences as they are emitted, and what is open."""
    done, windows = [], []
    room = lambda w: size - sum(n for _, n in w)
    for doc, n in documents:
        while n >= size:
            done.append([(doc, size)])
            n -= size
        while n:
            fitting = [w for w in windows if room(w) >= n]
            if not fitting and len(windows) < most:
                windows.append([])
                fitting = windows[-1:]
            if fitting:
                best = min(fitting, key=room)
                best.append((doc, n))
                n = 0
                if not room(best):
                    done.append(best)
                    windows = [w for w in windows if w is not best]
                break
            fullest = min(windows, key=room)
            gap = room(fullest)
            windows = [w for w in windows if w is not fullest]
            if gap >= min_piece:
                fullest.append((doc, gap))
                n -= gap
            done.append(fullest)
    return done, windows


@pytest.mark.parametrize("seed", range(40))
def test_a_packer_places_as_the_rule_says(seed):
    rng = random.Random(seed)
    size, most, min_piece = rng.choice([7, 20, 64]), rng.randint(1, 5), rng.randint(1, 6)
    documents = [(d, rng.choice([1, rng.randint(1, size), rng.randint(1, 3 * size)])) for d in range(120)]
    p = Packer(0, size, most, min_piece)
    for doc, n in documents:
        p.add(doc, 0, bytes(4 * n), n)
    done, windows = plainly_packed(documents, size, most, min_piece)
    emitted = {}
    for doc, _, length, _, _, sequence, _, _ in p.done:
        emitted.setdefault(sequence, []).append((doc, length))
    assert list(emitted.values()) == done
    assert sorted([(d, len(i) // 4) for d, _, i, _ in w] for w in p.windows) == sorted(windows)


def test_without_ids_and_empty(spark, docs):
    assert pack(docs, PATH).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert pack(docs.limit(0), PATH).isEmpty()
    assert pack(docs.filter(F.col("text").isNull()), PATH).select("length", "doc_tokens").collect() == [(1, 1)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_a_file_that_cuts_otherwise_is_refused(name):
    with pytest.raises(ValueError, match="another way"):
        WordTokens(public_tokenizers.path(name))
