"""Language identification: kernels against sets of n-grams, and accuracy on documents that taught nothing."""

import zlib

import numpy as np
import pytest

from lexiloom.llm import languages, queries

from ..conftest import DATA


def grams(text):
    """The n-grams by the definition, without hashing."""
    out, padded = set(), " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    padded = " " + " ".join(padded.split()) + " " if padded.strip() else ""
    for n in range(1, languages.GRAMS + 1):
        out |= {padded[i : i + n] for i in range(len(padded) - n + 1)}
    return out


TEXTS = ["Hello, world", "HELLO   world!!", "", " 123 ", "x", "Ünïcode ñ — 你好", "a1b2c3", "the cat\n\nsat, the cat ran", "😀 smile 😀"]


def test_presence_is_the_set_of_ngrams():
    for text in TEXTS:
        assert abs(int(languages.presence(text).sum()) - len(grams(text))) <= 1, text
    for a in TEXTS:
        for b in TEXTS:
            shared = int((languages.presence(a) & languages.presence(b)).sum())
            assert abs(shared - len(grams(a) & grams(b))) <= 1


def test_pieces_of_long_texts_change_nothing(monkeypatch):
    text = "Über die, 12 Brücken! ging es; " * 50
    whole = languages.presence(text)
    for piece in (1, 2, 7, 100):
        monkeypatch.setattr(languages, "PIECE", piece)
        assert (languages.presence(text) == whole).all()


def test_with_all_texts_as_landmarks_it_is_kernel_ridge_regression():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcde " if i % 2 else "defgh "), 60)) for i in range(30)]
    rows = [("xy"[i % 2], np.packbits(languages.presence(t)).tobytes()) for i, t in enumerate(texts)]
    machine = languages.train(rows, landmarks=30, ridge=1e-3)
    sets = [np.flatnonzero(languages.presence(t)) for t in texts]
    kernel = np.array([[len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    # the dual solution, with the constant as one more (unpenalised) feature
    wanted = np.where(np.arange(30) % 2 == 1, 1.0, -1.0)
    penalty = 1e-3 * 30 / 2
    system = np.block([[kernel + penalty * np.eye(30), np.ones((30, 1))], [np.ones((1, 30)), np.zeros((1, 1))]])
    dual = np.linalg.solve(system, np.append(wanted, 0))
    got = machine.kernels(np.array([languages.presence(t) for t in texts])) @ machine.weights + machine.bias
    assert np.allclose(got[:, 1], kernel @ dual[:-1] + dual[-1], atol=1e-3)


def test_defined_results(spark):
    rows = [(i, w * 5, lang, "clash") for i, (w, lang) in enumerate([("the and with ", "en"), ("der und mit ", "de")] * 30)]
    odd = [(None, "the and with", None, ""), (100, None, "en", ""), (101, "", "de", ""), (102, "12 — 34", "xx", ""), (103, "und der", None, ""), (103, "the with", None, ""), (104, "the and with " * 50000, None, "")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    machine = languages.fit(docs)
    assert machine.languages == ["de", "en"]
    out = languages.identify(docs, machine)
    assert out.columns == ["doc_id", "text", "lang", "score", "held_out", "lang_pred"] and out.count() == len(rows + odd)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.lang_pred) for r in out.collect() if r.doc_id is None or r.doc_id >= 100)
    assert got == [(-1, "en"), (100, "und"), (101, "und"), (102, "und"), (103, "de"), (103, "en"), (104, "en")]
    assert all(0 <= r.score <= 1 and (r.score == 0) == (r.lang_pred == "und") for r in out.collect())
    assert languages.identify(docs.limit(0), machine).isEmpty()


def test_without_anything_to_learn_all_is_undetermined(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    for table in (docs, docs.limit(0)):
        machine = languages.fit(table)
        assert {(r.lang_pred, r.score) for r in languages.identify(docs, machine).collect()} == {("und", 0.0)}


def test_held_out_documents_teach_nothing(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame([(i, "nur hier steht etwas", "de") for i in ids], "doc_id long, text string, lang string")
    assert languages.fit(docs).languages == []


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_held_out_accuracy(spark, sf):
    got = queries.QUERIES["op12_languages"](spark, f"{DATA}/{sf}")
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    wanted = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/{sf}/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(wanted)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in wanted if zlib.crc32(str(i).encode()) % 5 == 0}
    right = sum(r["lang_pred"] == wanted[r["doc_id"]] for r in held) / len(held)
    assert right > 0.97, right
