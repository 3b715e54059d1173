import zlib

import numpy as np
from pyspark.sql import functions as F

from lexiloom.llm import quality
from lexiloom.llm.queries import op2_quality

from ..conftest import DATA


def test_pairwise_terms_are_the_sum_of_squares():
    rng = np.random.default_rng(0)
    machine = quality.Machine(0.3, rng.normal(size=quality.WORDS + quality.STATISTICS), rng.normal(size=(quality.WORDS + quality.STATISTICS, 3)), np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))
    at, x = machine.row("One two two three, FOUR!!")
    pairs = sum(machine.v[at[i]] @ machine.v[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert abs(machine.score("One two two three, FOUR!!") - 1 / (1 + np.exp(-(0.3 + machine.w[at] @ x + pairs)))) < 1e-9


def test_held_out_accuracy(spark):
    sf = f"{DATA}/sf0.01"
    out = op2_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(out["doc_id"], out["held_out"]))
    held = out[out["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.93
    assert out["score"].between(0, 1).all() and ((out["score"] >= 0.3) == (out["predicted"] == 1)).all()


def test_held_out_labels_and_metadata_are_never_learned(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/sf0.001/labels.parquet")
    one = quality.fit(docs, labels)
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    two = quality.fit(docs.withColumns({"lang": F.lit("q"), "source": F.lit("q")}), turned)
    assert np.array_equal(one.w, two.w) and np.array_equal(one.v, two.v) and one.w0 == two.w0


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "x " * 50_000, 0.5), (2, "", 0.5)], "doc_id long, text string, score double")
    empty = spark.createDataFrame([], "doc_id long, quality int")
    machine = quality.fit(df, empty)
    out = quality.score(df, machine).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out) and len({r.score for r in out if not r.text}) == 1
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    assert 0 <= quality.score(df, quality.fit(df, odd)).first().score <= 1
    assert quality.score(df.limit(0), machine).isEmpty()


def test_the_fit_is_gradient_descent_on_the_logistic_loss():
    """The same steps on dense rows, with the pairwise term and its gradient written out."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["good", "fine", "words", "spam", "BUY", "now!"], 12)) for _ in range(20)]
    labels = [int("spam" not in t) for t in texts]
    rows = [(*quality.features(t), y) for t, y in zip(texts, labels)]
    settings = {"factors": 2, "epochs": 2, "batch": 8, "rate": 0.1, "ridge": 1e-5, "seed": 7}
    machine = quality.train(rows, **settings)

    draw, size = np.random.default_rng(7), quality.WORDS + quality.STATISTICS
    w, v, w0 = np.zeros(size), draw.normal(0, 0.05, (size, 2)), 0.0
    gw, gv, g0 = np.full(size, 1e-6), np.full((size, 2), 1e-6), 1e-6
    stats = np.array([r[2] for r in rows])
    scaled = np.clip((stats - stats.mean(axis=0)) / np.maximum(stats.std(axis=0), 1e-3), -4, 4) / 4
    dense = np.zeros((20, size))
    for i, (at, x, _, _) in enumerate(rows):
        dense[i, at], dense[i, quality.WORDS :] = x, scaled[i]
    used = np.zeros((20, size), dtype=bool)
    for i, r in enumerate(rows):
        used[i, r[0]] = used[i, quality.WORDS :] = True
    y = np.array(labels, dtype=float)
    for _ in range(2):
        order = draw.permutation(20)
        for start in range(0, 20, 8):
            take = order[start : start + 8]
            x = dense[take]
            pairs = np.array([sum((v[i] @ v[j]) * r[i] * r[j] for a, i in enumerate(at) for j in at[:a]) for r, at in ((r, np.flatnonzero(r)) for r in x)])
            error = (1 / (1 + np.exp(-(w0 + x @ w + pairs))) - y[take]) / len(take)
            seen = used[take].any(axis=0)
            dw = error @ x + np.where(seen, 1e-5 * w, 0)
            dv = np.stack([error @ (x * (x @ v[:, f])[:, None] - x * x * v[:, f]) for f in range(2)], axis=1) + np.where(seen[:, None], 1e-5 * v, 0)
            gw, gv, g0 = gw + dw**2, gv + dv**2, g0 + error.sum() ** 2
            w, v, w0 = w - 0.1 * dw / np.sqrt(gw), v - 0.1 * dv / np.sqrt(gv), w0 - 0.1 * error.sum() / np.sqrt(g0)
    assert np.allclose(machine.w, w, atol=1e-4) and np.allclose(machine.v, v, atol=1e-4) and abs(machine.w0 - w0) < 1e-4
