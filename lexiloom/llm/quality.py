"""Quality classifier: a factorisation machine over hashed words, structure statistics and length.

A text is one sparse row: its hashed words with their L2-normalised counts, and standardised statistics. Its score is
the sigmoid of ``w0 + sum w x + 1/2 sum_f ((sum v_f x)^2 - sum v_f^2 x^2)``, which takes time linear in the entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import whole_text

WORDS = 1 << 15
STATISTICS = 16


def _class_table() -> np.ndarray:
    """For each byte: 0 lower case, 1 upper case, 2 digit, 3 space, 4 newline, 5 full stop or comma, 6 other sign, 7 beyond ASCII."""
    kind = np.full(256, 6)
    kind[ord("a") : ord("z") + 1], kind[ord("A") : ord("Z") + 1], kind[ord("0") : ord("9") + 1] = 0, 1, 2
    kind[[9, 11, 12, 13, 32]], kind[10], kind[[ord("."), ord(",")]], kind[128:] = 3, 4, 5, 7
    return kind


CLASSES = _class_table()


def features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets (distinct), their values, and the statistics of the whole text."""
    raw = text.encode()
    stats = np.zeros(STATISTICS)
    words = raw.lower().split()
    lines = raw.split(b"\n")
    bytes_ = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    kinds = np.bincount(CLASSES, weights=bytes_, minlength=8)
    n, m = max(1, len(raw)), max(1, len(words))
    stats[:8] = kinds / n
    stats[8] = np.log1p(len(raw)) / 10
    stats[9] = min(len(raw) / m, 50) / 10
    stats[10] = kinds[1] / max(1, kinds[0] + kinds[1])
    stats[11] = bytes_[[ord(c) for c in "#$%&*|!"]].sum() / m
    stats[12] = bytes_[ord("|")] / m
    stats[13] = 1 - len(set(lines)) / len(lines)
    stats[14] = len(words) / len(lines) / 100
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0), stats
    buckets, counts = np.unique(np.fromiter(map(crc32, words), dtype=np.int64, count=len(words)) % WORDS, return_counts=True)
    stats[15] = len(buckets) / len(words)
    return buckets, counts / np.sqrt(np.dot(counts, counts)), stats


@dataclass
class Machine:
    """w0; w: a weight for each entry; v: its factors; mean, scale: of the statistics."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def row(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        buckets, values, stats = features(text)
        return np.append(buckets, WORDS + np.arange(STATISTICS)), np.append(values, _standard(stats, self.mean, self.scale))

    def score(self, text: str) -> float:
        at, x = self.row(text)
        v = self.v[at] * x[:, None]
        z = self.w0 + self.w[at] @ x + 0.5 * float((v.sum(axis=0) ** 2).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _standard(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((stats - mean) / scale, -4, 4) / 4


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], *, factors: int = 4, epochs: int = 6, batch: int = 64, rate: float = 0.1, ridge: float = 1e-5, seed: int = 7) -> Machine:
    """Fit by AdaGrad on the logistic loss. rows: word buckets, values, statistics, label. No rows: scores near one half."""
    rng = np.random.default_rng(seed)
    size = WORDS + STATISTICS
    stats = np.array([r[2] for r in rows]).reshape(-1, STATISTICS)
    mean = stats.mean(axis=0) if rows else np.zeros(STATISTICS)
    scale = np.maximum(stats.std(axis=0), 1e-3) if rows else np.ones(STATISTICS)
    w, v, w0 = np.zeros(size), rng.normal(0, 0.05, (size, factors)), 0.0
    gw, gv, g0 = np.full(size, 1e-6), np.full((size, factors), 1e-6), 1e-6
    ats = [np.append(r[0], WORDS + np.arange(STATISTICS)).astype(np.int32) for r in rows]
    xs = [np.append(r[1], _standard(r[2], mean, scale)).astype(np.float32) for r in rows]
    labels = np.array([r[3] for r in rows], dtype=float)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), batch):
            take = order[start : start + batch]
            at, x, y = np.concatenate([ats[i] for i in take]), np.concatenate([xs[i] for i in take]).astype(float), labels[take]
            lengths = np.array([len(ats[i]) for i in take])
            first = np.cumsum(lengths) - lengths
            vx = v[at] * x[:, None]
            total = np.add.reduceat(vx, first)
            z = w0 + np.add.reduceat(w[at] * x, first) + 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), first))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(take)
            each = np.repeat(error, lengths)
            used, where = np.unique(at, return_inverse=True)
            dw = np.bincount(where, weights=each * x) + ridge * w[used]
            dv = (each * x)[:, None] * (np.repeat(total, lengths, axis=0) - vx)
            dv = np.stack([np.bincount(where, weights=dv[:, f]) for f in range(factors)], axis=1) + ridge * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            g0 += error.sum() ** 2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
            w0 -= rate * error.sum() / np.sqrt(g0)
    return Machine(float(w0), w.astype(np.float32), v.astype(np.float32), mean, scale)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text, mod 5, is 0. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, most: int = 6000, **settings) -> Machine:
    """Fit on at most ``most`` labelled rows that aren't held out: those with the least hash of their doc_id.

    ``labels``: doc_id, quality (0 or 1); of several for one id the least counts, as does the least text;
    nulls don't. Only the sample's ids are broadcast and only its features come to the driver, so ``most`` bounds both.
    """
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    marks = marks.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(marks), "doc_id")
    sample = sample.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, quality in zip(batch["doc_id"], batch["text"], batch["quality"], strict=True):
                buckets, counts, stats = features(text)
                rows.append((doc_id, buckets.astype("<i4").tobytes(), counts.astype("<f4").tobytes(), stats.astype("<f8").tobytes(), quality))
            yield pd.DataFrame(rows, columns=["doc_id", "buckets", "counts", "stats", "quality"])

    found = sample.mapInPandas(of, "doc_id long, buckets binary, counts binary, stats binary, quality int").orderBy("doc_id", "buckets")
    # bounded by ``most``; 8 bytes for a word
    rows = [(np.frombuffer(r.buckets, "<i4"), np.frombuffer(r.counts, "<f4"), np.frombuffer(r.stats, "<f8"), r.quality) for r in found.toLocalIterator()]
    return train(rows, **settings)


def score(docs: DataFrame, machine: Machine, *, threshold: float = 0.3) -> DataFrame:
    """``docs`` (doc_id, text and any others, kept) with ``held_out, score, predicted`` in place of columns so named.

    Only the text is an input of the score. Null and empty texts are scored like any other; equal texts have equal
    scores; null and repeated doc_ids stay; an empty table gives no rows.
    """

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return texts.map(machine.score).astype(float)

    out = docs.withColumn("score", scored(whole_text()))
    return out.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, machine: Machine, *, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the machine doesn't reject, with all their columns as they are; see score()."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id"), F.col("text"))
    return score(rows, machine, threshold=threshold).filter("predicted = 1").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
