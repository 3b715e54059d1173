"""Language identification by a string kernel.

A text is the set of its letter n-grams of one to GRAMS letters (a blended spectrum, by presence), hashed into BUCKETS
bits. The kernel of two texts is the number of n-grams they share over the root of the product of their sizes. Some
texts are landmarks: the kernels with them, whitened (Nyström), are the features of a ridge regression for each language
against the rest. A batch of texts is scored by two matrix products: presence with landmarks, kernels with weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality import held_out

BUCKETS = 1 << 16
GRAMS = 3
#: Code points that are cut into n-grams at once, and texts of one matrix product.
PIECE, BATCH = 1 << 20, 64
UNDETERMINED = "und"
#: Odd numbers that hash an n-gram: one for each place of each length.
_ODD = np.random.default_rng(12).integers(1 << 63, size=(GRAMS + 1, GRAMS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LAST = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - (BUCKETS - 1).bit_length())


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point: is it a letter?"""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _mark(codes: np.ndarray, bits: np.ndarray) -> None:
    wide = codes.astype(np.uint64)
    for n in range(1, GRAMS + 1):
        if len(wide) >= n:
            sums = wide[: len(wide) - n + 1] * _ODD[n, 0]
            for place in range(1, n):
                sums = sums ^ (wide[place : len(wide) - n + 1 + place] * _ODD[n, place])
            bits[(sums * _LAST) >> _SHIFT] = True


def presence(text: str) -> np.ndarray:
    """Which n-grams the whole text has, lower-cased, each run of other signs as one space; none without a letter."""
    bits, space, lowered = np.zeros(BUCKETS, dtype=bool), ord(" "), text.lower()
    carry, any_letter = np.array([space], dtype=np.uint32), False
    for at in range(0, len(lowered), PIECE):
        codes = np.frombuffer(lowered[at : at + PIECE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[codes]
        any_letter |= bool(letter.any())
        after = np.concatenate([carry[-1:] != space, letter[:-1]])
        codes = np.concatenate([carry, np.where(letter, codes, space)[letter | after]])
        _mark(codes, bits)
        carry = codes[-GRAMS + 1 :]
    if carry[-1] != space:
        _mark(np.append(carry, np.uint32(space)), bits)
    return bits if any_letter else np.zeros(BUCKETS, dtype=bool)


@dataclass
class Classifier:
    """languages, sorted; landmarks: packed bits; weights: landmark x language; bias: of each language."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @cached_property
    def _bits(self) -> tuple[np.ndarray, np.ndarray]:
        bits = np.unpackbits(self.landmarks, axis=1)
        return np.ascontiguousarray(bits.T, dtype=np.float32), np.sqrt(bits.sum(axis=1, dtype=np.float64))

    def kernels(self, bits: np.ndarray) -> np.ndarray:
        """Texts (a row of bits each) with the landmarks; zero where one has no n-gram."""
        matrix, size = self._bits
        own = np.sqrt(bits.sum(axis=1, dtype=np.float64))
        return (bits.astype(np.float32) @ matrix) / np.maximum(own[:, None] * size, 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its score: how far the best regression is from -1 (0) to 1 (1)."""
        found, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        for at in range(0, len(texts), BATCH if self.languages else len(texts) + 1):
            bits = np.array([presence(t or "") for t in texts[at : at + BATCH]])
            some = np.flatnonzero(bits.any(axis=1)) if self.languages else []
            if len(some):
                f = self.kernels(bits[some]) @ self.weights + self.bias
                best = f.argmax(axis=1)
                scores[at + some] = np.clip((f[np.arange(len(some)), best] + 1) / 2, 0, 1)
                for i, b in zip(some, best, strict=True):
                    found[at + i] = self.languages[b]
        return found, scores


def train(rows: list[tuple[str, bytes]], *, landmarks: int = 160, ridge: float = 1e-2) -> Classifier:
    """Fit on (language, packed bits) rows, of which the first are the landmarks. No rows: nothing is determined."""
    names = sorted({name for name, _ in rows})
    packed = np.array([np.frombuffer(b, dtype=np.uint8) for _, b in rows], dtype=np.uint8).reshape(len(rows), BUCKETS // 8)
    machine = Classifier(names, packed[:landmarks], np.zeros((min(landmarks, len(rows)), len(names))), np.zeros(len(names)))
    if not rows:
        return machine
    kernels = np.concatenate([machine.kernels(np.unpackbits(packed[at : at + BATCH], axis=1)) for at in range(0, len(rows), BATCH)]).astype(np.float64)
    among = kernels[: len(machine.landmarks)]
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    whiten = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    features = np.column_stack([kernels @ whiten, np.ones(len(rows))])
    wanted = np.where(np.array([[name == n for n in names] for name, _ in rows]), 1.0, -1.0)
    penalty = np.diag([ridge * len(rows) / len(names)] * whiten.shape[1] + [1e-9])
    solved = np.linalg.solve(features.T @ features + penalty, features.T @ wanted)
    machine.weights, machine.bias = whiten @ solved[:-1], solved[-1]
    return machine


def fit(docs: DataFrame, *, most: int = 1600, languages: int = 64, **settings) -> Classifier:
    """Fit on at most ``most`` documents (doc_id, text, lang) that aren't held out, equally many of each language.

    Learned are the ``languages`` commonest values of lang. Of a language the documents with the least hash of their
    doc_id count: its number is counted first, and only hashes below a bound that leaves about twice the wanted number
    are ordered, so no task holds a language. Null ids, texts and langs teach nothing, nor do texts without a letter;
    of several texts of one id and lang the least counts. Texts are read once the ids are known, and ``most`` bounds
    what is broadcast (ids) and what comes to the driver (8 KB each).
    """
    known = docs.filter("doc_id is not null and lang is not null and text is not null").filter(~held_out(F.col("doc_id")))
    common = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not common:
        return train([], **settings)
    each = max(1, most // len(common))
    # of 2^64 hashes those below; signed
    below = [(r["lang"], min((1 << 63) - 1, int((2 * each + 64) / r["n"] * 2**64) - (1 << 63))) for r in common]
    bounds = docs.sparkSession.createDataFrame(below, "lang string, below long")
    hashed = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash")).join(F.broadcast(bounds), "lang").filter("hash <= below")
    by = Window.partitionBy("lang").orderBy("hash", "doc_id")
    ids = hashed.select("doc_id", "lang", "hash").distinct().withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= each)
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("rank", "lang").agg(F.min("text").alias("text"))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = [presence(t) for t in batch["text"]]
            some = [b.any() for b in bits]
            yield batch.loc[some, ["rank", "lang"]].assign(bits=[np.packbits(b).tobytes() for b, s in zip(bits, some, strict=True) if s])

    found = sample.mapInPandas(of, "rank int, lang string, bits binary").orderBy("rank", "lang")
    return train([(r["lang"], bytes(r["bits"])) for r in found.toLocalIterator()], **settings)


def identify(docs: DataFrame, machine: Classifier) -> DataFrame:
    """``docs`` (doc_id, text and any others, kept) with ``held_out, lang_pred, score`` in place of columns so named.

    Only the text is an input, and all of it. A null text, one without a letter, or any if nothing was learned is
    ``und`` with score 0; languages that tie go to the first by name. Null and repeated doc_ids stay; an empty table
    gives no rows.
    """

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        found, scores = machine.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": found, "score": scores})

    out = docs.withColumn("__found", of("text")).withColumns({"held_out": held_out(F.col("doc_id")), "lang_pred": F.col("__found.lang_pred"), "score": F.col("__found.score")})
    return out.drop("__found")
