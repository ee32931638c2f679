"""Language identification (operator 6): sparse multinomial logistic regression on TF-IDF character n-grams.

A text's features are hashed character n-grams (n = 1 to 3) of its letters, lower-cased, with any other run of
characters as one space; a feature's value is its share of the text's n-grams times its inverse document frequency.
Document frequencies come from all learnable documents. Weights are trained by follow-the-regularised-leader (FTRL-
proximal) with L1 and L2 penalties on a bounded sample, and a temperature is fitted on a part of it held back.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.llm.common import free_names, lean, with_columns_from

UNKNOWN = "und"
#: Features; documents that weights are trained on at most (the bound of the sample), characters in a row of them handled at a time.
FEATURES, SAMPLE, SPAN = 1 << 16, 4000, 1 << 20
_ORDERS = (1, 2, 3)


def _letters() -> np.ndarray:
    """For each code point its lower-case form if it is a letter or a mark, else a space."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        if 0xD800 <= c <= 0xDFFF:
            continue
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LM":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Features:
    _table: np.ndarray | None = None
    _is_letter: np.ndarray

    def __init__(self):
        if Features._table is None:
            Features._table = _letters()
            Features._is_letter = np.zeros(len(Features._table), bool)
            Features._is_letter[[c for c in np.unique(Features._table).tolist() if unicodedata.category(chr(c))[0] == "L"]] = True

    def __call__(self, text: str | None) -> np.ndarray | None:
        """Hashed n-grams in order, or None if the text has no letter."""
        if not text:
            return None
        c = self._table[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        gap = c == 32
        if not self._is_letter[c].any():  # marks alone are no letters
            return None
        c = np.concatenate(([32], c[~(gap & np.concatenate(([False], gap[:-1])))], [32])).astype(np.uint32)
        out, h = [], np.zeros(len(c), np.uint32)
        for n in _ORDERS:
            h = (h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] * np.uint32(0x9E3779B1)) ^ np.uint32(n)
            mixed = h * np.uint32(0x85EBCA6B)
            out.append(mixed >> np.uint32(32 - FEATURES.bit_length() + 1))
        return np.concatenate(out)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features, counts, langs = Features(), np.zeros(FEATURES, np.int64), {}
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            if (f := features(text)) is not None:
                counts[np.unique(f)] += 1
                langs[lang] = langs.get(lang, 0) + 1
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array([None] * len(at) + list(langs), pa.string()), pa.array([*at.tolist(), *[-1] * len(langs)], pa.int32()), pa.array([*counts[at].tolist(), *langs.values()], pa.int64())], ["lang", "feature", "n"])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        keep, ids, shares = [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            if (f := features(text)) is not None:
                u, c = np.unique(f, return_counts=True)
                keep.append(i), ids.append(u.astype(np.int32).tobytes()), shares.append((c / len(f)).astype(np.float32).tobytes())
        part = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("h"), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], ["lang", "h", "ids", "shares"])


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # feature x language, times the inverse document frequency
    bias: np.ndarray
    temperature: float

    def predict(self, f: np.ndarray | None) -> tuple[str, float]:
        if f is None or not self.langs:
            return UNKNOWN, 0.0
        z = np.zeros(len(self.langs))
        for i in range(0, len(f), SPAN):
            z += self.weights[f[i : i + SPAN]].sum(0, dtype=np.float64)
        p = softmax((z / len(f) + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train_ftrl(examples: list[tuple[int, np.ndarray, np.ndarray]], classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, epochs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal per coordinate: z and n of each weight; a weight is zero while |z| <= l1. The last row is the bias."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for y, ids, values in examples:
            at, x = np.append(ids, FEATURES), np.append(values, 1.0)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
    w = weights(z, n)
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least negative log likelihood, by golden section over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    a, b, g = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def equal_parts(langs: dict[str, int], sample: int) -> dict[str, int]:
    """How many of each language's documents are drawn: `sample` in equal parts, what a language lacks going to the others; one at least."""
    parts, left = {}, sample
    for i, (lang, n) in enumerate(sorted(langs.items(), key=lambda x: (x[1], x[0]))):
        parts[lang] = min(n, max(1, left // (len(langs) - i)))
        left -= parts[lang]
    return parts


def _drawn(learnable: DataFrame, langs: dict[str, int], sample: int) -> list[Row]:
    """(lang, rank, ids, shares): of each language the documents of the smallest |h|, as many as equal_parts says, in a mixed order."""

    def draw(parts: dict[str, int], shares: dict[str, float]) -> list[Row]:
        of = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])[F.col("lang")]
        near = F.abs(F.col("h") / float(1 << 63))
        found = learnable.filter(F.col("lang").isin(list(parts)) & (near <= of(shares))).mapInArrow(lean(_examples), "lang string, h long, ids binary, shares binary")
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(near, "h")))
        return found.filter(F.col("rank") <= of(parts)).orderBy(F.xxhash64("h"), "h").select("lang", "rank", "ids", "shares").collect()

    parts = equal_parts(langs, sample)
    # Six standard deviations more than are wanted come within these shares, unless many rows repeat a hash.
    drawn = draw(parts, {lang: min(1.0, (n + 6 * n**0.5 + 20) / langs[lang]) for lang, n in parts.items()})
    got = Counter(r.lang for r in drawn)
    if short := {lang: n for lang, n in parts.items() if got[lang] < n}:
        drawn = [r for r in drawn if r.lang not in short] + draw(short, dict.fromkeys(short, 1.0))
    return drawn


def train(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from text and lang of documents(doc_id, text, lang) that aren't held out and have a lang.

    Inverse document frequencies cover all of them; weights are fitted on at most `sample` (each language's of the
    smallest hashes of id and text, with languages drawn in equal parts as far as they go, but one of each at least) and
    every fifth of a language's sets the temperature. No such document gives a model that knows no language.
    """
    learnable = documents.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    rows = learnable.select("text", "lang").mapInArrow(lean(_document_frequencies), "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).collect()  # a row for each feature and language at most
    langs = {r.lang: r.n for r in rows if r.feature < 0}
    if not langs:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros(0), 1.0)
    df = np.zeros(FEATURES)
    for r in rows:
        if r.feature >= 0:
            df[r.feature] = r.n
    names, total = sorted(langs), sum(langs.values())
    idf = np.log((1 + total) / (1 + df)) + 1
    held, kept = [], []
    for r in _drawn(learnable, langs, sample):
        ids = np.frombuffer(bytes(r.ids), np.int32)
        (kept if r["rank"] % 5 else held).append((names.index(r.lang), ids, np.frombuffer(bytes(r.shares), np.float32) * idf[ids] * 10))
    weights, bias = train_ftrl(kept, len(names))
    logits = np.array([x @ weights[ids] + bias for _, ids, x in held])
    temperature = fit_temperature(logits, np.array([y for y, _, _ in held]))
    return Model(names, (weights * idf[:, None] * 10).astype(np.float32), bias, temperature)


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """documents with two columns more, language and score; `und` with score 0 if the text is null or has no letter, or the model knows nothing.

    They are called __lang and __score, lengthened by underscores where documents has such columns.
    """
    lang, score = free_names(documents, "__lang", "__score")
    known = documents.sparkSession.sparkContext.broadcast(model)

    def start():
        features, m = Features(), known.value

        def run(texts: list[str | None]) -> list[pa.Array]:
            found = [m.predict(features(t)) for t in texts]
            return [pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())]

        return run

    return with_columns_from(documents, "text", start, [lang, score], f"{lang} string, {score} double")


def language_digests(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row."""
    found = identify(documents.select("doc_id", "text"), train(documents))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def keep_identified(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """documents whose language is known at a score of `least` or more; all columns stay as they are."""
    found = identify(documents, train(documents))
    lang, score = found.columns[-2:]
    return found.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).drop(lang, score)
