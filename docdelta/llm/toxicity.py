"""Toxicity by multiple-instance learning with a noisy-or.

A document is a bag of sentences; p(document) = 1 - prod(1 - p(sentence)), with
p(sentence) a logistic model over hashed words and word beginnings, zero where no word of the model
occurs. Only document labels are needed.
A leak term takes up labels that no sentence explains, so that mislabelled
documents do not turn clean words toxic; it is left out when scoring. Sentences
with p of at least 0.5 are returned as the offending ones, with their places.

Defined cases
    null or empty text: no sentence, score 0; no labels of one class: every
    score is 0; repeated rows and ties: scored alike; empty table: no rows;
    extra columns are ignored.

Scale: the fit sees at most ``2 * per_class`` documents as hashed sentences
(bounded); scoring is one pass without shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docdelta.llm.labelled import held_out, sample

BITS = 18
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W_]+")


PREFIXES = (4, 5, 6)
#: Words whose weight a worker remembers.
KNOWN = 100_000


def hashed(word: str) -> list[int]:
    """Features of a word: itself, and its beginnings (insults are inflected and compounded)."""
    parts = [word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for p in parts]


def sentences(text: str | None) -> Iterator[tuple[int, int, set[str]]]:
    """(start, end, words) of every sentence that has a word."""
    for m in _SENTENCE.finditer(text or ""):
        words = set(_WORD.findall(m.group().lower()))
        if words:
            yield m.start(), m.end(), words


@dataclass
class Model:
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -30.0

    def sentence(self, words: set[str], known: dict[str, float]) -> float:
        z, told = self.bias, False
        for w in words:
            v = known.get(w)
            if v is None:
                v = known[w] = sum(self.weights.get(h, 0.0) for h in hashed(w))
            if v:
                z, told = z + v, True
        return 1 / (1 + exp(-z)) if told and z > -30 else 0.0

    def document(self, text: str | None, known: dict[str, float]) -> tuple[float, list[tuple[int, int, float]]]:
        """Score, and the sentences at or above one half."""
        clean, found = 0.0, []
        for start, end, words in sentences(text):
            p = self.sentence(words, known)
            clean += log1p(-min(p, 1 - 1e-12))
            if p >= 0.5:
                found.append((start, end, p))
        return 1 - exp(clean), found


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, y, words by sentence (hashed), sentence lengths."""
    for batch in batches:
        for i, y, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            bags = [sorted({h for w in words for h in hashed(w)}) for _, _, words in sentences(text)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int64()), pa.array([y], pa.int32()), pa.array([[w for b in bags for w in b]], pa.list_(pa.int32())), pa.array([[len(b) for b in bags]], pa.list_(pa.int32()))],
                names=["doc_id", "y", "words", "lengths"],
            )


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 1000, min_contexts: int = 5, min_z: float = 5.0, steps: int = 200) -> Model:
    """Learns sentence weights from document labels."""
    rows = sample(docs, labels, label, per_class).mapInArrow(_bags, "doc_id long, y int, words array<int>, lengths array<int>").toArrow()
    rows = rows.sort_by("doc_id")
    y = rows["y"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Model()
    words = rows["words"].combine_chunks().flatten().to_numpy().astype(np.int64)
    lengths = rows["lengths"].combine_chunks().flatten().to_numpy().astype(np.int64)
    per_doc = np.diff(rows["lengths"].combine_chunks().offsets.to_numpy())
    bag_of = np.repeat(np.arange(len(lengths)), lengths)
    doc_of_bag = np.repeat(np.arange(len(y)), per_doc)
    keep = _telling(words, bag_of, y[doc_of_bag], min_contexts, min_z)[words]
    words, bag_of = words[keep], bag_of[keep]
    vocab, at = np.unique(words, return_inverse=True)
    # A sentence without a telling word has p = 0, however many of them there are.
    told, bag_of = np.unique(bag_of, return_inverse=True)
    doc_of_bag = doc_of_bag[told]
    w, b, leak = np.zeros(len(vocab)), -3.0, -2.0
    m = np.zeros(len(vocab) + 2)
    v = np.zeros(len(vocab) + 2)
    for step in range(1, steps + 1):
        g = np.concatenate(gradient(w, b, leak, at, bag_of, doc_of_bag, y))
        g[: len(w)] += 2e-4 * w
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w -= move[:-2]
        b -= move[-2]
        leak = min(leak - move[-1], -0.2)
    return Model({int(k): float(x) for k, x in zip(vocab, w, strict=True) if abs(x) > 1e-3}, float(b))


def gradient(w: np.ndarray, b: float, leak: float, at: np.ndarray, bag_of: np.ndarray, doc_of_bag: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, list[float]]:
    """Of the mean negative log-likelihood of the documents: by weight, and by bias and leak.

    A document is clean if all its sentences and the leak are: its log-probability
    of that is the sum of their log-complements.
    """
    d, n = len(y), len(doc_of_bag)
    z = b + np.bincount(bag_of, weights=w[at], minlength=n)
    p, miss = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-leak))
    s = np.bincount(doc_of_bag, weights=-np.logaddexp(0, z), minlength=d) + np.log(1 - miss)
    e = np.minimum(np.exp(s), 1 - 1e-9)
    ds = y * e / (1 - e) - (1 - y)
    dz = -p * ds[doc_of_bag] / d
    return np.bincount(at, weights=dz[bag_of], minlength=len(w)), [dz.sum(), (-miss * ds).sum() / d]


def _telling(words: np.ndarray, bag_of: np.ndarray, toxic: np.ndarray, least: int, min_z: float) -> np.ndarray:
    """Which hashes stand in clearly more different sentences of toxic documents than of others.

    Equal sentences count once for each label, so that the copies of one
    mislabelled document do not speak for its words.
    """
    n = len(toxic)
    mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    begin = np.r_[0, np.flatnonzero(np.diff(bag_of)) + 1] if len(bag_of) else np.array([], int)
    code = np.zeros(n, np.uint64)
    if len(begin):
        code[bag_of[begin]] = np.add.reduceat(mixed, begin)
    counts = []
    for label in (1, 0):
        _, first = np.unique(np.where(toxic == label, code, np.uint64(0)), return_index=True)
        once = np.zeros(n, bool)
        once[first] = True
        once &= toxic == label
        counts += [np.bincount(words[once[bag_of]], minlength=1 << BITS), max(1, once.sum())]
    a, n1, c, n0 = counts
    p = (a + c) / (n1 + n0)
    z = (a / n1 - c / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    return (a >= least) & (z >= min_z)


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            got = []
            for text in batch.column(1):
                got.append(model.document(text.as_py(), known))
                if len(known) > KNOWN:
                    known.clear()
            spans = [[{"start": a, "stop": b, "score": p} for a, b, p in found] for _, found in got]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "offending"])

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the offending sentences (code points, end exclusive) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(model), "doc_id long, score double, offending array<struct<start:int,stop:int,score:double>>")


def _filter(model: Model, threshold: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            clean = []
            for text in batch.column(batch.schema.get_field_index("text")):
                clean.append(model.document(text.as_py(), known)[0] < threshold)
                if len(known) > KNOWN:
                    known.clear()
            yield batch.filter(pa.array(clean, pa.bool_()))

    return keep


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows that score below the threshold, with all their columns."""
    return docs.mapInArrow(_filter(model, threshold), docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how: int) -> DataFrame:
    """Contract columns of the query, and the offending sentences."""
    rows = score(docs, fit(docs, labels, **how))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")
