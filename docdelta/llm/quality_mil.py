"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded (shares of
character classes, word statistics, repetition inside the passage and against
earlier ones; one tanh layer on top), gated attention weights are learned from
document labels, and the weighted passage representation is scored.

Defined cases
    null or empty text: one empty passage, scored like any other; no labels of
    one class: every score is the share of label 1; repeated rows and ties:
    scored alike; empty table: no rows; extra columns are ignored.

Scale: the fit sees at most ``2 * per_class`` documents (bounded), as passage
vectors; scoring is one pass without shuffle over whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docdelta.llm.labelled import held_out, sample

PASSAGE = 64
#: Passages that a worker holds before it scores them.
HELD = 4096
_LOWER = bytes(range(97, 123))
_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_MARKS = b"#*$%&"
_TABLE = b"|<>"
_LOUD = b"!?"
_STOPS = b".,;:'\"()-"
_HIGH = bytes(range(128, 256))
_CLASSES = (_LOWER, _UPPER, _DIGIT, _MARKS, _TABLE, _LOUD, _STOPS, _HIGH)
FEATURES = len(_CLASSES) + 9


def encode(text: str | None) -> list[list[float]]:
    """One vector per passage; at least one passage."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: set[bytes] = set()
    out = []
    for low in range(0, max(1, len(words)), PASSAGE):
        part = words[low : low + PASSAGE]
        body = b" ".join(part)
        n, size = max(1, len(part)), max(1, len(body))
        shares = [(size - len(body.translate(None, c))) / size if body else 0.0 for c in _CLASSES]
        kinds = Counter(part)
        triples = [body_ for body_ in map(b" ".join, zip(part, part[1:], part[2:]))]
        fresh = set(triples)
        again = sum(t in seen for t in triples) / max(1, len(triples))
        seen |= fresh
        lengths = [len(w) for w in part]
        mean = sum(lengths) / n
        out.append(
            shares
            + [
                len(kinds) / n,
                len(fresh) / max(1, len(triples)),
                again,
                min(mean / 20, 2.0),
                sum(x <= 3 for x in lengths) / n,
                sum(x >= 14 for x in lengths) / n,
                max(kinds.values(), default=0) / n,
                len(part) / PASSAGE,
                1.0 if len(words) < 50 else 0.0,
            ]
        )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, dict]:
        """Scores of bags whose passages lie one behind the other."""
        p = self.p
        bag = np.repeat(np.arange(len(counts)), counts)
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, begin)[bag])
        a = e / np.add.reduceat(e, begin)[bag]
        z = np.add.reduceat(a[:, None] * h, begin)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return s, {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "bag": bag}


def gradient(model: Model, x: np.ndarray, begin: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy of the bags, by parameter."""
    p = model.p
    s, o = model.forward(x, begin, counts)
    ds = (s - y) / len(y)
    dz = ds[:, None] * p["c"]
    dh = o["a"][:, None] * dz[o["bag"]]
    da = (o["h"] * dz[o["bag"]]).sum(1)
    de = o["a"] * (da - np.add.reduceat(o["a"] * da, begin)[o["bag"]])
    dt = de[:, None] * p["w"] * o["g"] * (1 - o["t"] ** 2)
    dg = de[:, None] * p["w"] * o["t"] * o["g"] * (1 - o["g"])
    dh = (dh + dt @ p["V"].T + dg @ p["U"].T) * (1 - o["h"] ** 2)
    return {
        "W": o["x"].T @ dh, "b": dh.sum(0), "V": o["h"].T @ dt, "U": o["h"].T @ dg,
        "w": ((o["t"] * o["g"]) * de[:, None]).sum(0), "c": o["z"].T @ ds, "d": np.array([ds.sum()]),
    }


def _train(x: np.ndarray, counts: np.ndarray, y: np.ndarray, hidden: int, gate: int, steps: int, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    begin = np.r_[0, np.cumsum(counts)[:-1]]
    p = {
        "W": rng.normal(0, 0.3, (x.shape[1], hidden)), "b": np.zeros(hidden), "V": rng.normal(0, 0.3, (hidden, gate)), "U": rng.normal(0, 0.3, (hidden, gate)),
        "w": rng.normal(0, 0.3, gate), "c": rng.normal(0, 0.3, hidden), "d": np.zeros(1),
    }
    model = Model(x.mean(0), np.maximum(x.std(0), 0.01), p)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(w) for k, w in p.items()}
    for step in range(1, steps + 1):
        grad = gradient(model, x, begin, counts, y)
        for k in p:
            g = grad[k] + 1e-4 * p[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p[k] -= 0.03 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return model


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, y, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            flat = [v for row in encode(text) for v in row]
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([y], pa.int32()), pa.array([flat], pa.list_(pa.float32()))], names=["doc_id", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2000, hidden: int = 16, gate: int = 8, steps: int = 250, seed: int = 1) -> Model | float:
    """A model, or the share of label 1 where only one class is known."""
    rows = sample(docs, labels, label, per_class).mapInArrow(_vectors, "doc_id long, y int, x array<float>").toArrow().sort_by("doc_id")
    y = rows["y"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    lists = rows["x"].combine_chunks()
    x = lists.flatten().to_numpy().astype(float).reshape(-1, FEATURES)
    return _train(x, np.diff(lists.offsets.to_numpy()) // FEATURES, y, hidden, gate, steps, seed)


def _scorer(model: Model | float):
    def scores(bags: list[list[list[float]]]) -> np.ndarray:
        if isinstance(model, float):
            return np.full(len(bags), model)
        counts = np.array([len(b) for b in bags])
        return model.forward(np.array([v for b in bags for v in b]), np.r_[0, np.cumsum(counts)[:-1]], counts)[0]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, held, bags = 0, 0, []
            for row in range(batch.num_rows):
                bags.append(encode(batch.column(1)[row].as_py()))
                held += len(bags[-1])
                if held >= HELD or row == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(bags)), pa.array(scores(bags), pa.float64())], names=["doc_id", "score"])
                    low, held, bags = row + 1, 0, []

    return score


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id and score of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(model), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how: int) -> DataFrame:
    """Contract columns of the query."""
    rows = score(docs, fit(docs, labels, **how))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
