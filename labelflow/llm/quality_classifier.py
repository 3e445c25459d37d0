"""Operator 3: quality by logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Features are the uni- and bigrams of words, and the uni-, bi- and trigrams of word shapes (case, marks around the
letters, equal to the word before), hashed into 2^BITS places; a text is a sparse vector of damped counts of length
one, and its score the logistic function of its dot product with the weights.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.llm.common import WORD, labelled_sample, remainder_column, scored

BITS = 18
#: At most so many labelled documents are fitted on.
SAMPLE = 8_000
_MARKS = re.compile(r"[^\W\d_]+")
#: Words a worker remembers before it starts anew.
CACHE_ENTRIES = 400_000


def shape(word: str) -> str:
    """Letters become X (upper case), Xx (capitalised) or x; up to four of the marks around them stay."""
    def letters(m):
        w = m[0]
        return "x" if w.islower() or not w.isupper() and not w[0].isupper() else "X" if w.isupper() and len(w) > 1 else "Xx"

    return _MARKS.sub(letters, re.sub(r"\d+", "0", word))[:8]


class _Words(dict):
    """word -> (hash of it, hash of its shape), as 32-bit integers in one 64-bit integer."""

    def __missing__(self, word: str) -> int:
        data = word.encode("utf-8", "surrogatepass")
        out = zlib.crc32(data) << 31 ^ zlib.crc32(shape(word[:64]).encode("utf-8", "surrogatepass")) >> 1
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if len(data) <= 64:
            self[word] = out
        return out


@functools.lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text, places ascending; both empty for a text without words."""
    words = WORD.findall(text)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    cache = _words()
    both = np.fromiter((cache[w] for w in words), np.int64, len(words)).astype(np.uint64)
    word, form = both >> np.uint64(31), both & np.uint64(0x7FFFFFFF)
    form[1:] ^= (word[1:] == word[:-1]).astype(np.uint64) << np.uint64(33)
    k1, k2 = np.uint64(0x100000001B3), np.uint64(0xC2B2AE3D27D4EB4F)
    grams = [_mixed(word, 1), _mixed(form, 3)]
    if len(words) > 1:
        grams += [_mixed(word[:-1] * k1 + word[1:], 2), _mixed(form[:-1] * k1 + form[1:], 4)]
    if len(words) > 2:
        grams.append(_mixed((form[:-2] * k1 + form[1:-1]) * k2 + form[2:], 5))
    at, n = np.unique(np.concatenate(grams).astype(np.int32), return_counts=True)
    value = np.log1p(n)
    return at, (value / np.sqrt((value * value).sum())).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias by follow-the-regularised-leader updates, one document after the other. Without rows: zeros."""
    size = 1 << BITS
    z, n, b, bn = np.zeros(size), np.zeros(size), 0.0, 1.0
    order = np.random.default_rng(0)

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(w @ x + b, -35, 35))) - y
            gx = g * x
            n[at] = ni + gx * gx
            z[at] = zi + gx - (np.sqrt(n[at]) - np.sqrt(ni)) / alpha * w
            bn += g * g
            b -= 0.2 * g / np.sqrt(bn)
    return weights(z, n).astype(np.float32), float(b)


def fit(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = (4, 2), sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights (2^BITS) and bias from at most `sample` labelled documents; their sparse vectors come to the driver. Null
    doc_ids and labels teach nothing, a null text is an empty one, repeated rows count each; an empty table or one without
    labels gives zero weights and bias 0."""

    def run(batches):
        for batch in batches:
            f = [features(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.tobytes() for a, _ in f], pa.binary()), pa.array([v.tobytes() for _, v in f], pa.binary())], names=["doc_id", "y", "at", "x"])

    rows = labelled_sample(docs, labels, "quality", sample, held_out).select(F.col("doc_id").cast("bigint"), "_label", "_text").mapInArrow(run, "doc_id bigint, y int, at binary, x binary").toPandas()
    rows = rows.sort_values(["doc_id", "y"])
    return train([(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32), y) for a, x, y in zip(rows["at"], rows["x"], rows["y"])])


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.7, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, score and predicted. A text is scored whole, however long; a null text scores as an empty one: the bias
    alone. Rows are scored one by one, repeated ones too, and a score of just the threshold is predicted 1; an empty table
    gives no rows. Columns other than keep and text are not read, and may have any name. The weights are broadcast:
    2^BITS numbers, whatever the corpus."""
    at = keep.index("text") if "text" in keep else len(keep)

    def scores(model, texts):
        w, b = model
        s = np.array([w[at] @ x for at, x in (features(t or "") for t in texts)], np.float64)
        return 1 / (1 + np.exp(-np.clip(s + b, -35, 35)))

    return scored(docs, model, scores, at, threshold, keep)


def with_held_out(scored: DataFrame, modulus: int, remainder: int) -> DataFrame:
    return scored.withColumn("held_out", remainder_column("doc_id", modulus) == remainder)
