"""Operator 2: toxicity by a counterfactual-regularised linear classifier.

A text's features are the words it holds (lower-cased, marks stripped) and the first letters of longer words, hashed.
For each labelled text that names a group of people, a counterfactual is made by swapping every identity term for
another one of its kind; the loss adds lam times the squared change of the score, so that a neutral mention of a group
does not raise it. Weights are fitted by proximal gradient steps with an absolute penalty.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.llm.common import WORD, labelled_sample, scored

BITS = 18
#: At most so many labelled documents are fitted on.
SAMPLE = 12_000
#: Lengths of the word beginnings that count as features.
BEGINNINGS = (4, 5)
#: Features of labelled texts that a step of training works on at a time.
BLOCK = 250_000
#: Words a worker remembers before it starts anew.
CACHE_ENTRIES = 200_000
#: Identity terms by kind; a term is swapped for the next of its kind.
IDENTITY = [
    "women men girls boys transgender nonbinary".split(),
    "woman man girl boy".split(),
    "muslims christians jews hindus buddhists atheists".split(),
    "muslim christian jewish hindu buddhist atheist".split(),
    "black white asian latino indigenous arab".split(),
    "gay straight lesbian bisexual queer heterosexual".split(),
    "immigrants refugees natives foreigners".split(),
    "african european american mexican chinese indian".split(),
    "disabled deaf blind autistic".split(),
    "frauen männer".split(),
    "muslime christen juden".split(),
    "femmes hommes".split(),
    "musulmans chrétiens juifs".split(),
    "mujeres hombres".split(),
    "musulmanes cristianos judíos".split(),
]
SWAP = {w: kind[(i + 1) % len(kind)] for kind in IDENTITY for i, w in enumerate(kind)}


class _Words(dict):
    """raw word -> (bare word, hashed places)."""

    def __missing__(self, word: str) -> tuple[str, tuple[int, ...]]:
        bare = word.lower()
        while bare and not bare[0].isalnum():
            bare = bare[1:]
        while bare and not bare[-1].isalnum():
            bare = bare[:-1]
        parts = [f"w {bare}"] + [f"{n} {bare[:n]}" for n in BEGINNINGS if len(bare) > n and bare.isalpha()] if bare else []
        out = bare, tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) >> (32 - BITS) for p in parts)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out


@functools.lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def places(words: set[str]) -> np.ndarray:
    cache = _words()
    return np.unique(np.fromiter((p for w in words for p in cache[w][1]), np.int32))


def features(text: str) -> tuple[np.ndarray, np.ndarray | None]:
    """Places of a text and, where it holds identity terms, those of its counterfactual."""
    words = set(WORD.findall(text))
    cache = _words()
    named = {w for w in words if cache[w][0] in SWAP}
    return places(words), places(words - named | {SWAP[cache[w][0]] for w in named}) if named else None


def train(rows: list[tuple[np.ndarray, np.ndarray | None, int]], lam: float = 1.0, l1: float = 3e-4, steps: int = 120, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights (2^BITS) and bias. Places that fewer than three texts hold get no weight. Without rows: zeros, bias 0."""
    size = 1 << BITS
    if not rows:
        return np.zeros(size, np.float32), 0.0
    df = np.zeros(size, np.int64)
    for at, _, _ in rows:
        df[at] += 1
    used = np.flatnonzero(df >= min(3, len(rows)))
    index = np.full(size, -1, np.int32)
    index[used] = np.arange(len(used))

    def flat(lists):
        many = [int((index[a] >= 0).sum()) for a in lists]
        out, at = np.empty(sum(many), np.int32), 0
        for a, k in zip(lists, many):
            out[at : at + k] = index[a][index[a] >= 0]
            at += k
        return out, np.array(many, np.int64)

    def numbered(many):
        return np.repeat(np.arange(len(many), dtype=np.int32), many)

    at, many = flat([a for a, _, _ in rows])
    ends = np.concatenate([[0], np.cumsum(many)])
    # Texts a block: copies that a step makes of features are as large as a block, not as the sample.
    cuts = np.unique(np.concatenate([np.searchsorted(ends, np.arange(0, len(at), BLOCK)), [len(rows)]]))
    blocks = [(a, b, at[ends[a] : ends[b]]) for a, b in zip([0, *cuts], cuts) if b > a]
    y = np.array([t for _, _, t in rows], np.float64)
    pairs = [(a, c) for a, c, _ in rows if c is not None]
    out_at, out_row = flat([np.setdiff1d(a, c) for a, c in pairs])
    in_at, in_row = flat([np.setdiff1d(c, a) for a, c in pairs])
    out_row, in_row = numbered(out_row), numbered(in_row)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)) ** 0.5
    w, b, g2, gb2 = np.zeros(len(used)), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), np.full(len(used), 1e-8), 1e-8
    n = len(rows)
    for _ in range(steps):
        single, r, g = w.astype(np.float32), np.empty(n, np.float32), np.zeros(len(used))
        for lo, hi, here in blocks:
            row = numbered(many[lo:hi])
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, single[here], hi - lo) + b, -35, 35)))
            r[lo:hi] = weight[lo:hi] * (p - y[lo:hi]) / n
            np.add.at(g, here, r[lo:hi].astype(np.float64)[row])
        if pairs:
            d = (np.bincount(in_row, w[in_at], len(pairs)) - np.bincount(out_row, w[out_at], len(pairs))) * (2 * lam / n)
            g += np.bincount(in_at, d[in_row], len(used)) - np.bincount(out_at, d[out_row], len(used))
        gb = r.sum()
        g2 += g * g
        gb2 += gb * gb
        step = rate / np.sqrt(g2)
        w -= step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b -= rate * gb / np.sqrt(gb2)
    full = np.zeros(size, np.float32)
    full[used] = w
    return full, float(b)


def fit(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = (5, 0), sample: int = SAMPLE, lam: float = 1.0) -> tuple[np.ndarray, float]:
    """The model from at most `sample` labelled documents; their places alone come to the driver. Null doc_ids and labels
    teach nothing, a null text is an empty one, repeated rows count each; an empty table or one without labels gives zero
    weights and bias 0."""

    def run(batches):
        for batch in batches:
            f = [features(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.tobytes() for a, _ in f], pa.binary()), pa.array([None if c is None else c.tobytes() for _, c in f], pa.binary())], names=["doc_id", "y", "at", "cf"])

    got = labelled_sample(docs, labels, "toxic", sample, held_out).select(F.col("doc_id").cast("bigint"), "_label", "_text").mapInArrow(run, "doc_id bigint, y int, at binary, cf binary").toArrow()
    y, at, cf = (got.column(k) for k in ("y", "at", "cf"))
    view = lambda x: np.frombuffer(x.as_buffer(), np.int32) if x.is_valid else None
    return train([(view(at[k]), view(cf[k]), y[k].as_py()) for k in pc.sort_indices(got, [("doc_id", "ascending"), ("y", "ascending")]).to_pylist()], lam)


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, score and predicted. A text is scored whole, however long; a null text scores as an empty one: the bias
    alone. Rows are scored one by one, repeated ones too, and a score of just the threshold is predicted 1; an empty table
    gives no rows. Columns other than keep and text are not read, and may have any name. The weights are broadcast:
    2^BITS numbers, whatever the corpus."""
    at = keep.index("text") if "text" in keep else len(keep)

    def scores(model, texts):
        w, b = model
        s = np.array([w[places(set(WORD.findall(t or "")))].sum() for t in texts], np.float64)
        return 1 / (1 + np.exp(-np.clip(s + b, -35, 35)))

    return scored(docs, model, scores, at, threshold, keep)
