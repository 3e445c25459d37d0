"""Vector columns and embedders."""

from __future__ import annotations

import hashlib
import re
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that are made into vectors at a time.
EMBED_ROWS = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


class Embedder(Protocol):
    """What turns a text into a unit vector; loaded once per Python worker."""

    model_name: str
    dimension: int

    def embed(self, text: str) -> np.ndarray: ...


class HashingEmbedder:
    """Words hashed by MD5 into a fixed number of places, scaled to length one: a stand-in that needs no model file."""

    model_name = "hashing-md5"

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def embed(self, text: str) -> np.ndarray:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        """A row per text; a text without words has a vector without length."""
        out = np.zeros((len(texts), self.dimension))
        for row, t in zip(out, texts):
            words, n = np.unique(re.findall(r"[a-z0-9]+", (t or "").lower()), return_counts=True)
            np.add.at(row, [int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % self.dimension for w in words.tolist()], n)
        n = np.sqrt((out * out).sum(1))[:, None]
        return np.divide(out, n, out=out, where=n > 0).astype(np.float32)


def embed_rows(rows: DataFrame, text: str, embedder: Embedder, keep: tuple[str, ...]) -> DataFrame:
    """keep and vector: the texts of a column in batches of Arrow, EMBED_ROWS at a time where the embedder takes batches."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches):
        many = getattr(embedder, "embed_batch", None) or (lambda texts: np.stack([embedder.embed(t) for t in texts]))
        for batch in batches:
            for at in range(0, len(batch), EMBED_ROWS):
                part = batch.slice(at, EMBED_ROWS)
                x = np.asarray(many(part.column(len(keep)).to_pylist()), np.float32)
                places = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.ListArray.from_arrays(places, pa.array(x.ravel()))], names=[*keep, "vector"])

    return rows.select(*keep, text).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "vector array<float>"]))


def vector_to_bytes(vector: Column) -> Column:
    """Raw little-endian float32 bytes of a vector, for exports."""

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return run(vector)


def vector_from_bytes(blob: Column) -> Column:
    """Raw little-endian float32 bytes to a vector, for imports."""

    @F.pandas_udf("array<float>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else np.frombuffer(b, "<f4").tolist())

    return run(blob)
