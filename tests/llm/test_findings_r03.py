"""Cases of the findings of round 3 on the training-data operators."""

from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa

from labelflow.llm import language_model, packing
from labelflow.llm.common import folded_words

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def test_chunks_of_a_part_are_encoded_in_one_call():
    """A part's Latin chunks were looked up and kept one by one in a table of Python's, which was emptied and learnt anew."""
    cache = packing.chunk_ids(BYTE)
    cache.clear()
    texts = [None, "", " ", "a  b", "One two,\nthree four's <|x|> über ɐb 12.5%% 中文 end. a\n", "tail two, of\x85 rare zyxwv", "two, 中文 é\x1c", *[f"w{i} is w{i % 7}" for i in range(300)]]
    asked, fast = [], cache.fast
    cache.fast = lambda text: asked.append(text) or fast(text)
    try:
        got = list(packing.encoded(texts, BYTE))
    finally:
        cache.fast = fast
    assert got == [cache.encode(t) if t else b"" for t in texts]
    assert sum(" zyxwv" in x for x in asked) == 1 and "zyxwv" not in cache and "is" not in cache and "中文" in cache


def test_language_model_words_by_arrow():
    """Texts were cut into words and numbered one by one in Python's tables. Arrow's cut is the same, END before and after."""
    texts = ["a B  c", "", "  ", "\n x\ty \x0b\x0c\r Z ", "É Ä\x1cq\x85w\xa0e \x00 a", "x", "Σ İ K"]
    words, edges = language_model._tokens(pa.array(texts))
    want = [[b"", *folded_words(t), b""] for t in texts]
    assert [x.encode() for x in words.to_pylist()] == [x for t in want for x in t] and edges.tolist() == np.cumsum([0, *map(len, want)]).tolist()
    g = language_model._Gathered()
    assert [*g.add_all(pa.array(texts[:3])), *g.add_all(pa.array(texts[3:]))] == [len(t) - 1 for t in want]
    assert [[list(g.ids)[k] for k in t] for t in g.texts] == want and g.texts[0].dtype == np.int32


def test_language_model_texts_in_parts(spark, monkeypatch):
    """A part of texts holds the bytes that it is allowed, or one text; each text counts once, whatever the parts."""
    docs = spark.createDataFrame([(k, None if k % 9 == 0 else f"a B w{k % 4} c " * (k % 5)) for k in range(60)], "doc_id long, text string").coalesce(1)
    assert {r.w: r.n for r in language_model.token_counts(docs).collect()} == Counter(w.decode() for r in docs.collect() for w in [*folded_words(r.text), b""])
    monkeypatch.setattr(language_model, "CUT", 11)
    cuts = lambda *n: list(language_model._cuts(pa.array(["x" * k for k in n], pa.string())))
    assert cuts(5, 5, 30, 1) == [(0, 1), (1, 2), (2, 3), (3, 4)] and cuts(4, 4, 0, 1) == [(0, 3), (3, 4)] and cuts() == []
