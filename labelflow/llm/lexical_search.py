"""Operator 11: ranked lexical search with integer impacts, by sort-based accumulation.

One pass over the texts counts terms and keeps, block by block of documents, the postings of the queries' terms. With the
sums over all blocks (documents N, terms L, documents a term df) a second pass over the blocks gives every posting its
impact, concatenates an (item, document, impact) entry for each item that has its term, radix sorts the entries by a
packed key of item and document and adds up runs of equal keys by numpy's reduceat. A task keeps its k best documents an
item in heaps; theirs are dealt by ranges of (item, hash) and selected again, then by ranges of items.

Items are worked off in groups of about PAIRS (item, term) pairs, so that what is broadcast and collected (the terms of a
group, their weights and items) has that bound, whatever the number of items.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.llm.common import discard, materialise, with_row_id

#: (item, term) pairs of a group of items; one item with more is a group of its own.
PAIRS = 1_000_000
#: Documents of a block, and postings after which a block ends.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 13, 1 << 20
#: Entries sorted at once (more only for a single document).
ENTRIES = 1 << 21
#: Bytes of a text that are split at once.
PART = 1 << 20

#: All but 0-9, A-Z, a-z and what is not ASCII separates terms; A-Z is lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(text: bytes | None) -> Counter:
    """Terms of a whole UTF-8 text with their numbers."""
    folded, counts, at = (text or b"").translate(_FOLD), Counter(), 0
    while at < len(folded):
        end = folded.find(b" ", at + PART)
        end = len(folded) if end < 0 else end
        counts.update(folded[at:end].split())
        at = end
    return counts


def impact_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def item_terms(items: DataFrame, item_key: str, text: str) -> DataFrame:
    """(item, terms): the distinct terms of each item's whole text."""

    def run(batches):
        for batch in batches:
            terms = [sorted(term_counts(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], names=["item", "terms"])

    kind = items.schema[item_key].dataType.simpleString()
    rows = items.select(F.col(f"`{item_key}`").alias("item"), F.col(f"`{text}`").cast("string").cast("binary").alias("t"))
    return rows.mapInArrow(run, f"item {kind}, terms array<binary>")


def posting_blocks(docs: DataFrame, doc_key: str, text: str, number: dict[bytes, int]) -> DataFrame:
    """A row per block: n_docs and n_terms (of all its documents), the documents with a posting (doc, their n, where their
    postings end), the postings (tid, tf), and in how many documents each term is (df_tid, df_n)."""
    sent = docs.sparkSession.sparkContext.broadcast(number)
    kind = docs.schema[doc_key].dataType.simpleString()
    names = ["n_docs", "n_terms", "doc", "n", "ends", "tid", "tf", "df_tid", "df_n"]

    def run(batches):
        known = sent.value.get
        docs, lengths, ends, tids, tfs, seen, total = [], [], [], [], [], 0, 0

        def block(kind_of):
            n, c = np.unique(np.array(tids, np.int32), return_counts=True)
            raw = [np.array(x, t).tobytes() for x, t in ((lengths, np.int64), (ends, np.int32), (tids, np.int32), (tfs, np.int64))]
            return pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([total]), pa.array([docs], pa.list_(kind_of)), *(pa.array([r], pa.binary()) for r in raw), pa.array([n], pa.list_(pa.int32())), pa.array([c], pa.list_(pa.int64()))], names=names)

        kind_of = None
        for batch in batches:
            kind_of = batch.schema.field(0).type
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = term_counts(data)
                if not counts:
                    continue
                n = counts.total()
                seen, total = seen + 1, total + n
                hits = [(t, c) for w, c in counts.items() if (t := known(w)) is not None]
                if hits:
                    docs.append(doc)
                    lengths.append(n)
                    tids += [t for t, _ in hits]
                    tfs += [c for _, c in hits]
                    ends.append(len(tids))
                if len(docs) >= BLOCK_DOCS or len(tids) >= BLOCK_POSTINGS:
                    yield block(kind_of)
                    docs, lengths, ends, tids, tfs, seen, total = [], [], [], [], [], 0, 0
        if seen:
            yield block(kind_of)

    rows = docs.select(F.col(f"`{doc_key}`").alias("doc"), F.col(f"`{text}`").cast("string").cast("binary").alias("t"))
    return rows.mapInArrow(run, f"n_docs bigint, n_terms bigint, doc array<{kind}>, n binary, ends binary, tid binary, tf binary, df_tid array<int>, df_n array<bigint>")


def radix_order(keys: np.ndarray) -> np.ndarray:
    """Stable order of unsigned keys, 16 bits a pass (numpy sorts 16-bit integers by radix)."""
    order, bits = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable"), 16
    top = int(keys.max()) if len(keys) else 0
    while top >> bits:
        order = order[np.argsort((keys[order] >> bits & 0xFFFF).astype(np.uint16), kind="stable")]
        bits += 16
    return order


def _worst_last(row: tuple) -> tuple:
    """Order of (score, doc): larger scores first, then smaller documents, null last."""
    return -row[0], row[1] is None, row[1] if row[1] is not None else 0


class Best:
    """The k best (score, doc) of each item so far."""

    def __init__(self, k: int):
        self.k, self.rows = k, {}

    def add(self, item: int, rows: list[tuple]) -> int:
        """Adds rows of an item; the score below which no further row can be among the best."""
        held = self.rows[item] = heapq.nsmallest(self.k, self.rows.get(item, []) + rows, key=_worst_last)
        return held[-1][0] if len(held) == self.k else 1


def block_scores(lengths, ends, tids, tfs, weights, starts, items_of, n_docs: int, n_terms: int):
    """Yields (item, position of the document in the block, score) of a block, as arrays, some documents at a time.
    weights: by term; starts, items_of: the items of each term one after the other."""
    doc = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    m = 50 + 50 * lengths * n_docs // n_terms
    impact = weights[tids] * (1_000_000_000 * tfs // (1000 * tfs + 20 * m[doc]))
    fan = np.diff(starts)[tids]
    upto = np.cumsum(np.r_[0, fan])[np.r_[0, ends]]
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + ENTRIES, "right")) - 1)
        a, b = ends[first - 1] if first else 0, ends[last - 1]
        n = fan[a:b]
        post = np.repeat(np.arange(a, b), n)
        item = items_of[starts[tids[post]] + np.arange(len(post)) - np.repeat(np.cumsum(n) - n, n)]
        bits = BLOCK_DOCS.bit_length()
        keys = item.astype(np.uint64) << bits | doc[post].astype(np.uint64)
        order = radix_order(keys)
        keys, values = keys[order], impact[post[order]]
        heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        if len(heads):
            yield (keys[heads] >> bits).astype(np.int64), (keys[heads] & ((1 << bits) - 1)).astype(np.int64), np.add.reduceat(values, heads)
        first = last


def _best_of_blocks(blocks: DataFrame, kind: str, k: int, sent) -> DataFrame:
    """(item, doc, score): the k best of each item in each task."""

    def run(batches):
        weights, starts, items_of, n_items, n_docs, n_terms = sent.value
        best, floor, kind_of = Best(k), np.ones(n_items, np.int64), None
        for batch in batches:
            kind_of = batch.schema.field(0).type.value_type
            for row in batch.to_pylist():
                docs = row["doc"]
                place = np.empty(len(docs), np.int64)
                place[sorted(range(len(docs)), key=lambda i: _worst_last((0, docs[i])))] = np.arange(len(docs))
                raw = [np.frombuffer(row[c], t) for c, t in (("n", np.int64), ("ends", np.int32), ("tid", np.int32), ("tf", np.int64))]
                for item, at, score in block_scores(*raw, weights, starts, items_of, n_docs, n_terms):
                    on = score >= floor[item]
                    item, at, score = item[on], at[on], score[on]
                    order = np.lexsort((place[at], -score, item))
                    item, at, score = item[order], at[order], score[order]
                    heads = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else []
                    for a, b in zip(heads, np.r_[heads[1:], len(item)]):
                        b = min(a + k, b)
                        floor[item[a]] = best.add(int(item[a]), [(s, docs[d]) for s, d in zip(score[a:b].tolist(), at[a:b].tolist())])
        flat = [(i, d, s) for i, rows in best.rows.items() for s, d in rows]
        for a in range(0, len(flat), 10_000):
            i, d, s = zip(*flat[a : a + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(d, kind_of), pa.array(s, pa.int64())], names=["item", "doc", "score"])

    return blocks.select("doc", "n", "ends", "tid", "tf").mapInArrow(run, f"item bigint, doc {kind}, score bigint")


def _selected(rows: DataFrame, kind: str, k: int) -> DataFrame:
    """(item, rank, doc, score): the k best of each item in each partition."""

    def run(batches):
        best, kind_of = Best(k), pa.int64()
        for batch in batches:
            kind_of, new = batch.schema.field(1).type, {}
            for i, d, s in zip(*(batch.column(c).to_pylist() for c in range(3))):
                new.setdefault(i, []).append((s, d))
            for i, found in new.items():
                best.add(i, found)
        flat = [(i, r, d, s) for i, rows in best.rows.items() for r, (s, d) in enumerate(rows, 1)]
        for a in range(0, len(flat), 10_000):
            i, r, d, s = zip(*flat[a : a + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(r, pa.int32()), pa.array(d, kind_of), pa.array(s, pa.int64())], names=["item", "rank", "doc", "score"])

    return rows.select("item", "doc", "score").mapInArrow(run, f"item bigint, rank int, doc {kind}, score bigint")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """item_key, rank (int from 1), doc_key, score: each item's k best documents with a score above 0, equal scores by
    ascending doc_key.

    Null and empty texts have no term: such documents do not count and such items have no rows. Whole texts count, however
    long. Rows are told apart, not keys: repeated documents are each ranked (in any order among rows that agree in key and
    score), repeated items each have their rows; null keys come after all others and keep being null. Empty tables give an
    empty result. Other columns are not read; the keys and the text have private names inside. Keys are integers or
    strings. The sums are 64-bit: 50 * terms of a document * documents must stay below 9.2e18."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    queries = materialise(with_row_id(materialised := materialise(item_terms(items, item_key, text), "items"), "row").where("size(terms) > 0"), "queries")
    discard(materialised)
    groups = 1 + (queries.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0] // PAIRS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    results = []
    for g in range(groups):
        rows = queries.where(F.pmod(F.xxhash64("row"), F.lit(groups)) == g).collect()
        if not rows:
            continue
        number: dict[bytes, int] = {}
        pairs = np.array([(number.setdefault(bytes(t), len(number)), i) for i, r in enumerate(rows) for t in r["terms"]], np.int64)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        starts = np.searchsorted(pairs[:, 0], np.arange(len(number) + 1))
        blocks = materialise(posting_blocks(docs, doc_key, text, number), "blocks")
        n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        df = blocks.select(F.inline(F.arrays_zip("df_tid", "df_n"))).groupBy("df_tid").agg(F.sum("df_n").alias("n")).collect()
        weights = np.zeros(len(number), np.int64)
        for t, n in df:
            weights[t] = impact_weight(n_docs, n)
        sent = spark.sparkContext.broadcast((weights, starts, pairs[:, 1].copy(), len(rows), n_docs, n_terms))
        found = materialise(_best_of_blocks(blocks, kind, k, sent), "found")
        discard(blocks)
        ranged = _selected(found.repartitionByRange(parts, "item", F.xxhash64("doc")), kind, k)
        last = _selected(ranged.repartitionByRange(parts, "item"), kind, k)
        ids = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], f"item bigint, _id {item_kind}")
        results.append(last.join(ids, "item").select(F.col("_id").alias(item_key), "rank", F.col("doc").alias(doc_key), "score"))
    if not results:
        return spark.createDataFrame([], f"`{item_key}` {item_kind}, rank int, `{doc_key}` {kind}, score bigint")
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out
