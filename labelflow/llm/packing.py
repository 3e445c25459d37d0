"""Operator 5: best-fit-decreasing packing of tokenised documents into sequences of a fixed capacity.

Best-fit decreasing depends on lengths alone, so the plan is made from the histogram of lengths (at most `capacity`
numbers, whatever the corpus holds): open bins are counted by remaining capacity, a segment tree over the capacities
finds the tightest one that fits in logarithmic time, and documents of one length that land in bins of one remaining
capacity are placed as one run. The plan's runs are broadcast (their number is bounded by the capacity, not by the
corpus); each piece finds its place from its rank among pieces of its length.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
import tiktoken

from labelflow.llm.bpe import BYTE_LEVEL_PATTERN, byte_alphabet
from labelflow.llm.common import in_parts, materialise, with_row_id

#: Entries a worker keeps before it starts anew; bounds memory, not results.
CACHE_ENTRIES = 400_000
#: A chunk that starts (after one space at most) and ends with something other than white space.
_WHOLE = re.compile(r" ?\S(?:.*\S)?\Z", re.DOTALL)
#: Sub-ranks per length, so that a length that many documents share is ranked by many tasks.
SALTS = 64


def rank_encoder(path: str):
    """The same byte-level vocabulary as ranks for tiktoken, which encodes Latin chunks in less time; None where the
    file's merges are not in the order of their ids, or it is not byte-level alone."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"]
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model.get("end_of_word_suffix") or any(a >= b for a, b in zip(made, made[1:])):
        return None
    bytes_of = {c: b for b, c in enumerate(byte_alphabet())}
    ranks = {bytes(map(bytes_of.__getitem__, t)): i for t, i in model["vocab"].items()}
    encoding = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: encoding.encode_to_numpy(text, disallowed_special=())


class ChunkIds(dict):
    """Chunk of text -> its ids as little-endian uint32; None for chunks that can't be encoded on their own.

    Texts are cut at single spaces between two other characters that are not white space: there a byte-level
    pre-tokeniser always starts a new token (which takes the space along), so chunks can be encoded apart. A key is what
    follows the space, or a space and what a text begins with. Latin chunks that follow a space are not kept: `table`
    encodes those of some texts in one call.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.fast = rank_encoder(path)
        vocab = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith(byte_alphabet()[32])]] = True

    def learn(self, keys: set[str]) -> None:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        slow, fast, encode = [], [], self.fast
        for c in keys.difference(self):
            if c[0:1] == " ":
                if _WHOLE.match(c, 1):
                    slow.append(c)
                else:
                    self[c] = None
            elif not c or c.strip() != c:
                self[c] = None
            elif encode and (c.isascii() or max(c) < "\u0250") and "<|" not in c:
                fast.append(c)
            else:
                slow.append(c)
        if fast:
            # All in one call: a token that begins with a space begins a chunk.
            ids = encode(" " + " ".join(fast)).astype("<u4")
            edges = [*(4 * np.flatnonzero(self.spaced[ids])).tolist(), 4 * len(ids)]
            data = ids.tobytes()
            self.update(zip(fast, [data[i:j] for i, j in zip(edges, edges[1:])], strict=True))
        for c, e in zip(slow, self.tokenizer.encode_batch([c[1:] if c[0] == " " else " " + c for c in slow], add_special_tokens=False)):
            self[c] = array("I", e.ids).tobytes()

    def table(self, chunks: pa.StringArray, firsts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids one after the other, and where each chunk's begin and how many there are (-1: can't be encoded on its own):
        distinct chunks that follow a space, then what texts begin with."""
        whole = pc.and_(pc.greater(pc.binary_length(chunks), 0), pc.equal(pc.utf8_trim_whitespace(chunks), chunks)).to_numpy(zero_copy_only=False)
        if self.fast:
            latin = whole & ~pc.match_substring(chunks, "<|").to_numpy(zero_copy_only=False)
            if _beyond_latin(chunks):
                latin &= np.fromiter((c.isascii() or max(c, default="") < "\u0250" for c in chunks.to_pylist()), bool, len(chunks))
        else:
            latin = np.zeros(len(chunks), bool)
        starts, lengths, ids = np.zeros(len(chunks) + len(firsts), np.int64), np.full(len(chunks) + len(firsts), -1), [np.zeros(0, "<u4")]
        if latin.any():
            # All in one call: a token that begins with a space begins a chunk.
            some = chunks.filter(pa.array(latin))
            ids = [self.fast(" " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), " ")[0].as_py()).astype("<u4")]
            edges = np.flatnonzero(self.spaced[ids[0]])
            if len(edges) != latin.sum():
                raise ValueError("the tokeniser does not start a token at each space")
            starts[: len(chunks)][latin], lengths[: len(chunks)][latin] = edges, np.diff(edges, append=len(ids[0]))
        rest = np.concatenate([np.flatnonzero(whole & ~latin), len(chunks) + np.arange(len(firsts))])
        keys = [*chunks.filter(pa.array(whole & ~latin)).to_pylist(), *firsts]
        self.learn(set(keys))
        found = [self[c] for c in keys]
        some = np.array([x is not None for x in found], bool)
        n = np.array([len(x) // 4 for x in found if x is not None], np.int64)
        starts[rest[some]], lengths[rest[some]] = len(ids[0]) + np.cumsum(n) - n, n
        return np.concatenate([*ids, np.frombuffer(b"".join(x for x in found if x), "<u4")]), starts, lengths

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def _beyond_latin(chunks: pa.StringArray) -> bool:
    """Whether any character is U+0250 or beyond, by the first bytes of UTF-8."""
    data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)
    return bool((data > 0xC9).any() or (data[1:][data[:-1] == 0xC9] > 0x8F).any())


@functools.lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


def encoded(texts: list, path: str, chars: int = 2_000_000):
    """Yields each text's ids as little-endian uint32 bytes; a null text has none. Arrow numbers the chunks of about chars
    characters of texts, and numpy puts their ids in the texts' order."""
    cache, at = chunk_ids(path), 0
    while at < len(texts):
        size, part = 0, []
        while at < len(texts) and (not part or size < chars):
            part.append(texts[at] or "")
            size += len(part[-1])
            at += 1
        cut = pc.split_pattern(pa.array(part, pa.string()), " ")
        edges = cut.offsets.to_numpy()
        chunks = cut.flatten().dictionary_encode()
        ids, starts, lengths = cache.table(chunks.dictionary, [" " + t.partition(" ")[0] for t in part])
        which = chunks.indices.to_numpy().astype(np.int64)
        which[edges[:-1]] = len(chunks.dictionary) + np.arange(len(part))
        n = lengths[which]
        broken = np.logical_or.reduceat(n < 0, edges[:-1])
        n = np.maximum(n, 0)
        ends = np.cumsum(n)
        data = ids[np.repeat(starts[which] - (ends - n), n) + np.arange(ends[-1])].tobytes()
        for text, bad, a, b in zip(part, broken.tolist(), (4 * (ends - n)[edges[:-1]]).tolist(), (4 * ends[edges[1:] - 1]).tolist()):
            yield (b"" if not text else cache.encode(text)) if bad else data[a:b]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int | None, keep: tuple[str, ...] = ("doc_id",), payload: bool = False) -> DataFrame:
    """Tokenises and cuts: a row per piece of at most `capacity` tokens, only longer documents being cut (the first
    piece takes what is left over, the others are full). Columns: keep, _row, piece, start, length, ids_crc32 and,
    with payload, ids (binary). A null or empty text has just end_id, or no piece where end_id is None."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    names = [*keep, "_row", "piece", "start", "length", "ids_crc32"] + ["ids"] * payload
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["_row bigint, piece int, start bigint, length bigint, ids_crc32 bigint"] + ["ids binary"] * payload)
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches):
        for batch in in_parts(batches):
            texts = batch.column(len(keep) + 1).to_pylist()
            source, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, data in enumerate(encoded(texts, tokenizer)):
                data += end
                n = len(data) // 4
                first = n % capacity or min(n, capacity)
                edges = [0, *range(first, n + 1, capacity)] if n else [0]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    part = data[4 * a : 4 * b]
                    source.append(row), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(part))
                    if payload:
                        ids.append(part)
            take = pa.array(source, pa.int64())
            cols = [batch.column(i).take(take) for i in range(len(keep) + 1)]
            cols += [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))] + [pa.array(ids, pa.binary())] * payload
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return with_row_id(docs.select(*keep, F.col("text").cast("string").alias("_text"))).select(*keep, "_row", "_text").mapInArrow(run, schema)


class Tightest:
    """Segment tree over remaining capacities 0..capacity: how many open bins have each; finds the least one that fits."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.width)

    def add(self, remaining: int, bins: int) -> None:
        i = self.width + remaining
        while i:
            self.tree[i] += bins
            i >>= 1

    def find(self, need: int) -> int | None:
        """The least remaining capacity >= need that an open bin has."""
        i = self.width + need
        if self.tree[i]:
            return need
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return None


def plan_runs(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing of histogram[length] pieces. Returns runs (length, first rank, pieces, first bin, pieces a
    bin, offset in the bin) and the number of bins: the piece of rank r in a run goes to bin first + (r - rank) // per,
    at offset + (r - rank) % per * length."""
    tree = Tightest(capacity)
    open_bins: dict[int, list[list[int]]] = {}  # remaining -> [first bin, bins]
    runs, used = [], 0

    def leave(first: int, bins: int, remaining: int) -> None:
        if remaining and bins:
            open_bins.setdefault(remaining, []).append([first, bins])
            tree.add(remaining, bins)

    for length in sorted((n for n in histogram if n > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            remaining = tree.find(length)
            if remaining is None:
                per = capacity // length
                full, rest = divmod(left, per)
                if full:
                    runs.append((length, rank, full * per, used, per, 0))
                    leave(used, full, capacity - per * length)
                if rest:
                    runs.append((length, rank + full * per, rest, used + full, rest, 0))
                    leave(used + full, 1, capacity - rest * length)
                used += full + (rest > 0)
                break
            # A bin that took a piece is the tightest for the next one, as long as it fits: bins fill one by one.
            per = remaining // length
            first, bins = open_bins[remaining][-1]
            full = min(bins, left // per)
            if full:
                runs.append((length, rank, full * per, first, per, capacity - remaining))
                taken, placed = full, full * per
                leave(first, full, remaining - per * length)
            else:
                runs.append((length, rank, left, first, left, capacity - remaining))
                taken, placed = 1, left
                leave(first, 1, remaining - left * length)
            tree.add(remaining, -taken)
            if taken == bins:
                open_bins[remaining].pop()
            else:
                open_bins[remaining][-1] = [first + taken, bins - taken]
            rank, left = rank + placed, left - placed
    return sorted(runs), used


def pack(parts: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows with _row, piece and length (1..capacity). parts must be cheap to read
    twice (a written table). Ties among equal lengths are settled by _row and piece."""
    spark = parts.sparkSession
    parts = parts.withColumn("_salt", F.pmod(F.xxhash64("_row", "piece"), F.lit(SALTS)))
    # At most capacity x SALTS rows, whatever the corpus holds.
    counts = parts.groupBy("length", "_salt").count().collect()
    histogram: dict[int, int] = {}
    starts = np.zeros((capacity + 1, SALTS), np.int64)
    for length, salt, n in sorted(map(tuple, counts)):
        starts[length, salt] = histogram.get(length, 0)
        histogram[length] = histogram.get(length, 0) + n
    runs, _ = plan_runs(histogram, capacity)
    keys = np.array([(r[0] << 44) + r[1] for r in runs] or [0], np.int64)
    plan = spark.sparkContext.broadcast((starts, keys, np.array(runs or [(1, 0, 0, 0, 1, 0)], np.int64)))
    ranked = parts.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row", "piece")).cast("bigint"))
    names = [c for c in ranked.columns if c not in ("_salt", "_rank")]
    out = [c for c in names if c != "_row"]

    def run(batches):
        starts, keys, runs = plan.value
        for batch in batches:
            at = lambda name: batch.column(batch.schema.get_field_index(name))
            length = at("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = starts[length, at("_salt").to_numpy(zero_copy_only=False).astype(np.int64)] + at("_rank").to_numpy(zero_copy_only=False) - 1
            r = runs[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            k = rank - r[:, 1]
            yield pa.RecordBatch.from_arrays([*map(at, out), pa.array(r[:, 3] + k // r[:, 4]), pa.array(r[:, 5] + k % r[:, 4] * length)], names=[*out, "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema.fields}
    return ranked.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in out] + ["sequence_id bigint, offset bigint"]))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int | None = 2, keep: tuple[str, ...] = ("doc_id",), payload: bool = False) -> DataFrame:
    """Packs whole documents into sequences of at most `capacity` tokens; a row per piece.

    Null and empty texts are documents of end_id alone. Repeated rows are packed each on its own. An empty table gives
    no rows. Columns other than keep and text are not read. payload adds each piece's ids.
    """
    return pack(materialise(pieces(docs, tokenizer, capacity, end_id, keep, payload), "pieces"), capacity)
