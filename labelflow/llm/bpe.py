"""Operator 1: byte-pair encoding and decoding.

Each pre-token's adjacent pairs are the leaves of a segment tree that holds the minimum of (merge rank, position);
the root is the leftmost pair of lowest rank. A merge changes three leaves, each in logarithmic time; merging ends
when the root holds no mergeable pair.

Vocabulary, merges, normaliser and pre-tokeniser come from a tokenizers JSON file whose path is a parameter.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

_SPACES = regex.compile(r"\s+")
_NONE = 1 << 62
_POS = (1 << 31) - 1
#: Entries a worker keeps before it starts anew; bounds its memory, not its results.
CACHE_ENTRIES = 600_000
#: Pattern of the byte-level pre-tokeniser (fixed value of the public format).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else 256 and up in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merge_ids(ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """ids after all merges; merges: pair of ids -> (rank, merged id)."""
    n = len(ids)
    if n < 2:
        return ids
    ids = list(ids)
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [_NONE] * (2 * width)
    get = merges.get
    for i in range(n - 1):
        if (m := get((ids[i], ids[i + 1]))) is not None:
            tree[width + i] = m[0] << 31 | i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))

    def put(leaf: int, key: int) -> None:
        i = width + leaf
        tree[i] = key
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                return
            tree[i] = least
            i >>= 1

    while (root := tree[1]) != _NONE:
        at = root & _POS
        gone = after[at]
        ids[at] = get((ids[at], ids[gone]))[1]
        ids[gone] = -1
        after[at] = nxt = after[gone]
        if gone < n - 1:
            put(gone, _NONE)
        if nxt < n:
            before[nxt] = at
            m = get((ids[at], ids[nxt]))
            put(at, _NONE if m is None else m[0] << 31 | at)
        else:
            put(at, _NONE)
        if (left := before[at]) >= 0:
            m = get((ids[left], ids[at]))
            put(left, _NONE if m is None else m[0] << 31 | left)
    return [i for i in ids if i >= 0]


def _unassigned(text: str) -> bool:
    return any(unicodedata.category(c) == "Cn" for c in text)


class PairTable:
    """merges as sorted arrays, for many look-ups at once."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]], size: int):
        self.size = size
        keys = np.fromiter((a * size + b for a, b in merges), np.int64, len(merges))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.fromiter((r for r, _ in merges.values()), np.int64, len(merges))[order]
        self.merged = np.zeros(len(merges) and int(self.ranks.max()) + 1, np.int64)
        self.merged[self.ranks] = np.fromiter((m for _, m in merges.values()), np.int64, len(merges))[order]

    def leaves(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf keys rank << 31 | at of the pairs (a, b); _NONE where they do not merge or either is negative."""
        want = a * self.size + b
        i = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where((self.keys[i] == want) & (a >= 0) & (b >= 0), self.ranks[i] << 31 | at, _NONE)


def merge_many(words: list[list[int]], table: PairTable) -> list[list[int]]:
    """merge_ids of words of 2 to about 64 ids, one segment tree a row; all words take their next merge together."""
    count, most = len(words), max(map(len, words))
    width = 1 << max(0, (most - 2).bit_length())
    ids = np.full((count, width + 2), -1, np.int64)
    lengths = np.fromiter(map(len, words), np.int64, count)
    ids[np.arange(width + 2) < lengths[:, None]] = np.concatenate([np.asarray(w, np.int64) for w in words])
    tree = np.full((count, 2 * width), _NONE, np.int64)
    tree[:, width:] = table.leaves(ids[:, :width], ids[:, 1 : width + 1], np.arange(width))
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    after = np.tile(np.arange(1, width + 3), (count, 1))
    before = np.tile(np.arange(-1, width + 1), (count, 1))
    rows = np.flatnonzero(tree[:, 1] != _NONE)
    while len(rows):
        root = tree[rows, 1]
        at = root & _POS
        gone = after[rows, at]
        new = table.merged[root >> 31]
        nxt = after[rows, gone]
        ids[rows, at], ids[rows, gone] = new, -1
        after[rows, at], before[rows, nxt] = nxt, at
        left = before[rows, at]
        tail = np.where(nxt <= width, ids[rows, nxt], -1)
        for leaf, key in (
            (gone, np.full(len(rows), _NONE)),
            (at, table.leaves(new, tail, at)),
            (left, table.leaves(np.where(left >= 0, ids[rows, np.maximum(left, 0)], -1), new, left)),
        ):
            on = (leaf >= 0) & (leaf < width)
            r, node = rows[on], leaf[on] + width
            tree[r, node] = key[on]
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
        rows = rows[tree[rows, 1] != _NONE]
    kept = ids >= 0
    return [a.tolist() for a in np.split(ids[kept], np.cumsum(kept.sum(1))[:-1])]


class Bpe:
    """Encodes and decodes as the tokenizers library does with add_special_tokens=False and skip_special_tokens=False."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.vocab = dict(vocab) | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.symbols = byte_alphabet()
        self.inner = [vocab.get(c, -1) for c in self.symbols]
        self.last = [vocab.get(c + self.suffix, -1) for c in self.symbols]
        steps = spec.get("normalizer") or {"normalizers": []}
        self.normal = [s["type"] for s in steps.get("normalizers", [steps])]
        pre = spec["pre_tokenizer"]
        split = next((p for p in pre.get("pretokenizers", [pre]) if p["type"] == "Split"), None)
        self.pattern = regex.compile(split["pattern"]["Regex"] if split else BYTE_LEVEL_PATTERN)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.byte_decoder = {c: b for b, c in enumerate(self.symbols)} if spec.get("decoder") else None
        self.table = PairTable(self.merges, len(self.vocab) + 1)
        self._words: dict[str, list[int]] = {}

    def _normalise(self, text: str) -> str:
        ascii_only = text.isascii()
        for step in self.normal:
            if step == "NFC":
                text = text if ascii_only else unicodedata.normalize("NFC", text)
            elif step == "Replace":
                text = _SPACES.sub(" ", text)
            elif step == "Lowercase":
                # One character at a time: no final-sigma rule.
                text = text.replace("Σ", "σ").lower() if ascii_only or not _unassigned(text) else normalizers.Lowercase().normalize_str(text)
        return text

    def _split(self, text: str) -> list[str]:
        """Pre-tokens. Python's, the regular expression's and the library's character tables are of different versions:
        texts with code points that are new to Python's are cut by the library's."""
        if text.isascii() or not _unassigned(text):
            return self.pattern.findall(text)
        return [p for p, _ in pre_tokenizers.Split(Regex(self.pattern.pattern), "removed", invert=True).pre_tokenize_str(text)]

    def _symbols(self, word: str) -> list[int]:
        data = word.encode("utf-8")
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        return ids

    def learn(self, texts) -> None:
        """Puts the pre-tokens of texts (without special tokens) into the cache, all new ones of a size at once."""
        if len(self._words) >= CACHE_ENTRIES:
            self._words.clear()
        sized = defaultdict(list)
        for word in {w for t in texts for w in self._split(self._normalise(t))} - self._words.keys():
            ids = self._symbols(word)
            if len(ids) == 1:
                self._words[word] = ids
            elif len(ids) <= 64:
                sized[(len(ids) - 2).bit_length()].append((word, ids))
        for group in sized.values():
            for i in range(0, len(group), 20_000):
                part = group[i : i + 20_000]
                if len(part) >= 8:
                    self._words.update(zip([w for w, _ in part], merge_many([ids for _, ids in part], self.table)))

    def _word(self, word: str) -> list[int]:
        found = self._words.get(word)
        if found is None:
            found = merge_ids(self._symbols(word), self.merges)
            if len(self._words) >= CACHE_ENTRIES:
                self._words.clear()
            if len(word) <= 64:
                self._words[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            self._plain(text[at : m.start()], out)
            out.append(self.vocab[m[0]])
            at = m.end()
        self._plain(text[at:] if at else text, out)
        return out

    def _plain(self, text: str, out: list[int]) -> None:
        for word in self._split(self._normalise(text)):
            out += self._word(word)

    def decode(self, ids) -> str:
        """Token strings joined by spaces, as the library does for a file that names no decoder; for a byte-level
        decoder, the bytes they stand for (broken UTF-8 becomes U+FFFD)."""
        if self.byte_decoder is None:
            return " ".join(self.tokens[i] for i in ids)
        data = b"".join(bytes(map(self.byte_decoder.__getitem__, t)) if all(c in self.byte_decoder for c in t) else t.encode() for t in map(self.tokens.__getitem__, ids))
        return data.decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


class ChunkCache(dict):
    """Space-free chunk of text -> (ids as little-endian uint32, decoded UTF-8). Chunks are encoded apart from each
    other, which is exact for a pre-tokeniser that drops white space: no token spans a space."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe

    def learn(self, chunks: set[str]) -> None:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        new = [c for c in chunks if c not in self]
        self.bpe.learn(c for c in new if not (self.bpe.special and "<|" in c))
        for chunk in new:
            self[chunk]  # noqa: B018  fills it

    def __missing__(self, chunk: str) -> tuple[bytes, bytes]:
        ids = self.bpe.encode(chunk)
        data = array("I", ids)
        out = data.tobytes(), self.bpe.decode(ids).encode("utf-8")
        if len(chunk) <= 64 and len(self) < 2 * CACHE_ENTRIES:
            self[chunk] = out
        return out


@functools.lru_cache(maxsize=2)
def chunk_cache(path: str) -> ChunkCache:
    return ChunkCache(load(path))


def split_batches(texts: list, cache: ChunkCache, chars: int = 2_000_000):
    """Yields the chunks of each text; cache learns those of about chars characters of texts at a time."""
    at = 0
    while at < len(texts):
        size, part = 0, []
        while at < len(texts) and (not part or size < chars):
            part.append((texts[at] or "").split(" "))
            size += len(texts[at] or "")
            at += 1
        cache.learn({c for chunks in part for c in chunks if c})
        yield from part


def encode_decode(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), payload: bool = True) -> DataFrame:
    """Adds to the columns of keep: n_tokens, ids (little-endian uint32), decoded (string), and the SHA-256 of both.

    payload=False leaves out ids and decoded. A null text counts as empty: no ids, decoded ''. Rows are mapped one by
    one, so repeated rows give repeated results; other columns are not read, whatever their names. The tokenizer must
    drop white space before merging (its pre-tokeniser removes it), as chunks between spaces are encoded apart.
    """
    keep_n = len(keep)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["n_tokens bigint"] + ["ids binary", "decoded string"] * payload + ["ids_sha256 string", "decoded_sha256 string"])

    def run(batches):
        cache = chunk_cache(tokenizer)
        for batch in batches:
            n, ids, dec, h1, h2 = [], [], [], [], []
            for chunks in split_batches(batch.column(keep_n).to_pylist(), cache):
                parts = [cache[c] for c in chunks if c]
                data = b"".join([p[0] for p in parts])
                back = b" ".join([p[1] for p in parts if p[0]])
                n.append(len(data) // 4)
                h1.append(hashlib.sha256(data).hexdigest())
                h2.append(hashlib.sha256(back).hexdigest())
                if payload:
                    ids.append(data)
                    dec.append(back.decode("utf-8"))
            cols = [batch.column(i) for i in range(keep_n)] + [pa.array(n, pa.int64())]
            cols += [pa.array(ids, pa.binary()), pa.array(dec, pa.string())] * payload
            yield pa.RecordBatch.from_arrays(cols + [pa.array(h1), pa.array(h2)], names=[x.split(" ")[0].strip("`") for x in schema.split(", ")])

    return docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
