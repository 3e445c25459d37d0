"""Operator 13: SentencePiece encoding and decoding, byte-pair models with byte fallback.

Symbols of many words lie in flat numpy arrays. A round takes, in every word at once, the least pair rank of the word and
merges all pairs that have it, from the left; arrays are then compacted, and words without a mergeable pair leave. Two
rules make a round give what one merge after the other gives: pairs that overlap a merged one are gone, and a word's round
ends after a merge that makes a pair of no larger rank, as that pair comes before all that stand further right.

The library pairs symbols across words; no piece holds a character followed by a space, so that words may be merged
apart. For the same reason words are cut between any two characters that stand side by side in no piece.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.llm.bpe import CACHE_ENTRIES, merge_ids

SPACE = "\u2581"
_NONE = np.int64(1 << 40)
_CODES = 0x110000
#: Rounds after which the words that are left (long ones whose pairs tie, as runs of spaces) are merged by a segment tree,
#: with the same result: their rounds would merge a pair each.
ROUNDS = 256


class Pieces:
    """A model file of the sentencepiece library: byte-pair encoding, byte fallback, no normalisation but the spaces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        normal, train, kind = spec.normalizer_spec, spec.trainer_spec, type(spec.pieces[0]) if spec.pieces else None
        plain = train.model_type == train.BPE and train.byte_fallback and not normal.precompiled_charsmap and not normal.remove_extra_whitespaces and normal.escape_whitespaces
        if not plain or train.treat_whitespace_as_suffix or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in spec.pieces):
            raise ValueError("only byte-pair models with byte fallback, an identity normaliser and no piece of the user's are supported")
        self.prefix = SPACE if normal.add_dummy_prefix else ""
        self.size = len(spec.pieces)
        byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == kind.BYTE}
        self.byte_ids = [byte_ids[b] for b in range(256)]
        self.byte_of = {i: b for b, i in byte_ids.items()}
        text = {p.piece: (i, p.score) for i, p in enumerate(spec.pieces) if p.type == kind.NORMAL}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in text):
            raise ValueError("a piece holds a space after another character: words cannot be merged apart")
        self.surface = {i: p.replace(SPACE, " ").encode() for p, (i, _) in text.items()}
        self.control = {i for i, p in enumerate(spec.pieces) if p.type == kind.CONTROL}
        self.unknown = SentencePieceProcessor(model_file=path).decode([next(i for i, p in enumerate(spec.pieces) if p.type == kind.UNKNOWN)]).encode()

        # A symbol is a piece's id, or size + code point of a character that is no piece.
        self.symbol_of = np.arange(self.size, self.size + _CODES, dtype=np.int64)
        for p, (i, _) in text.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        ranks = {s: r for r, s in enumerate(sorted({s for _, s in text.values()}, reverse=True))}
        number = lambda p: text[p][0] if p in text else int(self.symbol_of[ord(p)]) if len(p) == 1 else None
        self.span = self.size + _CODES
        pairs, together = {}, set()
        for p, (i, s) in text.items():
            for at in range(1, len(p)):
                together.add(ord(p[at - 1]) << 21 | ord(p[at]))
                a, b = number(p[:at]), number(p[at:])
                if a is not None and b is not None:
                    pairs[a * self.span + b] = (ranks[s], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.together = np.array(sorted(together), np.int64)
        self.words = re.compile(r" *[^ \n]+| +|\n" if not any("\n" in p and len(p) > 1 for p in text) else r" *[^ ]+| +")

    @functools.cached_property
    def pairs(self) -> dict[tuple[int, int], tuple[int, int]]:
        return {divmod(k, self.span): (r, m) for k, r, m in zip(self.keys.tolist(), self.ranks.tolist(), self.merged.tolist())}

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of the pairs (a, b); rank _NONE where they do not merge."""
        want = a * self.span + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        hit = self.keys[at] == want
        return np.where(hit, self.ranks[at], _NONE), self.merged[at]

    def merge_rounds(self, ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, and their words; word: which word a symbol is of, ascending."""
        done_ids, done_word = [], []
        rank, merged = np.full(len(ids), _NONE), np.zeros(len(ids), np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], merged[inner] = self.look_up(ids[inner], ids[inner + 1])
        rounds = 0
        while len(ids):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(ids)]))
            if (ended := least == _NONE).any():
                done_ids.append(ids[ended]), done_word.append(word[ended])
                live = ~ended
                ids, word, rank, merged, least = ids[live], word[live], rank[live], merged[live], least[live]
                if not len(ids):
                    break
            rounds += 1
            if rounds > ROUNDS:
                cuts = np.flatnonzero(word[1:] != word[:-1]) + 1
                for w, part in zip(word[np.r_[0, cuts]], np.split(ids, cuts)):
                    part = np.array(merge_ids(part.tolist(), self.pairs), np.int64)
                    done_ids.append(part), done_word.append(np.full(len(part), w))
                break
            # Of pairs that overlap one another, every second from the left.
            at = np.flatnonzero(rank == least)
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1], np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            new, end = merged[at], len(ids) - 1
            # The pairs that each merge makes: with the symbol before, which may just have been merged, and the one after.
            before = np.where(np.r_[False, np.diff(at) == 2], np.r_[0, new[:-1]], ids[np.maximum(at - 1, 0)])
            has_before, has_after = (at > 0) & (word[np.maximum(at - 1, 0)] == word[at]), (at + 2 <= end) & (word[np.minimum(at + 2, end)] == word[at])
            left = np.where(has_before, self.look_up(before, new)[0], _NONE)
            right = np.where(has_after, self.look_up(new, ids[np.minimum(at + 2, end)])[0], _NONE)
            stops = np.cumsum(np.minimum(left, right) <= rank[at])
            head = np.r_[True, word[at[1:]] != word[at[:-1]]]
            so_far = np.r_[0, stops[:-1]]
            at = at[so_far == np.maximum.accumulate(np.where(head, so_far, 0))]
            ids[at] = merged[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            place = at - np.arange(len(at))
            ids, word, rank, merged = ids[keep], word[keep], rank[keep], merged[keep]
            marked = np.zeros(len(ids), bool)
            marked[place] = marked[place[place > 0] - 1] = True
            touched = np.flatnonzero(marked)
            after = np.minimum(touched + 1, len(ids) - 1)
            paired = (touched + 1 < len(ids)) & (word[after] == word[touched])
            r, m = self.look_up(ids[touched], ids[after])
            rank[touched], merged[touched] = np.where(paired, r, _NONE), m
        ids, word = np.concatenate([*done_ids, np.zeros(0, np.int64)]), np.concatenate([*done_word, np.zeros(0, np.int64)])
        order = np.argsort(word, kind="stable")
        return ids[order], word[order]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """ids of each word; a word has SPACE for a space."""
        if not words:
            return []
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        both = codes[:-1] << 21 | codes[1:]
        near = np.searchsorted(self.together, both)
        met = self.together[np.minimum(near, len(self.together) - 1)] == both
        part = np.cumsum(np.r_[0, ~met | (owner[1:] != owner[:-1])])
        out, where = self.merge_rounds(self.symbol_of[codes], part)
        owners = owner[np.flatnonzero(np.r_[True, part[1:] != part[:-1]])][where]
        cuts = np.searchsorted(owners, np.arange(len(words) + 1)).tolist()
        ids = out.tolist()
        found = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        for w in np.unique(owners[out >= self.size]).tolist():
            found[w] = self.expanded(found[w])
        return found

    def expanded(self, symbols: list[int]) -> list[int]:
        """ids of symbols: characters that are no piece become their bytes."""
        out: list[int] = []
        for s in symbols:
            out += [s] if s < self.size else [self.byte_ids[b] for b in chr(s - self.size).encode()]
        return out

    def encode(self, text: str) -> list[int]:
        words = [w.replace(" ", SPACE) for w in self.split(text)]
        return [i for w in self.encode_words(words) for i in w]

    def split(self, text: str) -> list[str]:
        """Words of a text, spaces as ' '; the model's own sign for a space counts as one."""
        return self.words.findall((" " if self.prefix else "") + text.replace(SPACE, " ")) if text else []

    def decoded(self, ids) -> bytes:
        """UTF-8 of the pieces one after the other, the leading space included; bytes that are no UTF-8 become U+FFFD."""
        out, raw = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_text_of(bytes(raw)))
                raw = bytearray()
            if i is not None and i not in self.control:
                out.append(self.surface.get(i, self.unknown))
        return b"".join(out)

    def without_prefix(self, decoded: bytes) -> bytes:
        return decoded[1:] if self.prefix and decoded.startswith(b" ") else decoded

    def decode(self, ids) -> str:
        out, first = self.decoded(ids), next((i for i in ids if i not in self.control), None)
        return (self.without_prefix(out) if first in self.surface else out).decode()


def _text_of(raw: bytes) -> bytes:
    """raw if it is UTF-8, else with U+FFFD for each byte that begins no character."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    raw[at : at + n].decode()
                    out.append(raw[at : at + n])
                    at += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("\ufffd".encode())
                at += 1
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


class WordCache(dict):
    """Word -> (number of ids, ids as decimal text, decoded UTF-8)."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.number = [str(i).encode() for i in range(pieces.size)]

    def learn(self, words: set[str]) -> None:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        new = [w for w in words if w not in self]
        number, surface = self.number, self.pieces.surface
        for w, ids in zip(new, self.pieces.encode_words([w.replace(" ", SPACE) for w in new])):
            try:
                back = b"".join([surface[i] for i in ids])
            except KeyError:  # bytes
                back = self.pieces.decoded(ids)
            self[w] = len(ids), b",".join([number[i] for i in ids]), back


@functools.lru_cache(maxsize=2)
def word_cache(path: str) -> WordCache:
    return WordCache(load(path))


def encode_decode(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), payload: bool = True) -> DataFrame:
    """Adds to the columns of keep: n_tokens, ids (array of int), decoded (string), the SHA-256 of the ids in decimal joined
    by commas, and that of decoded's UTF-8.

    payload=False leaves out ids and decoded. A null or empty text has no ids and decodes to ''. Whole texts are encoded,
    however long; a text's words are learnt about 2 million characters of texts at a time, and one longer text by itself.
    Rows are mapped one by one, so repeated rows give repeated results and an empty table none; other columns are not
    read, whatever their names, and those of keep have private names inside.
    """
    kept = [f"_keep{i}" for i in range(len(keep))]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    named = ["n_tokens bigint", *["ids array<int>", "decoded string"] * payload, "ids_sha256 string", "decoded_sha256 string"]

    def run(batches):
        cache = word_cache(model)
        pieces = cache.pieces
        for batch in batches:
            n, ids, dec, h1, h2 = [], [], [], [], []
            texts, at = batch.column(len(kept)).to_pylist(), 0
            while at < len(texts):
                size, part = 0, []
                while at < len(texts) and (not part or size < 2_000_000):
                    part.append(pieces.split(texts[at] or ""))
                    size += len(texts[at] or "")
                    at += 1
                words = set().union(*part)
                cache.learn(words)
                for ws in part:
                    found = [cache[w] for w in ws]
                    said = b",".join([f[1] for f in found])
                    back = pieces.without_prefix(b"".join([f[2] for f in found]))
                    n.append(sum([f[0] for f in found]))
                    h1.append(hashlib.sha256(said).hexdigest())
                    h2.append(hashlib.sha256(back).hexdigest())
                    if payload:
                        ids.append(np.array(said.split(b",") if said else [], np.int32))
                        dec.append(back.decode())
            columns = [pa.array(n, pa.int64()), *([pa.array(ids, pa.list_(pa.int32())), pa.array(dec, pa.string())] if payload else []), pa.array(h1, pa.string()), pa.array(h2, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *columns], names=[*kept, *(x.split(" ")[0] for x in named)])

    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept)], F.col(f"`{text}`").cast("string").alias("_text"))
    out = rows.mapInArrow(run, ", ".join([f"{k} {kinds[c]}" for k, c in zip(kept, keep)] + named))
    return out.toDF(*keep, *(x.split(" ")[0] for x in named))
