"""Operator 7: a hierarchical Pitman-Yor language model.

Restaurants. Every token that another one follows is a context whose restaurant serves all tokens seen after it; the
parent of all of them is the root restaurant, which serves every token of the corpus, rare and frequent alike; its base
is uniform over the V known tokens and one unknown. A table of a context's restaurant is a customer of the root's.

Seating. Seats start from a sequential Chinese-restaurant draw. A Gibbs step then takes one customer of each dish that
has several off a table, drawn by the tables' sizes, and seats it again, at an old table with weight size - discount or
at a new one with weight (strength + discount * tables) * (the parent's probability of the dish). Steps of different
dishes run side by side; their restaurant's number of tables is brought up to date after each. Passes over the contexts
alternate with passes over the root; discounts and strengths of both levels are drawn after each pass from their
posterior by the usual auxiliary variables. Predictive probabilities are averaged over the steps of the last pass.

Scale. Everything grows with the corpus and nothing is cut off. A context belongs to a bucket of about BUCKET x ROOM
customers; a bucket's words, pairs and seats are one block of compressed arrays, so that a pair takes a few bytes in a
shuffle. The root's customers lie in parts by a hash of the word; in each pass a bucket sends every part the tables of its
words, and the part answers with the root's, both as compressed arrays again, once a word of a bucket, not once a pair. A
context with more than ROOM and more than 1/HOT of all customers is dealt over several buckets by its followers, and the
numbers of tables there meet once a pass. Texts send their pairs to the buckets, which answer with sums for each text;
words that a bucket doesn't know meet their root probability in a join. The driver holds four parameters and the fewer
than HOT frequent contexts.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from labelflow.llm.common import HOT, discard, materialise, spread_join, steady

#: Tokens whose pairs a task gathers before it hands them on, bytes of texts that it cuts into words at a time, and customers
#: that a bucket holds of one frequent context (a bucket holds BUCKET times as many customers).
FLUSH, CUT, ROOM, BUCKET = 1_000_000, 12_000_000, 50_000, 20
#: Distinct words of a part of the root's customers (about).
ROOT = 50_000
#: Dishes with at most so many customers are seated by a table of all ways to seat them.
FEW = 16
#: Dishes that a step works on at a time, so that what it makes stays in the cache.
LANE = 8192
#: The end of a text; words are never empty.
END = ""


def _texts(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))


def _cuts(column: pa.Array):
    """(from, to) of parts of about CUT bytes of texts."""
    ends, at = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) + 1), 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CUT, side="right")))
        yield at, end
        at = end


def _tokens(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Tokens of texts one after the other, END before and after each text, and where each text's begin. Arrow's functions
    for ASCII change A-Z and cut at space and \\t to \\r alone, as folded_words does; the space before and after a text cuts
    an empty word off."""
    cut = pc.ascii_split_whitespace(pc.binary_join_element_wise("", pc.ascii_lower(texts), "", " "))
    return cut.flatten().dictionary_encode(), cut.offsets.to_numpy()


def token_counts(docs: DataFrame) -> DataFrame:
    """(w, n) over all texts: how often token w occurs. Each text ends with END."""

    def run(batches):
        for batch in batches:
            for a, b in _cuts(batch.column(0)):
                words, _ = _tokens(batch.column(0).slice(a, b - a))
                n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                n[0] -= b - a  # the END before each text
                yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(n)], names=["w", "n"])

    return _texts(docs).mapInArrow(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


def _pack(x: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers as bytes: first the lowest byte of each, then the next, compressed."""
    x = np.ascontiguousarray(x, kind)
    rows, columns = x.view(np.uint8).reshape(len(x), x.itemsize), np.empty((x.itemsize, len(x)), np.uint8)
    for k in range(x.itemsize):
        columns[k] = rows[:, k]
    return zstandard.ZstdCompressor(level=1).compress(columns.data)


def _unpack(b: bytes, kind: str = "<u4") -> np.ndarray:
    size = np.dtype(kind).itemsize
    x = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(size, -1)
    rows = np.empty((x.shape[1], size), np.uint8)
    for k in range(size):
        rows[:, k] = x[k]
    x = rows.view(kind).ravel()
    return x.astype(np.int64) if kind == "<u4" else x


def _ascending(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=0))


def _pack_names(names: list[bytes]) -> bytes:
    """Words hold no space; END is empty."""
    return zstandard.ZstdCompressor().compress(b" ".join(names))


def _unpack_names(b: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(b).split(b" ")


def _names(words: pa.Array) -> list[bytes]:
    """Words of Arrow as Python's."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.binary())), b" ")[0].as_py().split(b" ") if len(words) else []


def _all_words(packed: list[bytes]) -> tuple[pa.Array, list[int]]:
    """The words of several blocks one after the other, and how many each has."""
    cut = pc.split_pattern(pa.array(map(zstandard.ZstdDecompressor().decompress, packed), pa.binary()), b" ")
    return cut.flatten(), np.diff(cut.offsets.to_numpy()).tolist()


def _numbered(packed: list[bytes]) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct words of several blocks, and for each block its words as places in these."""
    words, sizes = _all_words(packed)
    words = words.dictionary_encode()
    return words.dictionary, np.split(words.indices.to_numpy().astype(np.int64), np.cumsum(sizes)[:-1])


_BYTE = np.random.default_rng(64).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes that deal words out: sums of their bytes times a number for each place, mixed."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    many, h = np.diff(ends), np.zeros(len(words), np.uint64)
    if many.any():
        data, starts = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends[:-1] - ends[0]
        value = (data.astype(np.uint64) + np.uint64(1)) * _BYTE[(np.arange(len(data)) - np.repeat(starts, many)) & 255]
        h[many > 0] = np.add.reduceat(value, starts[many > 0])
    for shift, by in ((32, 0x9E3779B97F4A7C15), (29, 0xBF58476D1CE4E5B9), (32, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(31))


class _Gathered:
    """Texts as numbered tokens, until they are handed on to buckets."""

    def __init__(self):
        self.cuts, self.edges, self.size = [], [], 0

    def add_all(self, texts: pa.Array) -> np.ndarray:
        """How many tokens each text has."""
        words, edges = _tokens(texts)
        self.cuts.append(words), self.edges.append(edges)
        self.size += len(words)
        return np.diff(edges) - 1

    def add(self, text: str) -> int:
        return int(self.add_all(pa.array([text]))[0])

    def _one(self) -> list[pa.DictionaryArray]:
        """All tokens, cut by cut, numbered alike."""
        if len(self.cuts) > 1:
            self.cuts = pa.chunked_array(self.cuts).unify_dictionaries().chunks
        return self.cuts

    @property
    def words(self) -> pa.Array:
        return self._one()[0].dictionary

    @property
    def ids(self) -> list[bytes]:
        return _names(self.words)

    @property
    def texts(self) -> list[np.ndarray]:
        return [x for words, edges in zip(self._one(), self.edges) for x in np.split(words.indices.to_numpy(), edges[1:-1])]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of each token and of the one before it, text after text."""
        c, w = [], []
        for words, edges in zip(self._one(), self.edges):
            x, inner = words.indices.to_numpy(), np.ones(max(0, len(words) - 1), bool)
            inner[edges[1:-1] - 1] = False
            c.append(x[:-1][inner]), w.append(x[1:][inner])
        return (c[0], w[0]) if len(c) == 1 else (np.concatenate(c), np.concatenate(w))

    def slices(self, buckets: int, parts: dict[bytes, int], c: np.ndarray, w: np.ndarray):
        """(bucket, its places in c and w, its words, c and w as places in these)."""
        words = self.words
        names, h = np.array(_names(words), object), _hashes(words)
        own = np.ones(len(names), np.uint64)
        if parts:
            found = pc.index_in(pa.array(list(parts), pa.binary()), value_set=words.cast(pa.binary()))
            for k, n in zip(found.to_pylist(), parts.values()):
                if k is not None:
                    own[k] = n
        bucket = (h % np.uint64(buckets)).astype(np.int32)[c]
        if parts:
            dealt = np.flatnonzero((own > 1)[c])
            bucket[dealt] = (bucket[dealt] + ((h >> np.uint64(32))[w[dealt]] % own[c[dealt]]).astype(np.int64)) % buckets
        # numpy sorts 16-bit numbers by radix.
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        c, w, bucket = c[order], w[order], bucket[order]
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        place, here = np.zeros(len(names), np.int32), np.zeros(len(names), bool)
        for lo, hi in zip(first, [*first[1:], len(order)]):
            cs, ws = c[lo:hi], w[lo:hi]
            here[cs] = here[ws] = True
            used = np.flatnonzero(here)
            here[used] = False
            place[used] = np.arange(len(used), dtype=np.int32)
            yield int(bucket[lo]), order[lo:hi], names[used], place[cs], place[ws]


_BLOCK = pa.list_(pa.binary())
_STATE = "bucket int, block array<binary>, part int, guests array<binary>, hot_c array<string>, hot_t array<double>, e array<double>"


def _state(bucket: int, block: list[bytes], guests: list[tuple[int, list[bytes]]], hot: dict[str, float], e=(0.0,) * 4) -> pa.Table:
    """A row with a bucket's block, and one for each part of the words that follow another in it: the words, their tables
    there, and their customers."""
    n = len(guests)
    first = lambda x, kind: pa.array([x, *[None] * n], kind)
    return pa.Table.from_arrays(
        [
            pa.array(np.full(n + 1, bucket, np.int32)), first(block, _BLOCK), pa.array([None, *(p for p, _ in guests)], pa.int32()), pa.array([None, *(x for _, x in guests)], _BLOCK),
            first(list(hot), pa.list_(pa.string())), first(list(hot.values()), pa.list_(pa.float64())), first([float(x) for x in e], pa.list_(pa.float64())),
        ],
        names=["bucket", "block", "part", "guests", "hot_c", "hot_t", "e"],
    )


def _ends(sizes) -> list[tuple[int, int]]:
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return list(zip([0, *ends], ends))


#: Places in a block: words that follow no other here, contexts as places in the words, of each pair its context's number
#: (ascending), its word's place and its count; then, as passes go on, tables (or their mean), their sizes (or the contexts'
#: tables), and last the words' root probabilities and counts; which contexts are frequent; words that follow, by part.
_OFTEN, _WORDS = 9, 10


def _joined(words: pa.Array) -> bytes:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.binary())), b" ")[0].as_py()


def _block_words(block: list[bytes]) -> pa.Array:
    """All words of a block: those that follow others, then the rest."""
    packed = [*block[_WORDS:], *([block[0]] if block[0] else [])]
    return pc.split_pattern(pa.array([b" ".join(map(zstandard.ZstdDecompressor().decompress, packed))], pa.binary()), b" ").flatten()


def pair_blocks(docs: DataFrame, buckets: int, parts: dict[str, int], root_parts: int) -> DataFrame:
    """Blocks of pairs (previous token, token) with their counts; no seats yet. END stands before each text. A frequent
    context's followers are dealt over `parts` buckets."""
    parts = {c.encode(): n for c, n in parts.items()}

    def gather(batches):
        def out(g):
            (c, w), many = g.pairs(), len(g.words)
            k, n = np.unique(c.astype(np.int64) * many + w, return_counts=True)
            c, n = (k // many).astype(np.int32), n.astype(np.uint32)
            w = (k - c.astype(np.int64) * many).astype(np.int32)
            rows = [(b, [_pack_names(names), _ascending(c), _pack(w), _pack(n[at])]) for b, at, names, c, w in g.slices(buckets, parts, c, w)]
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], _BLOCK)], names=["bucket", "block"])

        g = _Gathered()
        for batch in batches:
            for a, b in _cuts(batch.column(0)):
                g.add_all(batch.column(0).slice(a, b - a))
                if g.size >= FLUSH:
                    yield out(g)
                    g = _Gathered()
        if g.cuts:
            yield out(g)

    def merge(table: pa.Table) -> pa.Table:
        c, w, n, blocks = [], [], [], table.column("block").to_pylist()
        words, places = _numbered([x[0] for x in blocks])
        for (_, cs, ws, ns), at in zip(blocks, places):
            c.append(at[np.cumsum(_unpack(cs))]), w.append(at[_unpack(ws)]), n.append(_unpack(ns))
        # Words in the order of their part of the root.
        many = len(words)
        part = (_hashes(words) >> np.uint64(48)).astype(np.int64) % root_parts
        by_part = np.argsort(part, kind="stable")
        rank = np.empty(many, np.int64)
        rank[by_part] = np.arange(many)
        key = rank[np.concatenate(c)] * many + rank[np.concatenate(w)]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        key, n = key[order[first]], np.add.reduceat(np.concatenate(n)[order], first)
        c = key // many
        w = key - c * many
        here = np.zeros((2, many), bool)
        here[0, w] = here[1, c] = True
        follow, own = map(np.flatnonzero, here)
        rest = np.flatnonzero(here[1] & ~here[0])
        place = np.full(many, -1)
        place[follow] = np.arange(len(follow))
        place[rest] = len(follow) + np.arange(len(rest))
        house = np.cumsum(np.diff(c, prepend=c[0]) > 0)
        own_words = words.take(pa.array(by_part[own])).cast(pa.binary())
        often = np.flatnonzero(pc.is_in(own_words, value_set=pa.array(list(parts), pa.binary())).to_numpy(zero_copy_only=False))
        hot = dict(zip(own_words.take(pa.array(often)).cast(pa.string()).to_pylist(), np.bincount(house)[often].astype(float).tolist()))
        w = place[w]
        follow_words = words.take(pa.array(by_part[follow]))
        of, sizes = np.unique(part[by_part[follow]], return_counts=True)
        packed = [zstandard.ZstdCompressor().compress(_joined(follow_words.slice(a, b - a))) for a, b in _ends(sizes)]
        rest = zstandard.ZstdCompressor().compress(_joined(words.take(pa.array(by_part[rest])))) if len(rest) else b""
        block = [rest, _pack(place[own]), _ascending(house), _pack(w), _pack(n), b"", b"", b"", b"", _pack(often), *packed]
        tables, customers = np.bincount(w), np.bincount(w, n)
        guests = [(p, [x, _pack(tables[a:b]), _pack(customers[a:b])]) for p, x, (a, b) in zip(of.tolist(), packed, _ends(sizes))]
        return _state(table.column("bucket")[0].as_py(), block, guests, hot)

    return _texts(docs).mapInArrow(gather, "bucket int, block array<binary>").groupBy("bucket").applyInArrow(merge, _STATE)


def seat(customers: np.ndarray, mass: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its customers sat down one after the other (long queues in blocks that grow with the
    queue); mass: the weight of a new table. Seats start from this draw."""
    tables = (customers > 0).astype(np.int64)
    seated = tables.copy()
    at = np.flatnonzero(customers > seated)
    while len(at):
        n, t = seated[at], tables[at]
        block = np.minimum(customers[at] - n, np.maximum(1, n // 8))
        p = mass[at] / (n - d * t + mass[at])
        tables[at] = t + rng.binomial(block, np.clip(p, 0, 1))
        seated[at] = n + block
        at = at[customers[at] > seated[at]]
    return tables


@functools.lru_cache(maxsize=1)
def _partitions() -> tuple[np.ndarray, ...]:
    """All ways to seat 1 to FEW customers, by their tables' sizes, as numbered states. Of each: its sizes, largest first; its
    number of tables; its key, by which it is found; which state it becomes when its k-th customer goes; which when one
    comes, to a new table (0), or to the table of its k-th customer that is not the first at a table, then to its k-th
    table (1 + k)."""
    states, n = [], {1: [(1,)]}
    for k in range(1, FEW + 1):
        states += n[k]
        n[k + 1] = sorted({tuple(sorted((*x[:i], x[i] + 1, *x[i + 1 :]), reverse=True)) for x in n[k] for i in range(len(x))} | {(*x, 1) for x in n[k]})
    number = {x: k for k, x in enumerate(states)}
    sizes, less, more = np.zeros((len(states), FEW), np.int64), np.zeros((len(states), FEW), np.int16), np.zeros((len(states), FEW + 1), np.int16)
    moved = lambda x, i, by: number.get(tuple(sorted((y for y in (*x[:i], x[i] + by, *x[i + 1 :]) if y), reverse=True)), 0)
    for k, x in enumerate(states):
        sizes[k, : len(x)] = x
        less[k, : sum(x)] = [moved(x, i, -1) for i in range(len(x)) for _ in range(x[i])]
        more[k, : sum(x) + 1] = [number.get((*x, 1), 0), *(moved(x, i, 1) for i in range(len(x)) for _ in range(x[i] - 1)), *(moved(x, i, 1) for i in range(len(x)))]
    return sizes, (sizes > 0).sum(1), np.where(sizes > 0, (FEW + 1) ** np.maximum(sizes - 1, 0), 0).sum(1), less, more


class _Few:
    """Dishes with 2 to FEW customers: each one's state. at: the dishes' places."""

    def __init__(self, at, n, house, p, flat, t):
        self.at, self.n, self.house, self.p = at, n[at].astype(np.int64), house[at], p[at]
        self.all_sizes, self.tables, key, self.less, self.more = _partitions()
        order = np.argsort(key)
        t = t[at]
        self.state = order[np.searchsorted(key[order], np.add.reduceat((FEW + 1) ** (flat.astype(np.int64) - 1), np.cumsum(t) - t))] if len(at) else np.zeros(0, np.int64)

    @property
    def t(self) -> np.ndarray:
        return self.tables[self.state]

    @property
    def size(self) -> np.ndarray:
        return self.all_sizes[self.state].ravel()

    def take(self, rng) -> np.ndarray:
        """Takes a customer of each dish off its table; the dishes whose table is gone."""
        less, gone = self.less.ravel(), np.empty(len(self.n), bool)
        for lo in range(0, len(gone), LANE):
            at = slice(lo, lo + LANE)
            state, n = self.state[at], self.n[at]
            left = less[state * FEW + (rng.random(len(n)) * n).astype(np.int64)]
            gone[at] = self.tables[left] < self.tables[state]
            self.state[at] = left
        return np.flatnonzero(gone)

    def put(self, tables: np.ndarray, d: float, strength: float, rng) -> np.ndarray:
        """Seats them again; the dishes that have a new table. An old table's weight, size -
        discount, is drawn as 1 for each customer but the first, and 1 - discount for that one."""
        more, new = self.more.ravel(), np.empty(len(self.n), bool)
        for lo in range(0, len(new), LANE):
            at = slice(lo, lo + LANE)
            state, most = self.state[at], self.n[at] - 2
            mass = (strength + d * tables[self.house[at]]) * self.p[at]
            left = self.tables[state]
            others = most + 1 - left
            x = rng.random(len(mass)) * (others + left * (1 - d) + mass) - mass
            over = x - others
            k = np.where(over < 0, x, np.minimum(others + over * (1 / (1 - d)), most)).astype(np.int64)
            opened = x < 0
            k[opened] = -1
            self.state[at] = more[state * (FEW + 1) + k + 1]
            new[at] = opened
        return np.flatnonzero(new)


class _Many:
    """Dishes with many customers: sizes of their tables in slots, some of them free."""

    def __init__(self, at, n, house, p, flat, t):
        self.at, self.n, self.house, self.p, self.t = at, n[at], house[at], p[at], t[at]
        self._lay(flat)

    def _lay(self, flat: np.ndarray) -> None:
        t = self.t
        slots = np.minimum(self.n, t + 2 + t // 2)
        self.first = np.concatenate([[0], np.cumsum(slots)])
        self.owner = np.repeat(np.arange(len(slots)), slots)
        self.size = np.zeros(self.first[-1], np.int64)
        inner = np.arange(len(flat)) - np.repeat(np.cumsum(t) - t, t)
        self.size[np.repeat(self.first[:-1], t) + inner] = flat

    def take(self, rng) -> np.ndarray:
        """Takes a customer of each dish off its table; the dishes whose table is gone."""
        while True:
            n, (lo, hi) = self.n, (self.first[:-1], self.first[1:])
            total = np.cumsum(self.size)
            left = np.searchsorted(total, total[lo] - self.size[lo] + np.floor(rng.random(len(n)) * n).astype(np.int64), side="right")
            self.size[left] -= 1
            gone = self.size[left] == 0
            t = self.t - gone
            self.slots = hi - lo - t
            if not ((self.slots == 0) & (t < n)).any():
                self.t = t
                return np.flatnonzero(gone)
            # No slot for a new table: make room for all dishes and put their customers where they were.
            self.size[left] += 1
            self._lay(self.size[self.size > 0])

    def put(self, tables: np.ndarray, d: float, strength: float, rng) -> np.ndarray:
        """Seats them again; the dishes that have a new table."""
        mass = (strength + d * tables[self.house]) * self.p
        lo, hi = self.first[:-1], self.first[1:]
        total = np.cumsum(np.where(self.size > 0, self.size - d, (mass / np.maximum(self.slots, 1))[self.owner]))
        start = np.concatenate([[0.0], total])[lo]
        new = np.searchsorted(total, start + rng.random(len(lo)) * (total[hi - 1] - start), side="right").clip(lo, hi - 1)
        opened = self.size[new] == 0
        self.size[new] += 1
        self.t = self.t + opened
        return np.flatnonzero(opened)


class Seats:
    """Table sizes of dishes in restaurants, re-seated by Gibbs steps.

    n: customers of each dish; house: its restaurant; p: the parent's probability of it; elsewhere: tables of each
    restaurant that are not among these dishes. sizes: table sizes of all dishes one after the other and how many tables
    each has, or None for a first draw."""

    def __init__(self, n, house, p, elsewhere, d: float, strength: float, rng, sizes=None):
        self.n, self.house, self.d, self.strength, self.rng = n, house, d, strength, rng
        if sizes is None:
            first = np.bincount(house, minlength=len(elsewhere)) + elsewhere
            t = seat(n, (strength + d * first[house]) * p, d, rng)
            share = rng.standard_gamma(1 - d, int(t.sum())) + 1e-12
            owner = np.repeat(np.arange(len(n)), t)
            flat = 1 + np.floor((n - t)[owner] * share / np.bincount(owner, share, len(n))[owner]).astype(np.int64)
            flat[np.cumsum(t) - t] += n - np.bincount(owner, flat, len(n)).astype(np.int64)
        else:
            flat, t = sizes
        t = np.asarray(t, np.int64)
        self.tables = np.bincount(house, t, len(elsewhere)) + elsewhere
        # A single customer always has one table.
        self.kinds = []
        for kind, here in ((_Few, (n > 1) & (n <= FEW)), (_Many, n > FEW)):
            if here.any():
                self.kinds.append((kind(np.flatnonzero(here), n, house, p, flat[np.repeat(here, t)], t), here))

    @property
    def t(self) -> np.ndarray:
        """How many tables each dish has."""
        t = np.ones(len(self.n), np.int64)
        for x, _ in self.kinds:
            t[x.at] = x.t
        return t

    def step(self) -> None:
        """Takes one customer of each dish that has several off its table and seats it again."""
        size = len(self.tables)
        tables = self.tables - sum(np.bincount(x.house[x.take(self.rng)], minlength=size) for x, _ in self.kinds)
        self.tables = tables + sum(np.bincount(x.house[x.put(tables, self.d, self.strength, self.rng)], minlength=size) for x, _ in self.kinds)

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of all tables, dish by dish, and how many each dish has."""
        t = self.t
        out = np.ones(int(t.sum()), np.int64)
        for x, here in self.kinds:
            size = x.size
            out[np.repeat(here, t)] = size[size > 0]
        return out, t

    def evidence(self, whole: np.ndarray) -> np.ndarray:
        """What the draw of discount and strength needs of the dishes' tables, (sum of 1 - z), and of restaurants that
        are whole here: (sums of 1 - y, of y, and of log x)."""
        flat, _ = self.sizes()
        d, s = self.d, self.strength
        more = len(flat) - np.cumsum(np.bincount(flat))[:-1]  # tables with more than j customers, from j = 0
        j = np.arange(1, len(more))
        z = self.rng.binomial(more[1:].astype(np.int64), (1 - d) / (j - d)).sum() if len(j) else 0
        t = self.tables[whole].astype(np.int64)
        customers = np.bincount(self.house, self.n, len(self.tables))[whole]
        return np.array([z, *_strength_evidence(customers, t, d, s, self.rng)], float)


def _strength_evidence(customers: np.ndarray, tables: np.ndarray, d: float, strength: float, rng) -> tuple[float, float, float]:
    tables = tables[customers > 1]
    customers = customers[customers > 1]
    if not len(tables):
        return 0.0, 0.0, 0.0
    more = len(tables) - np.cumsum(np.bincount(tables))[:-1]
    i = np.arange(1, len(more))
    y = rng.binomial(more[1:].astype(np.int64), strength / (strength + d * i)).sum() if len(i) else 0
    return float(more[1:].sum() - y), float(y), float(np.log(rng.beta(strength + 1, customers - 1)).sum())


def draw_parameters(evidence: np.ndarray, rng) -> tuple[float, float]:
    """Discount and strength from their posterior: beta(1, 1) and gamma(1, 1) before the evidence of Seats."""
    z, not_y, y, log_x = evidence
    d = float(np.clip(rng.beta(1 + not_y, 1 + z), 0.02, 0.98))
    return d, float(np.clip(rng.gamma(1 + y, 1 / (1 - log_x)), 1e-3, 1e6))


@dataclass
class Model:
    n_train: int
    n_types: int
    unknown: float  # the root's probability of the unknown token, and its share of every other's
    blocks: DataFrame  # bucket, block: _Fitted
    words: DataFrame  # w, n, root: the tokens' counts and root probabilities
    buckets: int
    parts: dict[str, int]  # over how many buckets a frequent context's followers are dealt
    frequent: dict[str, tuple[float, float]]  # a frequent context's weight and customers
    d: float
    strength: float

    def _rows(self, kind: str, rows) -> DataFrame:
        frequent, d, strength = {c.encode(): x for c, x in self.frequent.items()}, self.d, self.strength

        def run(batches):
            for batch in batches:
                for block in batch.column(0).to_pylist():
                    yield rows(_Fitted(block, frequent, d, strength))

        return self.blocks.select("block").mapInArrow(run, kind)

    @property
    def seats(self) -> DataFrame:
        """c, w, gain, weight, root of every pair seen: its probability is gain + weight * root."""

        def rows(b: _Fitted) -> pa.RecordBatch:
            names = b.names.cast(pa.string())
            cols = [names.take(pa.array(b.own[b.house])), names.take(pa.array(b.w)), *map(pa.array, (b.gain, b.weight[b.house], b.p[b.w]))]
            return pa.RecordBatch.from_arrays(cols, names=["c", "w", "gain", "weight", "root"])

        return self._rows("c string, w string, gain double, weight double, root double", rows)

    @property
    def weights(self) -> DataFrame:
        """c, weight of every context: how much of its probability goes by the root."""

        def rows(b: _Fitted) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.names.take(pa.array(b.own)).cast(pa.string()), pa.array(b.weight)], names=["c", "weight"])

        return self._rows("c string, weight double", rows).groupBy("c").agg(F.max("weight").alias("weight"))


class _Fitted:
    """A bucket's block after the last pass: the predictive probabilities of its pairs."""

    def __init__(self, block: list[bytes], frequent: dict[bytes, tuple[float, float]], d: float, strength: float):
        self.names = _block_words(block)
        self.own, self.house, self.w = _unpack(block[1]), np.cumsum(_unpack(block[2])), _unpack(block[3])
        n, mean, tables = _unpack(block[4]), _unpack(block[5], "<f8"), _unpack(block[6], "<f8")
        self.p, self.n_w = _unpack(block[7], "<f8"), _unpack(block[8], "<i8")
        customers = np.bincount(self.house, n, len(self.own))
        often = _unpack(block[_OFTEN])
        for k, name in zip(often.tolist(), self.names.take(pa.array(self.own[often])).to_pylist()):
            customers[k] = frequent[name][1]
        self.weight = (strength + d * tables) / (strength + customers)
        for k, name in zip(often.tolist(), self.names.take(pa.array(self.own[often])).to_pylist()):
            self.weight[k] = frequent[name][0]
        self.gain = (n - d * mean) / (strength + customers[self.house])


def _seated(bucket: int, left: pa.Table, right: pa.Table, root: tuple[float, float, float], hot: dict, d: float, strength: float, seed: list[int], steps: int, ahead: int) -> pa.Table:
    """_state rows of a bucket after one pass. left: its block; right: what each part of the root answers; root: weights
    of the root's t, mean and of all; hot: customers and tables of the frequent contexts; ahead: passes that follow."""
    block, last = left.column("block")[0].as_py(), not ahead
    own, house, w, n, t, sizes = _unpack(block[1]), np.cumsum(_unpack(block[2])), _unpack(block[3]), _unpack(block[4]), block[5], block[6]
    answers = sorted(zip(right.column("part").to_pylist(), right.column("answer").to_pylist()))
    guests, opened = (np.concatenate([_unpack(x[k]) for _, x in answers]) for k in range(2))
    p, words = root[0] * guests - root[1] * opened + root[2], len(guests)
    started = (_unpack(sizes), _unpack(t)) if t else None
    mine = np.bincount(house, started[1] if t else None, len(own))
    at = dict(zip(_unpack(block[_OFTEN]).tolist(), left.column("hot_c")[0].as_py()))
    whole, others = np.ones(len(own), bool), np.zeros(len(own))
    for h, c in at.items():
        whole[h], others[h] = False, max(0.0, hot[c][1] - mine[h])
    s = Seats(n, house, p[w], others, d, strength, np.random.default_rng([*seed, bucket]), started)
    mean, tables, kept = np.zeros(len(n)), np.zeros(len(own)), 0
    for step in range(steps):
        s.step()
        if last and 2 * step >= steps:
            mean, tables, kept = mean + s.t, tables + s.tables, kept + 1
    flat, now = s.sizes()
    mean, tables = (mean / kept, tables / kept) if kept else (now.astype(float), s.tables.astype(float))
    here = np.bincount(house, mean, len(own))
    asks = []
    if last:
        n_w = np.concatenate([_unpack(x[2]) for _, x in answers])
        block[5:_OFTEN] = _pack(mean, "<f8"), _pack(tables, "<f8"), _pack(p, "<f8"), _pack(n_w, "<i8")
    else:
        block[5:_OFTEN] = _pack(now), _pack(flat), b"", b""
        tables = np.bincount(w, now, words)
        customers = np.bincount(w, n, words) if ahead == 1 else None  # the root counts them in its last pass
        ends = _ends([len(_unpack(x[0])) for _, x in answers])
        asks = [(k, [x, _pack(tables[a:b]), b"" if customers is None else _pack(customers[a:b])]) for (k, _), x, (a, b) in zip(answers, block[_WORDS:], ends)]
    return _state(bucket, block, asks, {c: here[h] for h, c in at.items()}, s.evidence(whole))


def fit(train: DataFrame, seed: int = 7, passes: int = 3, steps: int = 24, room: int = ROOM) -> tuple[Model, DataFrame]:
    """The model and the table (w, n, root) of all tokens. train: rows with a text; a null text is an empty one, repeated
    rows count each, and texts count whole, however long. Without any row every token is unknown. Each pass makes `steps`
    Gibbs steps in all contexts and in the root; the last pass averages over the second half of its steps."""
    rng = np.random.default_rng(seed)
    counts = materialise(token_counts(train), "token_counts")
    n_train, n_types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    base = 1 / (n_types + 1)
    # A context has as many customers as the token of its name; fewer than HOT contexts are frequent.
    buckets = 1 + n_train // (BUCKET * room)
    hot = {w: [int(n), 0.0] for w, n in counts.where(F.col("n") > max(room, n_train // HOT)).select("w", "n").collect()}
    parts = {c: min(buckets, 1 + n // room) for c, (n, _) in hot.items()}
    d, strength, d0, strength0 = 0.7, 5.0, 0.6, 20.0
    state = materialise(pair_blocks(train, buckets, parts, 1 + n_types // ROOT), "pairs")
    root_tables = 0.0

    def meet() -> None:
        for c, t in state.where("block is not null").select(F.explode(F.arrays_zip("hot_c", "hot_t")).alias("h")).groupBy("h.hot_c").agg(F.sum("h.hot_t")).collect():
            hot[c][1] = float(t)

    kept = max(1, steps - (steps + 1) // 2)

    def root_pass(number: int) -> DataFrame:
        """Seats the root's customers, a part at a time: sums (t, mean, now, z) of each part; an answer to each bucket, the
        words' t, sums of tables over `kept` steps, and n; in the last pass also the words (w, n, t, mean)."""
        args, last = (d0, strength0, root_tables), number == passes - 1
        schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("answer", _BLOCK), ("w", pa.string()), ("n", pa.int64()), ("t", pa.float64()), ("mean", pa.float64()), ("now", pa.float64()), ("z", pa.float64())])

        def run(key, table):
            d0, strength0, tables = args
            part, asked = key[0].as_py(), table.column("guests").to_pylist()
            words, at = _numbered([x for x, _, _ in asked])
            sums = lambda k: np.bincount(np.concatenate(at), np.concatenate([_unpack(x[k]) for x in asked])).astype(np.int64)
            guests, n = sums(1), sums(2) if last else None
            # Of the root's tables those of other parts stay as they were; a table a dish is the first guess.
            other = np.array([max(0.0, (tables or float(n_types)) - len(guests))])
            s = Seats(guests, np.zeros(len(guests), np.int64), np.full(len(guests), base), other, d0, strength0, np.random.default_rng([seed, 1, number, part]))
            opened = np.zeros(len(guests), np.int64)
            for k in range(steps):
                s.step()
                if 2 * k >= steps:
                    opened += s.t
            mean = opened / kept
            found = [{"part": part, "t": float(guests.sum()), "mean": float(mean.sum()), "now": float(s.t.sum()), "z": float(s.evidence(np.zeros(1, bool))[0])}]
            found += [{"bucket": b, "part": part, "answer": [_pack(guests[k]), _pack(opened[k]), _pack(n[k]) if last else b""]} for b, k in zip(table.column("bucket").to_pylist(), at)]
            out = pa.Table.from_pylist(found, schema)
            if last:
                cols = {"w": words.cast(pa.string()), "n": pa.array(n), "t": pa.array(guests.astype(float)), "mean": pa.array(mean)}
                out = pa.concat_tables([out, pa.Table.from_arrays([cols.get(f.name, pa.nulls(len(n), f.type)) for f in schema], schema=schema)])
            return out

        asks = state.where("guests is not null").select("bucket", "part", "guests")
        return materialise(asks.groupBy("part").applyInArrow(run, "bucket int, part int, answer array<binary>, w string, n bigint, t double, mean double, now double, z double"), "root")

    def seating(number: int, weights: tuple[float, float, float]):
        args = weights, dict(hot), d, strength, [seed, 2, number], steps, passes - 1 - number
        return lambda key, left, right: _seated(key[0].as_py(), left, right, *args)

    meet()
    for number in range(passes):
        # The root, given the contexts' tables.
        root = root_pass(number)
        guests, opened, tables, z = root.where("z is not null").agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in ("t", "mean", "now", "z")]).first()
        used = d0, strength0
        if guests and number < passes - 1:
            d0, strength0 = draw_parameters(np.array([z, *_strength_evidence(np.array([guests]), np.array([int(tables)]), d0, strength0, rng)]), rng)
        root_tables = tables
        unknown = (used[1] + used[0] * opened) / (used[1] + guests) * base if guests else 1.0
        share = 1 / (used[1] + guests), used[0] / (used[1] + guests)
        # The contexts, given the root. A word is asked for once a bucket.
        met = root.where("answer is not null").select("bucket", "part", "answer")
        blocks = state.where("block is not null").select(F.col("bucket").alias("of"), "block", "hot_c")
        old, state = [state, root], materialise(blocks.groupBy("of").cogroup(met.groupBy("bucket")).applyInArrow(seating(number, (share[0], share[1] / kept, unknown)), _STATE), "seats")
        meet()
        if number == passes - 1:
            break
        evidence = np.array([float(x or 0) for x in state.where("block is not null").agg(*[F.sum(F.col("e")[k]) for k in range(4)]).first()])
        if hot:
            evidence[1:] += _strength_evidence(np.array([n for n, _ in hot.values()]), np.array([int(t) for _, t in hot.values()]), d, strength, rng)
        d, strength = draw_parameters(evidence, rng)
        discard(*old)
    table = materialise(root.where("w is not null").select("w", "n", (share[0] * F.col("t") - share[1] * F.col("mean") + unknown).alias("root")), "words")
    discard(counts, *old)
    frequent = {c: ((strength + d * t) / (strength + n), float(n)) for c, (n, t) in hot.items()}
    return Model(int(n_train), int(n_types), float(unknown), state.where("block is not null").select("bucket", "block"), table, buckets, parts, frequent, d, strength), table


class _Places:
    """Places of numbers in an array of distinct ones, by a hash table with at least half of its slots free."""

    def __init__(self, keys: np.ndarray):
        bits = (4 * len(keys) + 8).bit_length() - 1
        self.keys, self.shift, self.mask = keys if len(keys) else np.zeros(1, np.int64), np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slots(keys)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            lost = self.table[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def _slots(self, x: np.ndarray) -> np.ndarray:
        return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """-1 for numbers that are not there."""
        out = np.empty(len(x), np.int32)
        for lo in range(0, len(x), 2 * LANE):
            some = x[lo : lo + 2 * LANE]
            slot = self._slots(some)
            at = self.table[slot]
            wrong = np.flatnonzero((at >= 0) & (self.keys[at] != some))
            while len(wrong):
                slot[wrong] = (slot[wrong] + 1) & self.mask
                at[wrong] = there = self.table[slot[wrong]]
                wrong = wrong[(there >= 0) & (self.keys[there] != some[wrong])]
            out[lo : lo + 2 * LANE] = at
        return out


def _answered(left: pa.Table, right: pa.Table, schema: pa.Schema, fitted) -> pa.Table:
    """Sums of a bucket's pairs for each text that sent some, tokens that the bucket doesn't know, and rows (ids, tokens)
    as they came. left: requests; right: the bucket's block, if it has one."""
    weights, unigram = fitted[0], fitted[2]
    b = _Fitted(right.column("block")[0].as_py(), weights, *fitted[1]) if right.num_rows else None
    look = b.names if b else pa.array([], pa.binary())
    more = pa.array(list(weights), pa.binary())
    more = more.filter(pc.invert(pc.is_in(more, value_set=look)))
    # Of each word, and last of one not known: the number of its restaurant and its weight.
    house_of, share_of = np.full(len(look) + len(more) + 1, -1), np.ones(len(look) + len(more) + 1)
    known = len(b.p) if b else 0
    if b:
        house_of[b.own], share_of[b.own] = np.arange(len(b.own)), b.weight
        places, gain, log_n = _Places(b.house * known + b.w), np.append(b.gain, 0.0), unigram(b.n_w)
    share_of[len(look) : -1] = [weights[c][0] for c in more.to_pylist()]
    look = pa.concat_arrays([look, more])
    out = [left.filter(pc.is_valid(left.column("ids"))).select(["flush", "ids", "tokens"])]
    sums, unmet = [], []
    asked = left.filter(pc.is_valid(left.column("block")))
    blocks = asked.column("block").to_pylist()
    names, sizes = _all_words([x[0] for x in blocks])
    name_at = pc.fill_null(pc.index_in(names, value_set=look), -1).to_numpy(zero_copy_only=False)

    def answer(part: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]], lo: int, hi: int) -> None:
        """Of some blocks, whose words are lo to hi of all: flush, where its words begin, texts, contexts and words of its pairs."""
        flushes, at = np.array([x[0] for x in part]), name_at[lo:hi]
        of = np.repeat(np.arange(len(part)), [len(x[2]) for x in part])
        text = np.concatenate([x[2] for x in part])
        c, w = (np.concatenate([x[k] + (x[1] - lo) for x in part]) for k in (3, 4))
        share, v = share_of[at][c], at[w]
        met = (v >= 0) & (v < known)
        if met.any():
            here = v[met]
            p = share[met] * b.p[here] + gain[places.find(house_of[at][c[met]] * known + here)]
            one = of[met] * (int(text.max()) + 1) + text[met]
            new = np.diff(one, prepend=-1) > 0  # texts come in order
            inner = np.cumsum(new) - 1
            texts, many, base, mine = text[met][new], np.bincount(inner), np.bincount(inner, log_n[here]), np.bincount(inner, np.log10(p))
            found, many_of = np.unique(of[met][new], return_counts=True)
            for k, (i, j) in zip(found.tolist(), _ends(many_of)):
                sums.append((flushes[k], [_ascending(texts[i:j]), _pack(many[i:j]), _pack(base[i:j], "<f8"), _pack(mine[i:j], "<f8")]))
        if not met.all():
            off = np.flatnonzero(~met)
            unmet.append(pa.table([pa.array(flushes[of[off]]), pa.array(text[off].astype(np.int32)), names.take(pa.array(w[off] + lo)).cast(pa.string()), pa.array(share[off])], names=["flush", "k", "w", "weight"]))

    part, size, first = [], 0, 0
    for flush, (_, text, c, w), (lo, hi) in zip(asked.column("flush").to_pylist(), blocks, _ends(sizes)):
        part.append((flush, lo, np.cumsum(_unpack(text)), _unpack(c), _unpack(w)))
        size += len(part[-1][2])
        if size >= FLUSH // 2:
            answer(part, first, hi)
            part, size, first = [], 0, hi
    if part:
        answer(part, first, hi)
    out.append(pa.table([pa.array([f for f, _ in sums], pa.int64()), pa.array([x for _, x in sums], _BLOCK)], names=["flush", "block"]))
    out += unmet
    whole = [pa.Table.from_arrays([t.column(f.name).cast(f.type) if f.name in t.column_names else pa.nulls(t.num_rows, f.type) for f in schema], schema=schema) for t in out]
    return pa.concat_tables(whole)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row's whole text, however long.

    base_score is the add-one unigram's log10 probability, score the model's. A null or empty text is END alone. Repeated
    rows are scored each on its own; an empty table gives no rows; columns other than doc_id and text are not read.
    """
    m = model
    floor = float(m.n_train + m.n_types + 1)
    kind = docs.schema["doc_id"].dataType.simpleString()
    buckets, parts = m.buckets, {c.encode(): n for c, n in m.parts.items()}
    fitted = {c.encode(): x for c, x in m.frequent.items()}, (m.d, m.strength), lambda n: np.log10((n + 1) / floor)

    def ask(batches):
        """Of some texts at a time: a row with their doc_ids and numbers of tokens, and their pairs for each bucket."""
        first = TaskContext.get().partitionId() << 32

        def out(g, ids, n, flush):
            c, w = g.pairs()
            text = np.repeat(np.arange(len(n), dtype=np.int32), n)
            rows = [(b, [_pack_names(names), _ascending(text[at]), _pack(c), _pack(w)]) for b, at, names, c, w in g.slices(buckets, parts, c, w)]
            ids = pa.chunked_array(ids).combine_chunks()
            own = lambda x: pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), x), pa.nulls(len(rows), pa.list_(x.type))])
            return pa.RecordBatch.from_arrays(
                [pa.array([flush % buckets, *(b for b, _ in rows)], pa.int32()), pa.array(np.full(len(rows) + 1, flush)), pa.array([None, *(x for _, x in rows)], _BLOCK), own(ids), own(pa.array(n.astype(np.int32)))],
                names=["bucket", "flush", "block", "ids", "tokens"],
            )

        g, ids, n, flush = _Gathered(), [], [], first
        for batch in batches:
            for a, b in _cuts(batch.column(1)):
                n.append(g.add_all(batch.column(1).slice(a, b - a)))
                ids.append(batch.column(0).slice(a, b - a))
                if g.size >= FLUSH:
                    yield out(g, ids, np.concatenate(n), flush)
                    g, ids, n, flush = _Gathered(), [], [], flush + 1
        if n:
            yield out(g, ids, np.concatenate(n), flush)

    asked = _texts(steady(docs), "doc_id").mapInArrow(ask, f"bucket int, flush bigint, block array<binary>, ids array<{kind}>, tokens array<int>")
    form = f"flush bigint, block array<binary>, ids array<{kind}>, tokens array<int>, k int, w string, weight double"
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    schema = pa.schema([("flush", pa.int64()), ("block", _BLOCK), ("ids", pa.list_(id_type)), ("tokens", pa.list_(pa.int32())), ("k", pa.int32()), ("w", pa.string()), ("weight", pa.float64())])
    answer = lambda left, right: _answered(left, right, schema, fitted)
    answers = materialise(asked.groupBy("bucket").cogroup(m.blocks.groupBy("bucket")).applyInArrow(answer, form), "answers")
    # Tokens that their bucket doesn't know meet their own rows.
    new = materialise(answers.where("w is not null").select("flush", "k", "w", "weight"), "new")
    new = spread_join(new, m.words, ["w"], ["flush", "k"], "left")
    one = lambda x: F.coalesce("n", F.lit(0)) + x
    alone = new.groupBy("flush", "k").agg(
        F.count("n").alias("known"), F.sum(F.log10(one(1) / F.lit(floor))).alias("base"), F.sum(F.log10(F.col("weight") * F.coalesce("root", F.lit(m.unknown)))).alias("mine")
    )
    parts_of = answers.where("w is null").select("flush", "block", "ids", "tokens").unionByName(alone, allowMissingColumns=True)

    def total(table: pa.Table) -> pa.Table:
        rows = table.filter(pc.is_valid(table.column("ids")))
        ids, tokens = rows.column("ids").combine_chunks().flatten(), rows.column("tokens").combine_chunks().flatten()
        sums = np.zeros((3, len(tokens)))
        for block in table.column("block").to_pylist():
            if block:
                at = np.cumsum(_unpack(block[0]))
                for k, (b, form) in enumerate(zip(block[1:], ("<u4", "<f8", "<f8"))):
                    sums[k, at] += _unpack(b, form)
        lone = table.filter(pc.is_valid(table.column("k")))
        for k, name in enumerate(("known", "base", "mine")):
            sums[k, lone.column("k").to_numpy()] += lone.column(name).to_numpy()
        return pa.table([ids, tokens.cast(pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    out = parts_of.groupBy("flush").applyInArrow(total, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(m.n_train).cast("bigint").alias("train_tokens"), "base_score", "score")
