"""Operator 4: exact Jaccard similarity join of word-shingle sets, using relations between sets to skip work.

1. Equal sets are one class; classes are joined by one member, copies are never expanded.
2. Sets are ordered by (how often a shingle was seen again, hash): any order gives the same result, this one puts shared
   passages last. Sets that reach the threshold share shingles among their first elements, and their sizes bound where.
   Index lists hold (set, size, position) of those elements; lists of one set are dropped.
3. In each list and band of sizes the set at the least position leads. A set is compared in full with the leader that
   shares most of its lists; the answer is kept as a difference: what the set adds to the leader and what it lacks. Sets that
   link with no leader do so once more among themselves. Linked sets are components by now.
4. Lists are laid out in blocks of BLOCK entries by leader, component, size and position, and a pair of blocks is skipped
   whole if one leader or one component fills both, if their sizes are too far apart, or if their positions leave too
   little overlap. Entries of the rest meet if the parity bits of their sets, which differ in no more places than the
   sets in elements, allow a link. Out of them come the pairs across components that share as many shingles there as a
   link takes.
5. The answers of one leader's sets are derived from the leader's. As |x & y| = |l| - |l-x| - |l-y| + |(l-x) & (l-y)| +
   |(x-l) & (y-l)|, two sets that are not linked through the leader link only if their differences have so much in
   common; candidates come from an index of the differences, in blocks again, and are answered by the formula. Sets of
   different leaders are compared in full.

All lists go this way, whatever their length. A dense group of near copies thus costs a comparison per member, not per
pair. Lists of shingles known to be frequent are dealt over several parts, and the followers of a leader too. Sets are
rebuilt from the texts where they are compared, as a text is smaller than its shingles.

Shingles are 64-bit hashes of their words, as in the size of the sets: two different shingles of one pair of texts would
have to collide to change its answer.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelflow.llm.common import dealt, discard, folded_words, hot_keys, in_parts, materialise, repeated, spread_join, with_row_id
from labelflow.llm.components import connected

#: Shingles that a task counts at a time, and how many repeated ones shape the order at most (it is only an order).
CHUNK, ORDER_HINTS = 4_000_000, 400_000
#: Entries of a block of an index list, and of a part of a frequent shingle's list (about).
BLOCK, PART = 32, 4096
#: Size of the bitmap that finds the texts of sets again.
FILTER_BITS = 23
#: 64-bit words of parity bits kept for a set, and their columns.
PARITY_WORDS = 2
PARITY = [f"b{k}" for k in range(PARITY_WORDS)]


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text (A-Z lower-cased); of fewer words, the whole
    sequence is one shingle; without words there is none."""
    words = folded_words(text)
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(width, len(h))
    out = np.full(len(h) - span + 1, span, np.uint64)
    for k in range(span):
        out = (out ^ h[k : len(h) - span + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    out = np.sort(out.view(np.int64))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def parity(s: np.ndarray, words: int = PARITY_WORDS) -> np.ndarray:
    """Bits of a set of hashes: each says whether the number of elements that fall on it is odd. Two sets' bits differ in
    no more places than the sets in elements."""
    place = (s.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    odd = np.bincount((place % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def order_hints(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles seen three times or more in different sets of a task's share, with their summed counts, at most
    ORDER_HINTS of the most frequent."""

    def run(batches):
        held, size, seen = [], 0, set()

        def out():
            token, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(token[n > 2]), pa.array(n[n > 2].astype(np.int64))], names=["token", "n"])

        for batch in in_parts(batches):
            for t in batch.column(0).to_pylist():
                s = shingles(t, width)
                if len(s) and (key := hash(s.tobytes())) not in seen:
                    seen.add(key), held.append(s)
                    size += len(s)
                if size > CHUNK:
                    yield out()
                    held, size = [], 0
                    seen.clear()
        yield out()

    got = texts.select("_text").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(ORDER_HINTS).toPandas().sort_values("token")
    return got["token"].to_numpy(np.int64), got["n"].to_numpy(np.int64)


def signatures(texts: DataFrame, hints, width: int, num: int, den: int) -> DataFrame:
    """(_row, _id, size, key, prefix, bits): the set's size, a 128-bit digest of it, its first elements in the order, and
    its parity bits. hints: broadcast order_hints."""
    kind = texts.schema["_id"].dataType.simpleString()

    def run(batches):
        token, count = hints.value
        for batch in in_parts(batches):
            size, key, prefix, bits = [], [], [], []
            for t in batch.column(2).to_pylist():
                s = shingles(t, width)
                size.append(len(s))
                key.append(hashlib.md5(s.tobytes()).digest())
                bits.append(parity(s))
                if len(token) and len(s):
                    at = np.minimum(np.searchsorted(token, s), len(token) - 1)
                    seen = np.where(token[at] == s, count[at], 0)
                    s = s[np.argsort(seen, kind="stable")]
                prefix.append(s[: len(s) - -(-num * len(s) // den) + 1].tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int32()), pa.array(key, pa.binary()), pa.array(prefix, pa.binary()), pa.array(bits, pa.list_(pa.int64()))], names=["_row", "_id", "size", "key", "prefix", "bits"])

    return texts.select("_row", "_id", "_text").mapInArrow(run, f"_row bigint, _id {kind}, size int, key binary, prefix binary, bits array<bigint>")


def _entries(sets: DataFrame, hints) -> DataFrame:
    """(token, parts, x, n, i): element `token` of set x, of size n, at position i; parts: over how many parts the
    token's list is dealt."""

    def run(batches):
        token, count = hints.value
        for batch in in_parts(batches):
            tokens = [np.frombuffer(p, np.int64) for p in batch.column(2).to_pylist()]
            many = np.array([len(t) for t in tokens], np.int64)
            flat = np.concatenate([*tokens, np.zeros(0, np.int64)])
            parts = np.ones(len(flat), np.int32)
            if len(token):
                at = np.minimum(np.searchsorted(token, flat), len(token) - 1)
                parts += np.where(token[at] == flat, count[at] // PART, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat), pa.array(parts), pa.array(np.repeat(batch.column(0).to_numpy(), many)), pa.array(np.repeat(batch.column(1).to_numpy(), many)), pa.array(np.concatenate([*map(np.arange, many), np.zeros(0, np.int64)]).astype(np.int32))],
                names=["token", "parts", "x", "n", "i"],
            )

    return sets.select("x", "n", "prefix").mapInArrow(run, "token bigint, parts int, x bigint, n int, i int")


def _ceil_share(n: Column, num: int, den: int) -> Column:
    """The least overlap that a set of size n or more needs with any other."""
    return F.floor((n.cast("bigint") * num + (den - 1)) / den)  # exact: sizes are far below 2^53


def _can_share(num: int, den: int, n: Column, i: Column, m: Column, j: Column) -> Column:
    """The size and position bounds of two entries (n, i) and (m, j) of a list: either set has enough elements from here
    on to reach the larger one's least overlap."""
    need = _ceil_share(F.greatest(n, m), num, den)
    return (F.least(n, m).cast("bigint") * den >= F.greatest(n, m).cast("bigint") * num) & (n - i >= need) & (m - j >= need)


def _may_link(num: int, den: int, n: Column, b: list[Column], m: Column, d: list[Column]) -> Column:
    """Whether sets of sizes n and m with parity bits b and d may differ in as few elements as a link allows."""
    apart = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(b, d)), F.lit(0))
    return apart * (num + den) <= (n.cast("bigint") + m) * (den - num)


def _least_shared(num: int, den: int, n: Column, m: Column) -> Column:
    """How many lists within _can_share a pair of sizes n and m within the threshold has at least."""
    need = F.floor(((n.cast("bigint") + m) * num + (num + den - 1)) / (num + den))
    return need - _ceil_share(F.greatest(n, m), num, den) + 1


def _compared(pairs: DataFrame, sets: DataFrame, num: int, den: int, differences: bool) -> DataFrame:
    """pairs (x, y), a written table, with link, and with differences also n2, lacks and adds of x against y, from the
    whole sets (_sets of these pairs). Many pairs of one set are dealt over several tasks."""
    left = spread_join(pairs.select("x", "y"), sets.where("is_x").select("x", F.col("set").alias("sx")), ["x"], ["y"])
    hot = hot_keys(pairs, ["y"])
    left = dealt(left, hot, ["y"], ["x"])
    right = repeated(sets.where("is_y").select(F.col("x").alias("y"), F.col("set").alias("sy")), hot, ["y"])
    both = left.join(right, ["y", "_part"]).select("x", "y", "sx", "sy")
    extra = ", n2 int, lacks array<bigint>, adds array<bigint>" * differences

    def run(batches):
        for batch in in_parts(batches):
            link, n2, lacks, adds = [], [], [], []
            for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(p, np.int64), np.frombuffer(q, np.int64)
                both = np.intersect1d(a, b, assume_unique=True)
                link.append(den * len(both) >= num * (len(a) + len(b) - len(both)))
                if differences:
                    n2.append(len(b)), lacks.append(np.setdiff1d(b, both, assume_unique=True)), adds.append(np.setdiff1d(a, both, assume_unique=True))
            cols = [pa.array(n2, pa.int32()), pa.array(lacks, pa.list_(pa.int64())), pa.array(adds, pa.list_(pa.int64()))] if differences else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(link, pa.bool_()), *cols], names=["x", "y", "link", "n2", "lacks", "adds"][: 3 + len(cols)])

    return both.mapInArrow(run, f"x bigint, y bigint, link boolean{extra}")


def _sets(texts: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(x, set, is_x, is_y) of the rows that pairs have as x or as y, and which of both. Two bitmaps of 2^FILTER_BITS
    hashed row ids, the same size whatever the corpus, let tasks skip nearly all other texts, so that neither texts nor
    sets are shuffled here. The few sets that they let through in error meet no pair later on."""
    place = lambda x: (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)

    def mark(batches):
        bits = np.zeros((2, 1 << FILTER_BITS), bool)
        for batch in batches:
            for side in range(2):
                bits[side, place(batch.column(side).to_numpy())] = True
        words = np.packbits(bits, axis=1).view(np.int64).ravel()
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(words[at])], names=["at", "word"])

    words = np.zeros(2 * (1 << FILTER_BITS) // 64, np.int64)
    marked = pairs.select("x", "y").mapInArrow(mark, "at int, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
    words[marked["at"].to_numpy()] = marked["word"].to_numpy()
    sent = texts.sparkSession.sparkContext.broadcast(words)

    def rebuild(batches):
        bits = np.unpackbits(sent.value.view(np.uint8)).view(bool).reshape(2, -1)
        for batch in in_parts(batches):
            is_x, is_y = bits[:, place(batch.column(0).to_numpy())]
            here = is_x | is_y
            batch = batch.filter(pa.array(here))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([shingles(t, width).tobytes() for t in batch.column(1).to_pylist()], pa.binary()), pa.array(is_x[here]), pa.array(is_y[here])],
                names=["x", "set", "is_x", "is_y"],
            )

    return texts.select("_row", "_text").mapInArrow(rebuild, "x bigint, set binary, is_x boolean, is_y boolean")


def leaders(lists: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y): the leader y of set x, that of most of x's lists (ties: the least) among those that lead at least a quarter as
    many as a link takes. In a list the set at the least position leads each band of sizes: rare elements come first,
    so it has the fewest of its own and is the most central one. Any choice gives the same result."""
    lists = lists.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))))
    first = F.min(F.struct("i", "x", "n"))
    led = lists.where("parts = 1").withColumn("h", first.over(Window.partitionBy("token", "band")))
    # A list dealt over parts has one leader all the same; a row per part finds it.
    long = lists.where("parts > 1")
    heads = long.groupBy("token", "band").agg(first.alias("h"), F.first("parts").alias("_parts"))
    heads = heads.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    led = led.unionByName(long.join(heads, ["token", "part", "band"]))
    led = led.where("x <> h.x").where(_can_share(num, den, F.col("n"), F.col("i"), F.col("h.n"), F.col("h.i")))
    led = led.groupBy("x", F.col("h.x").alias("y"), "n", F.col("h.n").alias("m")).agg(F.count(F.lit(1)).alias("shared"))
    led = led.where(4 * F.col("shared") >= _least_shared(num, den, F.col("n"), F.col("m")))
    return led.groupBy("x").agg(F.max(F.struct("shared", (-F.col("y")).alias("minus"))).alias("best")).select("x", (-F.col("best.minus")).alias("y"))


def _met(lists: DataFrame, order: list[str], fields: list[str], stats: list[Column]) -> DataFrame:
    """Lists (token, parts, part, c, ...) that hold more than one component c, in blocks: all pairs of blocks of one
    list, with the stats and entries (l) of either, those of the second under names that end in 2. A list of one block
    meets itself without a join. Blocks are written once, as all sides read them; the result and what comes of it discard
    them."""
    w = Window.partitionBy("token", "part")
    mixed = lists.withColumn("lo", F.min("c").over(w)).withColumn("hi", F.max("c").over(w)).where("parts > 1 or lo < hi")
    mixed = mixed.withColumn("lone", (F.col("parts") == 1) & (F.count(F.lit(1)).over(w) <= BLOCK))
    laid = mixed.withColumn("k", F.floor((F.row_number().over(w.orderBy(*order)) - 1) / BLOCK))
    blocks = laid.groupBy("token", "part", "k").agg(F.first("parts").alias("parts"), F.first("lone").alias("lone"), F.min("c").alias("c_lo"), F.max("c").alias("c_hi"), *stats, F.collect_list(F.struct(*fields)).alias("l"))
    blocks = materialise(blocks, "blocks")
    # A frequent token's blocks meet in as many joins as its list has parts.
    fields = [f for f in blocks.columns if f not in ("token", "parts", "lone")]
    twice = [F.col(f).alias(f"{f}2") for f in fields]
    left = blocks.where("not lone").select("token", F.col("part").alias("s"), *fields)
    right = blocks.where("not lone").withColumn("s", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("token", "s", *twice)
    met = left.join(right, ["token", "s"]).where("part < part2 or part = part2 and k <= k2").drop("s")
    met = met.unionByName(blocks.where("lone").select("token", *fields, *twice))
    met._shared_path = blocks._shared_path
    return met


def _apart(lo: str, hi: str) -> Column:
    """Not one and the same value in both blocks."""
    return ~((F.col(lo) == F.col(f"{hi}2")) & (F.col(hi) == F.col(f"{lo}2")))


def _entry_pairs(met: DataFrame, fits) -> DataFrame:
    """(e, o): pairs of entries of different components that `fits` holds for, each once."""
    rows = met.select((F.col("part") == F.col("part2")).alias("own"), (F.col("k") == F.col("k2")).alias("same"), F.explode("l").alias("e"), "l2")
    other = lambda o: (o["c"] != F.col("e.c")) & (~(F.col("own") & F.col("same")) | (o["x"] > F.col("e.x"))) & fits(F.col("e"), o)
    return rows.select("e", F.explode(F.filter("l2", other)).alias("o"))


def index_pairs(lists: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame, Column]:
    """Pairs (x, y) of different components and leaders (c and s of the lists) that share enough lists to link; also the
    pairs of blocks and which of them are not skipped."""
    met = _met(lists, ["s", "c", "n", "i", "x"], ["x", "n", "i", "c", "s", *PARITY], [F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.max(F.col("n") - F.col("i")).alias("rest"), F.min("s").alias("s_lo"), F.max("s").alias("s_hi")])
    need = _ceil_share(F.greatest("n_lo", "n_lo2"), num, den)
    kept = _apart("c_lo", "c_hi") & _apart("s_lo", "s_hi") & (F.col("rest") >= need) & (F.col("rest2") >= need)
    kept &= F.expr(f"cast(n_hi as bigint) * {den} >= cast(n_lo2 as bigint) * {num} and cast(n_hi2 as bigint) * {den} >= cast(n_lo as bigint) * {num}")
    pairs = _entry_pairs(met.where(kept), lambda e, o: (e["s"] != o["s"]) & _can_share(num, den, e["n"], e["i"], o["n"], o["i"]) & _may_link(num, den, e["n"], [e[b] for b in PARITY], o["n"], [o[b] for b in PARITY]))
    pairs = pairs.select(F.least("e.x", "o.x").alias("x"), F.greatest("e.x", "o.x").alias("y"), F.least("e.n", "o.n").alias("n"), F.greatest("e.n", "o.n").alias("m"))
    pairs = pairs.groupBy("x", "y", "n", "m").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= _least_shared(num, den, F.col("n"), F.col("m")))
    pairs = pairs.select("x", "y")
    pairs._shared_path = met._shared_path
    return pairs, met, kept


def difference_pairs(star: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (x, y) of one leader's sets (star: x, l, n2, lacks, adds, c, parts) in different components whose differences
    may have enough in common. What they need is least for the leader itself, so that each set's own comparison bounds
    how much of its difference the index must hold."""
    need = lambda n, m: F.floor(((n.cast("bigint") + m) * num + (num + den - 1)) / (num + den))
    rows = star.withColumn("a", F.size("lacks")).withColumn("d", F.size("lacks") + F.size("adds")).withColumn("n", F.col("n2") - F.size("lacks") + F.size("adds"))
    # What x adds comes first: other sets rarely have that. Added and lacking elements never meet in one leader's lists.
    rows = rows.select("x", "l", "c", "n", "a", "d", "n2", "parts", F.posexplode(F.concat(F.array_sort("adds"), F.array_sort("lacks"))).alias("i", "e"))
    rows = rows.where(F.col("i") <= F.col("d") - F.greatest(F.lit(1), need(F.col("n"), F.col("n2")) - F.col("n2") + F.col("a")))
    lists = rows.withColumn("token", F.xxhash64("l", "e")).withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int"))
    stats = [F.min("n").alias("n_lo"), F.min("a").alias("a_lo"), F.max(F.col("d") - F.col("i")).alias("rest"), F.max("n2").alias("of")]
    met = _met(lists, ["c", "d", "i", "x"], ["x", "c", "n", "a", "d", "i", "n2"], stats)
    least = need(F.col("n_lo"), F.col("n_lo2")) - F.greatest("of", "of2") + F.col("a_lo") + F.col("a_lo2")
    kept = _apart("c_lo", "c_hi") & (F.col("rest") >= least) & (F.col("rest2") >= least)

    def fits(e, o):
        common = need(e["n"], o["n"]) - e["n2"] + e["a"] + o["a"]
        return (e["d"] - e["i"] >= common) & (o["d"] - o["i"] >= common)

    pairs = _entry_pairs(met.where(kept), fits).select(F.least("e.x", "o.x").alias("x"), F.greatest("e.x", "o.x").alias("y")).distinct()
    pairs._shared_path = met._shared_path
    return pairs


def _links(pairs: DataFrame, star: DataFrame, texts: DataFrame, width: int, num: int, den: int, seen: dict | None) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) among pairs (x, y), a written table: by the formula for sets of one leader, in full for others. Beside
    them the tables that they read."""
    star = star.join(pairs.select("x").unionByName(pairs.select(F.col("y").alias("x"))), "x", "left_semi")
    right = star.select(F.col("x").alias("y"), F.col("l").alias("l2"), F.col("n2").alias("n2_2"), F.col("lacks").alias("lacks2"), F.col("adds").alias("adds2"))
    tried = materialise(pairs.join(star, "x", "left").join(right, "y", "left"), "tried")
    common = F.col("n2") - F.size("lacks") - F.size("lacks2") + F.size(F.array_intersect("lacks", "lacks2")) + F.size(F.array_intersect("adds", "adds2"))
    sizes = F.col("n2") + F.col("n2_2") - F.size("lacks") - F.size("lacks2") + F.size("adds") + F.size("adds2")
    derived = tried.where("l = l2").where(common * den >= (sizes - common) * num).select(F.col("x").alias("a"), F.col("y").alias("b"))
    full = materialise(tried.where("not (l <=> l2) or l is null").select("x", "y"), "full")
    sets = materialise(_sets(texts, full, width), "sets")
    rest = _compared(full, sets, num, den, differences=False).where("link").select(F.col("x").alias("a"), F.col("y").alias("b"))
    if seen is not None:
        for name, df in (("derived", tried.where("l = l2")), ("derived_links", derived), ("compared", full)):
            seen[name] = seen.get(name, 0) + df.count()
    return derived.unionByName(rest), [tried, full, sets]


def similar_sets(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (80, 100), keep: tuple[str, ...] = ("doc_id",), seen: dict[str, int] | None = None) -> DataFrame:
    """keep, n_shingles, component_id and _group of every row: the least doc_id among the rows reachable by links, itself
    included, and a number of those rows as a group. Two rows link when den * |a & b| >= num * |a | b| of their shingle
    sets, threshold being (num, den). seen, if given, receives how many pairs were answered in which way.

    Rows without words have no shingle and link with nothing. Equal sets link, repeated rows among them. Null doc_ids
    count for nothing in a component's least doc_id; a component without any other has null. Texts are taken whole,
    however long. Empty tables give no rows; columns other than keep, doc_id and text are not read, and may have any
    name.
    """
    num, den = threshold
    kept = [F.col(f"`{c}`").alias(f"_keep{i}") for i, c in enumerate(keep)]
    texts = with_row_id(docs.select(*kept, F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text")))
    hints = texts.sparkSession.sparkContext.broadcast(order_hints(texts, width))
    sig = materialise(signatures(texts, hints, width, num, den), "signatures")
    some = sig.where("size > 0")
    classes = materialise(some.groupBy("key", "size").agg(F.min("_row").alias("x"), F.min("_id").alias("_least")), "classes")
    heads = some.join(classes.select("key", "size", "x"), ["key", "size"]).where("_row = x").select("x", F.col("size").alias("n"), "prefix")
    entries = _entries(heads, hints).withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int"))
    lists = entries.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("token", "part"))).where("m > 1 or parts > 1").drop("m")
    lists = materialise(lists, "lists")

    led = materialise(leaders(lists, num, den), "leaders")
    sets = materialise(_sets(texts, led, width), "sets")
    answers = materialise(_compared(led, sets, num, den, differences=True), "answers")
    found = connected(answers.where("link").select(F.col("x").alias("a"), F.col("y").alias("b")))
    # A leader is in its own star, without a difference.
    star = answers.select("x", F.col("y").alias("l"), "n2", "lacks", "adds")
    own = answers.select(F.col("y").alias("x"), F.col("y").alias("l"), "n2").distinct().select("x", "l", "n2", F.array().cast("array<bigint>").alias("lacks"), F.array().cast("array<bigint>").alias("adds"))
    star = materialise(star.unionByName(own.join(star.select("x"), "x", "left_anti")), "star")

    # Sets without a link choose leaders among themselves.
    ordered = lambda df: df.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    again = materialise(ordered(leaders(lists.join(found.select(F.col("node").alias("x")), "x", "left_anti"), num, den)).distinct().join(ordered(led), ["x", "y"], "left_anti"), "again")
    links, tables = _links(again, star, texts, width, num, den, seen)
    joined = lambda f, more: connected(f.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    first, found = found, joined(found, links)
    discard(sets, first, *tables)

    # What is left: pairs across components.
    placed = star.join(found.withColumnRenamed("node", "x"), "x", "left").withColumn("c", F.coalesce("component", "x")).drop("component")
    open_ = placed.groupBy("l").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("l", (1 + F.floor(F.col("n") / PART)).cast("int").alias("parts"))
    placed = materialise(placed, "placed")
    inside = difference_pairs(spread_join(placed, open_, ["l"], ["x"]), num, den)
    bits = [F.col("bits")[k].alias(b) for k, b in enumerate(PARITY)]
    at = lists.join(found.withColumnRenamed("node", "x"), "x", "left").join(star.select("x", F.col("l").alias("s")), "x", "left").join(sig.select(F.col("_row").alias("x"), *bits), "x")
    across, met, needed = index_pairs(at.select("token", "parts", "part", "x", "n", "i", F.coalesce("component", "x").alias("c"), F.coalesce("s", -1 - F.col("x")).alias("s"), *PARITY), num, den)
    if seen is not None:
        seen["led"], seen["block_pairs"], seen["skipped_block_pairs"] = led.count(), met.count(), met.where(~needed).count()
    pairs = materialise(across.unionByName(inside).join(ordered(led).unionByName(again), ["x", "y"], "left_anti"), "pairs")
    discard(across, inside)
    links, tables = _links(pairs, star, texts, width, num, den, seen)
    # Components so far are stars, so new links need only join those.
    merged = joined(found, links)
    discard(lists, led, answers, star, again, placed, found, pairs, *tables)

    named = classes.join(merged.withColumnRenamed("node", "x"), "x", "left").select("key", "size", F.coalesce("component", "x").alias("c"), "_least")
    named = materialise(named, "named")
    discard(classes, merged)
    least = named.groupBy("c").agg(F.min("_least").alias("component_id"))
    by_set = materialise(named.select("key", "size", "c").join(least, "c"), "by_set")
    discard(named)
    # Rows meet their set by its key; a set's copies are dealt over several tasks.
    out = spread_join(sig.select("_row", "_id", "size", "key"), by_set, ["key", "size"], ["_row"], "left")
    out = out.select("_row", "_id", F.col("size").cast("bigint").alias("n_shingles"), F.when(F.col("size") == 0, F.col("_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("c", "_row").alias("_group"))
    if keep == ("doc_id",):
        return out.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id", "_group")
    return texts.select("_row", *[f"_keep{i}" for i in range(len(keep))]).join(out, "_row").select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], "n_shingles", "component_id", "_group")
