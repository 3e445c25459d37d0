"""Nearest neighbours by cosine similarity, in two forms with the same result.

neighbours_sql is one relational expression. neighbours_blocked packs both sides into matrices, the index by places in
space, and goes through the index block by block, leaving out patches that are too far off to hold a neighbour: a task keeps
only k rows a query, so what is shuffled grows with queries times tasks, and nothing is broadcast beyond what Spark itself
decides.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelflow.functions.vector import cosine, norm
from labelflow.schemas import K_NEIGHBOURS

#: Rows of a block, at the most, and bytes of the vectors of one.
BLOCK_ROWS, BLOCK_BYTES = 8192, 4 << 20
#: Directions that tell places apart.
PLACE_BITS = 8
#: Blocks of queries that a task has in hand.
OPEN_BLOCKS = 32
#: Queries of a block that are multiplied with a block of the index at a time.
TILE_ROWS = 256
#: Rows of a block of the index that they are multiplied with at a time.
TILE_COLUMNS = 2048
#: Pairs of vectors that are multiplied exactly at a time.
EXACT_PAIRS = 2048
#: Neighbours found that a block of queries gathers before it keeps the best k.
FOUND_ROWS = 1 << 18
#: What rounding may change in a cosine, at the most.
SLACK = 1e-9


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest per query; ties go to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbours_sql(queries: DataFrame, index: DataFrame, k: int = K_NEIGHBOURS, exclude_self: bool = False) -> DataFrame:
    """query_id, neighbour_id, label, similarity, rank from queries (id, vector) and index (id, vector, label).

    Every index row is a candidate, also those without length (similarity 0); a query without length has no neighbour.
    """
    q = queries.select(F.col("id").alias("query_id"), F.col("vector").alias("qv")).where(norm(F.col("qv")) > 0)
    i = index.select(F.col("id").alias("neighbour_id"), "label", F.col("vector").alias("iv"))
    pairs = q.crossJoin(i)
    if exclude_self:
        pairs = pairs.where("query_id <> neighbour_id")
    return _ranked(pairs.select("query_id", "neighbour_id", "label", cosine(F.col("qv"), F.col("iv")).alias("similarity")), k)


def _places(x: np.ndarray) -> np.ndarray:
    """A number for each row by the sides of fixed directions on which it lies: rows near one another often share it."""
    turned = x @ np.random.default_rng(17).choice([-1.0, 1.0], (x.shape[1], PLACE_BITS))
    return (turned > 0) @ (1 << np.arange(PLACE_BITS))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1))[:, None]
    return np.divide(x, n, out=np.zeros(x.shape), where=n > 0)


def _stored(rows: DataFrame) -> tuple[str, str]:
    """Vectors as they travel, in Spark's and numpy's terms: single numbers stay single."""
    return ("array<float>", "<f4") if rows.schema["vector"].dataType.simpleString() == "array<float>" else ("array<double>", "<f8")


def index_blocks(index: DataFrame, kind: str) -> DataFrame:
    """The index in blocks: ids, labels, vectors; and the block's patches of rows that lie near one another: where each
    starts, its pivot (mean of its unit vectors) and radius (largest distance from it). Written once, they serve any number
    of queries."""

    vector, number = _stored(index)
    rows_id = pa.string() if kind == "string" else pa.int64()

    def placed(batches):
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_places(_matrix(batch.column(2))), pa.int64())], names=["i", "l", "v", "place"])

    def room(width: int) -> int:
        return max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(1, width * np.dtype(number).itemsize)))

    def block(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        x = _matrix(part.column(2).combine_chunks())
        u, starts = _unit(x), [0]
        # A patch ends where rows of another place begin, if it isn't small by then.
        for turn in (np.flatnonzero(np.diff(part.column("place").to_numpy())) + 1).tolist():
            if turn - starts[-1] >= BLOCK_ROWS // 32:
                starts.append(turn)
        sizes = np.diff([*starts, len(x)])
        pivots = np.add.reduceat(u, starts) / sizes[:, None]
        radii = np.maximum.reduceat(np.sqrt(((u - np.repeat(pivots, sizes, 0)) ** 2).sum(1)), starts)
        cells = ([part.column(0).to_pylist()], pa.list_(rows_id)), ([part.column(1).to_pylist()], pa.list_(pa.string())), ([x.astype(number).tobytes()], pa.binary()), ([starts], pa.list_(pa.int32())), ([pivots.tobytes()], pa.binary()), ([radii.tolist()], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(*c) for c in cells], names=["i", "l", "m", "starts", "pivots", "radii"])

    def packed(batches):
        # What is in hand is less than a block and a batch of rows, whatever the partition holds; it may be empty.
        held, at = None, 0
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held, at = new if held is None else pa.concat_tables([held.slice(at), new]), 0
            most = room(len(new.column(2)[0])) if len(new) else BLOCK_ROWS
            while at + most <= len(held):
                yield block(held.slice(at, most))
                at += most
        if held is not None and at < len(held):
            yield block(held.slice(at))

    rows = index.where("vector is not null").select(F.col("id").cast(kind).alias("i"), F.col("label").cast("string").alias("l"), F.col("vector").cast(vector).alias("v"))
    near = rows.mapInArrow(placed, f"i {kind}, l string, v {vector}, place bigint").hint("rebalance", "place").sortWithinPartitions("place", "i")
    # Blocks are few and each is much work: they are dealt over all cores.
    return near.mapInArrow(packed, f"i array<{kind}>, l array<string>, m binary, starts array<int>, pivots binary, radii array<double>").repartition(2 * index.sparkSession.sparkContext.defaultParallelism)


def _query_blocks(queries: DataFrame, kind: str) -> DataFrame:
    """Queries with length in blocks, each under a name by its content, so that a task that runs again makes the same."""
    vector, number = _stored(queries)

    def packed(batches):
        most = min(TILE_COLUMNS, BLOCK_ROWS)
        for batch in batches:
            for at in range(0, len(batch), most):
                part = batch.slice(at, most)
                x = _matrix(part.column(1))
                some = np.flatnonzero((x * x).sum(1) > 0)
                if len(some):
                    ids, m = part.column(0).take(pa.array(some)).to_pylist(), x[some].astype(number).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(repr(ids).encode() + m).hexdigest()]), pa.array([ids]), pa.array([m], pa.binary())], names=["b", "q", "qm"])

    rows = queries.where("vector is not null").select(F.col("id").cast(kind).alias("q"), F.col("vector").cast(vector).alias("v"))
    near = rows.hint("rebalance", "q").sortWithinPartitions("q").mapInArrow(packed, f"b string, q array<{kind}>, qm binary")
    # Packed once, not again for every part of the index.
    return near.repartition(queries.sparkSession.sparkContext.defaultParallelism)


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths, summed in the order of the columns, as SQL does."""
    return np.sqrt(np.add.accumulate(x * x, axis=1)[:, -1])


def _exact(x: np.ndarray, y: np.ndarray, xn: np.ndarray, yn: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of x[r] and y[c] to the last bit as functions.vector.cosine has them: products are added in the order of the
    columns, which a matrix product does not promise. 0 where either has no length."""
    out = np.zeros(len(r))
    for at in range(0, len(r), EXACT_PAIRS):
        i, j = r[at : at + EXACT_PAIRS], c[at : at + EXACT_PAIRS]
        total, scale = x[i], xn[i] * yn[j]
        total *= y[j]
        np.add.accumulate(total, axis=1, out=total)
        np.divide(total[:, -1], scale, out=out[at : at + EXACT_PAIRS], where=scale != 0)
    return out + 0.0


class _Nearest:
    """The k nearest index rows so far of each query of a block; the queries' vectors come along with each block."""

    def __init__(self, ids: np.ndarray, k: int, exclude_self: bool):
        self.ids, self.k, self.exclude_self, self.kth = ids, k, exclude_self, np.full(len(ids), -np.inf)
        self.row, self.sim, self.near, self.label = np.zeros(0, np.int64), np.zeros(0), ids[:0], np.zeros(0, object)
        self.asked = self.skipped = 0

    def look(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, y: np.ndarray, starts: np.ndarray, pivots: np.ndarray, radii: np.ndarray) -> None:
        """Takes in a block, but for queries that can have no neighbour in a patch: a row's distance is at least the pivot's
        less the radius, and on unit vectors a distance d means a cosine of 1 - d*d/2."""
        u, w, xn, yn = _unit(x), _unit(y), _norms(x), _norms(y)
        gap = np.maximum(0, np.sqrt(np.maximum(0, (u * u).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * (u @ pivots.T))) - radii)
        reach = 1 - gap * gap / 2 + SLACK
        # Products in single precision choose what is multiplied exactly; they are off by less than slack.
        u, w, slack = u.astype(np.float32), w.astype(np.float32), (x.shape[1] + 8) * 2.0**-24 + SLACK
        own = np.isin(ids, self.ids) if self.exclude_self else np.zeros(len(ids), bool)
        ends, at = [*starts[1:].tolist(), len(y)], 0
        while at < len(starts):
            last, on = at, np.flatnonzero(reach[:, at] >= self.kth)
            # Patches that nobody skips are looked at together.
            while last + 1 < len(starts) and len(on) == len(x) and ends[last + 1] - starts[at] <= TILE_COLUMNS and (reach[:, last + 1] >= self.kth).all():
                last += 1
            self.asked, self.skipped = self.asked + len(x) * (last + 1 - at), self.skipped + len(x) - len(on)
            if len(on):
                for c in range(starts[at], ends[last], TILE_COLUMNS):
                    self._patch(on, slice(c, min(c + TILE_COLUMNS, ends[last])), x, ids, labels, y, u, w, xn, yn, slack, own)
            at = last + 1

    def _patch(self, on, cols: slice, x, ids, labels, y, u, w, xn, yn, slack: float, own) -> None:
        found, n, mine = [], 0, np.flatnonzero(own[cols])
        for at in range(0, len(on), TILE_ROWS):
            some = on[at : at + TILE_ROWS]
            s = u[some] @ w[cols].T
            if len(mine):
                s[:, mine] = np.where(self.ids[some][:, None] == ids[cols][mine][None, :], -np.inf, s[:, mine])
            # All that may tie with the k-th stay, so that exact cosines and ids can settle it.
            edge = self.kth[some] - slack
            if s.shape[1] > self.k and (new := edge == -np.inf).any():
                edge[new] = np.partition(s[new], s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k] - 2 * slack
            hit = np.flatnonzero(np.fmax.reduce(s, axis=1) >= edge)
            s = s[hit]
            r, c = np.nonzero((s >= edge[hit][:, None]) & np.isfinite(s))
            if len(r):
                r, c = some[hit[r]], c + cols.start
                found.append((r, _exact(x, y, xn, yn, r, c), ids[c], labels[c]))
                n += len(r)
            if n > FOUND_ROWS:
                self._keep(found)
                found, n = [], 0
        if n:
            self._keep(found)

    def _keep(self, found: list[tuple]) -> None:
        """The k best of what is there and what was found."""
        row, sim, near, label = map(np.concatenate, zip((self.row, self.sim, self.near, self.label), *found))
        order = np.lexsort((near, -sim, row))
        sorted_ = row[order]
        first = np.maximum.accumulate(np.where(np.r_[True, sorted_[1:] != sorted_[:-1]], np.arange(len(sorted_)), 0))
        order = order[np.arange(len(order)) - first < self.k]
        self.row, self.sim, self.near, self.label = row[order], sim[order], near[order], label[order]
        full = np.bincount(self.row, minlength=len(self.ids)) == self.k
        last = np.flatnonzero(np.r_[self.row[1:] != self.row[:-1], True])
        kth = np.full(len(self.ids), -np.inf)
        kth[self.row[last]] = self.sim[last]
        self.kth = np.where(full, kth, -np.inf)


def _sides(queries: DataFrame, index: DataFrame):
    """Spark's and Arrow's kind of ids; what makes an array of a list of ids; what makes a matrix of a block's bytes, by the
    side that it is of."""
    kind = "string" if index.schema["id"].dataType.simpleString() == "string" else "bigint"
    array_of = lambda values: np.array(values.to_pylist(), object) if kind == "string" else values.to_numpy()
    numbers = {"qm": _stored(queries)[1], "m": _stored(index)[1]}
    matrix = lambda side, cell, n: np.frombuffer(cell.as_buffer(), numbers[side]).reshape(n, -1).astype(np.float64)
    return kind, pa.string() if kind == "string" else pa.int64(), array_of, matrix


def similarities(queries: DataFrame, index: DataFrame, digits: int = 6) -> DataFrame:
    """(query_id, neighbour_id, similarity) of every query with length and every other row of the index, in tiles of
    matrix products: a task holds a tile at a time, whatever there is. Rounded as DuckDB does; where a product's own
    rounding could matter, the exact one is taken. Rows without a vector have a null similarity."""
    kind, ids, array_of, matrix = _sides(queries, index)
    scale = 10.0**digits

    def run(batches):
        for batch in batches:
            for at in range(len(batch)):
                q, i = (array_of(batch.column(c)[at].values) for c in ("q", "i"))
                x, y = matrix("qm", batch.column("qm")[at], len(q)), matrix("m", batch.column("m")[at], len(i))
                w, xn, yn = _unit(y).T, _norms(x), _norms(y)
                for t, d in itertools.product(range(0, len(q), TILE_ROWS), range(0, len(i), TILE_COLUMNS)):
                    part, cols = slice(t, t + TILE_ROWS), slice(d, d + TILE_COLUMNS)
                    v = (_unit(x[part]) @ w[:, cols]) * scale
                    r, c = np.nonzero(np.abs(v - np.floor(v) - 0.5) < scale * SLACK)
                    v[r, c] = _exact(x[part], y[cols], xn[part], yn[cols], r, c) * scale
                    v = np.copysign(np.floor(np.abs(v) + 0.5), v) / scale + 0.0
                    r, c = np.nonzero(q[part][:, None] != i[cols][None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(q[part][r], ids), pa.array(i[cols][c], ids), pa.array(v[r, c])], names=["query_id", "neighbour_id", "similarity"])

    pairs = _query_blocks(queries, kind).select("q", "qm").crossJoin(index_blocks(index, kind).select("i", "m"))
    bare = queries.where(norm(F.col("vector")) > 0).select(F.col("id").cast(kind).alias("query_id")).crossJoin(index.where("vector is null").select(F.col("id").cast(kind).alias("neighbour_id"))).where("query_id <> neighbour_id")
    return pairs.mapInArrow(run, f"query_id {kind}, neighbour_id {kind}, similarity double").unionByName(bare.withColumn("similarity", F.lit(None).cast("double")))


def neighbours_blocked(queries: DataFrame, index: DataFrame, k: int = K_NEIGHBOURS, exclude_self: bool = False, counters: tuple | None = None, bare: bool = False) -> DataFrame:
    """As neighbours_sql; ids are integers or strings, of one kind on both sides. Each block of queries looks at one block
    of the index after the other and skips patches that the triangle inequality rules out, so the result is exact. counters:
    two Spark accumulators, for (query, patch) pairs and for those skipped. bare: index rows without a vector are candidates
    too, with a null similarity, after all others."""
    kind, ids, array_of, matrix = _sides(queries, index)

    def run(batches):
        open_: dict[str, _Nearest] = {}

        def found(best):
            if counters:
                counters[0].add(best.asked)
                counters[1].add(best.skipped)
            return pa.RecordBatch.from_arrays([pa.array(best.ids[best.row].tolist(), ids), pa.array(best.near.tolist(), ids), pa.array(best.label.tolist(), pa.string()), pa.array(best.sim)], names=["query_id", "neighbour_id", "label", "similarity"])

        for batch in batches:
            for at in range(len(batch)):
                cell = lambda c: batch.column(c)[at]  # noqa: B023, E731
                # Pairs come with either side in the outer loop, as Spark sees fit.
                if (best := open_.get(b := cell("b").as_py())) is None:
                    if len(open_) == OPEN_BLOCKS:
                        yield found(open_.pop(next(iter(open_))))
                    best = open_[b] = _Nearest(array_of(cell("q").values).copy(), k, exclude_self)
                i = array_of(cell("i").values)
                best.look(matrix("qm", cell("qm"), len(best.ids)), i, np.array(cell("l").values.to_pylist(), object), (y := matrix("m", cell("m"), len(i))), cell("starts").values.to_numpy(), np.frombuffer(cell("pivots").as_buffer()).reshape(-1, y.shape[1]), cell("radii").values.to_numpy())
        for best in open_.values():
            yield found(best)

    pairs = _query_blocks(queries, kind).crossJoin(index_blocks(index, kind)).select("b", "q", "qm", "i", "l", "m", "starts", "pivots", "radii")
    near = pairs.mapInArrow(run, f"query_id {kind}, neighbour_id {kind}, label string, similarity double")
    if bare:
        q = queries.where(norm(F.col("vector")) > 0).select(F.col("id").cast(kind).alias("query_id"))
        i = index.where("vector is null").orderBy("id").limit(k + 1).select(F.col("id").cast(kind).alias("neighbour_id"), F.col("label").cast("string").alias("label"))
        rest = q.crossJoin(i).where("query_id <> neighbour_id") if exclude_self else q.crossJoin(i)
        near = near.unionByName(rest.withColumn("similarity", F.lit(None).cast("double")))
    return _ranked(near, k)
