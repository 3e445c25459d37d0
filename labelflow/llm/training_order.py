"""Operator 6: token sequences in training order, as fixed-stride binary shards.

Documents are tokenised once and laid end to end into sequences of a fixed length, task by task. A task's byte count
bounds its number of sequences (a token takes a byte at least), so the bounds' running sum numbers all sequences without
a second pass over the tokens. A keyed Feistel network permutes a power-of-four domain over these numbers; cycle-walking
(applying it until the result falls inside) makes it a permutation of the numbers themselves: the sequences' draws. Draws
are cut into equal ranges, one a shard, and every range goes to a task of its own, which writes its sequences in the
order of their draws. A sequence's global slot is its place in that order: shards hold the slots 0 to n - 1 without gaps,
and an index of each shard's first slot and number of records, made from the files' lengths alone, lies beside them.

Every record has the same length: tokens as little-endian uint16 (uint32 for larger vocabularies), then draw (uint64),
first document (int64, DOC_NONE for null), position of the first token in it (uint32), documents begun or continued
(uint32), CRC-32 of the tokens (uint32) and a line feed. Slot s is record s - first of the last shard whose first slot
is s or less, at that many strides in its file; a reader can stop and go on at any slot. The shards are written by Spark's
committer to the output folder, whatever file system that is on.
"""

from __future__ import annotations

import bisect
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from labelflow.llm.common import in_parts, steady
from labelflow.llm.packing import encoded

DOC_NONE = -(1 << 63)
_TAIL = "<QqIII"


def record_bytes(length: int, wide: bool = False) -> int:
    return length * (4 if wide else 2) + struct.calcsize(_TAIL) + 1


def _round(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(27)


def permute(index: np.ndarray, size: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0..size-1 at index: a balanced Feistel network on the least power of four that holds
    size, walked along its cycles until inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [int(k) for k in np.random.default_rng(key).integers(0, 1 << 63, rounds)]
    out = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (_round(right, k) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


def write_shards(docs: DataFrame, tokenizer: str, path: str, length: int = 1024, end_id: int = 50256, pad_id: int = 50256, key: int = 20_240_229, per_shard: int = 16_384) -> int:
    """Writes shards and their index to path and returns how many sequences there are. docs: rows with doc_id and text.
    Each document ends with end_id, a task's last sequence is filled up with pad_id. A null or empty text is an end_id
    alone, a null doc_id is DOC_NONE; long texts run over as many sequences as they take. Repeated rows and rows of one
    doc_id are written each on its own, in the order of the table; an empty table gives an index without shards. Other
    columns are not read, and may have any name."""
    spark = docs.sparkSession
    texts = steady(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")))
    # A row per task: bytes bound tokens, and each document adds one.
    sizes = texts.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length("_text") + 1).alias("n")).collect()
    starts, total = {}, 0
    for p, n in sorted((r["p"], r["n"]) for r in sizes):
        starts[p] = total
        total += -(-n // length)
    wide = max(end_id, pad_id, Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) - 1) >= 1 << 16
    kind = np.dtype("<u4") if wide else np.dtype("<u2")
    sent = spark.sparkContext.broadcast(starts)
    span = -(-total // max(1, -(-total // (per_shard * 2))))

    def numbered(found, at):
        slots = permute(np.arange(at, at + len(found)), total, key)
        records = [data + struct.pack(_TAIL, slot, DOC_NONE if doc is None else doc, start, many, zlib.crc32(data)) + b"\n" for slot, (data, doc, start, many) in zip(slots.tolist(), found)]
        return pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(records, pa.binary())], names=["draw", "record"])

    def run(batches):
        at, held, size, meta = None, [], 0, []
        for batch in in_parts(batches):
            at = sent.value[TaskContext.get().partitionId()] if at is None else at
            found = []
            for doc, data in zip(batch.column(0).to_pylist(), encoded(batch.column(1).to_pylist(), tokenizer)):
                ids = np.frombuffer(data + int(end_id).to_bytes(4, "little"), "<u4").astype(kind)
                done = 0
                while done < len(ids):
                    take = min(length - size, len(ids) - done)
                    meta.append((doc, done))
                    held.append(ids[done : done + take])
                    size, done = size + take, done + take
                    if size == length:
                        found.append((np.concatenate(held).tobytes(), *meta[0], len(meta)))
                        held, size, meta = [], 0, []
            yield numbered(found, at)
            at += len(found)
        if size:
            yield numbered([(np.concatenate([*held, np.full(length - size, pad_id, kind)]).tobytes(), *meta[0], len(meta))], at)

    rows = texts.mapInArrow(run, "draw bigint, record binary").withColumn("shard", F.expr(f"cast(draw div {max(span, 1)} as int)"))
    # The text writer puts the record's bytes as they are; its line feed is the record's last byte.
    body = F.expr("substring(record, 1, octet_length(record) - 1)").cast("string").alias("value")
    shards = max(1, -(-total // max(span, 1)))
    rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "draw").select("shard", body).write.partitionBy("shard").text(path)
    return _write_index(spark, path, record_bytes(length, wide))


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).where("length > 0").withColumn("shard", F.regexp_extract("path", r"shard=(\d+)", 1).cast("int"))


def _write_index(spark, path: str, stride: int) -> int:
    """The shards' index: a line (shard, file, first slot, records, stride) each. A row a shard comes to the driver."""
    found, first = sorted(tuple(r) for r in _files(spark, path).select("shard", "path", "length").collect()), 0
    lines = []
    for shard, file, size in found:
        lines.append(f"{shard}\t{file}\t{first}\t{size // stride}\t{stride}")
        first += size // stride
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_index")
    out = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).create(jpath)
    out.write(bytearray("\n".join(lines).encode()))
    out.close()
    return first


def shard_index(spark, path: str) -> list[tuple[int, str, int, int, int]]:
    """(shard, file, first slot, records, stride) of every shard, by slots."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_index")
    stream = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).open(jpath)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return [(int(a), f, int(b), int(c), int(d)) for a, f, b, c, d in (line.split("\t") for line in text.split("\n") if line)]


def locate(index: list[tuple[int, str, int, int, int]], slot: int) -> tuple[str, int]:
    """The file of a slot and the byte at which its record starts."""
    i = bisect.bisect_right([r[2] for r in index], slot) - 1
    if i < 0 or slot >= index[i][2] + index[i][3]:
        raise IndexError(slot)
    return index[i][1], (slot - index[i][2]) * index[i][4]


def read_shards(spark, path: str, length: int = 1024, wide: bool = False) -> DataFrame:
    """(shard, record, slot, draw, doc_id, start, n_docs, tokens_crc32, ok) of every record of the shards under path;
    record counts from 0 in its shard, ok tells that the tokens match their checksum."""
    stride, body = record_bytes(length, wide), length * (4 if wide else 2)
    sent = spark.sparkContext.broadcast({r[0]: r[2] for r in shard_index(spark, path)})

    def run(batches):
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                view = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, stride)
                tails = np.frombuffer(view[:, body : body + struct.calcsize(_TAIL)].tobytes(), np.dtype([("draw", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("n", "<u4"), ("crc", "<u4")]))
                ok = [zlib.crc32(r[:body]) == int(c) for r, c in zip(view, tails["crc"])]
                record = np.arange(len(view), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(view), shard, np.int32)), pa.array(record), pa.array(sent.value[shard] + record), pa.array(tails["draw"].astype(np.int64)),
                        pa.array(tails["doc"].astype(np.int64), mask=tails["doc"] == DOC_NONE), pa.array(tails["start"].astype(np.int64)), pa.array(tails["n"].astype(np.int64)), pa.array(tails["crc"].astype(np.int64)), pa.array(ok),
                    ],
                    names=["shard", "record", "slot", "draw", "doc_id", "start", "n_docs", "tokens_crc32", "ok"],
                )

    return _files(spark, path).select("shard", "content").mapInArrow(run, "shard int, record bigint, slot bigint, draw bigint, doc_id bigint, start bigint, n_docs bigint, tokens_crc32 bigint, ok boolean")
