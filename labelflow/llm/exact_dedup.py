"""Operator 10: exact duplicates by deterministic block naming (DataFrame operations only).

A text's bytes are cut into blocks of a fixed size. Equal blocks get one integer name, given by sorting the blocks
themselves, so unequal blocks never share one. Adjacent names are then paired and the pairs named the same way, level
by level, until each document has one name: equal names mean equal texts, without any reliance on a hash's collisions.

Naming runs in two rounds. The first sorts within (bucket, salt), where the salt spreads the rows of one block over
many tasks, and passes one row for each distinct block on; the second sorts these within their bucket. A block that a
third of all documents share is thus split before anything gathers it. Buckets and salts grow with the bytes at hand, so
that a bucket's distinct blocks and a salt's share of a block fit a task at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelflow.llm.common import discard, materialise, spread_join, with_row_id

BLOCK_BYTES = 4096
#: Bytes of distinct blocks in a bucket and of copies of one block in a salt, about, and the least numbers of both.
BUCKET_BYTES, SALT_BYTES = 16 << 20, 1 << 30
LEAST_BUCKETS, LEAST_SALTS = 4096, 16


def _named(rows: DataFrame, value: list[str], buckets: int, salts: int) -> DataFrame:
    """Replaces the columns `value` by an integer _name, equal for rows whose values are equal (nulls included): the rank
    in the value's bucket * buckets + bucket."""
    # coalesce says that the keys are never null, so that no null filter sets the shuffle's two uses below apart.
    hashed = lambda n, *c: F.coalesce(F.pmod(F.xxhash64(*c), F.lit(n)).cast("int"), F.lit(0))
    keyed = rows.withColumn("_bucket", hashed(buckets, *value)).withColumn("_salt", hashed(salts, "_row"))
    local = Window.partitionBy("_bucket", "_salt").orderBy(*value)
    first = keyed.withColumn("_local", F.dense_rank().over(local)).withColumn("_first", F.row_number().over(local))
    # The row that opens each local rank carries the value on; the others only need the rank. Both uses below read
    # the same shuffle, and ranks depend on values alone, so a task that runs again gives the same names.
    first = first.withColumn("_opens", (F.col("_first") == 1) | (F.col("_local") != F.lag("_local").over(local)))
    # The conditions on _row and _at hold for every row: they keep both uses' shuffles alike, so that one is read twice.
    distinct = first.where("_opens and _row >= 0 and _at >= 0").select("_bucket", "_salt", "_local", *value)
    name = (F.dense_rank().over(Window.partitionBy("_bucket").orderBy(*value)).cast("bigint") - 1) * buckets + F.col("_bucket")
    names = distinct.select("_bucket", "_salt", "_local", name.alias("_name"))
    return first.select("_row", "_at", "_bucket", "_salt", "_local").join(names, ["_bucket", "_salt", "_local"]).select("_row", "_at", "_name")


def identities(rows: DataFrame, data: Column) -> tuple[DataFrame, list[DataFrame]]:
    """(_row, _level, _name): one name for each row's bytes. Rows have equal (_level, _name) just if their bytes are
    equal. Beside it the tables that it reads, to be deleted after use."""
    size = F.octet_length("_data")
    held = rows.agg(F.coalesce(F.sum(F.octet_length(data)), F.lit(0))).first()[0]
    buckets, salts = max(LEAST_BUCKETS, held // BUCKET_BYTES), max(LEAST_SALTS, held // SALT_BYTES)
    blocks = rows.select("_row", data.alias("_data")).select(
        "_row",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(size / BLOCK_BYTES) - 1, F.lit(0)).cast("int")), lambda i: F.substring("_data", i * BLOCK_BYTES + 1, F.lit(BLOCK_BYTES)))).alias("_at", "_block"),
    )
    level, done = 0, None
    named = materialise(_named(blocks, ["_block"], buckets, salts), "level0")
    tables = [named]
    while True:
        # A row ends when one name is left; its level is set by its number of blocks alone.
        last = named.groupBy("_row").agg(F.max("_at").alias("_last"), F.first("_name").alias("_name"))
        ended = last.where("_last = 0").select("_row", F.lit(level).alias("_level"), "_name")
        done = ended if done is None else done.unionByName(ended)
        going = materialise(named.join(last.where("_last > 0").select("_row"), "_row"), f"going{level}")
        if going.isEmpty():
            return done, [*tables, going]
        level += 1
        pairs = going.groupBy("_row", (F.col("_at") / 2).cast("int").alias("_at")).agg(
            F.max(F.when(F.col("_at") % 2 == 0, F.col("_name"))).alias("_left"), F.max(F.when(F.col("_at") % 2 == 1, F.col("_name"))).alias("_right")
        )
        named = materialise(_named(pairs, ["_left", "_right"], buckets, salts), f"level{level}")
        tables.append(named)
        discard(going)


def exact_duplicates(docs: DataFrame, text: str = "text", normalise=None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: keep, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after normalise (a Column function; none by default), whole, however long. A null text
    counts as empty. Of equal texts the row with the largest doc_id stays; nulls count as least, and of several rows with
    that doc_id the first in the table stays. keep_id is that doc_id. Empty tables give no rows; other columns are not
    read, and may have any name.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    value = normalise(value) if normalise else value
    kept = [f"_keep{i}" for i in range(len(keep))]
    rows = with_row_id(docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept)], F.col("doc_id").alias("_id"), value.alias("_text")))
    named, tables = identities(rows, F.col("_text").cast("binary"))
    facts = rows.select(*kept, "_row", "_id", F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"))
    facts = materialise(facts.join(named, "_row"), "identities")
    discard(*tables)
    rank = F.struct(F.col("_id"), -F.col("_row"))
    groups = facts.groupBy("_level", "_name").agg(F.count(F.lit(1)).alias("group_size"), F.max(rank).alias("_kept"))
    # The rows of a large group are dealt over several tasks, each of which meets the group's one row.
    return spread_join(facts, groups, ["_level", "_name"], ["_row"]).select(
        *[F.col(k).alias(c) for c, k in zip(keep, kept)], F.col("_kept._id").alias("keep_id"), "group_size", (F.col("_kept.col2") == -F.col("_row")).alias("kept"), "text_sha256"
    )
