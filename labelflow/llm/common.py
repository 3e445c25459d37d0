"""Helpers shared by the training-data operators: tables, shared storage, words."""

from __future__ import annotations

import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than space, \t, \n, \v, \f and \r.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Lower-cases A-Z only.
LOWER_ASCII = {c: c + 32 for c in range(65, 91)}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session (tests)
    gets a folder under its temporary folder, once for the context; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = sc._jvm.System.getProperty("java.io.tmpdir")
        sc.setCheckpointDir(f"file://{base}/labelflow-{uuid.uuid4().hex}")
    return sc.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/labelflow/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends in files that outlive executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that materialise gave and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(df._shared_path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


#: Plans whose rows come in the same order each time they run: scans, and what works on them row by row.
_STEADY = {"Project", "Filter", "Union", "Range", "LocalRelation", "LogicalRDD", "LogicalRelation", "Relation", "SubqueryAlias"}


def _steady(plan) -> bool:
    return plan.nodeName().split(" ")[0] in _STEADY and plan.deterministic() and all(_steady(plan.children().apply(i)) for i in range(plan.children().size()))


def steady(df: DataFrame) -> DataFrame:
    """df, such that a second run has the same rows in the same order and tasks. Scans do; what comes from a shuffle or a
    random plan is written to the shared folder first. How files are split depends on the number of cores at hand, so it
    is pinned for the session: losing an executor must not change a second read."""
    spark = df.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return df if _steady(df._jdf.queryExecution().optimizedPlan()) else materialise(df, "rows")


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """A row id of our own, so that repeated or null doc_ids stay separate rows; the same each time that it is computed."""
    return steady(df).withColumn(name, F.monotonically_increasing_id())


#: A key with more than 1/HOT of all rows is hot: there are fewer than HOT of them, whatever the data.
HOT = 4096


def hot_keys(rows: DataFrame, keys: list[str], room: int = 256) -> DataFrame:
    """(keys, _parts): keys that more than `room` rows and more than 1/HOT of all rows have, and into how many parts of
    about that many rows theirs are dealt. It has fewer than HOT rows and may be broadcast."""
    room = max(room, rows.count() // HOT)
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return F.broadcast(n.where(F.col("_n") > room).select(*keys, (1 + F.floor(F.col("_n") / room)).cast("int").alias("_parts")))


def dealt(rows: DataFrame, hot: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """rows with _part: which of its key's parts a row belongs to, by a hash of `by`."""
    return rows.join(hot, keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")


def repeated(facts: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """facts once for each _part of their key."""
    return facts.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """rows joined with facts, which has one row a key, where any number of rows may share a key: the rows of hot keys
    are dealt over parts, for each of which their facts are repeated. rows is read three times and must be cheap to read
    (a written table). Null keys meet nothing."""
    hot = hot_keys(rows, keys)
    return dealt(rows, hot, keys, by).join(repeated(facts, hot, keys), [*keys, "_part"], how).drop("_part")


def doc_remainder(doc_id, modulus: int) -> int:
    """crc32 of doc_id's decimal text modulo modulus; a null doc_id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def remainder_column(column: str, modulus: int):
    """doc_remainder as a column."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


#: Rows of texts that a task turns into Python's objects at a time.
PART_ROWS = 512


def in_parts(batches):
    """Slices of Arrow batches, so that what a task makes of one is gone before the next."""
    for batch in batches:
        for at in range(0, len(batch), PART_ROWS):
            yield batch.slice(at, PART_ROWS)


def fold_case(text: str) -> str:
    """Lower-cases A-Z and nothing else."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def folded_words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased. bytes.lower and bytes.split know ASCII alone: they change A-Z and
    cut at space and \\t to \\r, as WORD does."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, held_out: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, text, label) of at most `bound` labelled documents, the least by a hash of doc_id. Rows with
    crc32(doc_id) % held_out[0] == held_out[1] give no label. Where labels repeat a doc_id, its largest label counts.
    The chosen ids are broadcast: at most `bound` rows."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("_label")).where("doc_id is not null and _label is not null")
    if held_out:
        known = known.where(remainder_column("doc_id", held_out[0]) != held_out[1])
    chosen = known.groupBy("doc_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return docs.select("doc_id", F.col("text").cast("string").alias("_text")).join(F.broadcast(chosen), "doc_id")


def scored(docs: DataFrame, model, scores, at: int, threshold: float, keep: tuple[str, ...]) -> DataFrame:
    """keep, score and predicted: scores(model, texts) of each batch of texts, which are column `at` of keep, or come
    after it. The model is broadcast; keep has names of its own inside."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f"_keep{i}" for i in range(len(keep))]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(scores(sent.value, batch.column(at).to_pylist()))], names=[*kept, "score"])

    rows = docs.select(*keep) if at < len(keep) else docs.select(*keep, F.col("text").cast("string").alias("_text"))
    rows = rows.mapInArrow(run, ", ".join([f"{k} {kinds[c]}" for k, c in zip(kept, keep)] + ["score double"]))
    return rows.select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
