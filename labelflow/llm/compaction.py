"""Operator 12: compaction of small files by a plan of first-fit-decreasing groups, made and executed in Spark SQL.

The plan: a day's file structs are collected in order, and the higher-order function aggregate() folds them into an array
of groups, each file joining the first group that has room; the groups are exploded into a table of (file, its group, its
place there). The execution: rows of grouped files are read by their partition folders, dealt by group, sorted by place
and row number, and written one file a group; these then take the place of their sources. Files outside groups are never
read for writing nor touched.

How many files and groups there are depends on the number of days alone (at most 804 + 4 files a day), so that the plan is
small whatever the rows: it alone is collected, for the renames. Rows go by hash to as many tasks as there are files.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.llm.common import discard, materialise, shared_dir, spread_join

#: Days up to which their table of row counts is broadcast; beyond, rows of frequent days are dealt over parts.
DAYS = 65_536
#: The folder value of rows without a day.
NO_DAY = -(1 << 40)


def share(rows: int, parts: int) -> int:
    """Rows of one of `parts` even shares."""
    return 1 + rows // parts


def first_fit(files: Column, limit: Column) -> Column:
    """files: array of struct(rows, lot, piece), in the order in which they are dealt out. An array of groups
    struct(rows, files): each file joins the earliest group that with it has at most limit rows, else begins one."""
    group = "struct<rows:bigint,files:array<struct<rows:bigint,lot:bigint,piece:bigint>>>"

    def put(groups: Column, f: Column) -> Column:
        at = F.array_position(F.transform(groups, lambda g: g["rows"] + f["rows"] <= limit), F.lit(True))
        joined = F.transform(groups, lambda g, i: F.when(i + 1 == at, F.struct((g["rows"] + f["rows"]).alias("rows"), F.concat(g["files"], F.array(f)).alias("files"))).otherwise(g))
        return F.when(at > 0, joined).otherwise(F.concat(groups, F.array(F.struct(f["rows"].alias("rows"), F.array(f).alias("files")))))

    return F.aggregate(files, F.array().cast(f"array<{group}>"), put)


def plan_groups(files: DataFrame, small: int, limit: int) -> DataFrame:
    """(day, lot, piece, group_lot, group_piece, place): where each of files (day, lot, piece, rows) goes. Files of less
    than `small` rows are dealt to groups by descending rows, lot and piece; a group is named by its first file."""
    f = F.struct(F.col("rows"), F.col("lot"), F.col("piece"))
    order = F.struct((-F.col("rows")).alias("less"), F.col("lot"), F.col("piece"))
    dealt = files.where(F.col("rows") < small).groupBy("day").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), f.alias("f")))).alias("s"))
    groups = dealt.select("day", F.explode(first_fit(F.transform("s", lambda x: x["f"]), F.lit(limit).cast("bigint"))).alias("g"))
    small_files = groups.select("day", F.col("g.files")[0]["lot"].alias("group_lot"), F.col("g.files")[0]["piece"].alias("group_piece"), F.posexplode("g.files").alias("place", "f"))
    alone = files.where(F.col("rows") >= small).select("day", "lot", "piece", F.col("lot").alias("group_lot"), F.col("piece").alias("group_piece"), F.lit(0).alias("place"))
    return small_files.select("day", "f.lot", "f.piece", "group_lot", "group_piece", "place").unionByName(alone)


class Layout:
    """Names and schema of a table's folder: partition folders by day, lot and piece under names that no column has."""

    def __init__(self, spark: SparkSession, table: DataFrame, path: str):
        self.spark, self.columns, self.path = spark, table.columns, path
        used = {c.lower() for c in self.columns}
        self.keys = [next(n for i in range(len(used) + 1) if (n := f"{k}{i or ''}") not in used) for k in ("day", "lot", "piece")]
        self.schema = f"{table._jdf.schema().toDDL()}, {', '.join(f'{k} bigint' for k in self.keys)}" if self.columns else ""

    def read(self) -> DataFrame:
        """The folder as a table. Its folders are listed by as many tasks as there are cores, not by one a folder."""
        key, conf = "spark.sql.sources.parallelPartitionDiscovery.parallelism", self.spark.conf
        before = conf.get(key, None)
        conf.set(key, str(max(1, self.spark.sparkContext.defaultParallelism)))
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        finally:
            conf.unset(key) if before is None else conf.set(key, before)

    def key_columns(self, df: DataFrame) -> list[Column]:
        return [df[k].alias(n) for k, n in zip(self.keys, ("day", "lot", "piece"))]

    def folder(self, base: str, day, lot, piece) -> str:
        return f"{base}/" + "/".join(f"{k}={v}" for k, v in zip(self.keys, (day, lot, piece)))

    def write(self, df: DataFrame, to: str, order: list[str]) -> None:
        """One file for each day, lot and piece of df, its rows in this order."""
        df.repartition(*self.keys).sortWithinPartitions(*self.keys, *order).select(*self.columns, *self.keys).write.partitionBy(*self.keys).parquet(to)


def write_lots(table: DataFrame, path: str, id_key: str, time_key: str, lots: int = 200) -> tuple[Layout, int]:
    """Writes the table to path: a file for each day (of time_key; null is a day), lot and piece, its rows by time and id."""
    spark = table.sparkSession
    out = Layout(spark, table, path)
    day_key, lot_key, piece_key = out.keys
    day = F.coalesce(F.unix_date(F.col(f"`{time_key}`").cast("date")).cast("bigint"), F.lit(NO_DAY))
    counts = materialise(table.select(day.alias(day_key)).groupBy(day_key).agg(F.count(F.lit(1)).alias("_day_rows")), "days")
    total, days = counts.agg(F.coalesce(F.sum("_day_rows"), F.lit(0)), F.count(F.lit(1))).first()
    rows = table.withColumn(day_key, day)
    rows = rows.join(F.broadcast(counts), day_key) if days <= DAYS else spread_join(materialise(rows, "by_day"), counts, [day_key], [id_key])
    h = F.crc32(F.coalesce(F.col(f"`{id_key}`").cast("string"), F.lit("")).cast("binary"))
    placed = rows.withColumn(lot_key, F.pmod(F.floor(h / 16), 1 + F.floor(F.col("_day_rows") / share(total, lots))).cast("bigint"))
    placed = placed.withColumn(piece_key, F.least(h % 4, F.pmod(F.floor(h / 4), F.lit(4))).cast("bigint"))
    out.write(placed, path, [f"`{time_key}`", f"`{id_key}`"])
    discard(counts)
    return out, total


def _put_in_place(out: Layout, staged: str, plan: list) -> None:
    """Moves each group's new file to the folder of its first source and deletes the sources. May be repeated after a
    failure: a group whose new file has been moved has nothing staged any more."""
    spark = out.spark
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(out.path).getFileSystem(spark._jsc.hadoopConfiguration())
    groups: dict[tuple, list] = {}
    for r in plan:
        groups.setdefault((r["day"], r["group_lot"], r["group_piece"]), []).append(out.folder(out.path, r["day"], r["lot"], r["piece"]))
    for key, sources in groups.items():
        new = path(out.folder(staged, *key))
        if fs.exists(new):
            for s in sources:
                fs.delete(path(s), True)
            home = path(out.folder(out.path, *key))
            fs.mkdirs(home.getParent())
            if not fs.rename(new, home):
                raise RuntimeError(f"{new} could not be moved to {home}")


def _digests(rows: DataFrame) -> DataFrame:
    """day, lot, piece, path, n_rows, least and largest id, cents and the SHA-256 of the ids of each file. rows: (day, lot, piece, path,
    row, id, cents); a file's rows stream through one task, in file order."""
    keys = ["day", "lot", "piece"]
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "row")
    names = [*keys, "path", "n_rows", "least", "largest", "cents", "ids_sha256"]

    def run(batches):
        at, h = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*at, h[0], h[1], h[2], h[3], h[4].hexdigest()], [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 4 + [pa.string()])], names=names)

        for batch in batches:
            if not len(batch):
                continue
            k = [batch.column(i).to_pylist() for i in range(3)]
            cuts = [0, *(i for i in range(1, len(batch)) if any(c[i] != c[i - 1] for c in k)), len(batch)]
            for a, b in zip(cuts, cuts[1:]):
                now = (*(c[a] for c in k), batch.column(3)[a].as_py())
                if now != at:
                    if at is not None:
                        yield row()
                    at, h = now, [0, None, None, 0, hashlib.sha256()]
                ids, cents = batch.column(4).slice(a, b - a), batch.column(5).slice(a, b - a)
                low, high = pc.min(ids).as_py(), pc.max(ids).as_py()
                h[4].update((("," if h[0] else "") + ",".join("" if i is None else str(i) for i in ids.to_pylist())).encode())
                h[:4] = [h[0] + b - a, low if h[1] is None else h[1] if low is None else min(low, h[1]), high if h[2] is None else h[2] if high is None else max(high, h[2]), h[3] + (pc.sum(cents).as_py() or 0)]
        if at is not None:
            yield row()

    return ordered.select(*keys, "path", "id", "c").mapInArrow(run, "day bigint, lot bigint, piece bigint, path string, n_rows bigint, least bigint, largest bigint, cents bigint, ids_sha256 string")


def write_and_compact(table: DataFrame, path: str | None = None, id_key: str = "click_id", time_key: str = "arrived_at", value_key: str = "value", lots: int = 200, small: int = 750, full: int = 400) -> DataFrame:
    """Writes the table (see write_lots) to a new folder, compacts it there and returns a row per final file: day, lot,
    piece (of its first source), n_rows, min_<id>, max_<id>, cents (sum of floor(100 * value + 0.5), null counts as 0),
    sources (`lot-piece` of its starting files in joining order), ids_sha256 (of its ids joined by commas, a null id
    empty), columns, path, rewritten. Within a day, files under 1/small of the table's rows are grouped up to 1/full.

    Without path it is a new one under the shared folder; the files stay. Rows without a time make a day of their own, null
    in the result; rows without an id have the hash of an empty text and come first in their file. Repeated rows stay, in
    any order among themselves. An empty table leaves an empty folder and no row. Columns may have any names: partition
    folders and inner columns get others."""
    spark = table.sparkSession
    path = path or f"{shared_dir(spark)}/compacted/{uuid.uuid4().hex}"
    out, total = write_lots(table, path, id_key, time_key, lots)
    stored = out.read()
    sizes = stored.select(out.key_columns(stored)).groupBy("day", "lot", "piece").agg(F.count(F.lit(1)).alias("rows"))
    files = materialise(sizes, "files")
    plan = materialise(plan_groups(files, share(total, small), share(total, full)), "plan")
    group = ["day", "group_lot", "group_piece"]
    sources = materialise(plan.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("place", "lot", "piece"))).alias("s")), "sources")
    grouped = plan.join(sources.where("size(s) > 1").select(*group), group, "left_semi")
    # Partition columns are joined, so that other files are not read.
    meta = stored.metadataColumn("_metadata")
    inner = [f"_c{i}" for i in range(len(out.columns))]
    rows = stored.select(*[stored[f"`{c}`"].alias(i) for c, i in zip(out.columns, inner)], *out.key_columns(stored), meta["row_index"].alias("_row"))
    moved = rows.join(grouped, ["day", "lot", "piece"]).select(*inner, F.col("day"), F.col("group_lot").alias("lot"), F.col("group_piece").alias("piece"), "place", "_row")
    staged = f"{path}-staged"
    renamed = moved.repartition("day", "lot", "piece").sortWithinPartitions("day", "lot", "piece", "place", "_row").select(*[F.col(i).alias(c) for i, c in zip(inner, out.columns)], *[F.col(k).alias(n) for k, n in zip(("day", "lot", "piece"), out.keys)])
    renamed.write.partitionBy(*out.keys).parquet(staged)
    _put_in_place(out, staged, grouped.collect())
    jpath = spark._jvm.org.apache.hadoop.fs.Path(staged)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    final = out.read()
    meta = final.metadataColumn("_metadata")
    cents = F.coalesce(F.floor(100 * final[f"`{value_key}`"] + 0.5), F.lit(0)).cast("bigint")
    digests = _digests(final.select(*out.key_columns(final), meta["file_path"].alias("path"), meta["row_index"].alias("row"), final[f"`{id_key}`"].cast("bigint").alias("id"), cents.alias("c")))
    said = sources.select("day", F.col("group_lot").alias("lot"), F.col("group_piece").alias("piece"), F.array_join(F.transform("s", lambda x: F.concat_ws("-", x["lot"].cast("string"), x["piece"].cast("string"))), ",").alias("sources"), (F.size("s") > 1).alias("rewritten"))
    return digests.join(said, ["day", "lot", "piece"]).select(
        F.nullif("day", F.lit(NO_DAY)).alias("day"), "lot", "piece", "n_rows", F.col("least").alias(f"min_{id_key}"), F.col("largest").alias(f"max_{id_key}"), "cents", "sources", "ids_sha256", F.lit(",".join(out.columns)).alias("columns"), "path", "rewritten",
    )
