"""Paged listings as batches and streams."""

import json

import pytest
from pyspark.sql import functions as F

from labelflow.sources.paged import PagedListing, PagedSource, StagedListing, stage


@pytest.fixture()
def listing(spark, tmp_path):
    spark.dataSource.register(PagedSource)
    rows = spark.range(0, 47).select((46 - F.col("id")).alias("seq"), F.concat(F.lit("m"), F.col("id") % 5).alias("message_id"), F.when(F.col("id") % 9 > 0, "x").alias("kind")).repartition(5)
    return rows, stage(rows, "seq", f"file://{tmp_path}/listing", 10)


def test_pages_by_tokens(spark, listing):
    rows, root = listing
    service, token, seen = StagedListing(root), 0, []
    while token is not None:
        page, token = service.page(token, 500)
        seen.append([r[0] for r in page])
    assert seen == [list(range(0, 10)), list(range(10, 20)), list(range(20, 30)), list(range(30, 40)), list(range(40, 47))] and service.page(5, 9) == ([], None)


def test_batch_reads_all_or_a_limit(spark, listing, monkeypatch):
    rows, root = listing
    read = lambda **o: spark.read.format("paged_listing").options(root=root, **o).load()
    assert sorted(map(tuple, read().collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert [r.seq for r in read(limit=13).collect()] == list(range(13)) and read(size=3, limit=4).count() == 4
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = read(limit=5, pushdown="true").where("kind = 'x' and seq > 20")
        assert [r.seq for r in got.collect()] == [r.seq for r in rows.where("kind = 'x' and seq > 20").orderBy("seq").limit(5).collect()]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_limit_stops_paging():
    asked = []

    class Many(PagedListing):
        def end(self):
            return 100

        def page(self, token, size):
            asked.append(token)
            return [(token * size + i,) for i in range(size)], token + 1

    from labelflow.sources.paged import _PagedReader

    r = _PagedReader(Many(), ["n"], 4, 9)
    assert [x for p in r.partitions() for x in r.read(p)] == [(i,) for i in range(9)] and asked == [0, 1, 2]


def test_stream_goes_on_where_it_stopped(spark, listing, tmp_path):
    """The listing grows; a run is interrupted in the middle of a batch, and the next ones lose and repeat nothing."""
    rows, root = listing
    got, about = [], tmp_path / "listing" / "listing.json"
    whole = json.loads(about.read_text())

    def run(pages, fail=False):
        (tmp_path / "listing" / ".listing.json.crc").unlink(missing_ok=True)
        about.write_text(json.dumps(whole | {"pages": pages}))

        def step(batch, i):
            if fail:
                raise RuntimeError("stop")
            got.append((i, sorted(r.seq for r in batch.collect())))

        q = spark.readStream.format("paged_listing").option("root", root).load().writeStream.foreachBatch(step).option("checkpointLocation", f"{tmp_path}/cp").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    run(2)
    with pytest.raises(Exception, match="stop"):
        run(4, fail=True)
    run(5)
    run(5)
    assert got == [(0, list(range(0, 20))), (1, list(range(20, 40))), (2, list(range(40, 47)))]


def test_expired_cursor_is_an_error_of_its_own(spark, listing, tmp_path):
    rows, _ = listing
    root = stage(rows, "seq", f"file://{tmp_path}/old", 10, first=2)
    q = spark.readStream.format("paged_listing").options(root=root, start=1).load().writeStream.format("memory").queryName("expired").option("checkpointLocation", f"{tmp_path}/cp2").start()
    with pytest.raises(Exception, match="CursorExpired"):
        q.processAllAvailable()
    q.stop()
    assert sorted(r.seq for r in spark.read.format("paged_listing").option("root", root).load().collect()) == list(range(20, 47))
