"""Late rows and the progressive build, on small tables stated by hand."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from labelflow.operators import progressive
from labelflow.sources.shared import new_folder
from labelflow.sources.store import SnapshotStore
from labelflow.streaming import late

T0 = datetime(2024, 1, 1)
DDL = "id bigint, ts timestamp_ntz, arrived_at timestamp_ntz, mark string"


def _log():
    """Minutes of event and arrival; a tie with the watermark is on time."""
    rows = [(0, 50, 50), (1, 170, 170), (2, 100, 175), (3, 110, 180), (4, 109, 185), (4, 109, 185), (5, 400, 190), (6, 60, 200), (7, 300, 250), (8, None, 251), (9, 252, None)]
    at = lambda m: None if m is None else T0 + timedelta(minutes=m)
    return [(i, at(e), at(a), "clash") for i, e, a in rows]


def _plainly(log):
    """The rule row by row."""
    hour = lambda t: t.replace(minute=0)
    out = []
    for i, e, a, _ in log:
        if e is None or a is None:
            out.append((i, "undated"))
            continue
        before = [x[1] for x in log if x[1] and x[2] and hour(x[2]) < hour(a)]
        out.append((i, "late" if before and e < max(before) - timedelta(hours=1) else "on_time"))
    return sorted(out)


@pytest.mark.parametrize("cuts", [[0], [0, 3, 5, 8], list(range(11))])
def test_late_rows_whatever_the_cut(spark, cuts):
    log = _log()
    split = late.LateSplit(spark, new_folder(spark, "streams"), "ts", "arrived_at")
    df = lambda rows: spark.createDataFrame(rows, DDL)
    split.schema = df([]).schema
    for n, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(log)])):
        for _ in range(1 + (n == 1)):  # a batch that is run again changes nothing
            split.step(df(log[a:b]), n)
    got = sorted((r["id"], r["route"]) for r in split.rows().collect())
    assert got == _plainly(log)
    assert {r for _, r in got} == {"late", "on_time", "undated"} and (3, "on_time") in got and (4, "late") in got


def test_late_rows_of_an_empty_batch(spark):
    split = late.LateSplit(spark, new_folder(spark, "streams"), "ts", "arrived_at")
    empty = spark.createDataFrame([], DDL)
    split.schema = empty.schema
    split.step(empty, 0)
    split.step(spark.createDataFrame(_log()[:2], DDL), 1)
    assert {r["route"] for r in split.rows().collect()} == {"on_time"}


def test_late_messages_are_parked_once(spark):
    store = SnapshotStore(spark, new_folder(spark, "state"))
    store.commit({"labels": spark.createDataFrame([("2", "A", "a", "user")], store.table("labels").schema)})
    rows = spark.createDataFrame([(1, 20), (1, 30), (2, 20), (3, 5), (None, 20)], "message_id bigint, sent_s bigint")
    assert late.park_late(store, rows, 10_000, "7") == 1 and late.park_late(store, rows, 10_000, "8") == 0
    assert [tuple(r) for r in store.table("pending_new").collect()] == [("1", "7", "late")]
    assert late.park_late(store, rows, None, "9") == 0


@pytest.mark.parametrize("n, chunk", [(0, 4), (1, 4), (4, 4), (40, 3), (100, 2)])
def test_running_total_by_levels(spark, n, chunk):
    values = [(i * 7 + 3) % 5 for i in range(n)]
    rows = spark.createDataFrame(list(enumerate(values)), "pos bigint, v bigint")
    got = {r["pos"]: r["t"] for r in progressive.running_total(rows, "v", "t", chunk).collect()}
    assert got == {i: sum(values[: i + 1]) for i in range(n)}


def test_batches_are_admitted_by_new_vectors(spark):
    ids = ["a", "b", "a", "c", "have", "d", "b", "e", "have"]
    planned = spark.createDataFrame(list(enumerate(ids)), "pos bigint, message_id string")
    have = spark.createDataFrame([("have",), ("have",)], "message_id string")
    work = progressive.admitted(planned, have, 2)
    assert [(r["cost"], r["batch"]) for r in work.sort("pos").collect()] == [(1, 0), (1, 0), (0, 0), (1, 1), (0, 1), (1, 1), (0, 1), (1, 2), (0, 2)]
    assert [tuple(r) for r in progressive.batches(work, 2).sort("batch").collect()] == [(0, 3, 2, 2, 2), (1, 4, 2, 6, 6), (2, 2, 1, 8, None)]
    assert progressive.admitted(planned.where("false"), have, 2).count() == 0


def test_a_build_goes_on_after_an_interruption(spark):
    store = SnapshotStore(spark, new_folder(spark, "state"))
    ids = ["a", "b", "a", "c", "gone", "d"]
    planned = spark.createDataFrame([(i, m, f"L{i}", f"n{i}", "user") for i, m in enumerate(ids)], "pos bigint, message_id string, label_id string, label_name string, source string")
    calls = []

    def embed(rows):
        calls.append(1)
        if len(calls) == 2:
            raise ConnectionError("lost")
        return rows.where("message_id <> 'gone'").select("message_id", F.array(F.lit(1.0).cast("float")).alias("vector"))

    build = progressive.ProgressiveBuild(store, embed, 2)
    assert not build.is_mature() and not build.done()
    assert build.plan(lambda: planned) == 3 and build.run_batch() == 2
    with pytest.raises(ConnectionError):
        build.run_batch()
    again = progressive.ProgressiveBuild(store, embed, 2)
    assert again.plan(lambda: 1 / 0) == 3 and not again.finalise("me", "f", "h")
    assert again.run_for(1e9) == 2 and again.run_batch() == 0 and again.is_mature()
    assert again.finalise("me", "f", "h") and store.get_meta("bootstrap_status") == "complete" and store.get_meta("account_id") == "me"
    assert {(r["message_id"], r["label_id"]) for r in store.table("labels").collect()} == {("a", "L0"), ("b", "L1"), ("c", "L3"), ("d", "L5")}
