import json

import pytest
from pyspark.sql import functions as F

from labelflow.operators import changes, keyed, lifecycle, maturity, worklist
from labelflow.operators import registry as reg
from labelflow.schemas import EMBEDDINGS, HISTORY, LABELS, REGISTRY, SKIP
from labelflow.sources.mailbox import excluded_names, history_since, unlabelled_inbox
from labelflow.sources.store import SnapshotStore
from labelflow.streaming.pipeline import ChangeConsumer, run_with_retries, transient


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def labels(spark, *items):
    return spark.createDataFrame([(m, l, n, "user") for m, l, n in items], LABELS)


def test_join_ignores_orphans_and_names_fall_back(spark):
    e = spark.createDataFrame([("m1", [1.0]), ("m2", [1.0]), ("m4", [0.0])], EMBEDDINGS)
    j = keyed.index_join(e, labels(spark, ("m1", "L1", ""), ("m3", "L1", "x"), ("m4", SKIP, "whatever")))
    assert rows(j, "message_id", "index_label") == [("m1", "L1"), ("m4", SKIP)]


def test_upserts(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    delta = spark.createDataFrame([("a", 5, 1), ("a", 6, 2), ("c", 7, 1), ("c", 8, 0)], "k string, v int, seq int")
    assert rows(keyed.upsert(base, delta, "k"), "k", "v") == [("a", 6), ("b", 2), ("c", 7)]
    assert rows(keyed.insert_ignore(base, delta, "k"), "k", "v") == [("a", 1), ("b", 2), ("c", 8)]
    one = keyed.upsert(keyed.upsert(base, delta.where("seq < 2"), "k"), delta.where("seq = 2"), "k")
    assert rows(one, "k", "v") == rows(keyed.upsert(base, delta, "k"), "k", "v")


def history(spark, *events):
    return spark.createDataFrame([(i, t, m, l) for i, (t, m, l) in enumerate(events)], HISTORY)


def registry(spark):
    return spark.createDataFrame([("L1", "Tech", False), ("L2", "Travel", False), ("L9", "Secret", True)], REGISTRY)


def test_new_inbox(spark):
    e = history(spark, ("messagesAdded", "n1", ["INBOX"]), ("messagesAdded", "n1", ["INBOX"]), ("messagesAdded", "s", ["SENT"]), ("labelsAdded", "n2", ["INBOX"]), ("messagesAdded", "known", ["INBOX"]))
    assert rows(changes.new_inbox_ids(e, spark.createDataFrame([("known",)], "message_id string")), "message_id", "seq") == [("n1", 0)]


def test_label_changes(spark):
    e = history(
        spark, ("labelsAdded", "add", ["L1"]), ("labelsRemoved", "gone", ["L1"]), ("labelsRemoved", "rm", ["L1"]), ("labelsRemoved", "move", ["L1"]), ("labelsAdded", "move", ["L2"]), ("labelsAdded", "two", ["L1"]), ("labelsAdded", "two", ["L2"]),
        ("labelsAdded", "ex", ["L9", "UNREAD"]), ("labelsRemoved", "kept", ["L1"]), ("labelsAdded", "late", ["L1"]), ("labelsRemoved", "late", ["L1"]),
    )
    m = spark.createDataFrame([(i, l) for i, l in (("add", ["L1"]), ("rm", []), ("move", ["L2"]), ("two", ["L1"]), ("kept", ["L9"]), ("late", []))], "message_id string, labels array<string>")
    r = registry(spark)
    out = changes.label_outcomes(changes.change_sets(changes.relevant_changes(e, r)), m, r)
    assert rows(out, "message_id", "op") == [("add", "upsert"), ("gone", "gone"), ("kept", "remove"), ("late", "upsert"), ("move", "upsert"), ("rm", "skip"), ("two", "upsert")]
    assert rows(out.where("op = 'upsert'"), "message_id", "label_id") == [("add", "L1"), ("late", "L1"), ("move", "L2"), ("two", "L2")]
    assert rows(changes.movements(out), "source", "destination", "n") == [("Tech", "Tech", 1), ("Tech", "Travel", 1), ("Tech", "inbox", 1), ("inbox", "Tech", 1), ("inbox", "Travel", 1)]
    after = changes.apply_outcomes(labels(spark, ("gone", "L1", "Tech"), ("kept", "L1", "Tech"), ("other", "L1", "Tech")), out)
    assert ("other", "L1") in rows(after, "message_id", "label_id") and not {"gone", "kept"} & {r["message_id"] for r in after.collect()}


def test_echo_is_spent_once(spark):
    c = changes.relevant_changes(history(spark, ("labelsAdded", "a", ["L1"]), ("labelsRemoved", "a", ["L1"]), ("labelsAdded", "b", ["L1"])), registry(spark))
    left, tokens = changes.suppress_echoes(c, spark.createDataFrame([("a",), ("z",)], "message_id string"))
    assert rows(left, "message_id") == [("b",)] and rows(tokens, "message_id") == [("z",)]


def test_unknown_ids(spark):
    e = history(spark, ("labelsAdded", "a", ["L1", "NEW", "CATEGORY_PROMO", "INBOX"]))
    assert rows(changes.unknown_label_ids(e, registry(spark)), "label_id") == [("NEW",)]


def test_registry_diff_and_reconcile(spark):
    new = spark.createDataFrame([("L1", "Technology"), ("L3", "Brand new")], "label_id string, label_name string")
    d = reg.registry_diff(registry(spark), new)
    assert rows(d, "label_id", "change") == [("L1", "renamed"), ("L2", "deleted")]
    out, back = reg.reconcile(labels(spark, ("a", "L1", "Tech"), ("b", "L2", "Travel"), ("c", "L9", "Secret")), d)
    assert rows(out, "message_id", "label_name", "source") == [("a", "Technology", "user"), ("b", SKIP, "auto"), ("c", "Secret", "user")] and rows(back, "message_id") == [("b",)]


def test_round_robin_and_dedup(spark):
    l = spark.createDataFrame([("A", f"a{i}", -i) for i in range(1, 4)] + [("B", f"b{i}", -i) for i in range(1, 3)] + [("C", "c1", 0), ("C", "a1", -1)], "label_id string, message_id string, recency int")
    names = spark.createDataFrame([("A", "A", 0), ("B", "B", 1), ("C", "C", 2)], "label_id string, label_name string, ordinal int")
    pool = spark.createDataFrame([("s1", 2), ("s2", 1), ("b1", 3)], "message_id string, recency int")
    p = worklist.plan(l, pool, names, cap=200, frontload=1).orderBy("pos").collect()
    assert [r["message_id"] for r in p] == ["s1", "a1", "b1", "c1", "s2", "a2", "b2", "a1", "a3"] and [r["pos"] for r in p] == list(range(9))
    df = spark.createDataFrame(p)
    assert dict((r["message_id"], r["label_id"]) for r in worklist.first_wins(df).collect())["a1"] == "A"
    assert dict((r["message_id"], r["label_id"]) for r in worklist.last_wins(df).collect())["a1"] == "C"
    assert [r["message_id"] for r in worklist.next_batch(df, spark.createDataFrame([("s1",)], "message_id string"), 2).collect()] == ["a1", "b1"]


def test_gate(spark):
    make = lambda *x: spark.createDataFrame(list(x), "label string, available bigint")
    assert rows(maturity.gate(make(("Big", 100), ("Tiny", 4))), "label", "target") == [("Big", 20), (SKIP, 0)]
    g = maturity.gate(make(("A", 8), (SKIP, 12)))
    assert rows(g, "label", "target") == [("A", 8), (SKIP, 12)]
    have = lambda *x: spark.createDataFrame(list(x), "label string, examples bigint")
    assert not maturity.is_open(g, have(("A", 8), (SKIP, 11))).first()[0] and maturity.is_open(g, have(("A", 9), (SKIP, 12))).first()[0]
    assert maturity.is_open(g.where("false"), have(("A", 1))).first()[0]


def test_gap_matrix(spark):
    cases = [("c", "6400000", "REPLAY"), ("c", "6399999", "RESYNC"), ("c", "10000000", "REPLAY"), ("c", "10000001", "RESYNC"), ("c", None, "RESYNC"), ("c", "x", "RESYNC"), (None, "9999999", "RESYNC")]
    df = spark.createDataFrame(cases, "c string, at string, want string")
    assert all(r[0] == r[1] for r in df.select(lifecycle.gap_decision(F.col("c"), F.col("at"), F.lit(10_000_000)), "want").collect())


def test_resync_and_gap(spark):
    desired = spark.createDataFrame([("a1", "L1", "n", "user", 0), ("a1", "L2", "n", "user", 5), ("b", "L1", "n", "user", 1), ("n", "L1", "n", "user", 2)], "message_id string, label_id string, label_name string, source string, pos int")
    r = lifecycle.resync_snapshot(labels(spark, ("a1", "L1", "x"), ("a0", "L1", "x"), ("b", "L1", "x")), desired, spark.createDataFrame([("a1",), ("b",), ("a0",)], "message_id string"))
    assert rows(r, "message_id", "label_id", "action") == [("a0", "L1", "drop"), ("a1", "L2", "relabel"), ("b", "L1", "keep"), ("n", "L1", "embed")]
    inbox = spark.createDataFrame([("old", 4000), ("new", 6000), ("seen", 7000)], "message_id string, sent_s bigint")
    seen = spark.createDataFrame([("seen",)], "message_id string")
    assert rows(lifecycle.gap_message_ids(inbox, seen, 5_000_000), "message_id") == [("new",)] and lifecycle.gap_message_ids(inbox, seen, None).isEmpty()


def test_mailbox_sources(spark, tmp_path):
    m = spark.createDataFrame([("a", ["INBOX"], 5), ("b", ["INBOX", "L1"], 6), ("c", ["SENT"], 7), ("d", ["INBOX"], 1)], "message_id string, labels array<string>, sent_s bigint")
    assert rows(unlabelled_inbox(m, registry(spark), 2), "message_id") == [("a",)]
    with pytest.raises(LookupError):
        history_since(history(spark, ("labelsAdded", "a", [])), 3, oldest=10)
    assert rows(excluded_names(spark, " A \r\n\nB b\nA"), "label_name") == [("A",), ("B b",)] and excluded_names(spark, None).isEmpty()


def test_store_commits_together(spark, tmp_path):
    s = SnapshotStore(spark, f"file://{tmp_path}/state")
    v = s.version
    s.pin_boundary("100", 5)
    assert (s.get_meta("last_processed_history_id"), s.get_meta("bootstrap_status"), s.version) == ("100", "in_progress", v + 1)
    assert s.commit({"labels": labels(spark, ("a", "L1", "x"))}, batch_id=3) == v + 2 and s.commit({"labels": labels(spark)}, batch_id=3) == v + 2
    assert s.table("labels").count() == 1
    ro = SnapshotStore(spark, f"file://{tmp_path}/state", read_only=True)
    assert ro.table("labels").count() == 1
    with pytest.raises(PermissionError):
        ro.set_cursor("1", 1)
    with pytest.raises(FileNotFoundError):
        SnapshotStore(spark, f"file://{tmp_path}/none", read_only=True)


def test_consumer_parks_then_drains_and_replays_harmlessly(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    history(spark, ("messagesAdded", "n1", ["INBOX"]), ("labelsAdded", "x", ["L1"]), ("messagesAdded", "lab", ["INBOX"])).coalesce(1).write.mode("append").parquet(log)
    messages = lambda: spark.createDataFrame([("n1", ["INBOX"]), ("n2", ["INBOX"]), ("x", ["L1"]), ("lab", ["INBOX", "L2"])], "message_id string, labels array<string>")
    store, opened = SnapshotStore(spark, f"file://{tmp_path}/state"), []
    c = ChangeConsumer(store, lambda: registry(spark), messages, lambda: bool(opened), lambda ids: ids.select("message_id", F.lit(SKIP).alias("label_id"), F.lit(SKIP).alias("label_name"), F.lit("auto").alias("source")), lambda: 77)
    c.start(spark, log, f"file://{tmp_path}/cp").awaitTermination()
    assert rows(store.table("pending_new"), "message_id") == [("n1",)] and rows(store.table("labels"), "message_id", "label_id") == [("x", "L1")]
    assert store.get_meta("last_processed_at") == "77"
    before = store.version
    c.process(spark.read.schema(HISTORY).parquet(log), 0)
    assert store.version == before
    opened.append(1)
    spark.createDataFrame([(10, "messagesAdded", "n2", ["INBOX"])], HISTORY).coalesce(1).write.mode("append").parquet(log)
    c.start(spark, log, f"file://{tmp_path}/cp").awaitTermination()
    assert store.table("pending_new").isEmpty() and rows(store.table("labels"), "message_id") == [("n1",), ("n2",), ("x",)]


def test_retries():
    class Q:
        def __init__(self, fail):
            self.fail = fail

        def awaitTermination(self):
            if self.fail:
                raise ConnectionError("unavailable")

    left, waits = [True] * 6 + [False], []
    run_with_retries(lambda: Q(left.pop(0)), transient, waits.append)
    assert waits == [5, 10, 20, 40, 60, 60]
    with pytest.raises(ConnectionError):
        run_with_retries(lambda: Q(True), lambda e: False, waits.append)


def test_consumer_goes_the_whole_way(spark, tmp_path):
    """A new message is labelled and leaves through the outbox; its echo is ignored once; a far one becomes a reject."""
    from labelflow.sources.store import SnapshotStore
    from labelflow.streaming.pipeline import ChangeConsumer

    store = SnapshotStore(spark, f"file://{tmp_path}/live")
    near, far, odd = [1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]
    vectors = {**{f"a{k}": near for k in range(6)}, **{f"s{k}": far for k in range(6)}, "new": near, "off": far, "moved": odd}
    table = spark.createDataFrame(list(vectors.items()), "message_id string, vector array<float>")
    store.commit({
        "embeddings": table.where("message_id like 'a%' or message_id like 's%'"),
        "labels": spark.createDataFrame([(f"a{k}", "A", "Alpha", "user") for k in range(6)] + [(f"s{k}", "__skip__", "__skip__", "auto") for k in range(6)], "message_id string, label_id string, label_name string, source string"),
    })
    labels = spark.createDataFrame([("A", "Alpha", False)], "label_id string, label_name string, is_excluded boolean")
    messages = spark.createDataFrame([("new", ["INBOX"]), ("off", ["INBOX"]), ("moved", ["A"])], "message_id string, labels array<string>")
    embed = lambda ids: table.join(ids.select("message_id"), "message_id", "left_semi")
    consumer = ChangeConsumer(store, lambda: labels, lambda: messages, lambda: True, embed=embed)
    event = "seq bigint, type string, message_id string, label_ids array<string>"
    consumer.process(spark.createDataFrame([(1, "messagesAdded", "new", ["INBOX"]), (2, "messagesAdded", "off", ["INBOX"]), (3, "messagesAdded", "lost", ["INBOX"]), (4, "labelsAdded", "moved", ["A"])], event), 0)
    rows = lambda name: {tuple(r) for r in store.table(name).collect()}
    assert {r[:3] for r in rows("outbox")} == {("new", "A", "INBOX")} and rows("echoes") == rows("applied") == {("new",)}
    assert {r[0]: r[1] for r in rows("labels") if r[0] in vectors and r[0][0] not in "a" and len(r[0]) > 2} == {"off": "__skip__", "moved": "A"}
    assert {r["message_id"] for r in store.table("embeddings").collect()} >= {"off", "moved"}
    consumer.process(spark.createDataFrame([(5, "labelsAdded", "new", ["A"])], event), 1)
    assert rows("echoes") == set() and not any(r[0] == "new" for r in rows("labels"))
    consumer.process(spark.createDataFrame([(6, "labelsAdded", "new", ["A"])], event), 2)
    assert ("new", "A", "Alpha", "user") in rows("labels")
    version = store.version
    assert store.vacuum() > 0 and store.version == version and ("new", "A", "Alpha", "user") in rows("labels") and store.vacuum() == 0
