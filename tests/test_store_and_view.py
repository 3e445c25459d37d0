"""The delta store, the index view and the jobs on them."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from labelflow.functions.text import index_label
from labelflow.operators import live
from labelflow.operators.index_view import IndexView
from labelflow.schemas import EMBEDDINGS, LABELS, SKIP
from labelflow.sources import store as store_module
from labelflow.sources.store import Change, SnapshotStore
from labelflow.streaming.pipeline import ChangeConsumer

EVENT = "seq bigint, type string, message_id string, label_ids array<string>"


def labels(spark, *items):
    return spark.createDataFrame([(m, l, n, "user") for m, l, n in items], LABELS)


def ids(spark, *items):
    return spark.createDataFrame([(m,) for m in items], "message_id string")


def state(store, name="labels", *cols):
    return sorted(tuple(r) for r in store.table(name).select(*(cols or ("*",))).collect())


def size(tmp_path, name):
    return {p: p.stat().st_size for p in pathlib.Path(tmp_path).glob(f"**/tables/{name}/*/*.parquet")}


def test_small_change_of_a_large_table_is_a_small_write(spark, tmp_path):
    s = SnapshotStore(spark, f"file://{tmp_path}/s")
    s.commit({"labels": spark.range(1_000_000).select(F.col("id").cast("string").alias("message_id"), F.lit("L").alias("label_id"), F.lit("n").alias("label_name"), F.lit("user").alias("source"))})
    before = size(tmp_path, "labels")
    s.commit(changes={"labels": Change(labels(spark, *[(str(i), "M", "m") for i in range(5)], ("new", "M", "m")), ids(spark, "7", "8", "9", "no"))})
    assert 0 < sum(v for p, v in size(tmp_path, "labels").items() if p not in before) < 1_000_000
    t = s.table("labels")
    assert t.count() == 1_000_000 - 3 + 1 and t.where("label_id = 'M'").count() == 6 and s.written["labels"] == 10
    v = s.version
    s.commit(changes={"labels": Change(labels(spark)), "pending_new": Change(deletes=ids(spark))})
    assert s.version == v and s.written == {"labels": 0, "pending_new": 0}


@pytest.mark.parametrize("most, weight", [(8, 1 << 30), (2, 1 << 30), (8, 1)])
def test_merge_on_read_equals_rewriting(spark, tmp_path, monkeypatch, most, weight):
    """Random commits against a dict, with deltas kept, merged among themselves, and merged into the base."""
    monkeypatch.setattr(store_module, "MOST_DELTAS", most)
    monkeypatch.setattr(store_module, "DELTA_BYTES", weight)
    monkeypatch.setattr(store_module, "DELTA_SHARE", 0)
    rng, s, want = random.Random(most), SnapshotStore(spark, f"file://{tmp_path}/s"), {}
    for step in range(5):
        up = {f"k{rng.randint(0, 9)}": f"v{step}" for _ in range(rng.randint(0, 4))}
        gone = {f"k{rng.randint(0, 9)}" for _ in range(rng.randint(0, 3))}
        s.commit(changes={"meta": Change(spark.createDataFrame(list(up.items()), "key string, value string") if up else None, spark.createDataFrame([(g,) for g in gone], "key string")) if up or gone else Change(deletes=spark.createDataFrame([], "key string"))})
        want = {k: v for k, v in want.items() if k not in gone} | up
        assert dict(state(s, "meta")) == want
    kinds = [d.name.split("-")[0] for d in pathlib.Path(f"{tmp_path}/s/tables/meta").iterdir()]
    assert ("base" in kinds and weight == 1) == (kinds.count("base") > 1)
    s.compact("meta")
    assert dict(state(s, "meta")) == want and s.vacuum() > 0 and dict(state(s, "meta")) == want


def test_claims(spark, tmp_path):
    s = SnapshotStore(spark, f"file://{tmp_path}/s")
    orphan = pathlib.Path(f"{tmp_path}/s/manifests/.claim-{s.version + 1:012d}-000000")
    orphan.touch()
    with pytest.raises(RuntimeError, match="first"):
        s.set_cursor("1", 1)
    late = SnapshotStore(spark, s.root, now_ms=lambda: int(1000 * orphan.stat().st_mtime) + store_module.CLAIM_MS)
    late.set_cursor("2", 2)
    assert s.get_meta("last_processed_history_id") == "2" and not orphan.exists()
    # A writer that was overtaken between its claim and its manifest gives up.
    claim = s._claim
    s._claim = lambda version: (g := claim(version), pathlib.Path(f"{tmp_path}/s/manifests/.claim-{version:012d}-000009").touch())[0]
    with pytest.raises(RuntimeError, match="took over"):
        s.set_cursor("3", 3)
    assert late.get_meta("last_processed_history_id") == "2"
    with pytest.raises(RuntimeError):
        late.commit(changes={"meta": late.meta_change({"a": "b"})}, at=late.version - 1)


def test_boundary_is_repaired(spark, tmp_path):
    s = SnapshotStore(spark, f"file://{tmp_path}/s")
    assert s.ensure_boundary(lambda: "5", 1) == "5" and s.ensure_boundary(lambda: pytest.fail("watched again"), 2) == "5"
    s.commit(changes={"meta": Change(deletes=spark.createDataFrame([("last_processed_history_id",)], "key string"))})
    assert s.ensure_boundary(lambda: "9", 3) == "5" and s.get_meta("last_processed_history_id") == "5"


def joined(s):
    return sorted(tuple(r) for r in s.table("embeddings").join(s.table("labels"), "message_id").select("message_id", index_label(F.col("label_id"), F.col("label_name"))).collect())


def test_view_follows_both_sides(spark, tmp_path):
    """Random changes of vectors and labels: the view and its counts equal the join made anew."""
    rng, view = random.Random(5), IndexView(SnapshotStore(spark, f"file://{tmp_path}/s"))
    s = view.store
    for _ in range(4):
        some = lambda: {f"m{rng.randint(0, 12)}" for _ in range(rng.randint(0, 6))}
        changes = {
            "embeddings": Change(spark.createDataFrame([(m, [1.0]) for m in some()], EMBEDDINGS), ids(spark, *some())),
            "labels": Change(labels(spark, *[(m, rng.choice(["A", "B", SKIP]), rng.choice(["x", "", None])) for m in some()]), ids(spark, *some())),
        }
        view.apply(changes)
        assert state(s, "index_view") == joined(s) and s.viewed
        want = {}
        for _, l in joined(s):
            want[l] = want.get(l, 0) + 1
        assert dict(state(s, "index_counts")) == want
    assert "vector" not in "".join(line for line in s.table("index_view")._jdf.queryExecution().explainString(s._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).splitlines() if "ReadSchema" in line)


def test_index_operations(spark, tmp_path):
    view = IndexView(SnapshotStore(spark, f"file://{tmp_path}/s"))
    rows = lambda *r: spark.createDataFrame([(m, [float(v)], l, n, "user") for m, v, l, n in r], "message_id string, vector array<float>, label_id string, label_name string, source string")
    view.add(rows(("a", 1, "A", "x"), ("b", 2, "A", "x")))
    view.add(rows(("a", 3, "B", "y"), ("c", 1, "A", "x")))
    assert sorted((r[0], r[1][0], r[2]) for r in view.rows().collect()) == [("a", 3.0, "y"), ("b", 2.0, "x"), ("c", 1.0, "x")] and view.size() == 3
    assert view.rename_label("x", "z") == 2 and view.rename_label("none", "z") == 0 and dict(state(view.store, "index_counts")) == {"y": 1, "z": 2}
    view.remove(ids(spark, "b", "nobody"))
    assert [tuple(r) for r in view.contains(ids(spark, "a", "b")).orderBy("message_id").collect()] == [("a", True), ("b", False)]
    assert view.store.embedding("b") == [2.0] and view.store.embedding("q") is None and [r[0] for r in view.store.message_ids_by_label("z").collect()] == ["c"]
    # Tables that change without the view are noticed.
    view.store.commit(changes={"labels": Change(labels(spark, ("b", "A", "z")))})
    assert not view.store.viewed and view.in_step().size() == 3 and view.store.viewed
    assert view.store.remove_labels_by_name(["z", "q"]) == 2
    view.reset(rows(("n", 1, SKIP, None)))
    assert state(view.store, "index_view") == [("n", SKIP)] == joined(view.store) and view.size() == 1


def test_rebuild_beside_the_live_version(spark, tmp_path):
    s = SnapshotStore(spark, f"file://{tmp_path}/s")
    IndexView(s).reset(spark.createDataFrame([(f"m{i}", [0.0], "A", "x", "user") for i in range(5)], "message_id string, vector array<float>, label_id string, label_name string, source string"))
    asked = []

    def embed(rows):
        if len(asked) == 1:  # a correction comes in while the first vectors are made
            s.commit(changes={"labels": Change(labels(spark, ("late", "B", "y")))})
        asked.append(1)
        return rows.select("message_id", F.array(F.lit(9.0).cast("float")).alias("vector"))

    assert live.rebuild_beside(s, embed, "f2") == 6
    assert {(r[0], r[1][0]) for r in state(s, "embeddings")} == {(m, 9.0) for m in ("m0", "m1", "m2", "m3", "m4", "late")}
    assert s.get_meta("ml_fingerprint") == "f2" and state(s, "index_view") == joined(s) and dict(state(s, "index_counts")) == {"x": 5, "y": 1} and s.viewed


def test_jobs_make_one_commit(spark, tmp_path):
    s = SnapshotStore(spark, f"file://{tmp_path}/s")
    embed = lambda rows: rows.where("message_id <> 'lost'").select("message_id", F.array(F.lit(1.0).cast("float")).alias("vector"))
    IndexView(s).reset(spark.createDataFrame([("a", [1.0], "A", "x", "user"), ("b", [1.0], "B", "y", "user"), ("c", [1.0], "B", "y", "user")], "message_id string, vector array<float>, label_id string, label_name string, source string"))
    v = s.version
    diff = spark.createDataFrame([("A", "x", "new x", "renamed"), ("B", "y", None, "deleted")], "label_id string, old_name string, new_name string, change string")
    assert live.back_in_inbox(s, diff) == 2 and s.version == v + 1
    assert {(r[0], r[1], r[2]) for r in state(s, "outbox")} == {("b", "INBOX", None), ("c", "INBOX", None)} and state(s, "applied") == [("b",), ("c",)]
    assert dict(state(s, "labels", "message_id", "label_name")) == {"a": "new x", "b": SKIP, "c": SKIP} and state(s, "index_view") == joined(s)
    desired = spark.createDataFrame([(0, "a", "A", "new x", "user"), (1, "d", "A", "new x", "user"), (2, "lost", "A", "new x", "user"), (3, "g", SKIP, SKIP, "auto")], "pos int, message_id string, label_id string, label_name string, source string")
    inbox = spark.createDataFrame([("g", 90), ("old", 3)], "message_id string, sent_s bigint")
    gap = live.resync(s, desired, embed, "77", 99_000, inbox, 50_000)
    assert [r[0] for r in gap.collect()] == ["g"] and s.version == v + 2
    assert dict(state(s, "labels", "message_id", "label_id")) == {"a": "A", "d": "A"} and state(s, "pending_new") == [("g", "77", "gap")]
    assert s.get_meta("boundary_history_id") == s.get_meta("last_processed_history_id") == "77" and s.get_meta("last_processed_at") == "99000" and state(s, "index_view") == joined(s)
    included, listing = spark.createDataFrame([("N", "n")], "label_id string, label_name string"), spark.createDataFrame([(0, "z", "N")], "pos int, message_id string, label_id string")
    live.reconcile_exclusions(s, included, listing, embed, "hash")
    assert state(s, "labels", "message_id", "label_name") == [("z", "n")] and s.get_meta("excluded_hash") == "hash" and state(s, "index_view") == joined(s)


def test_message_that_was_applied_is_no_news(spark, tmp_path):
    """A repeated event makes no second order; parked messages are drained without events; nothing else is written."""
    s = SnapshotStore(spark, f"file://{tmp_path}/s")
    near = [1.0, 0.0]
    table = spark.createDataFrame([(f"a{k}", near) for k in range(6)] + [("new", near), ("more", near)], EMBEDDINGS)
    IndexView(s).reset(table.where("message_id like 'a%'").select("*", F.lit("A").alias("label_id"), F.lit("Alpha").alias("label_name"), F.lit("user").alias("source")))
    registry = spark.createDataFrame([("A", "Alpha", False)], "label_id string, label_name string, is_excluded boolean")
    messages = spark.createDataFrame([("new", ["INBOX"]), ("more", ["INBOX"])], "message_id string, labels array<string>")
    gate = [False]
    c = ChangeConsumer(s, lambda: registry, lambda: messages, lambda: gate[0], embed=lambda rows: table.join(rows.select("message_id"), "message_id", "left_semi"))
    event = lambda seq, m: spark.createDataFrame([(seq, "messagesAdded", m, ["INBOX"])], EVENT)
    c.process(event(1, "new"), 0)
    assert state(s, "pending_new", "message_id") == [("new",)] and c.drain() == 0
    gate[0] = True
    c.process(event(1, "new").where("false"), 1)
    assert state(s, "pending_new") == [] and [r[:3] for r in state(s, "outbox")] == [("new", "A", "INBOX")]
    before = {t: size(tmp_path, t) for t in ("outbox", "echoes", "embeddings", "labels", "applied")}
    c.process(event(2, "new"), 2)
    assert [r[:3] for r in state(s, "outbox")] == [("new", "A", "INBOX")] and {t: size(tmp_path, t) for t in before} == before
