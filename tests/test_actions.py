"""Two-phase delivery of the outbox."""

import pathlib

import pytest
from pyspark.sql import functions as F

from labelflow.schemas import OUTBOX
from labelflow.sources import actions
from labelflow.sources.store import Change, SnapshotStore


def orders(spark, *items):
    return spark.createDataFrame([(m, "A", "INBOX", b) for m, b in items], OUTBOX)


def sent(spark, root):
    return sorted((r.message_id, r.batch) for r in actions.delivered(spark, root).collect())


def test_each_action_goes_once(spark, tmp_path, monkeypatch):
    s, root = SnapshotStore(spark, f"file://{tmp_path}/s"), f"file://{tmp_path}/out"
    assert sent(spark, root) == []
    s.commit(changes={"outbox": Change(orders(spark, ("a", 1), ("b", 1)))})
    assert actions.deliver(s, root) == 2 and s.table("outbox").isEmpty() and sent(spark, root) == [("a", 1), ("b", 1)]
    assert actions.deliver(s, root) == 0
    # A crash between the delivery and taking rows out: the repetition sends nothing twice, later orders go all the same.
    s.commit(changes={"outbox": Change(orders(spark, ("a", 2), ("c", 2)))})
    commit = s.commit
    monkeypatch.setattr(s, "commit", lambda **_: (_ for _ in ()).throw(ConnectionError("died")))
    with pytest.raises(ConnectionError):
        actions.deliver(s, root)
    monkeypatch.setattr(s, "commit", commit)
    assert s.table("outbox").count() == 2
    actions.deliver(s, root)
    s.commit(changes={"outbox": Change(orders(spark, ("d", 3)))})
    actions.deliver(s, root)
    assert s.table("outbox").isEmpty() and sent(spark, root) == [("a", 1), ("a", 2), ("b", 1), ("c", 2), ("d", 3)]


def test_failing_task_leaves_nothing_visible(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    spark.dataSource.register(actions.MailboxActions)
    rows = spark.range(0, 40, 1, 4).select(F.concat(F.lit("m"), F.col("id")).alias("message_id"), F.lit("A").alias("add_label"), F.when(F.col("id") == 37, F.raise_error(F.lit("task fails")).cast("string")).otherwise("INBOX").alias("remove_label"), F.lit(1).cast("bigint").alias("batch"))
    write = lambda df: df.write.format("mailbox_actions").mode("append").options(root=root, delivery="d1").save()
    with pytest.raises(Exception, match="task fails"):
        write(rows)
    assert sent(spark, root) == []
    good = rows.withColumn("remove_label", F.lit("INBOX"))
    write(good)
    write(good)
    assert len(sent(spark, root)) == 40 == len(set(sent(spark, root)))
    assert len(list(pathlib.Path(f"{tmp_path}/out/deliveries").glob("[!.]*"))) == 1
