"""Look-ups of stored state by name and by id, with repeats, nulls and empty tables."""

from labelflow.operators import keyed
from labelflow.schemas import SKIP

LABELS = "message_id string, label_id string, label_name string, source string"


def tables(spark):
    labels = spark.createDataFrame([("a", "L1", "one", "user"), ("b", "L2", None, "user"), ("c", SKIP, "one", "auto"), ("d", "L1", "one", "user")], LABELS)
    return labels, spark.createDataFrame([("a", [1.0]), ("c", [2.0]), ("x", [3.0])], "message_id string, vector array<float>")


def test_ids_by_label(spark):
    labels, _ = tables(spark)
    names = spark.createDataFrame([("one",), ("one",), (None,), ("none such",)], "label_name string")
    assert sorted(map(tuple, keyed.ids_by_label(labels, names).collect())) == [("a", "one"), ("d", "one")]
    assert keyed.ids_by_label(labels.where("false"), names).count() == 0


def test_vectors_and_membership(spark):
    labels, vectors = tables(spark)
    ids = spark.createDataFrame([("a",), ("a",), ("b",), ("x",), (None,)], "message_id string")
    by = lambda r: (r[0] or "", str(r[1]))
    assert sorted(map(tuple, keyed.vectors_of(ids, vectors).collect()), key=by) == [(None, None), ("a", [1.0]), ("a", [1.0]), ("b", None), ("x", [3.0])]
    assert sorted(map(tuple, keyed.membership(ids, vectors, labels).collect()), key=by) == [(None, False), ("a", True), ("a", True), ("b", False), ("x", False)]
    assert {r["indexed"] for r in keyed.membership(ids, vectors.where("false"), labels).collect()} == {False}
