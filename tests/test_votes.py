import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelflow.functions.vector import cosine
from labelflow.operators import knn, vote

VECTORS = "id bigint, vector array<double>, label string"


def frame(spark, rows):
    return spark.createDataFrame(rows, VECTORS)


def decide(spark, index, query, k=5, search=knn.neighbours_sql):
    q = spark.createDataFrame([(0, query)], "id bigint, vector array<double>")
    idx = frame(spark, index)
    return vote.classify(q, idx, search(q, idx, k)).first()


def test_cosine_values(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, -1.0, 0.0]


def test_neighbours_in_order_and_clipped(spark):
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    index = [(i, unit(v), l) for i, (v, l) in enumerate([([1.0, 0.0, 0.0], "A"), ([0.9, 0.1, 0.0], "A"), ([0.8, 0.2, 0.0], "B"), ([0.0, 1.0, 0.0], "C"), ([0.0, 0.0, 1.0], "C")])]
    q = spark.createDataFrame([(9, [1.0, 0.0, 0.0])], "id bigint, vector array<double>")
    near = knn.neighbours_sql(q, frame(spark, index), 3).orderBy("rank").collect()
    assert [r["label"] for r in near] == ["A", "A", "B"] and near[0]["similarity"] == 1.0
    assert knn.neighbours_sql(q, frame(spark, index[:2]), 5).count() == 2


@pytest.mark.parametrize("seed", range(3))
def test_blocked_equals_sql(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist(), f"L{i % 3}") for i in range(60)]  # many ties and zero vectors
    idx = frame(spark, rows)
    q = idx.where("id % 7 = 0").select("id", "vector")
    get = lambda f: [(r["query_id"], r["rank"], r["neighbour_id"], round(r["similarity"], 9)) for r in f(q, idx, 5, exclude_self=True).orderBy("query_id", "rank").collect()]
    a, b = get(knn.neighbours_sql), get(knn.neighbours_blocked)
    assert [x[:2] + x[3:] for x in a] == [x[:2] + x[3:] for x in b]


def test_zero_rows(spark):
    idx = frame(spark, [(1, [0.0, 0.0], "A"), (2, [-1.0, 0.0], "A")])
    q = spark.createDataFrame([(0, [1.0, 0.0]), (5, [0.0, 0.0])], "id bigint, vector array<double>")
    near = knn.neighbours_sql(q, idx).collect()
    assert [(r["query_id"], r["neighbour_id"], r["similarity"]) for r in near] == [(0, 1, 0.0), (0, 2, -1.0)]


def test_rare_label_cannot_win_and_still_uses_up_k(spark):
    index = [(i, [0.6, 0.8], "Tech") for i in range(20)] + [(100 + i, [1.0, 0.0], "Rare") for i in range(3)]
    r = decide(spark, index, [1.0, 0.0])
    assert r["label"] == "Tech" and r["confidence"] == 1.0 and r["action"] == "label"
    assert [n["label"] for n in r["neighbours"]] == ["Rare"] * 3 + ["Tech"] * 2
    assert decide(spark, [(i, [1.0, 0.0], "Rare") for i in range(4)], [1.0, 0.0])["action"] == "no_label"
    assert decide(spark, [(i, [1.0, 0.0], "Five") for i in range(5)], [1.0, 0.0])["label"] == "Five"


def test_reject_label_votes_and_wins_as_nothing(spark):
    index = [(i, [1.0, 0.0], "__skip__") for i in range(10)] + [(50 + i, [0.0, 1.0], "Tech") for i in range(10)]
    r = decide(spark, index, [1.0, 0.1])
    assert (r["label"], r["confidence"], r["action"]) == ("", 0.0, "no_label")
    mixed = [(i, [1.0, 0.0], "Tech") for i in range(5)] + [(50 + i, [1.0, 0.0], "__skip__") for i in range(5)]
    r = decide(spark, mixed, [1.0, 0.0], k=7)
    assert r["label"] == "Tech" and abs(r["confidence"] - 5 / 7) < 1e-12


def test_empty_index_and_zero_query_still_give_a_row(spark):
    assert tuple(decide(spark, [], [1.0, 0.0]))[1:4] == ("", 0.0, "no_label")
    assert tuple(decide(spark, [(i, [1.0], "A") for i in range(6)], [0.0]))[1:4] == ("", 0.0, "no_label")


def test_confidence_from_signed_scores(spark):
    s = lambda rows: {r["query_id"]: (r["label"], round(r["confidence"], 9)) for r in vote.vote_confidence(spark.createDataFrame(rows, "query_id bigint, label string, score double, first_rank int")).collect()}
    got = s([(1, "Tech", 2.4, 1), (1, "Travel", 1.1, 2), (2, "a", 1.0, 2), (2, "b", 1.0, 1), (3, "x", 2.0, 1), (3, "y", 0.8, 2), (3, "z", 0.2, 3), (4, "n", -0.5, 1), (5, "p", 1.0, 1), (5, "q", -1.0, 2), (6, "p", 1.0, 1), (6, "q", -0.2, 2)])
    assert got == {1: ("Tech", round(2.4 / 3.5, 9)), 2: ("b", 0.5), 3: ("x", round(2 / 3, 9)), 4: ("n", 1.0), 5: ("", 0.0), 6: ("p", 1.25)}


def test_action_bounds(spark):
    rows = spark.createDataFrame([(x,) for x in (0.96, 0.95, 0.85, 0.8, 0.7999999, 0.0)], "c double").select(vote.decide_action(F.col("c"))).collect()
    assert [r[0] for r in rows] == ["label", "label", "label_with_review", "label_with_review", "no_label", "no_label"]


def test_gate_needs_a_registered_label(spark):
    v = spark.createDataFrame([(1, "A", "label"), (2, "B", "label"), (3, "C", "label_with_review"), (4, "A", "no_label")], "query_id bigint, label string, action string")
    r = spark.createDataFrame([("1", "A", False), ("2", "B", True)], "label_id string, label_name string, is_excluded boolean")
    assert {x["query_id"]: x["applied"] for x in vote.apply_gate(v, r).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_embedding_in_batches_and_bytes(spark):
    from labelflow.functions.vector import HashingEmbedder, embed_rows, vector_from_bytes, vector_to_bytes

    one, texts = HashingEmbedder(16), ["a b a", "", None, "ünï B2", "a b a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    got = {r.id: r.vector for r in embed_rows(rows, "text", one, ("id",)).collect()}
    assert all(got[i] == one.embed(t).tolist() for i, t in enumerate(texts)) and got[0] == got[4] and set(got[1]) == {0.0} and len(got) == 5

    class Single:
        def embed(self, text):
            return one.embed(text)

    assert {r.id: r.vector for r in embed_rows(rows, "text", Single(), ("id",)).collect()} == got
    back = embed_rows(rows, "text", one, ("id",)).select("id", vector_from_bytes(vector_to_bytes("vector")).alias("v"))
    assert {r.id: r.v for r in back.collect()} == got


def test_far_blocks_are_skipped_and_the_result_is_exact(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16)) * 4
    points = [(f"p{i:04d}", (centres[i % 12] + rng.normal(size=16) * 0.1).tolist()) for i in range(900)] + [("zero", [0.0] * 16), ("twin", centres[0].tolist()), ("twim", centres[0].tolist())]
    index = spark.createDataFrame([(i, v, f"L{k % 5}") for k, (i, v) in enumerate(points)], "id string, vector array<double>, label string").repartition(3)
    queries = index.where("id like 'p00%' or id like 't%' or id = 'zero'").select("id", "vector")
    seen, skipped = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    got = knn.neighbours_blocked(queries, index, 4, exclude_self=True, counters=(seen, skipped))
    key = lambda df: sorted((r.query_id, r["rank"], r.neighbour_id, r.label, round(r.similarity, 9)) for r in df.collect())
    assert key(got) == key(knn.neighbours_sql(queries, index, 4, exclude_self=True))
    assert skipped.value > seen.value // 4
