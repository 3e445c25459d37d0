"""Operators on small tables against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelflow.llm import bpe, exact_dedup, jaccard_join, language_model, license_scan, packing, quality_classifier, quality_rules, toxicity, training_order
from labelflow.llm.components import connected

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
#: Besides doc_id and text: columns that clash with what operators use inside or return.
SCHEMA = "doc_id bigint, text string, score double, _row string, kept string, token string, n int, ids string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, "x", None, "y", 1, "z") for i, t in rows], SCHEMA)


def words(seed, n, vocabulary=4000):
    rng = np.random.default_rng(seed)
    return [f"w{k}" for k in rng.integers(0, vocabulary, n)]


def corpus():
    base = words(1, 120)
    rows = [(1, None), (2, ""), (3, "  \n\t"), (4, "one two"), (5, "ONE Two"), (6, " ".join(base)), (7, " ".join(base)), (None, " ".join(base)), (8, " ".join(words(2, 30_000))), (9, "Ünï cödé 漢字 🙂"), (10, "one two"), (10, "one two"), (11, "x" * 9000), (12, "x" * 8999 + "y")]
    for k in range(40):  # near copies with one to ten words changed
        w = list(base)
        for j in np.random.default_rng(100 + k).integers(0, len(w), 1 + k // 4):
            w[j] = f"e{k}_{j}"
        rows.append((100 + k, " ".join(w)))
    shared = words(3, 60)
    rows += [(200 + k, " ".join(words(300 + k, 100) + shared)) for k in range(20)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_bpe(spark, rows):
    t = Tokenizer.from_file(WORD)
    got = bpe.encode_decode(make(spark, rows), WORD).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["decoded"]) for r in got) == want
    assert bpe.encode_decode(make(spark, []), WORD).count() == 0


def test_exact_duplicates(spark, rows):
    got = exact_dedup.exact_duplicates(make(spark, rows)).collect()
    groups = defaultdict(list)
    for i, x in rows:
        groups[x or ""].append(i)
    want = Counter((hashlib.sha256(x.encode()).hexdigest(), max((i for i in g if i is not None), default=None), len(g)) for x, g in groups.items() for _ in g)
    assert Counter((r["text_sha256"], r["keep_id"], r["group_size"]) for r in got) == want
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(hashlib.sha256(x.encode()).hexdigest() for x in groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.exact_duplicates(make(spark, [])).count() == 0


def test_block_names_tell_texts_apart_at_every_length(spark):
    n = exact_dedup.BLOCK_BYTES
    texts = ["a" * k for k in (0, 1, n - 1, n, n + 1, 2 * n, 3 * n, 4 * n + 1, 9 * n)] + ["b" + "a" * (3 * n - 1), "a" * (3 * n - 1) + "b"]
    got = exact_dedup.exact_duplicates(make(spark, [(i, t) for i, t in enumerate(texts + texts)])).collect()
    assert all(r["group_size"] == 2 and r["keep_id"] == r["doc_id"] % len(texts) + len(texts) for r in got) and len(got) == 2 * len(texts)


def brute_components(rows, width, num, den):
    def sets(t):
        w = SPLIT.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        return frozenset() if not w else frozenset([tuple(w)]) if len(w) < width else frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    s = [sets(t) for _, t in rows]
    label = list(range(len(rows)))
    def find(a):
        while label[a] != a:
            a = label[a]
        return a
    for a in range(len(rows)):
        for b in range(a):
            if s[a] and s[b] and den * len(s[a] & s[b]) >= num * len(s[a] | s[b]):
                label[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(rows):
        least[find(a)].append(i)
    return Counter((i, len(s[a]), i if not s[a] else min((j for j in least[find(a)] if j is not None), default=None)) for a, (i, _) in enumerate(rows))


@pytest.mark.parametrize("width, threshold", [(4, (85, 100)), (5, (80, 100)), (3, (1, 2))])
def test_jaccard_join(spark, rows, width, threshold):
    got = jaccard_join.similar_sets(make(spark, rows), width, threshold).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, width, *threshold)


def test_jaccard_join_links_across_components(spark):
    """Chains: each text is near the next one only, so no leader sees all of them."""
    w = words(5, 200)
    rows = [(1000 - k, " ".join(w[:k * 4] + [f"c{k}_{j}" for j in range(k * 0)] + [f"v{j}" for j in range(k * 4)] + w[k * 4:])) for k in range(12)]
    got = jaccard_join.similar_sets(make(spark, rows), 4, (85, 100)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, 4, 85, 100)
    assert jaccard_join.similar_sets(make(spark, []), 4, (85, 100)).count() == 0


def test_jaccard_join_skips_blocks(spark):
    base = words(21, 200)
    rows = [(0, " ".join(base))] + [(100 + k, " ".join([*base[:150], *words(500 + k, 10 + k % 3 * 10), *base[150:]])) for k in range(60)]
    seen = {}
    got = jaccard_join.similar_sets(make(spark, rows), 4, (85, 100), seen=seen).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, 4, 85, 100)
    assert seen["skipped_block_pairs"] > 0 and seen["led"] > 0


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(7)
    for _ in range(300):
        pool = rng.integers(-(2**63), 2**63, 400)
        a, b = (np.unique(rng.choice(pool, rng.integers(0, 300))) for _ in range(2))
        bits = lambda s: np.unpackbits(jaccard_join.parity(s).view(np.uint8))
        assert (bits(a) != bits(b)).sum() <= len(np.setxor1d(a, b))
        assert len(jaccard_join.parity(a)) == jaccard_join.PARITY_WORDS and (bits(a) == bits(a[::-1].copy())).all()


def test_jaccard_join_of_groups_that_share_passages(spark):
    """Pairs on both sides of the threshold, and at it, between sets of different leaders: the parity bits lose none."""
    shared, rows = words(3, 90), []
    for g in range(12):
        own = words(40 + g, 10 + g)
        rows += [(100 * g + k, " ".join([*shared[: 80 + g % 5], *own, *words(900 + 50 * g + k, k % 4)])) for k in range(6)]
    got = jaccard_join.similar_sets(make(spark, rows), 5, (80, 100)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, 5, 80, 100)


def test_jaccard_answers_derived_from_a_leader(spark):
    """The index of differences finds every link of two sets across components, and the formula answers as the sets do."""
    rng = np.random.default_rng(4)
    leader, rows, sets = list(range(100)), [], {0: frozenset(range(100))}
    for x in range(1, 120):
        lacks = [int(k) for k in rng.choice(24, rng.integers(4, 18), replace=False)]
        adds = [int(k) for k in rng.choice(np.arange(200, 222), rng.integers(2, 16), replace=False)]
        sets[x] = frozenset(leader) - set(lacks) | set(adds)
        rows.append((x, 0, 100, lacks, adds))
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    rows = [(*r, 0 if linked(r[0], 0) else r[0], 1 + r[0] % 2) for r in [(0, 0, 100, [], []), *rows]]
    star = spark.createDataFrame([(*r[:6], 2) for r in rows], "x bigint, l bigint, n2 int, lacks array<bigint>, adds array<bigint>, c bigint, parts int")
    found = jaccard_join.difference_pairs(star, 85, 100)
    c = {r[0]: r[5] for r in rows}
    want = {(a, b) for a in sets for b in sets if a < b and c[a] != c[b] and linked(a, b)}
    texts = spark.createDataFrame([], "_row bigint, _text string")
    seen = {}
    links, _ = jaccard_join._links(found, star.drop("c", "parts"), texts, 4, 85, 100, seen)
    assert len(want) > 20 and {(r["a"], r["b"]) for r in links.collect()} == want
    assert seen["derived_links"] == len(want) and seen["compared"] == 0 and seen["derived"] < len(sets) ** 2 / 2


def test_spread_join_deals_hot_keys(spark):
    from labelflow.llm.common import spread_join

    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 1, id) as k")
    facts = spark.range(3000).selectExpr("id as k", "id * 10 as v")
    got = spread_join(rows, facts, ["k"], ["id"]).collect()
    assert sorted((r["id"], r["k"], r["v"]) for r in got) == sorted((i, 1 if i % 3 == 0 else i, 10 if i % 3 == 0 else 10 * i) for i in range(3000))


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(k, k + 1) for k in range(100, 130)]
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = connected(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r["node"]: r["component"] for r in got.collect()} == label
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_packing(spark, rows):
    t = Tokenizer.from_file(BYTE)
    got = packing.pack_documents(make(spark, rows), BYTE, 64, 2, payload=True).collect()
    per, bins = defaultdict(list), defaultdict(list)
    for r in got:
        per[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and 0 < r["length"] <= 64
    for places in bins.values():
        at = 0
        for r in sorted(places, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    for i, x in rows:
        if i not in (10, None):
            ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
            parts = sorted(per[i], key=lambda r: r["piece"])
            assert b"".join(r["ids"] for r in parts) == ids and [r["piece"] for r in parts] == list(range(len(parts))) and all(r["length"] == 64 for r in parts[1:])
    runs, used = packing.plan_runs(Counter(r["length"] for r in got), 64)
    assert len(bins) == used and len(per[10]) == 2
    assert packing.pack_documents(make(spark, []), BYTE).count() == 0


def test_training_order(spark, rows, tmp_path):
    path = f"file://{tmp_path}/shards"
    total = training_order.write_shards(make(spark, rows), BYTE, path, length=32, per_shard=16)
    got = training_order.read_shards(spark, path, length=32).collect()
    assert all(r["ok"] for r in got) and len(got) == total
    got.sort(key=lambda r: r["slot"])
    # Slots are 0 to n - 1, in the order of the permutation's draws; a shard holds a range of them.
    assert [r["slot"] for r in got] == list(range(total)) and [r["draw"] for r in got] == sorted({r["draw"] for r in got})
    assert [(r["shard"], r["record"]) for r in got] == sorted((r["shard"], r["record"]) for r in got) and len({r["shard"] for r in got}) > 3
    index, stride = training_order.shard_index(spark, path), training_order.record_bytes(32)
    for r in got[:: max(1, total // 40)]:
        file, at = training_order.locate(index, r["slot"])
        with open(file.removeprefix("file:"), "rb") as f:
            f.seek(at)
            record = f.read(stride)
        assert zlib.crc32(record[:64]) == r["tokens_crc32"] and int.from_bytes(record[64:72], "little") == r["draw"]
    with pytest.raises(IndexError):
        training_order.locate(index, total)
    t = Tokenizer.from_file(BYTE)
    tokens = Counter()
    for f in tmp_path.glob("shards/shard=*/part-*"):
        data = f.read_bytes()
        assert len(data) % stride == 0
        for k in range(0, len(data), stride):
            tokens.update(np.frombuffer(data[k : k + 64], "<u2").tolist())
    want = Counter(i for _, x in rows for i in [*t.encode(x or "", add_special_tokens=False).ids, 50256])
    assert {k: v for k, v in tokens.items() if k != 50256} == {k: v for k, v in want.items() if k != 50256} and tokens[50256] >= want[50256]
    empty = f"file://{tmp_path}/none"
    assert training_order.write_shards(make(spark, []), BYTE, empty) == 0 and training_order.read_shards(spark, empty).count() == 0


def probabilities(model):
    seats = {(r["c"], r["w"]): r["gain"] + r["weight"] * r["root"] for r in model.seats.collect()}
    weights, root = {r["c"]: r["weight"] for r in model.weights.collect()}, {r["w"]: r["root"] for r in model.words.collect()}
    return lambda c, w: seats[c, w] if (c, w) in seats else weights.get(c, 1.0) * root.get(w, model.unknown)


@pytest.mark.parametrize("room", [50_000, 40])
def test_language_model(spark, rows, room):
    """Whole contexts, and frequent ones cut into rows of 40 customers."""
    docs = make(spark, rows)
    train = docs.where("doc_id is null or doc_id % 3 <> 0")
    model, counts = language_model.fit(train, room=room)
    got = language_model.score(docs, model).collect()
    c = Counter()
    low = lambda x: SPLIT.findall((x or "").translate({k: k + 32 for k in range(65, 91)}))
    for i, x in rows:
        if i is None or i % 3:
            c.update([*low(x), ""])
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(low(x)) + 1, sum(c[w] > 0 for w in [*low(x), ""]), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*low(x), ""]), 4)) for i, x in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got) and {(r["w"], r["n"]) for r in counts.collect()} == set(c.items())
    # Proper: over every known token and one unknown, each context's probabilities sum to one, and give the scores.
    p = probabilities(model)
    assert all(math.isclose(sum(p(a, w) for w in [*c, "unheard"]), 1, abs_tol=1e-6) for a in ["", "one", "nowhere", *list(c)[:6]])
    want = sorted((str(i), sum(math.log10(p(a, b)) for a, b in zip(["", *low(x)], [*low(x), ""]))) for i, x in rows if i != 10)
    assert all(a == str(r["doc_id"]) and math.isclose(s, r["score"], abs_tol=1e-6, rel_tol=1e-9) for (a, s), r in zip(want, sorted((r for r in got if r["doc_id"] != 10), key=lambda r: (str(r["doc_id"]), r["score"]))))
    assert language_model.score(make(spark, []), model).count() == 0
    none, _ = language_model.fit(make(spark, []))
    assert language_model.score(make(spark, [(1, "a b")]), none).first()["n_known"] == 0


def labelled(spark):
    good = [(i, " ".join(words(i, 60, 500)).capitalize() + ".") for i in range(60)]
    bad = [(100 + i, " ".join(w.upper() + "!!" for w in words(i, 60, 500))) for i in range(30)]
    toxic = [(200 + i, " ".join(words(i, 50, 500) + ["idiot", "scum"])) for i in range(30)]
    rows = good + bad + toxic + [(900, None), (901, ""), (902, "z" * 5000), (0, good[0][1])]
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(i, 1, 1) for i, _ in toxic] + [(None, 1, 1), (5000, 1, 0), (7, None, None), (1, 1, 0)]
    return make(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), len(rows)


def test_classifiers_and_rules(spark):
    docs, labels, n = labelled(spark)
    q = quality_classifier.score(docs, quality_classifier.fit(docs, labels)).collect()
    assert len(q) == n and all(0 <= r["score"] <= 1 for r in q) and sum(r["predicted"] for r in q if r["doc_id"] < 60) == 61 and not any(r["predicted"] for r in q if 100 <= r["doc_id"] < 130)
    t = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    learnt = lambda i: zlib.crc32(str(i).encode()) % 5 != 0  # noqa: E731  held-out rows of so small a table prove little
    assert len(t) == n and all(r["predicted"] == (200 <= r["doc_id"] < 230) for r in t if r["doc_id"] < 900 and learnt(r["doc_id"]))
    rules = quality_rules.fit(docs, labels)
    k = quality_rules.apply(docs, rules).collect()
    assert len(k) == n and all(r["kept"] == (r["doc_id"] < 100 or r["doc_id"] >= 200) for r in k if r["doc_id"] < 900) and all(r["base_failed"] for r in k if r["doc_id"] >= 900)
    none = labels.where("false")
    assert quality_classifier.score(docs, quality_classifier.fit(docs, none)).where("score = 0.5").count() == n
    assert toxicity.score(make(spark, []), toxicity.fit(make(spark, []), labels)).count() == 0
    assert quality_rules.apply(docs, quality_rules.fit(docs, none)).where("kept").count() == quality_rules.apply(docs, rules).where("not base_failed").count()


def test_license_scan(spark):
    files = [("a/b/c.txt", "text\nReleased under the MIT License."), ("a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/d.txt", "nothing here"), ("a/x/y/z.txt", None), ("q/r.txt", ""), ("top.txt", "words"), (None, "All rights reserved."), ("a/b/LICENSE", "Licensed under CC BY-NC 4.0."), ("a/b/e/f.txt", "more words")]
    df = spark.createDataFrame([(i, p, t, "clash", 3) for i, (p, t) in enumerate(files)], "doc_id bigint, path string, text string, license string, distance int")
    got = {r["doc_id"]: (r["license"], r["effective_license"], r["distance"]) for r in license_scan.scan(df).collect()}
    assert got == {
        0: ("MIT", "MIT", None), 1: ("Apache-2.0", "Apache-2.0", None), 2: (None, "CC-BY-NC-4.0", 0), 3: (None, "Apache-2.0", 2), 4: (None, None, None), 5: (None, None, None),
        6: ("Proprietary", "Proprietary", None), 7: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), 8: (None, "CC-BY-NC-4.0", 1),
    }
    assert license_scan.scan(df.where("false")).count() == 0


def test_license_cosine_is_tf_idf(spark):
    """A line's cosine against the definition; wrapped headers; templates of short words; a large directory."""
    templates = {"A": ["do as you wish with it"], "B": ["share alike in all the same ways", "share alike"]}
    m = license_scan._matcher(tuple((k, tuple(v)) for k, v in templates.items()))
    rows = [license_scan.grams(t) for v in templates.values() for t in v]
    idf = lambda g: 1 + math.log((1 + len(rows)) / (1 + sum(g in r for r in rows)))
    line = license_scan.grams("please share alike in the end")
    norm = lambda c: math.sqrt(sum((n * idf(g)) ** 2 for g, n in c.items()))
    want = max(sum(n * r[g] * idf(g) ** 2 for g, n in line.items()) / norm(line) / norm(r) for r in rows)
    assert math.isclose(m.best("please share alike in the end")[1], want)
    header = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n\nimport os"
    files = [("d/a.py", header), ("d/b.txt", "Do as you wish\nwith it"), ("e/LICENSE", "Released under the MIT License."), ("e/LICENSE", "Released under the MIT License.")] + [(f"e/f{k}", "plain") for k in range(600)]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "doc_id bigint, path string, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert got[0]["license"] == "GPL-3.0" and got[1]["license"] is None and all(got[k]["effective_license"] == "MIT" for k in range(2, 604))
    assert {r["doc_id"]: r["license"] for r in license_scan.scan(df, templates=templates).where("doc_id < 2").collect()} == {0: None, 1: "A"}


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r["doc_id"] for r in docs.collect()}
    truth = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in C.STAGES[:-1]:
        out = C.materialise(stage(spark, docs, sf), name)
        assert out.columns == docs.columns
        docs, ids = out, ids & {r["doc_id"] for r in out.collect()}
        assert out.count() == len(ids)
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert not any(truth[i][1] for i in ids if i in truth and zlib.crc32(str(i).encode()) % 5) and len({t for _, t in left}) == len(left)
    assert all(n == 1 for n in Counter(c for _, _, c in brute_components(left, 5, 80, 100).elements()).values())
    packed = C.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.collect()} == ids


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_any_table(spark, stage, tmp_path):
    """Nulls, empty and long texts, ties, repeats, empty tables, and extra columns that clash with the operators'."""
    import corpus_pipeline as C

    name, run = C.STAGES[stage]
    long = " ".join(words(9, 20_000))
    rows = [(1, None), (2, ""), (None, "a b"), (3, long), (3, long), (4, long), (None, None), (5, " ".join(words(4, 30))), (6, " ".join(words(4, 30)))]
    schema = "n_words string, doc_id bigint, kept string, score string, _pos string, TEXT2 string, text string, _row int, _text string, predicted string, _in0 string, n int, k string"
    docs = spark.createDataFrame([("a", i, "mine", "s", "p", "t", t, 7, "u", "v", "w", 1, "z") for i, t in rows], schema)
    spark.createDataFrame([(3, 1, 0), (5, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = run(spark, docs, str(tmp_path))
    got = out.collect()
    if stage == 4:
        assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(i for i, _ in rows)
    else:
        assert out.columns == docs.columns and all((r["kept"], r["n_words"], r["score"], r["_pos"], r["_row"], r["_text"], r["_in0"]) == ("mine", "a", "s", "p", 7, "u", "w") for r in got)
        left = Counter((r["doc_id"], r["text"]) for r in got)
        want = {
            "quality_rules": [r for r in rows if r[1] and len(r[1]) > 9], "toxicity": rows,
            "exact_dedup": [(2, ""), (None, "a b"), (4, long), (6, rows[8][1])], "ngram_jaccard": [(1, None), (2, ""), (None, "a b"), (3, long), (None, None), (5, rows[7][1])],
        }[name]
        assert left == Counter(want)
    none = run(spark, docs.where("false"), str(tmp_path))
    assert none.count() == 0 and (stage == 4 or none.columns == docs.columns)


def test_queries_have_the_agreed_columns(spark):
    from labelflow.llm import entries

    sf = "/root/testdata/sf0.001"
    want = {
        "op1": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op2": ["doc_id", "held_out", "score", "predicted"], "op4": ["doc_id", "n_shingles", "component_id"],
        "op5": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"], "op8": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    }
    for name, f in entries.QUERIES.items():
        if name.split("_")[0] in want:
            assert f(spark, sf).columns == want[name.split("_")[0]]
    held = entries.op2_toxicity(spark, sf).where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0))
    assert held.isEmpty()


def test_language_model_keeps_every_context(spark):
    """Every context and follower has probabilities of its own, and the model beats the unigram by far where pairs tell."""
    text = " ".join(f"c{k} f{k} c{k} g{k}" for k in range(200))
    model, _ = language_model.fit(make(spark, [(k, text) for k in range(5)]))
    words_ = ["", *text.split(), ""]
    assert {(r["c"], r["w"]) for r in model.seats.collect()} == set(zip(words_, words_[1:]))
    got = {r["doc_id"]: r for r in language_model.score(make(spark, [(1, "c150 f150"), (2, "c150 f151"), (3, "f150 c150"), (4, "zz c150"), (5, None)]), model).collect()}
    assert got[1]["score"] > got[2]["score"] + 1 and math.isclose(got[1]["base_score"], got[2]["base_score"])
    assert [got[k]["n_known"] for k in (1, 2, 3, 4, 5)] == [3, 3, 3, 2, 1]


def test_classifiers_equal_brute_force(spark, rows):
    """Scores of the whole path against the same sums written out one text at a time."""
    rng = np.random.default_rng(3)
    w = rng.normal(0, 0.05, 1 << 18).astype(np.float32)
    sigmoid = lambda x: 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))
    def toxic(text):
        seen = set()
        for word in SPLIT.findall(text):
            bare = word.lower()
            while bare and not bare[0].isalnum():
                bare = bare[1:]
            while bare and not bare[-1].isalnum():
                bare = bare[:-1]
            for part in ([f"w {bare}"] + [f"{n} {bare[:n]}" for n in (4, 5) if len(bare) > n and bare.isalpha()]) if bare else []:
                seen.add(zlib.crc32(part.encode()) >> 14)
        return sigmoid(sum(float(w[k]) for k in seen) - 0.3)
    def quality(text):
        at, x = quality_classifier.features(text)
        return sigmoid(sum(float(w[a]) * float(v) for a, v in zip(at, x)) - 0.3)
    for operator, brute in ((toxicity, toxic), (quality_classifier, quality)):
        got = operator.score(make(spark, rows), (w, -0.3), keep=("doc_id", "score", "text")).collect()
        assert len(got) == len(rows) and all(r[1] == 0.5 and math.isclose(r[3], brute(r[2] or ""), abs_tol=1e-4) for r in got)
