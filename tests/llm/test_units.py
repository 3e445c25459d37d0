"""Parts that need no Spark: merges, packing plan, permutation, learners, counts, licence lines."""

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from labelflow.llm import bpe, language_model, license_scan, packing, quality_classifier, quality_rules, toxicity, training_order

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
TEXT = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(list("abcde ,.'ÄßçΣé́\n\t\x1c\xa0  "))), max_size=40)


def encode_word(text):
    """As encode_decode does it for one row."""
    c = bpe.chunk_cache(WORD)
    parts = [c[x] for x in next(bpe.split_batches([text], c)) if x]
    return [i for p in parts for i in memoryview(p[0]).cast("I")], b" ".join(p[1] for p in parts if p[0]).decode()


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_bpe_equals_library(text):
    lib = _libs[0]
    want = lib.encode(text, add_special_tokens=False).ids
    assert encode_word(text) == (want, lib.decode(want, skip_special_tokens=False))


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_byte_chunks_equal_library(text):
    want = _libs[1].encode(text, add_special_tokens=False).ids
    assert list(memoryview(next(packing.encoded([text], BYTE))).cast("I")) == want
    assert bpe.load(BYTE).decode(bpe.load(BYTE).encode(text)) == text


_libs = (Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE))


@pytest.mark.parametrize("text", ["", " ", "x<|endoftext|> <|startoftext|>y", "a" * 5000, "İΣΣ ς", "it's 12½ 漢字🙂", "a  b   c \n d"])
def test_bpe_edges(text):
    want = _libs[0].encode(text, add_special_tokens=False).ids
    assert encode_word(text) == (want, _libs[0].decode(want, skip_special_tokens=False))
    assert list(memoryview(next(packing.encoded([text], BYTE))).cast("I")) == _libs[1].encode(text, add_special_tokens=False).ids


def test_segment_tree_takes_the_leftmost_lowest_rank():
    merges = {(1, 1): (5, 2), (2, 1): (1, 3), (2, 2): (0, 4)}
    def slow(ids):
        ids = list(ids)
        while True:
            best = min(((merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in merges), default=None)
            if best is None:
                return ids
            ids[best[1] : best[1] + 2] = [merges[(ids[best[1]], ids[best[1] + 1])][1]]
    rng = random.Random(0)
    words = [[rng.choice((1, 1, 2, 7)) for _ in range(rng.randint(2, 40))] for _ in range(300)]
    assert [bpe.merge_ids(w, merges) for w in words] == [slow(w) for w in words] == bpe.merge_many(words, bpe.PairTable(merges, 10))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 30), min_size=1), st.just(20))
def test_plan_is_best_fit_decreasing(histogram, capacity):
    bins: list[int] = []
    for n in sorted((x for n, c in histogram.items() for x in [n] * c), reverse=True):
        fit = [i for i, r in enumerate(bins) if r >= n]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    runs, used = packing.plan_runs(histogram, capacity)
    assert used == len(bins)
    filled: dict[int, list] = {}
    seen = Counter()
    for length, rank, count, first, per, offset in runs:
        for k in range(count):
            filled.setdefault(first + k // per, []).append((offset + k % per * length, length))
            seen[length] += 1
    assert seen == Counter(histogram)
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in p) for p in filled.values()) == sorted(bins)


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 700), st.integers(0, 5))
def test_feistel_is_a_permutation(size, key):
    out = training_order.permute(np.arange(size), size, key)
    assert sorted(out.tolist()) == list(range(size))


def brute_repeats(words, width=5):
    grams = Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
    return len({j for i in range(len(words) - width + 1) if grams[tuple(words[i : i + width])] > 1 for j in range(i, i + width)})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_text_counts(words):
    text = " ".join(words)
    got = dict(zip(quality_rules.COUNTS, quality_rules.text_counts(text)))
    assert got["n_words"] == len(words) and got["word_chars"] == len(words) and got["n_repeat_words"] == brute_repeats(words)


def test_text_counts_lines_and_symbols():
    got = dict(zip(quality_rules.COUNTS, quality_rules.text_counts("a #|\n\nb\na #|\n \n \nü$ ")))
    assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"]) == (6, 9, 5, 1)
    assert set(quality_rules.text_counts("")) == set(quality_rules.text_counts(" \n\x0b")) == {0}


def test_decision_list_learns_and_reads():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(600), "b": rng.random(600)}
    rules = quality_rules.learn(x, x["a"] > 0.8)
    hit = np.zeros(600, bool)
    for r in rules.rules:
        hit |= r.mask(x)
    assert (hit == (x["a"] > 0.8)).mean() > 0.97 and "a >" in str(rules)
    assert not quality_rules.learn(x, np.zeros(600, bool)).rules and not quality_rules.learn(x, np.ones(600, bool)).rules


def test_ftrl_separates():
    rows = [(*quality_classifier.features(t), y) for t, y in [("good words in a row here", 1), ("BAD!! BAD!! NOISE!! HERE!!", 0)] * 40]
    w, b = quality_classifier.train(rows)
    assert all(((w[at] @ x + b) > 0) == bool(y) for at, x, y in rows)
    assert quality_classifier.features("")[0].size == 0 and not quality_classifier.train([])[0].any()


def test_counterfactual_penalty_frees_identity_terms():
    texts = [("muslims are awful idiots", 1)] * 30 + [("christians baked bread today", 0)] * 30 + [("awful idiots", 1)] * 10 + [("bread today", 0)] * 10
    rows = [(*toxicity.features(t), y) for t, y in texts]
    gap = lambda m: abs(m[0][toxicity.places({"muslims"})].sum() - m[0][toxicity.places({"christians"})].sum())
    plain, fair = toxicity.train(rows, lam=0.0), toxicity.train(rows, lam=20.0)
    assert gap(fair) < 0.35 * gap(plain)
    assert all(((fair[0][at].sum() + fair[1]) > 0) == bool(y) for at, _, y in rows)
    assert not toxicity.train([])[0].any()


def test_toxicity_trains_in_blocks(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(3)
    rows = [(np.unique(rng.integers(0, 20_000, 600)).astype(np.int32), None, k % 3 % 2) for k in range(1500)]
    many = sum(len(at) for at, _, _ in rows)
    whole = toxicity.train(rows, steps=3)
    monkeypatch.setattr(toxicity, "BLOCK", 20_000)
    tracemalloc.start()
    parts = toxicity.train(rows, steps=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (whole[0] == parts[0]).all() and whole[1] == parts[1]
    # The features themselves are four bytes each, tables of all places about 5 MB; copies of all features were 25 bytes each.
    assert peak < 8e6 + 6 * many, peak


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for k in range(len(rest)):
            yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1 :]]


@pytest.mark.parametrize("first", ["drawn", "one table", "all apart"])
def test_gibbs_steps_reach_the_exact_distribution(first):
    """Numbers of tables of 20,000 restaurants of one dish against the sum over all partitions of its customers."""
    n, d, strength, p, many = 5, 0.6, 2.0, 0.3, 20_000
    exact = Counter()
    for part in partitions(list(range(n))):
        weight = math.prod((strength + d * i) * p for i in range(len(part))) * math.prod(math.gamma(len(b) - d) / math.gamma(1 - d) for b in part)
        exact[len(part)] += weight
    whole = sum(exact.values())
    sizes = {"drawn": None, "one table": (np.full(many, n), np.ones(many, np.int64)), "all apart": (np.ones(many * n, np.int64), np.full(many, n))}[first]
    s = language_model.Seats(np.full(many, n), np.arange(many), np.full(many, p), np.zeros(many), d, strength, np.random.default_rng(2), sizes)
    for _ in range(60):
        s.step()
    got = Counter(s.t.tolist())
    assert all(abs(got[t] / many - exact[t] / whole) < 0.015 for t in range(1, n + 1))
    flat, t = s.sizes()
    assert (np.bincount(np.repeat(np.arange(many), t), flat) == n).all() and (s.tables == t).all()


def test_few_customers_move_by_states():
    """Steps laid out all tables of all dishes with three customers or more; dishes of few have a state each, from which
    a customer goes and comes by the weights of the tables."""
    sizes, tables, key, less, more = language_model._partitions()
    assert len(set(key.tolist())) == len(key) and (np.diff(sizes, axis=1) <= 0).all() and (tables == (sizes > 0).sum(1)).all()
    bags = [tuple(x[x > 0].tolist()) for x in sizes]
    for k in [*range(60), len(bags) - 1]:
        n, bag = sum(bags[k]), bags[k]
        if n > 1:
            want = Counter(tuple(sorted([*bag[:i], *([x - 1] if x > 1 else []), *bag[i + 1 :]], reverse=True)) for i, x in enumerate(bag) for _ in range(x))
            assert Counter(bags[j] for j in less[k, :n]) == want
        if n < language_model.FEW:
            grown = [tuple(sorted([*bag[:i], x + 1, *bag[i + 1 :]], reverse=True)) for i, x in enumerate(bag)]
            assert [bags[j] for j in more[k, : n + 1]] == [(*bag, 1), *(g for g, x in zip(grown, bag) for _ in range(x - 1)), *grown]
    many, d, strength, p, rng = 60_000, 0.6, 2.0, 0.3, np.random.default_rng(5)
    s = language_model.Seats(np.full(many, 5), np.arange(many), np.full(many, p), np.zeros(many), d, strength, rng, (np.tile([3, 1, 1], many), np.full(many, 3)))
    assert [type(x) for x, _ in s.kinds] == [language_model._Few]
    s.step()
    want = Counter()
    for left, share in (((2, 1, 1), 0.6), ((3, 1), 0.4)):
        weights = [(strength + d * len(left)) * p, *(x - d for x in left)]
        for i, w in enumerate(weights):
            new = (*left, 1) if i == 0 else (*left[: i - 1], left[i - 1] + 1, *left[i:])
            want[tuple(sorted(new, reverse=True))] += share * w / sum(weights)
    flat, t = s.sizes()
    got = Counter(tuple(sorted(x.tolist(), reverse=True)) for x in np.split(flat, np.cumsum(t)[:-1]))
    assert set(got) <= set(want) and all(abs(got[x] / many - want[x]) < 0.01 for x in want)


def test_places_of_numbers():
    rng = np.random.default_rng(4)
    keys = rng.permutation(np.unique(rng.integers(0, 1 << 40, 40_000)))
    x = np.concatenate([keys[::3], rng.integers(-5, 1 << 40, 20_000), [-1, 0]])
    where = {k: i for i, k in enumerate(keys.tolist())}
    assert language_model._Places(keys).find(x).tolist() == [where.get(k, -1) for k in x.tolist()]
    assert language_model._Places(keys[:0]).find(x[:3]).tolist() == [-1] * 3 and language_model._Places(keys[:1]).find(keys[:2]).tolist() == [0, -1]


def test_seats_keep_their_customers():
    rng = np.random.default_rng(0)
    n = np.array([1, 2, 3, 50, 1000, 1, 70_000])
    house = np.array([0, 0, 0, 1, 1, 1, 1])
    s = language_model.Seats(n, house, np.full(7, 1 / 8), np.array([0.0, 5.0]), 0.5, 3.0, rng)
    for _ in range(300):
        s.step()
    flat, t = s.sizes()
    assert (np.bincount(np.repeat(np.arange(7), t), flat) == n).all() and (flat > 0).all() and (t <= n).all() and (t >= 1).all()
    assert s.tables.tolist() == [t[:3].sum(), t[3:].sum() + 5]
    assert np.isfinite(s.evidence(np.array([True, False]))).all()


def test_parameters_are_found_again():
    """Seats drawn with known parameters give these back."""
    rng = np.random.default_rng(1)
    d, strength, n, houses = 0.6, 4.0, 40, 400
    flat, t = [], []
    for _ in range(houses):
        tables = [1]
        for k in range(1, n):
            w = np.array([x - d for x in tables] + [strength + d * len(tables)])
            j = rng.choice(len(w), p=w / w.sum())
            if j == len(tables):
                tables.append(1)
            else:
                tables[j] += 1
        flat += tables
        t.append(len(tables))
    got, at = [], (0.3, 20.0)
    for k in range(400):
        s = language_model.Seats(np.full(houses, n), np.arange(houses), np.ones(houses), np.zeros(houses), *at, rng, (np.array(flat), np.array(t)))
        at = language_model.draw_parameters(s.evidence(np.ones(houses, bool)), rng)
        got.append(at)
    mean = np.mean(got[100:], 0)
    assert abs(mean[0] - d) < 0.06 and abs(mean[1] - strength) < 1.5


@pytest.mark.parametrize("line, name", [("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("All rights reserved.", "Proprietary"), ("// licensed under the apache license, version 2.0", "Apache-2.0"), ("The quick brown fox of the north", None), ("", None)])
def test_license_lines(line, name):
    m = license_scan._matcher(tuple((k, tuple(v)) for k, v in license_scan.TEMPLATES.items()))
    assert license_scan.scan_text("some words\n" + line, m, 0.75)[0] == name


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50), st.lists(st.binary(max_size=9).filter(lambda x: b" " not in x), min_size=1, max_size=20))
def test_language_model_blocks_round_trip(numbers, names):
    x = np.array(numbers, np.int64)
    assert language_model._unpack(language_model._pack(x)).tolist() == numbers
    assert np.cumsum(language_model._unpack(language_model._ascending(np.sort(x)))).tolist() == sorted(numbers)
    assert language_model._unpack(language_model._pack(x / 7, "<f8"), "<f8").tolist() == (x / 7).tolist()
    assert language_model._unpack_names(language_model._pack_names(names)) == names


def test_language_model_slices_hold_every_pair_once():
    """Each pair lies in one bucket, the same one whatever else is gathered; a frequent context is dealt over several."""
    texts = ["a b a c a d a e a f", "x y z a g a h", "", "b a"]
    found, buckets = Counter(), {}
    for group in (texts, texts[1:], texts[:1]):
        g = language_model._Gathered()
        for t in group:
            g.add(t)
        c, w = (np.concatenate([x[a:b] for x in g.texts]) for a, b in ((0, -1), (1, None)))
        for b, at, names, cs, ws in g.slices(7, {b"a": 5}, c, w):
            for i, j in zip(cs, ws):
                found[names[i], names[j]] += group is texts
                assert buckets.setdefault((names[i], names[j]), b) == b
    want = Counter(p for t in texts for p in zip([b"", *t.encode().split()], [*t.encode().split(), b""]))
    assert found == want and len({b for (c, _), b in buckets.items() if c == b"a"}) > 1
    assert all(len({b for (c, _), b in buckets.items() if c == x}) == 1 for x in {c for c, _ in buckets} - {b"a"})


def test_unknown_chunks_in_one_call_and_batches_in_parts():
    import pyarrow as pa

    from labelflow.llm.common import in_parts

    cache, asked = packing.ChunkIds(BYTE), []
    fast = cache.fast
    cache.fast = lambda text: asked.append(text) or fast(text)
    text = "One two,\nthree  four's <|x|> über 12.5%% 中文 end. a\n"
    cache.learn({" One", *text.split(" ")[1:]})
    assert len(asked) == 1 and cache["12.5%%"] == cache.encode(" 12.5%%") and cache["two,\nthree"] == cache.encode(" two,\nthree") and cache["a\n"] is None and cache[""] is None and cache[" One"] == cache.encode("One")
    assert [len(b) for b in in_parts([pa.RecordBatch.from_pydict({"a": list(range(1300))})])] == [512, 512, 276]
