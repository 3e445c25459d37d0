"""Operators 11 to 13 against brute force, the library, and plain Python."""

import glob
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

from labelflow.llm import compaction, entries, lexical_search, piece_bpe

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


# ---- lexical search ----------------------------------------------------------------------------------------------


def brute_ranks(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 100 - 50 + 50 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def made_up(rng, n):
    words = ["Alpha", "beta", "gamma", "DELTA", "e5", "ünï", "zeta", "zeta,zeta", "日本", "\x00", "ÀB", "x-y_z"] + [f"w{i}" for i in range(30)]
    return [(rng.choice([None, i, i // 2]), rng.choice([None, "", " ... ", " ".join(rng.choices(words, k=rng.randint(1, 40)))]) if rng.random() < 0.2 else " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(n)]


@pytest.mark.parametrize("pairs, entries_at_once, block", [(1_000_000, 1 << 21, 1 << 13), (40, 64, 4)])
def test_search_equals_brute_force(spark, monkeypatch, pairs, entries_at_once, block):
    """Nulls, ties, repeated rows and keys, clashing names; also with several groups of items, blocks and slices."""
    monkeypatch.setattr(lexical_search, "PAIRS", pairs)
    monkeypatch.setattr(lexical_search, "PART", 7)
    rng = random.Random(3)
    docs, items = made_up(rng, 200), [(i, t) for i, (_, t) in enumerate(made_up(rng, 12))] + [(None, "beta"), (3, "zeta w1")]
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id bigint, text string, item bigint, score string").repartition(3)
    i = spark.createDataFrame([(*r, 2) for r in items], "item_id bigint, text string, doc bigint")
    got = lexical_search.rank_documents(d, i, 7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    # Rows that agree in key and score may stand in any order: they look the same.
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_ranks(docs, items, 7)


def test_block_scores_in_slices_equal_one_slice(monkeypatch):
    rng = np.random.default_rng(5)
    n_docs, per = 50, rng.integers(1, 9, 50)
    ends = np.cumsum(per).astype(np.int32)
    tids = np.concatenate([rng.choice(20, p, replace=False) for p in per]).astype(np.int32)
    tfs, lengths = rng.integers(1, 5, len(tids)), rng.integers(5, 90, n_docs)
    starts = np.r_[0, np.cumsum(rng.integers(0, 6, 20))]
    items_of, weights = rng.integers(0, 9, starts[-1]), rng.integers(0, 9000, 20)

    def run():
        total = Counter()
        for item, at, score in lexical_search.block_scores(lengths, ends, tids, tfs, weights, starts, items_of, 50, 2000):
            total.update({(i, d): s for i, d, s in zip(item.tolist(), at.tolist(), score.tolist())})
        return total

    whole = run()
    monkeypatch.setattr(lexical_search, "ENTRIES", 5)
    assert run() == whole and whole


def test_radix_order_is_stable():
    keys = np.random.default_rng(1).integers(0, 1 << 40, 5000).astype(np.uint64) >> np.uint64(30)
    assert (lexical_search.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    wide = np.random.default_rng(2).integers(0, 1 << 50, 5000).astype(np.uint64)
    assert (lexical_search.radix_order(wide) == np.argsort(wide, kind="stable")).all()


def test_search_of_empty_tables_and_string_keys(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "ONE")], "item_id string, text string")
    assert [(r.doc_id, r["rank"]) for r in lexical_search.rank_documents(docs, items, 50).orderBy("rank").collect()][1:] == [("a", 2), ("b", 3)]
    assert lexical_search.rank_documents(docs.where("false"), items).count() == 0
    assert lexical_search.rank_documents(docs, items.where("false")).count() == 0
    assert lexical_search.rank_documents(docs, items.withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_search_query_equals_its_sql(spark):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = duck.sql(entries.ORACLE_SQL["op11_lexical_search"]).fetchall()
    assert sorted(map(tuple, entries.op11_lexical_search(spark, SF).collect())) == sorted(want)


# ---- compaction --------------------------------------------------------------------------------------------------


def brute_compaction(rows):
    """Expected result rows without columns and path; rows: (click_id, arrived_at day, sort key of time, value)."""
    total = len(rows)
    share = lambda x: 1 + total // x
    per_day = Counter(r[1] for r in rows)
    files = defaultdict(list)
    for click, day, at, value in rows:
        h = zlib.crc32(b"" if click is None else str(click).encode())
        lot, piece = h // 16 % (1 + per_day[day] // share(200)), min(h % 4, h // 4 % 4)
        files[day, lot, piece].append((at or 0, click is not None, click or 0, click, value))
    for f in files.values():
        f.sort(key=lambda r: r[:3])
    groups = defaultdict(list)
    for (day, lot, piece), f in sorted(files.items(), key=lambda kv: (kv[0][0] is None, kv[0][0] or 0, -len(kv[1]), kv[0][1:])):
        if len(f) >= share(750):
            groups[day].append([math.inf, [(lot, piece)]])
            continue
        fit = next((g for g in groups[day] if g[0] + len(f) <= share(400)), None)
        if fit:
            fit[0] += len(f)
            fit[1].append((lot, piece))
        else:
            groups[day].append([len(f), [(lot, piece)]])
    out = []
    for day, gs in groups.items():
        for _, members in gs:
            ids = [r[3] for m in members for r in files[day, *m]]
            known = [i for i in ids if i is not None]
            cents = sum(math.floor(100 * r[4] + 0.5) for m in members for r in files[day, *m] if r[4] is not None)
            said = ",".join("" if i is None else str(i) for i in ids)
            out.append((day, *members[0], len(ids), min(known, default=None), max(known, default=None), cents, ",".join(f"{a}-{b}" for a, b in members), hashlib.sha256(said.encode()).hexdigest(), len(members) > 1))
    return sorted(out, key=str)


RESULT = ["day", "lot", "piece", "n_rows", "min_click_id", "max_click_id", "cents", "sources", "ids_sha256", "rewritten"]


def whole_check(spark, table, path):
    """The result against brute force, and the folder against the result and the table."""
    got = compaction.write_and_compact(table, path).collect()
    rows = [tuple(r) for r in table.select("click_id", F.unix_date(F.col("arrived_at").cast("date")), F.col("arrived_at").cast("string"), "value").collect()]
    stamps = {s: i for i, s in enumerate(sorted({r[2] for r in rows if r[2]}))}
    assert sorted((tuple(r[c] for c in RESULT) for r in got), key=str) == brute_compaction([(a, b, stamps.get(c), v) for a, b, c, v in rows])
    files = {f"file:{p}" for p in glob.glob(f"{path}/**/*", recursive=True) if p.endswith(".parquet")}
    assert files == {re.sub("^file:/+", "file:/", r["path"]) for r in got}
    held = Counter()
    for r in got:
        t = pq.read_table(re.sub("^file:/+", "/", r["path"]), partitioning=None)
        assert ",".join(t.column_names) == r["columns"] == ",".join(table.columns)
        ids = t["click_id"].to_pylist()
        assert hashlib.sha256(",".join("" if i is None else str(i) for i in ids).encode()).hexdigest() == r["ids_sha256"] and len(ids) == r["n_rows"]
        held.update(str(tuple(x.values())) for x in t.to_pylist())
    assert held == Counter(str(tuple(x.values())) for x in table.toArrow().to_pylist())
    return got


def test_compaction_of_clicks(spark, tmp_path):
    clicks = spark.read.parquet(f"{SF}/clicks.parquet")
    got = whole_check(spark, clicks, f"{tmp_path}/c")
    assert any(r["rewritten"] for r in got) and not all(r["rewritten"] for r in got)
    assert not glob.glob(f"{tmp_path}/c-staged")


def test_compaction_leaves_other_files_alone(spark, tmp_path, monkeypatch):
    before = {}
    put = compaction._put_in_place
    monkeypatch.setattr(compaction, "_put_in_place", lambda out, staged, plan: (before.update({p: open(p, "rb").read() for p in glob.glob(f"{out.path}/**/*.parquet", recursive=True)}), put(out, staged, plan), put(out, staged, plan)))
    got = compaction.write_and_compact(spark.read.parquet(f"{SF}/clicks.parquet"), f"{tmp_path}/c").collect()
    kept = [p for r in got if not r["rewritten"] for p in [re.sub("^file:/+", "/", r["path"])]]
    assert kept and all(open(p, "rb").read() == before[p] for p in kept)


def test_compaction_of_odd_tables(spark, tmp_path):
    """Null times, ids and values, repeated rows, a hot day, times before 1970, and columns named as our own."""
    rng = random.Random(4)
    rows = [(rng.choice([None, i, i // 3]), rng.choice([None, "2024-03-01 10:00:00", f"2024-03-0{rng.randint(1, 9)} 0{rng.randint(0, 9)}:00:00", "1969-12-31 23:00:00"]), rng.choice([None, 1.005, -2.5, 3.14]), f"d{i % 3}", i % 5, None) for i in range(900)]
    rows += rows[:50]
    table = spark.createDataFrame(rows, "click_id bigint, arrived_at string, value double, day string, Lot int, _day_rows string").withColumn("arrived_at", F.col("arrived_at").cast("timestamp_ntz")).drop("_day_rows")
    whole_check(spark, table, f"{tmp_path}/c")
    empty = compaction.write_and_compact(table.where("false"), f"{tmp_path}/e")
    assert empty.count() == 0 and len(empty.columns) == 12


def test_first_fit_against_plain_python(spark):
    rng = random.Random(9)
    for limit in (10, 25):
        sizes = [rng.randint(1, 10) for _ in range(60)]
        bins = []
        for i, s in enumerate(sizes):
            at = next((b for b in bins if sum(sizes[j] for j in b) + s <= limit), None)
            at.append(i) if at is not None else bins.append([i])
        df = spark.createDataFrame([([(s, i, 0) for i, s in enumerate(sizes)],)], "f array<struct<rows:bigint,lot:bigint,piece:bigint>>")
        got = df.select(compaction.first_fit(F.col("f"), F.lit(limit).cast("bigint")).alias("g")).first()["g"]
        assert [[f["lot"] for f in g["files"]] for g in got] == bins


# ---- pieces ------------------------------------------------------------------------------------------------------

TEXTS = ["", " ", "  a  b ", "▁▁a▁ b", "\n\n a\n b\n", " " * 400 + "x", "a" * 900, "ab" * 700 + "a", "日本語テキスト中文没有空格" * 20, "\x00 <s> </s> <unk> <0x41>", "🙂🙃👩‍👩‍👧 é", "\t\t\tif x:\n        return", "ＡＢ ﬁ"]


def test_pieces_equal_the_library(spark):
    sp, p = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_bpe.load(MODEL)
    rng = random.Random(1)
    single = [s.decode() for s in p.surface.values() if len(s.decode()) == 1]
    texts = TEXTS + ["".join(rng.choice(["a", "b", " ", "  ", "e", "th", "in", "\n", rng.choice(single)]) for _ in range(rng.randint(0, 120))) for _ in range(600)]
    rows = [(i % 40 or None, t) for i, t in enumerate([*texts, None])]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, n_tokens int")
    got = piece_bpe.encode_decode(docs, MODEL, keep=("doc_id", "text", "n_tokens")).toDF("doc_id", "text", "extra", "n_tokens", "ids", "decoded", "h1", "h2").collect()
    assert len(got) == len(rows)
    for r in got:
        ids = sp.encode(r["text"] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == sp.decode(ids) and r["extra"] == 7
        assert r["h1"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["h2"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


def test_rounds_equal_one_merge_after_the_other(monkeypatch):
    """Also when long words go over to the segment tree, and for pairs of equal rank."""
    sp, p = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_bpe.load(MODEL)
    for rounds in (256, 3, 0):
        monkeypatch.setattr(piece_bpe, "ROUNDS", rounds)
        for t in TEXTS:
            assert p.encode(t) == sp.encode(t)


def test_decode_of_any_ids():
    sp, p = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_bpe.load(MODEL)
    rng = random.Random(2)
    for _ in range(300):
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(259, 31999)]) for _ in range(rng.randint(0, 8))]
        assert p.decode(ids) == sp.decode(ids), ids


def test_pieces_of_whole_documents(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = entries.op13_sentencepiece(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = sp.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    empty = piece_bpe.encode_decode(spark.createDataFrame([], "doc_id bigint, text string"), MODEL)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"]
