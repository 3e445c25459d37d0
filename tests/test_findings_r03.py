"""Cases of the findings of round 3."""

import duckdb
import numpy as np

from labelflow.functions import vector
from labelflow.operators import knn
from labelflow.plans import catalogue
from labelflow.sources import paged


def sql_rows(name, **tables):
    c = duckdb.connect()
    for t, path in tables.items():
        c.sql(f"create view {t} as select * from '{path}/*.parquet'")
    return sorted(c.sql(catalogue.ORACLE_SQL[name]).fetchall())


def test_cap_note_of_long_urls(spark, tmp_path):
    """The base64 of a url beyond 57 bytes, broken into lines, was not wholly taken out."""
    rows = [(i, "https://example.com/" + "a" * 38, "x" * n) for i, n in enumerate(range(1000, 1100))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, catalogue.html_cap_note(spark, str(tmp_path)).select("page_id", "note").collect()))
    assert got == sql_rows("html_cap_note", pages=f"{tmp_path}/pages.parquet") and len(got) == 100


def embeddings(spark, tmp_path, n=700):
    """Vectors with copies of copies, ones without length and ones that are not there; ids are mixed."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(n // 7, 16)).astype(np.float32)
    rows = [(i * 37 % n, None if i == 5 else [0.0] * 16 if i % 90 == 1 else (base[i % len(base)] * (1 + i % 3)).tolist(), i % 10) for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return f"{tmp_path}/embeddings.parquet"


def test_neighbours_and_pairs_of_copies(spark, tmp_path, monkeypatch):
    """Copies tie to the last bit wherever a matrix product has them, so the smaller ids win, as in SQL."""
    path = embeddings(spark, tmp_path)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 48)
    monkeypatch.setattr(knn, "TILE_ROWS", 5)
    for name, columns in (("knn_topk", ("query_id", "neighbour_id", "label", "similarity", "rank")), ("cosine_pairs", ("query_id", "neighbour_id", "similarity"))):
        got = sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()), key=str)
        assert got == sorted(sql_rows(name, embeddings=path), key=str), name


def test_rows_of_an_index_are_not_gathered(spark, tmp_path, monkeypatch):
    """A task packs blocks as the rows come, and what it keeps of open queries is without their vectors."""
    monkeypatch.setattr(knn, "BLOCK_ROWS", 32)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        e = spark.read.parquet(embeddings(spark, tmp_path)).selectExpr("vec_id id", "embedding vector", "cast(label as string) label")
        blocks = knn.index_blocks(e, "bigint").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(i for b in blocks for i in b.i) == sorted(r.id for r in e.where("vector is not null").collect()) and all(len(b.i) <= 32 and len(b.m) == len(b.i) * 64 for b in blocks)
    assert not hasattr(knn._Nearest(np.arange(3), 2, True), "x")


def test_pages_share_files_and_tasks(spark, tmp_path):
    """Each page had a file and a task of its own, so both grew with the rows; pages of other sizes and starts are the same."""
    rows = spark.range(1, 3001).selectExpr("id seq", "concat('m', id % 7) kind")
    listing = paged.StagedListing(paged.stage(rows, "seq", f"file://{tmp_path}/listing", 10))
    assert listing.end() == 300 and len(list((tmp_path / "listing" / "sheets").glob("_sheet=*/*.parquet"))) == 5
    reader = paged._PagedStreamReader(listing, 500, 0)
    tasks = reader.partitions({"token": 3}, {"token": 300})
    assert [t.value for t in tasks] == [(3, 64), (64, 128), (128, 192), (192, 256), (256, 300)] and reader.partitions({"token": 300}, {"token": 300}) == []
    assert [r for t in tasks for r in reader.read(t)] == [(k, f"m{k % 7}") for k in range(31, 3001)]
    assert listing.page(64, 3) == ([(k, f"m{k % 7}") for k in (641, 642, 643)], 65) and [r[0] for r in listing.pages(63, 65, 2)] == [631, 632, 641, 642]


def test_texts_of_a_batch_are_embedded_in_parts(spark):
    """A whole Arrow batch of texts was made into vectors at once."""

    class Counting:
        """Vectors that say how many texts were made into vectors at a time."""

        model_name, dimension = "counting", 2

        def embed_batch(self, texts):
            return np.full((len(texts), 2), len(texts), np.float32)

    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "concat('text ', id) said")
    got = vector.embed_rows(rows, "said", Counting(), ("id",)).collect()
    assert [r.id for r in got] == list(range(3000)) and max(r.vector[0] for r in got) <= 1024


def test_ties_are_settled_as_they_come(monkeypatch):
    """All that tied in a block were gathered before the best k were kept."""
    most, keep = [], knn._Nearest._keep
    monkeypatch.setattr(knn, "FOUND_ROWS", 1000)
    monkeypatch.setattr(knn, "TILE_ROWS", 4)
    monkeypatch.setattr(knn._Nearest, "_keep", lambda self, found: (most.append(sum(len(f[0]) for f in found)), keep(self, found))[1])
    best, one = knn._Nearest(np.arange(100), 5, True), np.ones((900, 8))
    best.look(one[:100], np.arange(900)[::-1], np.full(900, "a", object), one, np.array([0, 450]), np.full((2, 8), 8**-0.5), np.zeros(2))
    assert len(most) > 10 and max(most) <= 1000 + 4 * 900
    assert best.near.reshape(100, 5).tolist() == [[n for n in range(6) if n != q][:5] for q in range(100)] and np.allclose(best.sim, 1)


def test_query_blocks_are_packed_once_and_the_same_again(spark, tmp_path):
    """Blocks had names by chance and were packed again for each part of the index, by a second Python worker a task."""
    e = spark.read.parquet(embeddings(spark, tmp_path)).selectExpr("vec_id id", "embedding vector")
    blocks = lambda: sorted((r.b, tuple(r.q), bytes(r.qm)) for r in knn._query_blocks(e, "bigint").collect())
    assert blocks() == blocks() and sorted(i for b in blocks() for i in b[1]) == sorted(r.id for r in e.collect() if r.vector and any(r.vector))
    assert knn._query_blocks(e, "bigint").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_index_blocks_hold_many_places(spark, tmp_path, monkeypatch):
    """A block ended with its place, so an index had hundreds of small ones, and all queries went along with each."""
    monkeypatch.setattr(knn, "BLOCK_ROWS", 256)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        blocks = knn.index_blocks(spark.read.parquet(embeddings(spark, tmp_path)).selectExpr("vec_id id", "embedding vector", "cast(label as string) label"), "bigint").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(len(b.i) for b in blocks) == 699 and len(blocks) == 3 and max(len(b.starts) for b in blocks) > 1


def test_single_precision_only_chooses(spark):
    """Cosines that differ by less than single precision can tell come in the order of the exact ones, over several patches."""
    rng = np.random.default_rng(7)
    base, turn = rng.normal(size=(3, 32)), rng.normal(size=(400, 32))
    rows = [(i * 7 % 400, (base[i % 3] + turn[i] * 10.0 ** -(4 + i % 5)).tolist(), f"L{i % 4}") for i in range(400)]
    index = spark.createDataFrame(rows, "id long, vector array<double>, label string").repartition(2)
    queries = index.where("id % 9 = 0").select("id", "vector")
    rows_of = lambda df: sorted(map(tuple, df.select("query_id", "rank", "neighbour_id", "label", "similarity").collect()))
    assert rows_of(knn.neighbours_blocked(queries, index, 5, exclude_self=True)) == rows_of(knn.neighbours_sql(queries, index, 5, exclude_self=True))
