"""Listings that come in pages, each naming the next by a token, as a data source for batches and streams.

`PagedListing` is what a listing is: page(token, size) gives rows and the token of the next page, None at the end. A stream's
offset is the position in the listing that its tokens stand for, so a restart goes on where the checkpoint says; a task reads
up to SHEET pages of a micro-batch. `StagedListing` serves a table that Spark has laid out in sheets of SHEET pages, a file
each (stage): its tokens are page numbers.

Subclass PagedSource and override `listing` for another service.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, InputPartition

#: Rows of a page at most (fixed value of the service).
PAGE_ROWS = 500
#: Pages of a staged file, and of a task at most.
SHEET = 64


class CursorExpired(LookupError):
    """The listing no longer has what a token stands for: a full resynchronisation is due."""


class PagedListing:
    def page(self, token: int, size: int) -> tuple[list[tuple], int | None]:
        """Rows of the page at token (0: the first), and the next page's token or None. Raises CursorExpired for tokens
        older than what is kept."""
        raise NotImplementedError

    def pages(self, start: int, end: int, size: int) -> Iterator[tuple]:
        """Rows of the pages at tokens from start to before end."""
        for token in range(start, end):
            yield from self.page(token, size)[0]

    def first(self) -> int:
        """The oldest token that is kept."""
        return 0

    def end(self) -> int:
        """The token after the last page that there is now."""
        raise NotImplementedError


class StagedListing(PagedListing):
    def __init__(self, root: str):
        self.fs, self.path = pafs.FileSystem.from_uri(root)
        with self.fs.open_input_stream(f"{self.path}/listing.json") as f:
            self.about = json.loads(f.read())

    def first(self) -> int:
        return self.about["first"]

    def end(self) -> int:
        return self.about["pages"]

    def page(self, token: int, size: int) -> tuple[list[tuple], int | None]:
        if token < self.first():
            raise CursorExpired(f"pages before {self.first()} are gone; the cursor is {token}")
        if token >= self.end():
            return [], None
        return list(self.pages(token, token + 1, size)), token + 1 if token + 1 < self.end() else None

    def pages(self, start: int, end: int, size: int) -> Iterator[tuple]:
        """Each sheet is read once."""
        sheet = self.about["sheet"]
        for k in range(start // sheet, -(-end // sheet)):
            folder = pafs.FileSelector(f"{self.path}/sheets/_sheet={k}")
            for f in self.fs.get_file_info(folder):
                if f.path.endswith(".parquet"):
                    table = pq.read_table(f.path, filesystem=self.fs, partitioning=None, filters=[("_page", ">=", start), ("_page", "<", end)])
                    rows = zip(table.column("_page").to_pylist(), zip(*(c.to_pylist() for c in table.drop_columns("_page").columns)))
                    for _, page in groupby(rows, lambda r: r[0]):
                        yield from (row for _, row in islice(page, size))


def _runs(start: int, end: int) -> list[InputPartition]:
    """Tokens from start to before end in runs that lie in one sheet each."""
    edges = [start, *range((start // SHEET + 1) * SHEET, end, SHEET), end] if start < end else []
    return [InputPartition(x) for x in zip(edges, edges[1:])]


def stage(rows: DataFrame, order: str, root: str, size: int = PAGE_ROWS, first: int = 0) -> str:
    """Lays rows (no nested columns) out as a StagedListing at root, pages of `size` rows by `order`, ties by all columns.
    first: pages before it count as expired. Places come from the sizes of ranges: no task sorts everything."""
    spark, columns = rows.sparkSession, rows.columns
    ranged = rows.repartitionByRange(order, *[c for c in columns if c != order]).sortWithinPartitions(order, *[c for c in columns if c != order]).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    ranged.write.parquet(f"{root}/ranges")
    ranged = spark.read.schema(ranged.schema).parquet(f"{root}/ranges")
    sizes = {p: n for p, n in ranged.groupBy("_part").agg(F.count(F.lit(1))).collect()}
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    placed = ranged.join(F.broadcast(spark.createDataFrame(before, "_part int, _before bigint")), "_part")
    paged = placed.withColumn("_page", F.expr(f"(_before + _at) div {size}")).withColumn("_sheet", F.expr(f"_page div {SHEET}"))
    paged.repartition("_sheet").sortWithinPartitions("_sheet", "_part", "_at").select(*columns, "_page", "_sheet").write.partitionBy("_sheet").parquet(f"{root}/sheets")
    out = (fs := (p := spark._jvm.org.apache.hadoop.fs.Path(f"{root}/listing.json")).getFileSystem(spark._jsc.hadoopConfiguration())).create(p)
    out.write(bytearray(json.dumps({"pages": -(-total // size), "first": first, "sheet": SHEET, "schema": rows._jdf.schema().toDDL()}).encode()))
    out.close()
    return root


class PagedSource(DataSource):
    """Options: root (of the listing), size (rows of a page, 500 at most), limit (0: all), start (token of a stream's first
    page), pushdown (true: equality and greater-than filters are applied
    by the source, before the limit; needs spark.sql.python.filterPushdown.enabled)."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def listing(self) -> PagedListing:
        return StagedListing(self.options["root"])

    def schema(self) -> str:
        return self.listing().about["schema"]

    def _number(self, name: str, default: int) -> int:
        return int(self.options.get(name, str(default)))

    def reader(self, schema) -> _PagedReader:
        kind = _FilteringReader if self.options.get("pushdown") == "true" else _PagedReader
        return kind(self.listing(), schema.fieldNames(), min(self._number("size", PAGE_ROWS), PAGE_ROWS), self._number("limit", 0))

    def streamReader(self, schema) -> _PagedStreamReader:
        return _PagedStreamReader(self.listing(), min(self._number("size", PAGE_ROWS), PAGE_ROWS), self._number("start", 0))


class _PagedReader(DataSourceReader):
    """A batch: without a limit a task a sheet; with one a single task that follows the tokens and stops asking as soon as it
    has enough rows, counted after the filters that it was given."""

    def __init__(self, listing: PagedListing, columns: list[str], size: int, limit: int):
        self.listing, self.columns, self.size, self.limit, self.filters = listing, columns, size, limit, []

    def _fits(self, row: tuple) -> bool:
        return all(row[c] is not None and (row[c] == v if equal else row[c] > v) for c, equal, v in self.filters)

    def partitions(self):
        tokens = range(self.listing.first(), self.listing.end())
        return [InputPartition((tokens.start, None))] if self.limit else _runs(tokens.start, tokens.stop)

    def read(self, partition):
        (token, end), left = partition.value, self.limit
        if not left:
            yield from filter(self._fits, self.listing.pages(token, end, self.size))
            return
        while token is not None:
            rows, token = self.listing.page(token, self.size)
            for row in filter(self._fits, rows):
                yield row
                left -= 1
                if not left:
                    return


class _FilteringReader(_PagedReader):
    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan)) and len(f.attribute) == 1 and f.attribute[0] in self.columns:
                self.filters.append((self.columns.index(f.attribute[0]), isinstance(f, EqualTo), f.value))
            else:
                yield f


class _PagedStreamReader(DataSourceStreamReader):
    """A micro-batch takes the pages between the checkpoint's token and the listing's end, a task a sheet."""

    def __init__(self, listing: PagedListing, size: int, start: int):
        self.listing, self.size, self.start = listing, size, start

    def initialOffset(self) -> dict:
        return {"token": self.start}

    def latestOffset(self) -> dict:
        return {"token": self.listing.end()}

    def partitions(self, start: dict, end: dict):
        if start["token"] < self.listing.first():
            raise CursorExpired(f"pages before {self.listing.first()} are gone; the cursor is {start['token']}")
        return _runs(start["token"], end["token"])

    def read(self, partition):
        yield from self.listing.pages(*partition.value, self.size)
