"""A service that answers in pages, as a data source: pages are partitions, filters go to the service, a limit ends the paging.

The service that is there is a folder of Parquet files: a page is a run of rows of a row group. Any store with an address
that pyarrow opens will do.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestone.registry import query


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of an address and the place in it; a plain path is a local one."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def expression(f: Filter) -> pc.Expression | None:
    """What the service is asked for a filter; None where it can't be asked. A comparison with null is never true, as in SQL."""
    if isinstance(f, Not):
        inner = expression(f.child)
        return None if inner is None else ~inner
    if len(f.attribute) != 1:
        return None
    c = pc.field(f.attribute[0])
    if isinstance(f, (IsNull, IsNotNull)):
        return c.is_null() if isinstance(f, IsNull) else c.is_valid()
    if f.value is None:
        return None
    if isinstance(f, In):
        return None if any(v is None for v in f.value) else c.isin(list(f.value))
    makers = {
        EqualTo: lambda v: c == v, GreaterThan: lambda v: c > v, GreaterThanOrEqual: lambda v: c >= v, LessThan: lambda v: c < v, LessThanOrEqual: lambda v: c <= v,
        StringStartsWith: lambda v: pc.starts_with(c, v), StringEndsWith: lambda v: pc.ends_with(c, v), StringContains: lambda v: pc.match_substring(c, v),
    }
    return makers[type(f)](f.value) if type(f) in makers else None


@dataclass
class Page(InputPartition):
    """Rows ``first`` to ``end`` of a row group, of which ``most`` that pass the filters are wanted (all, if None)."""

    path: str
    group: int
    first: int
    end: int
    most: int | None = None


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.path = schema, options["path"]
        self.rows = int(options.get("page_rows", 10_000))
        self.limit = int(options["limit"]) if options.get("limit") else None
        self.wanted: pc.Expression | None = None
        self.asked: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            e = expression(f)
            if e is None:
                yield f  # Spark applies it to what the service answers
            else:
                self.wanted = e if self.wanted is None else self.wanted & e
                self.asked.append(repr(f))

    def pages(self) -> Iterator[Page]:
        store, path = opened(self.path)
        for file in sorted(ds.dataset(path, filesystem=store, format="parquet").files):
            meta = pq.read_metadata(file, filesystem=store)
            for g in range(meta.num_row_groups):
                n = meta.row_group(g).num_rows
                for first in range(0, n, self.rows):
                    yield Page(file, g, first, min(first + self.rows, n))

    def partitions(self) -> list[Page]:
        if self.limit is None:
            return list(self.pages()) or [Page("", 0, 0, 0)]
        found, left = [], self.limit
        for page in self.pages():  # page by page, and no further than the limit
            if left <= 0:
                break
            page.most = min(left, self.table(page).num_rows)
            left -= page.most
            found.append(page)
        return found or [Page("", 0, 0, 0)]

    def table(self, page: Page) -> pa.Table:
        schema = to_arrow_schema(self.schema)
        if not page.path:
            return schema.empty_table()
        store, _ = opened(self.path)
        with pq.ParquetFile(page.path, filesystem=store) as file:
            rows = file.read_row_group(page.group, columns=schema.names).slice(page.first, page.end - page.first)
        return (rows if self.wanted is None else rows.filter(self.wanted)).select(schema.names).cast(schema)

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        rows = self.table(partition)
        yield from (rows if partition.most is None else rows.slice(0, partition.most)).to_batches()


class PagedSource(DataSource):
    """``spark.read.format("paged").schema(...).option("path", ...)``, with ``page_rows`` and ``limit``.

    Only the columns of the schema are read. ``limit`` counts rows that pass the filters that the service was asked, in
    the order of files and rows; the pages that hold them are looked at while the read is planned, and no others.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ValueError("name the columns with .schema(...)")

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, dict(self.options))


def read_pages(spark: SparkSession, path: str, schema: str, page_rows: int = 10_000, limit: int | None = None) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
    reader = spark.read.format("paged").schema(schema).option("path", path).option("page_rows", page_rows)
    return (reader.option("limit", limit) if limit else reader).load()


def _as_negatives(parts: DataFrame) -> DataFrame:
    return parts.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".cif")).alias("cif"), F.lit(0.0).alias("tc"))


@query("SELECT p_partkey || '.cif' AS cif, 0.0::DOUBLE AS tc FROM part WHERE p_retailprice >= 905")
def source_api_bandgap(spark, sf):
    """All that pass a bound, by pages; the bound goes to the service."""
    pages = read_pages(spark, f"{sf.rstrip('/')}/part.parquet", "p_partkey long, p_retailprice double", 500)
    return _as_negatives(pages.filter("p_retailprice >= 905"))


@query("SELECT p_partkey || '.cif' AS cif, 0.0::DOUBLE AS tc FROM (SELECT * FROM part WHERE p_retailprice >= 905 ORDER BY p_partkey LIMIT 150)")
def source_api_bandgap_limit(spark, sf):
    """The first of them, in the order of the service, from no more pages than it takes."""
    pages = read_pages(spark, f"{sf.rstrip('/')}/part.parquet", "p_partkey long, p_retailprice double", 100, limit=150)
    return _as_negatives(pages.filter("p_retailprice >= 905"))
