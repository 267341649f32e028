"""Files, databases and pages as DataFrames."""

from __future__ import annotations

import sqlite3
import time
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docgraph.functions.text import col
from docgraph.operators.lineage import cut


def files(spark: SparkSession, path: str, recursive: bool = True, extensions: list[str] | None = None, name_pattern: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content): the listing filters by name before a byte is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if name_pattern:
        reader = reader.option("pathGlobFilter", name_pattern)
    df = reader.load(path)
    if extensions:
        df = df.where(F.lower(F.concat(F.lit("."), F.substring_index("path", ".", -1))).isin([e.lower() for e in extensions]))
    return df


def texts(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(source, content): whole text files, as in a vault of notes."""
    df = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return df.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("content"))


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """A SQLite table or query, scanned in parallel by ranges of rows. Options: path, and table or query; partitions.

    A query is wrapped, a table is read by ranges of its rowid, so that no page is found by skipping rows. The file must
    be where every executor can read it. With no table and no query the names of all tables come.
    """

    @classmethod
    def name(cls) -> str:
        return "docgraph_sqlite"

    def _statement(self) -> str:
        if t := self.options.get("table"):
            return 'SELECT * FROM "' + t.replace('"', '""') + '"'
        return self.options.get("query") or "SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name"

    def schema(self) -> str:
        if given := self.options.get("schema"):
            return given
        kinds = {"INT": "bigint", "INTEGER": "bigint", "BIGINT": "bigint", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "BLOB": "binary"}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            if t := self.options.get("table"):
                found = [(r[1], kinds.get(r[2].upper(), "string")) for r in db.execute('PRAGMA table_info("' + t.replace('"', '""') + '")')]
            else:
                found = [(c[0], "string") for c in db.execute(f"SELECT * FROM ({self._statement()}) LIMIT 0").description]
        return ", ".join(f"`{n}` {k}" for n, k in found)

    def reader(self, schema: Any) -> DataSourceReader:
        return _SqliteReader(self.options, self._statement(), schema)


class _SqliteReader(DataSourceReader):
    def __init__(self, options: Any, statement: str, schema: Any) -> None:
        self.path, self.table, self.statement = options["path"], options.get("table"), statement
        self.parts = int(options.get("partitions", "4"))
        self.kinds = [f.dataType.simpleString() for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        if not self.table:
            return [_Range(0, 0)]
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute('SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "' + self.table.replace('"', '""') + '"').fetchone()
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, a + step) for a in range(low, high + 1, step)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple[Any, ...]]:
        fit = {"bigint": int, "double": float, "string": str}
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            rows = db.execute(f"{self.statement} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high)) if self.table else db.execute(self.statement)
            for r in rows:
                yield tuple(None if v is None else fit.get(k, lambda x: x)(v) for v, k in zip(r, self.kinds, strict=True))


def sqlite(spark: SparkSession, path: str, table: str | None = None, query: str | None = None, partitions: int = 4) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("docgraph_sqlite").option("path", path).option("partitions", partitions)
    return (reader.option("table", table) if table else reader.option("query", query) if query else reader).load()


def jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, bounds: tuple[str, int, int, int] | None = None, fetch: int = 5000, **properties: str) -> DataFrame:
    """A table or query of PostgreSQL, MySQL, SQL Server or Oracle; the driver's jar must be on the class path.

    ``bounds`` is (column, lowest, highest, partitions) of a parallel scan; filters and columns are pushed down.
    """
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch).options(**properties)
    if bounds:
        if query:
            table, query = f"({query}) q", None
        reader = reader.option("partitionColumn", bounds[0]).option("lowerBound", bounds[1]).option("upperBound", bounds[2]).option("numPartitions", bounds[3])
    return reader.option("query", query).load() if query else reader.option("dbtable", table).load()


def object_store(spark: SparkSession, uri: str, limit: int = 0, **options: Any) -> DataFrame:
    """Objects under an s3a or other Hadoop address, as files(); ``limit`` 0 is none."""
    df = files(spark, uri, **options)
    return df.limit(limit) if limit else df


def fetch(tasks: DataFrame, get: Callable[[str], bytes], uri: str = "uri", attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """The tasks with (data, success, error): each address is fetched on an executor, tried again, and never raises.

    ``get`` is any client's call: pages, feeds, mail, chats and trackers differ only in it.
    """
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.schema] + ["data binary, success boolean, error string"])

    def one(address: str) -> tuple[bytes | None, bool, str | None]:
        said = None
        for k in range(attempts):
            try:
                return get(address), True, None
            except Exception as e:
                said = f"{type(e).__name__}: {e}"
                if k + 1 < attempts:
                    time.sleep(wait)
        return None, False, said

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [one(x) for x in pdf[uri]]
            yield pdf.assign(data=[g[0] for g in got], success=[g[1] for g in got], error=[g[2] for g in got])

    return tasks.mapInPandas(run, schema)


def succeeded(packets: DataFrame) -> DataFrame:
    return packets.where(F.col("success"))


def packet_counts(packets: DataFrame) -> DataFrame:
    return packets.agg(F.count_if("success").alias("ok"), F.count_if(~F.coalesce("success", F.lit(False))).alias("failed"))


def hrefs(html: Column | str) -> Column:
    """Addresses of a page's links, as they stand there."""
    return F.array_distinct(F.regexp_extract_all(col(html), F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"'#]+)"""), F.lit(1)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def resolve(base: pd.Series, found: pd.Series) -> pd.Series:
    """Addresses made absolute against their page's; only those of the web stay."""
    return pd.Series([[u for x in (h if h is not None else []) if (u := urldefrag(urljoin(b or "", x))[0]).startswith("http")] for b, h in zip(base, found, strict=True)])


def crawl(pages: DataFrame, seeds: DataFrame, max_depth: int = 1, link_pattern: str | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """(url, depth): breadth first over stored pages; each hop joins only the frontier, and known addresses are skipped.

    The pages are read, and their links parsed, once.

    Fetching is ``pages``' matter: for a live crawl give what fetch() returned for the frontier, hop by hop.
    """
    links = pages.where(F.col(url).isNotNull()).select(F.col(url).alias("a"), F.explode(resolve(F.col(url), hrefs(html))).alias("b")).distinct()
    if link_pattern:
        links = links.where(F.col("b").rlike(link_pattern))
    links = cut(links)
    seen = cut(seeds.select("url").where("url IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        front = seen.where(F.col("depth") == depth - 1).select(F.col("url").alias("a"))
        fresh = cut(front.join(links, "a").select(F.col("b").alias("url")).distinct().join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
    return seen


def packet_source(*candidates: Column | str) -> Column:
    """The first name a packet has for where it is from."""
    return F.coalesce(*[F.nullif(F.trim(col(c)), F.lit("")) for c in candidates], F.lit("unknown"))


def path_extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(path), r"(\.[A-Za-z0-9]+)$", 1))


def lossy_text(data: Column | str) -> Column:
    """Bytes as UTF-8; bytes that are none become the replacement mark."""
    return F.make_valid_utf8(col(data).cast("string"))
