"""Archives of stored news pages as a Spark data source, for batches and streams.

An archive is a folder of Parquet files with the columns url and html, a folder a day of the fetch:
`day=2024-01-05/part-0.parquet`. `spark.read.format("news_pages")` gives the articles of a site, and so does readStream:

    archive.register(spark)
    spark.read.format("news_pages").option("site", "cafef").load(folder).where("day >= '2024-01-01'")

Every file is a partition of its own, parsed by the task that reads it. Ranges of `day` reach the reader (register() lets
filters through); options `start` and `end` do the same, also for streams,
and `limit` takes the first files only (to try things out). A stream takes
the files in the order of their paths; its offset is the last path taken, so days and files are only appended.

Pages without a title or body give no row (nor without a date, unless `require_date` is false); null pages too.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, EqualTo
from pyspark.sql.types import StructType

from volatide.sources import sites

PAGES = "day string, url string, title string, date_text string, body string"
#: Pages of a file that are parsed at once.
TOGETHER = 256
_DAY = re.compile(r"(?:^|/)day=(\d{4}-\d{2}-\d{2})/")


@dataclass
class PageFile(InputPartition):
    path: str
    day: str


class _Archive:
    """What batch and stream readers share: the files of an archive and how one is read."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.site = self.options.get("site", "plain")
        if self.site not in sites.SITES:
            raise ValueError(f"No selectors are known for site {self.site!r}.")
        if not self.options.get("path"):
            raise ValueError("load() names the archive's folder.")
        self.low, self.high = self.options.get("start", ""), self.options.get("end", "9999-12-31")

    def _store(self) -> tuple[fs.FileSystem, str]:
        path = re.sub(r"^file:/+", "/", self.options["path"])
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def files(self) -> list[PageFile]:
        """The archive's files in the range of days, by path."""
        store, folder = self._store()
        found = []
        for info in store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)):
            day = _DAY.search(info.path)
            if info.is_file and info.path.endswith(".parquet") and day and self.low <= day[1] <= self.high:
                found.append(PageFile(info.path, day[1]))
        limit = int(self.options.get("limit", 0))
        return sorted(found, key=lambda f: f.path)[: limit or None]

    def read(self, partition: PageFile) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        with store.open_input_file(partition.path) as source:
            for batch in pq.ParquetFile(source).iter_batches(TOGETHER, columns=["url", "html"]):
                found = [sites.parse(html or "", self.site) for html in batch.column("html").to_pylist()]
                columns = [pa.array([partition.day] * len(found), pa.string()), batch.column("url").cast(pa.string()), *(pa.array([f[i] for f in found], pa.string()) for i in range(3))]
                yield pa.RecordBatch.from_arrays(columns, ["day", "url", "title", "date_text", "body"])


class PageReader(_Archive, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Ranges of days choose files; all filters are left to Spark as well, but those that choose files exactly."""
        for f in filters:
            if getattr(f, "attribute", None) == ("day",) and isinstance(getattr(f, "value", None), str):
                if isinstance(f, (GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, f.value)
                if isinstance(f, (LessThanOrEqual, EqualTo)):
                    self.high = min(self.high, f.value)
                if isinstance(f, (GreaterThanOrEqual, LessThanOrEqual, EqualTo)):
                    continue
                # An open end keeps the day itself, which Spark then drops.
                if isinstance(f, GreaterThan):
                    self.low = max(self.low, f.value)
                elif isinstance(f, LessThan):
                    self.high = min(self.high, f.value)
            yield f

    def partitions(self) -> list[PageFile]:
        return self.files() or [PageFile("", "")]

    def read(self, partition: PageFile) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from super().read(partition)


class PageStream(_Archive, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        files = self.files()
        return {"after": files[-1].path if files else ""}

    def partitions(self, start: dict, end: dict) -> list[PageFile]:
        return [f for f in self.files() if start["after"] < f.path <= end["after"]]

    def commit(self, end: dict) -> None:
        """Nothing is kept beside Spark's own offsets."""


class NewsPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "news_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema: StructType) -> PageStream:
        return PageStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and let filters reach such readers."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NewsPages)


def articles(raw: DataFrame, site: str, require_date: bool = True) -> DataFrame:
    """The rows of the source (or its stream) as articles: url, source, category, title, date, published_at, body."""
    return sites.as_articles(raw, site, require_date)


def write_pages(pages: DataFrame, folder: str, day: str = "day") -> None:
    """Append pages (url, html, day) to an archive."""
    pages.select("url", "html", day).repartition(day).write.mode("append").partitionBy(day).parquet(folder)


def describe(folder: str, site: str = "plain") -> str:
    """What an archive holds, as JSON: days, files, and the offset a stream would have."""
    archive = _Archive({"path": folder, "site": site})
    files = archive.files()
    return json.dumps({"days": len({f.day for f in files}), "files": len(files), "after": files[-1].path if files else ""})
