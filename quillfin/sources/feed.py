"""A paged Atom feed, the latest entries first, as a Python data source for batches and streams.

    spark.dataSource.register(PagedFeed)
    spark.read.format("paged_feed").option("url", "https://host/feed?start={start}&count={count}&dateb={before}").load().filter("filed >= '2024-01-01'")

Bounds on `filed` are pushed into the reader (with spark.sql.python.filterPushdown.enabled): pages are read until
one holds an entry before the first day asked for, and no page after it. Where the address takes {before}, a day
before which entries must lie, the days asked for are cut into `parts` ranges, each a partition
that turns its own pages; without it, pages can only be had one after the other, in one partition.

As a stream, an offset is the newest moment of the feed and the links of that moment; a batch has what is newer
than the last offset and not newer than its own. So a restart takes no entry twice and misses none, even of equal times.

An address may also be a folder (file:, hdfs:, s3:), whose files together are the page. A page that does not exist is the end of the feed.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "title string, filed date, updated timestamp, link string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_ATOM = "{http://www.w3.org/2005/Atom}"
#: Times that a page is asked for before the read fails.
TRIES = 3


@dataclass(frozen=True)
class Entry:
    title: str
    filed: date
    updated: datetime
    link: str

    def row(self) -> tuple:
        return self.title, self.filed, self.updated, self.link


def _text(node: ET.Element, name: str) -> str:
    found = node.find(_ATOM + name)
    found = node.find(name) if found is None else found
    return (found.text or "").strip() if found is not None else ""


def entries_of(page: str) -> tuple[list[Entry], int]:
    """The entries of a page, those without a readable moment left out, and how many it has in all. The day is the one written, whatever the offset from UTC."""
    root = ET.fromstring(page)
    nodes = root.findall(_ATOM + "entry") or root.findall("entry")
    out = []
    for node in nodes:
        link = node.find(_ATOM + "link")
        link = node.find("link") if link is None else link
        try:
            moment = datetime.fromisoformat(_text(node, "updated"))
            if moment.tzinfo is None:
                moment = moment.replace(tzinfo=timezone.utc)
            out.append(Entry(_text(node, "title"), date.fromisoformat(_text(node, "updated")[:10]), moment.astimezone(timezone.utc), link.get("href", "") if link is not None else ""))
        except ValueError:
            continue
    return out, len(nodes)


def _folder(address: str) -> str | None:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(address)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        return None
    files = [path] if info.type == fs.FileType.File else sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.base_name[0] not in "._")
    return "".join(system.open_input_stream(f).read().decode() for f in files)


class Pages:
    """The pages of a feed by options url, count (entries of a page), pause (seconds between pages)."""

    def __init__(self, options: dict):
        self.url, self.count, self.pause = options["url"], int(options.get("count", 40)), float(options.get("pause", 0))
        self.agent = options.get("agent", "paged-feed")
        self.by_day = "{before}" in self.url

    def page(self, start: int, before: date | None) -> str | None:
        address = self.url.replace("{start}", str(start)).replace("{count}", str(self.count)).replace("{before}", before.strftime("%Y%m%d") if before else "")
        if not address.startswith("http"):
            return _folder(address)
        for attempt in range(TRIES):
            try:
                with urllib.request.urlopen(urllib.request.Request(address, headers={"User-Agent": self.agent}), timeout=30) as answer:
                    return answer.read().decode()
            except urllib.error.HTTPError as e:
                if e.code in (404, 410):
                    return None
                if e.code < 500 and e.code != 429 or attempt == TRIES - 1:
                    raise
            except urllib.error.URLError:
                if attempt == TRIES - 1:
                    raise
            time.sleep(max(self.pause, 0.2) * 2**attempt)
        return None

    def turn(self, before: date | None = None) -> Iterator[list[Entry]]:
        """The entries of each page, as far as the feed goes; a page is asked for when it is wanted."""
        start = 0
        while True:
            page = self.page(start, before)
            entries, n = entries_of(page) if page else ([], 0)
            if n:
                yield entries
            if n < self.count:
                return
            start += n
            time.sleep(self.pause)


@dataclass
class Days(InputPartition):
    """Entries filed from first (None: as far back as the feed goes) to last (None: to the newest)."""

    first: date | None
    last: date | None


class FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pages, self.parts = Pages(options), int(options.get("parts", 8))
        self.first: date | None = None
        self.last: date | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take in bounds on `filed`; the others, and what a bound leaves open, are Spark's."""
        for f in filters:
            if getattr(f, "attribute", None) != ("filed",) or not isinstance(getattr(f, "value", None), date):
                yield f
                continue
            low = f.value if isinstance(f, (EqualTo, GreaterThanOrEqual)) else f.value + timedelta(1) if isinstance(f, GreaterThan) else None
            high = f.value if isinstance(f, (EqualTo, LessThanOrEqual)) else f.value - timedelta(1) if isinstance(f, LessThan) else None
            if low is None and high is None:
                yield f
            if low is not None:
                self.first = max(self.first or low, low)
            if high is not None:
                self.last = min(self.last or high, high)

    def partitions(self) -> list[Days]:
        if not (self.pages.by_day and self.first and self.last) or self.first > self.last:
            return [Days(self.first, self.last)]
        days = (self.last - self.first).days + 1
        cuts = [self.first + timedelta(days * k // min(self.parts, days)) for k in range(min(self.parts, days) + 1)]
        return [Days(a, b - timedelta(1)) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: Days) -> Iterator[tuple]:
        if partition.first and partition.last and partition.first > partition.last:
            return
        before = partition.last + timedelta(1) if self.pages.by_day and partition.last else None
        for entries in self.pages.turn(before):
            for e in entries:
                if (partition.first is None or e.filed >= partition.first) and (partition.last is None or e.filed <= partition.last):
                    yield e.row()
            if partition.first and any(e.filed < partition.first for e in entries):
                return


@dataclass
class Since(InputPartition):
    start: dict
    end: dict


class FeedStream(DataSourceStreamReader):
    """Offsets: {"updated": the newest moment or "", "links": its links}."""

    def __init__(self, options: dict):
        self.pages = Pages(options)

    def initialOffset(self) -> dict:
        return {"updated": "", "links": []}

    def latestOffset(self) -> dict:
        newest, links = "", []
        for entries in self.pages.turn():
            for e in entries:
                moment = e.updated.isoformat()
                if not newest:
                    newest = moment
                if moment < newest:
                    return {"updated": newest, "links": sorted(links)}
                links.append(e.link)
        return {"updated": newest, "links": sorted(links)}

    def partitions(self, start: dict, end: dict) -> list[Since]:
        return [Since(start, end)]

    def read(self, partition: Since) -> Iterator[tuple]:
        start, end = partition.start, partition.end
        seen, known = set(start["links"]), set(end["links"])
        for entries in self.pages.turn():
            for e in entries:
                moment = e.updated.isoformat()
                if moment < start["updated"]:
                    return
                if (moment > start["updated"] or e.link not in seen) and (moment < end["updated"] or moment == end["updated"] and e.link in known):
                    yield e.row()

    def commit(self, end: dict) -> None:
        pass


class PagedFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> FeedStream:
        return FeedStream(self.options)


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(PagedFeed)
    spark.conf.set(PUSHDOWN, "true")
    return spark


def read_feed(spark: SparkSession, url: str, **options) -> DataFrame:
    """title, filed, updated, link of a feed. Filter by `filed` to bound what is fetched."""
    return _registered(spark).read.format("paged_feed").options(url=url, **options).load()


def stream_feed(spark: SparkSession, url: str, **options) -> DataFrame:
    """The entries of a feed as they come."""
    return _registered(spark).readStream.format("paged_feed").options(url=url, **options).load()
