"""Pages of a service as a Spark data source: one partition for each range of pages."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Iterator
from urllib.error import URLError
from urllib.parse import quote
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from terrafold.runtime import ship


class PageRange(InputPartition):
    """Pages first to last - 1 of so many; size and stated are what the first reply says of a page and of all, where that was asked."""

    def __init__(self, first: int, last: int, pages: int, size: int | None = None, stated: int | None = None) -> None:
        self.first, self.last, self.pages, self.size, self.stated = first, last, pages, size, stated


#: How a value of each type is read; anything else stays text.
_READ = {"double": float, "bigint": int, "int": int, "boolean": bool}
#: Comparisons that go into {where}; an option of the same name gives another form.
FORMS = {"equals": "{column}={value}", "in": "{column}__in={value}", "gt": "{column}__gt={value}", "gte": "{column}__gte={value}", "lt": "{column}__lt={value}", "lte": "{column}__lte={value}"}
_COMPARED = {GreaterThan: "gt", GreaterThanOrEqual: "gte", LessThan: "lt", LessThanOrEqual: "lte"}


class PagedReader(DataSourceReader):
    """Reads pages with a time limit and some tries each; checks that every page holds what the stated total leaves for it."""

    def __init__(self, options: dict, names: list[str], types: list[str] | None = None) -> None:
        self.url, self.names = options["url"], names
        self.read_as = [_READ.get(t, str) for t in types or ["string"] * len(names)]
        self.pages = int(options["pages"]) if "pages" in options else None
        self.per, self.key = int(options.get("pagesperpartition", 8)), options.get("records", "records")
        self.total, self.tries, self.timeout = options.get("total"), int(options.get("tries", 3)), float(options.get("timeout", 8))
        self.place = (options.get("lon", "lon"), options.get("lat", "lat"))
        self.forms = {k: options.get(k, v) for k, v in FORMS.items()}
        self.equal: dict[str, str] = {}
        self.where: list[str] = []
        self.box = [-180.0, -90.0, 180.0, 90.0]

    def partitions(self) -> list[PageRange]:
        pages, size, stated = self.pages, None, None
        if pages is None:
            first = self._page(0)
            if self.total is None:
                raise ValueError("give the number of pages, or the key of the total")
            size, stated = len(first[self.key]), int(first[self.total])
            if stated and not size:
                raise ValueError(f"page 0 is empty before the total of {stated} is reached")
            pages = -(-stated // size) if size else 1
        return [PageRange(a, min(a + self.per, pages), pages, size, stated) for a in range(0, pages, self.per)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        for page in range(partition.first, partition.last):
            reply = self._page(page)
            records = reply[self.key]
            self._check(page, reply, len(records), partition)
            for record in records:
                yield tuple(None if (v := record.get(n)) is None else read(v) for n, read in zip(self.names, self.read_as, strict=True))

    def _check(self, page: int, reply: dict, found: int, of: PageRange) -> None:
        """Every page but the last is full, and the last has the rest; so all pages together have the total."""
        if self.total is not None and not found and page < of.pages - 1:
            raise ValueError(f"page {page} is empty before the total of {reply[self.total]} is reached")
        if of.stated is not None and of.size:
            due = min(of.size, of.stated - page * of.size)
            if found != due or int(reply[self.total]) != of.stated:
                raise ValueError(f"page {page} has {found} of {due} records, and the total is {reply[self.total]} after {of.stated}")

    def _page(self, page: int) -> dict:
        where = "&".join([*(self.forms["equals"].format(column=quote(k), value=quote(v)) for k, v in sorted(self.equal.items())), *self.where])
        envelope = ",".join(f"{x:.12g}" for x in self.box)
        url = self.url.replace("{page}", str(page)).replace("{where}", where).replace("{envelope}", envelope).replace("{columns}", ",".join(map(quote, self.names)))
        for left in range(self.tries - 1, -1, -1):
            try:
                with urlopen(url, timeout=self.timeout) as reply:
                    return json.load(reply)
            except (URLError, TimeoutError):
                if not left:
                    raise
                time.sleep(0.5 * (self.tries - left))
        raise AssertionError("tries is at least 1")


class FilteringReader(PagedReader):
    """A reader of a service that filters: its address has {where} or {envelope}."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Equalities and lists go into {where}; bounds of the place's columns into {envelope}, other bounds into {where}. Spark tests bounds again."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo) and name and "{where}" in self.url:
                self.equal[name] = str(f.value)
            elif isinstance(f, In) and name and "{where}" in self.url:
                self.where.append(self.forms["in"].format(column=quote(name), value=",".join(quote(str(v)) for v in f.value)))
            else:
                if type(f) in _COMPARED and name:
                    self._bound(name, _COMPARED[type(f)], f.value)
                yield f

    def _bound(self, name: str, kind: str, value) -> None:
        if name in self.place and "{envelope}" in self.url:
            axis, low = self.place.index(name), kind in ("gt", "gte")
            at = axis if low else axis + 2
            self.box[at] = max(self.box[at], float(value)) if low else min(self.box[at], float(value))
        elif "{where}" in self.url:
            self.where.append(self.forms[kind].format(column=quote(name), value=quote(str(value))))


def within_bounds(records: DataFrame, keys: DataFrame, columns: dict[str, str], margin: float = 0.0) -> DataFrame:
    """The records whose columns lie between the least and greatest of the key columns, so that a join asks a service only for what it can use.

    columns: record column -> key column. Two numbers a column reach the driver; keys without a
    value bound nothing and leave no records.
    """
    ends = keys.agg(*(f(k).alias(f"{c}_{n}") for c, k in columns.items() for n, f in (("low", F.min), ("high", F.max)))).first()
    for c in columns:
        low, high = ends[f"{c}_low"], ends[f"{c}_high"]
        records = records.where(F.lit(False)) if low is None else records.where((F.col(c) >= low - margin) & (F.col(c) <= high + margin))
    return records


class PagedSource(DataSource):
    """format("paged").

    Options: url with {page}, and where the service takes them {columns}, {where} and
    {envelope} (west,south,east,north); columns, comma-joined, each a name with or without a
    type, as in "id,lat double" (or give a schema of fewer); pages, or total, the key of a
    reply that holds the number of records; records, the key of the records; lon and lat,
    the columns that the envelope bounds; equals, in, gt, gte, lt, lte, the forms of
    comparisons in {where}; pagesPerPartition; tries; timeout in seconds. Filters are pushed
    where spark.sql.python.filterPushdown.enabled is set.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        parts = (c.strip().rpartition(" ") for c in self.options["columns"].split(","))
        return ", ".join(f"`{name}` {kind}" if name else f"`{kind}` string" for name, _, kind in parts)

    def reader(self, schema: StructType) -> PagedReader:
        kind = FilteringReader if "{where}" in self.options["url"] or "{envelope}" in self.options["url"] else PagedReader
        return kind(dict(self.options), schema.fieldNames(), [f.dataType.simpleString() for f in schema.fields])


def register(spark: SparkSession) -> None:
    """Makes format("paged") known to a session; its readers run on executors that need not have this package."""
    ship(spark)
    spark.dataSource.register(PagedSource)
