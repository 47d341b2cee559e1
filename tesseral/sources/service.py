"""Events of a catalogue service, one request per time window, fetched in tasks.

    spark.dataSource.register(EventService)
    spark.read.format("event_service").options(url=..., start="2010-01-01", end="2024-01-01", days="90", minmagnitude="3.0").load()

Options: `url`; `start` and `end` (ISO dates or times, UTC); `days`, the width of a
window; `timeout` in seconds; all others are sent as they are.  Names are not
case-sensitive, so parameters are sent in lower case.

A service's bounds are closed, so an event at a window's end comes twice: rows
are kept from a window's start to before its end, those of the last window to
its end.  A row whose time can't be read is kept.  A status other than success,
an answer without the catalogue's columns or a timeout fails the task, which Spark
repeats; a request has no side effects.  Rows are parsed as they arrive, and
nothing passes through the driver.
"""

from __future__ import annotations

import csv
import io
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tesseral.operators.ingest import CATALOGUE_COLUMNS

TIMEOUT = 30
WINDOW_DAYS = 365.0
OWN_OPTIONS = ("url", "start", "end", "days", "timeout", "path")


def utc(text: str) -> datetime:
    """An ISO date or time; one without an offset is UTC."""
    t = datetime.fromisoformat(text.strip())
    return t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)


@dataclass
class TimeWindow(InputPartition):
    start: datetime
    end: datetime
    last: bool

    def holds(self, text: str | None) -> bool:
        try:
            t = utc(text or "")
        except ValueError:
            return True
        return self.start <= t and (t < self.end or self.last and t == self.end)


def time_windows(start: datetime, end: datetime, days: float) -> list[TimeWindow]:
    """Windows of the given width from start to end, the last one shorter; one for start = end."""
    if end < start or days <= 0:
        raise ValueError("the period must not end before it starts, and windows need a positive width")
    width, bounds = timedelta(days=days), [start]
    while bounds[-1] + width < end:
        bounds.append(bounds[-1] + width)
    ends = [*bounds[1:], end]
    return [TimeWindow(a, b, b is end) for a, b in zip(bounds, ends, strict=True)]


class EventReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        given = {k.lower(): v for k, v in options.items()}
        missing = [k for k in ("url", "start", "end") if k not in given]
        if missing:
            raise ValueError(f"options missing: {', '.join(missing)}")
        self.url, self.timeout = given["url"], float(given.get("timeout", TIMEOUT))
        self.windows = time_windows(utc(given["start"]), utc(given["end"]), float(given.get("days", WINDOW_DAYS)))
        self.params = {k: v for k, v in given.items() if k not in OWN_OPTIONS}

    def partitions(self) -> list[TimeWindow]:
        return self.windows

    def read(self, partition: TimeWindow) -> Iterator[tuple]:
        form = lambda t: t.strftime("%Y-%m-%dT%H:%M:%S.%f")
        sent = {"format": "csv", **self.params, "starttime": form(partition.start), "endtime": form(partition.end)}
        address = f"{self.url}?{urllib.parse.urlencode(sent)}"
        try:
            answer = urllib.request.urlopen(address, timeout=self.timeout)
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"{address}: HTTP status {e.code}") from e
        with answer:
            # No content is the protocol's answer where no event fits.
            if answer.status == 204:
                return
            rows = csv.DictReader(io.TextIOWrapper(answer, encoding="utf-8", newline=""))
            missing = [c for c in CATALOGUE_COLUMNS if c not in (rows.fieldnames or ())]
            if missing:
                raise ValueError(f"{address}: no columns {', '.join(missing)}")
            for row in rows:
                if partition.holds(row["time"]):
                    yield tuple(row[c] or None for c in CATALOGUE_COLUMNS)


class EventService(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_service"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in CATALOGUE_COLUMNS)

    def reader(self, schema: StructType) -> DataSourceReader:
        return EventReader(dict(self.options))


def fetch_events(spark: SparkSession, url: str, params: dict[str, str], days: float = WINDOW_DAYS, timeout: float = TIMEOUT) -> DataFrame:
    """Raw events for a service's query parameters (catalogue.request_params()), a
    task per window of `days`."""
    rest = {k: v for k, v in params.items() if k not in ("starttime", "endtime")}
    own = {"url": url, "start": params["starttime"], "end": params["endtime"], "days": str(days), "timeout": str(timeout)}
    spark.dataSource.register(EventService)
    return spark.read.format(EventService.name()).options(**rest, **own).load()
