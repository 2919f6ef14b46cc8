"""JSON pages of a service as a Spark data source: pages follow each other by token or are cut by a cursor of dates.

A fetch turns a request into a response. Here it reads files that hold the responses, so that pages recorded once can be
read again; a fetch over a network has the same shape. Each entity is a partition of its own and reads its pages one
after the other, with repeats after failures.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date, timedelta
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Answers of a service that are worth another try.
WORTH_RETRYING = frozenset({429, 500, 502, 503, 504})


class Failed(Exception):
    """A request that was answered with an error."""

    def __init__(self, status: int, text: str = "", after: float | None = None):
        super().__init__(f"{status} {text}".strip())
        self.status, self.after = status, after


@dataclass
class Retry:
    """How often a request is repeated and how long to wait: doubling from first to most, or what the service asks for."""

    times: int = 5
    first: float = 0.5
    most: float = 30.0
    sleep: Callable[[float], None] = field(default=time.sleep)

    def __call__(self, request: Callable[[], dict]) -> dict:
        for done in range(self.times + 1):
            try:
                return request()
            except Failed as e:
                if e.status not in WORTH_RETRYING or done == self.times:
                    raise
                self.sleep(min(self.most, e.after if e.after is not None else self.first * 2**done))
        raise AssertionError("unreachable")


@dataclass
class Throttle:
    """At least gap seconds between two requests of one process."""

    gap: float
    now: Callable[[], float] = field(default=time.monotonic)
    sleep: Callable[[float], None] = field(default=time.sleep)
    last: float | None = None

    def __call__(self) -> None:
        if self.last is not None and (wait := self.last + self.gap - self.now()) > 0:
            self.sleep(wait)
        self.last = self.now()


def token_pages(fetch: Callable[[dict], dict], request: dict, *, items: str, token: str, sends: str, retry: Retry | None = None) -> Iterator[dict]:
    """The items of all pages: each answer's token, until it has none, is sent with the next request. A token that comes again ends the pages."""
    retry, seen, asked = retry or Retry(), set(), dict(request)
    while True:
        answer = retry(lambda: fetch(asked))
        yield from answer.get(items) or []
        following = answer.get(token)
        if not following or following in seen:
            return
        seen.add(following)
        asked = request | {sends: following}


def cursor_pages(fetch: Callable[[dict], dict], request: dict, *, items: str, dated: str, limit: int, since: str, until: str, first: str, last: str, retry: Retry | None = None) -> Iterator[dict]:
    """The items between the days since and until of a service that gives the newest limit items up to a day.

    A full page means that there may be more: the next request ends with the oldest day of the page. Where a page holds
    but one day its other items can't be reached, and the next one ends a day earlier. Items that come again are left out.
    """
    retry, seen, end = retry or Retry(), set(), until
    while end >= since:
        asked = request | {first: since, last: end, "limit": limit}
        page = retry(lambda: fetch(asked)).get(items) or []
        for item in page:
            text = json.dumps(item, sort_keys=True)
            if text not in seen:
                seen.add(text)
                yield item
        if len(page) < limit:
            return
        oldest = min(str(i[dated])[:10] for i in page)
        end = oldest if oldest < end else (date.fromisoformat(end) - timedelta(days=1)).isoformat()


def recorded(folder: str) -> Callable[[dict], dict]:
    """A fetch over files: the answer to a request is the file named by its parameters in order. A file that holds a status other than 200 fails."""

    def fetch(request: dict) -> dict:
        name = "&".join(f"{k}={quote(str(v), safe='')}" for k, v in sorted(request.items()))
        path = os.path.join(folder, f"{name}.json")
        if not os.path.exists(path):
            raise Failed(404, name)
        with open(path) as f:
            answer = json.load(f)
        if answer.get("status", 200) != 200:
            raise Failed(int(answer["status"]))
        return answer

    return fetch


class _Entity(InputPartition):
    def __init__(self, name: str):
        self.name = name


class PagedJson(DataSource):
    """format tidewell_pages: entity and item (JSON text) of each item of all pages of the entities.

    Options: path (folder of recorded answers), entities (comma separated), by (the parameter that names one), items, and
    either token and sends, or dated, limit, since, until, first and last.
    """

    @classmethod
    def name(cls) -> str:
        return "tidewell_pages"

    def schema(self) -> str:
        return "entity string, item string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(dict(self.options))


class _PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Entity(e) for e in self.options["entities"].split(",") if e]

    def read(self, partition: _Entity) -> Iterator[tuple[str, str]]:
        o = self.options
        request = {o.get("by", "symbol"): partition.name}
        fetch = recorded(o["path"])
        if "token" in o:
            pages = token_pages(fetch, request, items=o["items"], token=o["token"], sends=o["sends"])
        else:
            pages = cursor_pages(fetch, request, items=o["items"], dated=o["dated"], limit=int(o["limit"]), since=o["since"], until=o["until"], first=o["first"], last=o["last"])
        for item in pages:
            yield partition.name, json.dumps(item)


def paged_table(spark: SparkSession, path: str, entities: list[str], **options: str) -> DataFrame:
    """The items of all pages of the entities, each entity in a task of its own; nothing passes the driver."""
    spark.dataSource.register(PagedJson)
    return spark.read.format("tidewell_pages").options(path=path, entities=",".join(entities), **options).load()
