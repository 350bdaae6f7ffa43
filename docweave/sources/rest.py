"""A reference library's local HTTP interface as a data source: spark.read.format("library").option("url", ...).option("route", ...)."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from urllib.parse import urlencode

from pyspark.sql.datasource import DataSource, DataSourceReader

PAGE = 100


def fetch(url: str, timeout: float = 8) -> str:
    """The body, without a proxy. RuntimeError says what went wrong."""
    try:
        with urllib.request.build_opener(urllib.request.ProxyHandler({})).open(url, timeout=timeout) as reply:
            return reply.read().decode()
    except urllib.error.HTTPError as e:
        told = {403: "the library does not allow it", 404: "the library has no such item"}
        raise RuntimeError(told.get(e.code, f"the library answered {e.code}")) from e
    except OSError as e:
        raise RuntimeError("the library is not running") from e


class LibrarySource(DataSource):
    """Rows of one column, value: each element of the JSON arrays that the route gives, page by page until one is short. Other
    options go into the query. The interface has no total, so the pages are read one after the other by one task."""

    @classmethod
    def name(cls) -> str:
        return "library"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return LibraryReader(dict(self.options))


class LibraryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.route = options.pop("url").rstrip("/"), options.pop("route", "items")
        options.pop("path", None)
        self.options = options

    def read(self, partition):
        start = 0
        while True:
            found = json.loads(fetch(f"{self.url}/{self.route}?{urlencode(self.options | {'limit': PAGE, 'start': start})}"))
            yield from ((json.dumps(x, ensure_ascii=False),) for x in found)
            start += len(found)
            if len(found) < PAGE:
                return
