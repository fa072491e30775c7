"""Recorded pages of providers' reports as a Spark data source, read in one go or as a stream that resumes.

A folder has one folder per account, and in it one JSON file per page in the order
of their names: ``{"data": [...], "next": "the next page's name or null"}``, or
``{"error": ...}`` where the provider refused.  Each account is a partition of its own,
so one that fails leaves the others whole: its rows up to the failure come out, then
one row with the error.  Files are reached by pyarrow's file systems, so any store that these know will do.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "account string, page string, ordinal int, row string, error string"


def _store(path: str):
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def accounts_in(path: str) -> list[str]:
    from pyarrow import fs

    store, base = _store(path)
    return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.Directory)


def pages_in(path: str, account: str) -> list[str]:
    """The names of an account's pages in order; only the listing is read."""
    from pyarrow import fs

    store, base = _store(path)
    found = store.get_file_info(fs.FileSelector(f"{base}/{account}"))
    return sorted(f.base_name.removesuffix(".json") for f in found if f.type == fs.FileType.File and f.base_name.endswith(".json"))


def read_page(path: str, account: str, page: str) -> dict:
    store, base = _store(path)
    with store.open_input_stream(f"{base}/{account}/{page}.json") as f:
        return json.loads(f.read().decode())


class AccountPages(InputPartition):
    """Some pages of one account: all from a cursor on (``pages`` None), or a given list."""

    def __init__(self, account: str, cursor: str | None, pages: list[str] | None):
        self.account, self.cursor, self.pages = account, cursor, pages


def _rows(path: str, account: str, page: str, found: dict) -> Iterator[tuple]:
    for k, row in enumerate(found.get("data", [])):
        yield account, page, k, json.dumps(row, ensure_ascii=False), None
    if "error" in found:
        yield account, page, -1, None, json.dumps(found["error"], ensure_ascii=False)


def _read(path: str, partition: AccountPages) -> Iterator[tuple]:
    if partition.pages is not None:
        for page in partition.pages:
            yield from _rows(path, partition.account, page, read_page(path, partition.account, page))
        return
    page, seen = partition.cursor, set()
    while page is not None:
        if page in seen:  # a provider that points back would be read for ever
            yield partition.account, page, -1, None, json.dumps({"message": "the pages go in a circle"})
            return
        seen.add(page)
        try:
            found = read_page(path, partition.account, page)
        except FileNotFoundError:
            yield partition.account, page, -1, None, json.dumps({"message": "the page is missing"})
            return
        yield from _rows(path, partition.account, page, found)
        page = None if "error" in found else found.get("next")


class PageReader(DataSourceReader):
    """Follows each account's pages from its first one, or from the cursor that it is given."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.cursors = json.loads(options.get("cursors", "{}"))

    def partitions(self) -> list[AccountPages]:
        out = []
        for account in accounts_in(self.path):
            pages = pages_in(self.path, account)
            if pages and (cursor := self.cursors.get(account, pages[0])) is not None:
                out.append(AccountPages(account, cursor, None))
        return out or [AccountPages("", None, None)]

    def read(self, partition: AccountPages) -> Iterator[tuple]:
        yield from _read(self.path, partition)


class PageStreamReader(DataSourceStreamReader):
    """Pages as they are recorded; the offset is the last page taken of each account.

    A page that holds an error comes out as its row, and the pages recorded after it come out too: a new attempt is a new page.
    """

    def __init__(self, options: dict):
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {a: p[-1] for a in accounts_in(self.path) if (p := pages_in(self.path, a))}

    def partitions(self, start: dict, end: dict) -> list[AccountPages]:
        out = []
        for account, last in sorted(end.items()):
            first = start.get(account, "")
            if pages := [p for p in pages_in(self.path, account) if first < p <= last]:
                out.append(AccountPages(account, None, pages))
        return out

    def read(self, partition: AccountPages) -> Iterator[tuple]:
        yield from _read(self.path, partition)

    def commit(self, end: dict) -> None:
        """Nothing to release: recorded pages stay."""


class RecordedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))

    def streamReader(self, schema) -> PageStreamReader:
        return PageStreamReader(dict(self.options))


def recorded_pages(spark: SparkSession, path: str, cursors: dict | None = None) -> DataFrame:
    """All rows of all accounts, each as JSON, with rows for failures.  cursors: where to begin by account; None skips one."""
    spark.dataSource.register(RecordedPages)
    return spark.read.format("recorded_pages").option("cursors", json.dumps(cursors or {})).load(path)


def page_stream(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(RecordedPages)
    return spark.readStream.format("recorded_pages").option("path", path).load()
