"""Site adapters as a data source: spark.read.format("sites") over stored pages.

An adapter says which hosts are its own, which of their pages are index pages, and what it reads from an index page (list)
and from a listing's page (detail). Pages are stored as Parquet (url, html), by whatever fetches them. A partition is one
adapter over some row groups of a file, so a large store is read by many tasks and no task holds more than a row group.
What an adapter can't read becomes a row with its error, and the others go on. Null addresses have no host, and so no
adapter but the fallback's, which takes every host that no other adapter has; a null page can't be read and says so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = "source string, kind string, url string, ref string, title string, about array<string>, error string"
_ARROW = pa.schema([(n, pa.list_(pa.string()) if n == "about" else pa.string()) for n in ("source", "kind", "url", "ref", "title", "about", "error")])


@dataclass(frozen=True)
class Adapter:
    """The usual reading; sites that differ override a method. Hosts include what is under them."""

    id: str
    hosts: tuple[str, ...] = ()
    #: A page with so many links is an index page.
    index_links: int = 6

    def links(self, html: str) -> list[str]:
        return list(dict.fromkeys(re.findall(r'<a\s[^>]*href="([^"]*)"', html)))

    def is_index(self, url: str, html: str) -> bool:
        return len(self.links(html)) >= self.index_links

    def ref(self, url: str) -> str | None:
        found = re.search(r"/(\d+)(?:[?#]|$)", url)
        return found and found[1]

    def title(self, html: str) -> str:
        found = re.search(r"<title[^>]*>([^<]*)</title>", html)
        if not found or not found[1].strip(" "):
            raise ValueError("no title")
        return found[1].strip(" ")

    def list(self, url: str, html: str) -> dict:
        return {"title": self.title(html), "about": self.links(html)}

    def detail(self, url: str, html: str) -> dict:
        return {"title": self.title(html), "about": re.findall(r'<meta\s[^>]*content="([^"]*)"', html)}


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


@dataclass
class _Part(InputPartition):
    adapter: str
    file: str
    groups: tuple[int, ...]


class SiteReader(DataSourceReader):
    def __init__(self, path: str, adapters: dict[str, Adapter], wanted: list[str], groups: int):
        self.path, self.adapters, self.wanted, self.groups = path, adapters, wanted, groups

    def partitions(self) -> list[_Part]:
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        info = store.get_file_info(root)
        files = [root] if info.type == fs.FileType.File else sorted(f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.path.endswith(".parquet"))
        parts = []
        for file in files:
            with store.open_input_file(file) as opened:
                count = pq.ParquetFile(opened).metadata.num_row_groups
            parts += [_Part(a, file, tuple(range(at, min(count, at + self.groups)))) for a in self.wanted for at in range(0, count, self.groups)]
        return parts

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        adapter, others = self.adapters[partition.adapter], [h for a in self.adapters.values() for h in a.hosts]
        under = lambda host, hosts: any(host == h or host.endswith(f".{h}") for h in hosts)
        with store.open_input_file(partition.file) as opened:
            file = pq.ParquetFile(opened)
            for group in partition.groups:
                table = file.read_row_group(group, columns=["url", "html"])
                rows = []
                for url, html in zip(table.column("url").to_pylist(), table.column("html").to_pylist()):
                    host = host_of(url)
                    if under(host, adapter.hosts) if adapter.hosts else not under(host, others):
                        rows.append(self._row(adapter, url, html))
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    @staticmethod
    def _row(adapter: Adapter, url: str | None, html: str | None) -> dict:
        row = {"source": adapter.id, "kind": None, "url": url, "ref": None, "title": None, "about": None, "error": None}
        try:
            if html is None:
                raise ValueError("no page")
            row["ref"] = adapter.ref(url or "")
            row["kind"] = "list" if adapter.is_index(url or "", html) else "detail"
            return row | (adapter.list if row["kind"] == "list" else adapter.detail)(url or "", html)
        except Exception as failure:  # an adapter's fault is a row of the result
            return row | {"error": f"{type(failure).__name__}: {failure}"}


def site_source(adapters: list[Adapter]) -> type[DataSource]:
    """The data source of these adapters; options: path, sources (comma-separated; all by default), groups (row groups of a
    partition, 4 by default)."""
    known = {a.id: a for a in adapters}

    class Sites(DataSource):
        @classmethod
        def name(cls) -> str:
            return "sites"

        def schema(self) -> str:
            return ROWS

        def reader(self, schema) -> SiteReader:
            wanted = [s for s in self.options.get("sources", "").split(",") if s] or list(known)
            unknown = set(wanted) - set(known)
            if unknown:
                raise ValueError(f"no adapter for {', '.join(sorted(unknown))}")
            return SiteReader(self.options["path"], known, wanted, int(self.options.get("groups", "4")))

    return Sites


def register(spark: SparkSession, adapters: list[Adapter]) -> None:
    """Makes format("sites") read by these adapters in the session."""
    spark.dataSource.register(site_source(adapters))
