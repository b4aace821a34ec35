"""Directories as a table.

A Python data source, since Spark's own file index drops names that begin with _ or a dot,
which are ordinary photo names.  Folders are opened level by level until there are enough
for the tasks; each is then one partition.  Roots in a store (with a scheme, as in hdfs://) are
listed by the driver through the store's own file system.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import dims
from .containers import file_facts

SCHEMA = "path string, dir string, name string, ext string, size long, mtime timestamp"
FACTS = ", hash string, tags map<string, string>"
_MEDIA = frozenset(dims.IMAGE_EXTENSIONS + dims.VIDEO_EXTENSIONS)
_STORE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]+:/")


def skipped(name: str, no_exclude: bool, include_hidden: bool) -> bool:
    """A04"""
    if no_exclude:
        return False
    return name.lower() in dims.EXCLUDED_DIRS or (name[:1] in (".", "$") and not include_hidden)


def normal(root: str) -> str:
    """A root as the paths below it begin."""
    return root.rstrip("/") if _STORE.match(root) else os.path.normpath(root)


def _outermost(roots: list[str], sep: str) -> list[str]:
    """A folder under two roots is read once."""
    return [r for r in dict.fromkeys(roots) if not any(r != o and r.startswith(o + sep) for o in roots)]


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.roots = [normal(r) for r in options.get("roots", options.get("path", "")).split(os.pathsep) if r]
        self.no_exclude = options.get("noexclude", "false").lower() == "true"
        self.include_hidden = options.get("includehidden", "false").lower() == "true"
        self.every_file = options.get("everyfile", "false").lower() == "true"
        self.facts = options.get("facts", "false").lower() == "true"
        self.enough = int(options.get("folders", "256"))

    def partitions(self):
        level = [r for r in _outermost(self.roots, os.sep) if os.path.isdir(r)]
        opened: list[str] = []
        while level and len(opened) + len(level) < self.enough:
            below = []
            for folder in level:
                try:
                    with os.scandir(folder) as entries:
                        below += [e.path for e in sorted(entries, key=lambda e: e.name) if e.is_dir(follow_symlinks=False) and not skipped(e.name, self.no_exclude, self.include_hidden)]
                except OSError:
                    pass  # gone or closed to us: its task finds nothing
            opened += level
            level = below
        return [Folder(f, False) for f in opened] + [Folder(f, True) for f in level]

    def read(self, partition) -> Iterator[tuple]:
        for top, folders, names in os.walk(partition.path):
            folders[:] = sorted(d for d in folders if partition.deep and not skipped(d, self.no_exclude, self.include_hidden))
            for name in sorted(names):
                ext = os.path.splitext(name)[1].lower()
                if not self.every_file and ext not in _MEDIA:
                    continue
                path = os.path.join(top, name)
                try:
                    stat = os.stat(path)
                except OSError:
                    continue  # gone since it was listed
                row = path, top, name, ext, stat.st_size, datetime.fromtimestamp(stat.st_mtime, timezone.utc)
                yield (*row, *file_facts(path, stat.st_size, ext in dims.VIDEO_EXTENSIONS)) if self.facts else row


class MediaSource(DataSource):
    """spark.read.format("media").option("roots", ...).load()"""

    @classmethod
    def name(cls) -> str:
        return "media"

    def schema(self) -> str:
        return SCHEMA + FACTS * (self.options.get("facts", "false").lower() == "true")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def _listed(spark: SparkSession, roots: list[str], no_exclude: bool, include_hidden: bool, every_file: bool) -> Iterator[tuple]:
    """The files of a store's folders."""
    for root in _outermost(roots, "/"):
        place = spark._jvm.org.apache.hadoop.fs.Path(root)
        store = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        level = [(root, place)] if store.exists(place) and store.getFileStatus(place).isDirectory() else []
        while level:
            top, place = level.pop()
            for found in store.listStatus(place):
                name = found.getPath().getName()
                path = f"{top}/{name}"
                if found.isDirectory():
                    level += [(path, found.getPath())] * (not skipped(name, no_exclude, include_hidden))
                elif every_file or os.path.splitext(name)[1].lower() in _MEDIA:
                    yield path, top, name, os.path.splitext(name)[1].lower(), found.getLen(), datetime.fromtimestamp(found.getModificationTime() / 1000, timezone.utc)


def scan(spark: SparkSession, *roots: str, no_exclude: bool = False, include_hidden: bool = False, every_file: bool = False, facts: bool = False, folders: int = 256):
    """Roots that are missing give no rows.  Folders without a scheme must be visible to the
    executors.  facts adds the sampled hash and the tags, for which the reader seeks in each file,
    so it takes no store; folders says how many to open into partitions at least, where there
    are so many."""
    stores = [normal(r) for r in roots if _STORE.match(r)]
    if stores and facts:
        raise ValueError(f"facts need folders that the tasks can open, not {stores[0]}")
    listed = spark.createDataFrame(list(_listed(spark, stores, no_exclude, include_hidden, every_file)), SCHEMA) if stores else None
    if len(stores) == len(roots) and stores:
        return listed
    spark.dataSource.register(MediaSource)
    options = {"roots": os.pathsep.join(r for r in roots if not _STORE.match(r)), "noExclude": str(no_exclude), "includeHidden": str(include_hidden), "everyFile": str(every_file), "facts": str(facts), "folders": str(folders)}
    found = spark.read.format("media").options(**options).load()
    return found.unionByName(listed) if stores else found
