"""The ``srctree`` data source: files of a source tree, with names that begin with '_' or '.' too."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

EXCLUDED = (".git", "__pycache__", "node_modules", "dist", "build", ".venv", "venv", ".mypy_cache", ".pytest_cache", "*.pyc", "*.min.js")
_GROUP_BYTES = 32 << 20


def excluded(relative: str, patterns) -> bool:
    """A leading * tests the end of the path; anything else is a path segment."""
    parts = relative.split("/")
    return any(relative.endswith(p[1:]) if p.startswith("*") else p in parts for p in patterns)


class _Files(InputPartition):
    def __init__(self, paths):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.patterns = tuple(x for x in options.get("exclude", ",".join(EXCLUDED)).split(",") if x)
        self.extensions = tuple("." + x.lower().lstrip(".") for x in options.get("exclude_ext", "").split(",") if x)

    def partitions(self):
        groups, now, size = [], [], 0
        for folder, dirs, files in os.walk(self.root):
            rel = os.path.relpath(folder, self.root)
            rel = "" if rel == "." else rel.replace(os.sep, "/") + "/"
            dirs[:] = sorted(d for d in dirs if not excluded(rel + d, self.patterns))
            for name in sorted(files):
                if not excluded(rel + name, self.patterns) and not name.lower().endswith(self.extensions or ("\0",)):
                    now.append(rel + name)
                    size += os.path.getsize(os.path.join(folder, name))
                    if size >= _GROUP_BYTES:
                        groups.append(_Files(now))
                        now, size = [], 0
        return groups + ([_Files(now)] if now else [])

    def read(self, partition):
        for rel in partition.paths if partition else ():
            full = os.path.join(self.root, rel)
            try:
                with open(full, "rb") as f:
                    yield rel, f.read(), os.path.getmtime(full)
            except OSError:
                yield rel, None, None


class SourceTree(DataSource):
    @classmethod
    def name(cls):
        return "srctree"

    def schema(self):
        return "path string, content binary, mtime double"

    def reader(self, schema):
        return _Reader(self.options)


def read_tree(spark: SparkSession, root: str, exclude=EXCLUDED, exclude_ext=()) -> DataFrame:
    spark.dataSource.register(SourceTree)
    return spark.read.format("srctree").option("path", root).option("exclude", ",".join(exclude)).option("exclude_ext", ",".join(exclude_ext)).load()
