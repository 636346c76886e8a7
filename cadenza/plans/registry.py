"""Registered queries: a name, a function over views, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.tables import scratch  # noqa: F401  for the modules of queries
from ..sources.buckets import files_at
from .views import view, with_views


_STORED: dict[tuple, str] = {}


def stored_once(df: DataFrame, name: str, write: Callable[[str], object]) -> str:
    """The folder of an index over ``df`` that ``write`` makes at the first call of a session, and again if a file that ``df`` reads has changed."""
    spark, files = df.sparkSession, []
    for f in sorted(df.inputFiles()):
        fs, at = files_at(spark, f)
        status = fs.getFileStatus(at)
        files.append((f, status.getModificationTime(), status.getLen()))
    key = (spark.sparkContext.applicationId, name, *files)
    if key not in _STORED:
        folder = scratch(spark, name)
        write(folder)
        _STORED[key] = folder
    return _STORED[key]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None, **extra: str) -> Callable:
        """Register a function of ``v``, which gives a view or table by name; ``extra`` are more views of the SQL."""

        def add(work: Callable) -> Callable:
            self.queries[name] = lambda spark, sf_dir: work(lambda n: view(spark, sf_dir, n))
            if sql is not None:
                self.sql[name] = with_views(sql, extra)
            return work

        return add
