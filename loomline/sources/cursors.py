"""Durable cursors of incremental runs: captured before the harvest, committed after it in one rename.

A run works on [since, until): ``until`` is when it began, so rows that arrive while it works are the next run's. A run that
raises or dies commits nothing, and the next one gets its rows again; a run that finds nothing commits all the same, so
that no window is looked at for ever. Of two runs at a time, the one that commits last raises CommitConflict.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.sources.commits import commit, commits


@dataclass(frozen=True)
class Window:
    """The run's number and its window; ``since`` is part of it, ``until`` is not."""

    number: int
    since: datetime
    until: datetime

    def holds(self, at: Column) -> Column:
        return (at >= F.lit(self.since)) & (at < F.lit(self.until))

    def of(self, rows: DataFrame, at: str = "modified") -> DataFrame:
        """The rows of the window; the bounds are literals, so that they reach the scan. A null time is in no window."""
        return rows.where(self.holds(F.col(at)))


def last(spark: SparkSession, path: str) -> tuple[int, datetime | None]:
    """Number and end of the last committed run; 0 and None before the first."""
    done = commits(spark, path)
    number = max(done, default=0)
    return number, datetime.fromisoformat(done[number]["until"]) if number else None


@contextmanager
def run(spark: SparkSession, path: str, now: datetime, first: datetime) -> Iterator[Window]:
    """The window of a run that begins ``now``; the first run begins at ``first``. Commits when the block ends well.

    A clock that went back gives an empty window and leaves the cursor where it is.
    """
    number, until = last(spark, path)
    since = first if until is None else until
    window = Window(number + 1, since, max(now, since))
    yield window
    commit(spark, path, window.number, {"since": window.since.isoformat(), "until": window.until.isoformat()})
