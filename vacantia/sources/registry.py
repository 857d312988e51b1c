"""Feed settings and the registry of feed readers."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.operators.boards import cap_per_board
from vacantia.schema import BOARD_SOURCES, SCRAPED_SOURCES, SOURCES
from vacantia.sources import feeds as _feeds


@dataclass(frozen=True)
class FeedSettings:
    enabled: bool = False
    limit: int | None = None  # rows per board; all of them by default
    boards: tuple[str, ...] = ()


@dataclass
class Landing:
    """Landed inputs of one run."""

    raw: DataFrame
    details: DataFrame | None = None  # workday posting pages
    meta: DataFrame | None = None  # board display names
    tabular: dict[str, DataFrame] | None = None  # scraped boards


# A reader maps (landing, settings, now) to postings; users may register their own feed.
Reader = Callable[[Landing, FeedSettings, "Column"], DataFrame]  # noqa: F821
READERS: dict[str, Reader] = {
    "greenhouse": lambda l, s, now: _feeds.read_greenhouse(l.raw, l.meta, s.limit),
    "lever": lambda l, s, now: _feeds.read_lever(l.raw, s.limit),
    "ashby": lambda l, s, now: _feeds.read_ashby(l.raw, s.limit),
    "workday": lambda l, s, now: _feeds.read_workday(l.raw, l.details, now, s.limit),
}


def register_feed(name: str, reader: Reader) -> None:
    READERS[name] = reader


def enabled_feeds(settings: dict[str, FeedSettings]) -> list[tuple[str, FeedSettings]]:
    """Enabled feeds in run order; board feeds without boards are skipped."""
    names = [n for n in SOURCES if n in settings] + [n for n in settings if n not in SOURCES]
    return [(n, settings[n]) for n in names
            if settings[n].enabled and not (n in BOARD_SOURCES and not settings[n].boards)]


def feed_table(spark: SparkSession, settings: dict[str, FeedSettings]) -> DataFrame:
    """(source, source_ord, is_scraped) of the enabled feeds."""
    rows = [(n, i, n in SCRAPED_SOURCES) for i, (n, _) in enumerate(enabled_feeds(settings))]
    return spark.createDataFrame(rows, "source string, source_ord int, is_scraped boolean")


def board_table(spark: SparkSession, settings: dict[str, FeedSettings]) -> DataFrame:
    """(source, board, board_ord) of the enabled board feeds."""
    rows = [(n, b, i) for n, s in enabled_feeds(settings) for i, b in enumerate(s.boards)]
    return spark.createDataFrame(rows, "source string, board string, board_ord int")


def read_feeds(landing: Landing, settings: dict[str, FeedSettings], now,
               wanted: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame | None:
    """Postings of all enabled feeds. ``landing.raw`` must have passed ``isolate``.

    Of scraped rows only those that ``wanted`` keeps are read; a limit counts what is left, so it never hides a wanted row
    behind others."""
    out = []
    for name, feed in enabled_feeds(settings):
        if name in READERS:
            out.append(READERS[name](landing, feed, now))
        elif name in SCRAPED_SOURCES and landing.tabular and name in landing.tabular:
            rows = _feeds.read_board_rows(landing.tabular[name], name)
            rows = rows if wanted is None else wanted(rows)
            if feed.limit is not None:
                rows = cap_per_board(rows.withColumn("board", F.col("source")), feed.limit).drop("board")
            out.append(rows)
    return _feeds.union_feeds(*out) if out else None
