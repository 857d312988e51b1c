"""Feed adapter: a user's feed as a Spark data source, read in batches or as a stream.

A feed names its boards with their newest version and fetches one version of one board. Both readers give rows of ``schema.RAW``, one
a board, so everything from ``isolate`` on works as with landed payloads. Boards are fetched inside tasks, ``boardsPerTask`` at a time
(the feed's ``per_task``, or more where that would make over 1,024 tasks); a board whose fetch fails gives a row with its error and harms no other.

As a stream, an offset holds the version of each board, and a batch reads the boards whose version has changed, at exactly the
version of its end: a replayed batch asks for the same payloads. Of several versions between two batches the newest counts, as
everywhere in a run. A board that the feed no longer names is left out and comes back when it is named again with a new version."""
from __future__ import annotations

import os
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import unquote

from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from vacantia.session import wide

_DDL = "source string, board string, board_ord int, fetched_at timestamp, ok boolean, error string, payload string"


class Boards(InputPartition):
    """(board, position among the boards, version) of what one task fetches."""

    def __init__(self, boards: list[tuple[str, int, int]]):
        self.boards = boards


class BoardFeed(DataSource):
    """Subclass with ``name``, ``versions`` and ``fetch``; options are in ``self.options``."""

    #: Boards of a task: a fetch is taken to be slow beside the start of a task.
    per_task = 16

    def versions(self) -> dict[str, int]:
        """Boards in feed order with the time of their newest version (milliseconds since 1970). Runs on the driver."""
        raise NotImplementedError

    def fetch(self, board: str, version: int) -> str:
        """Payload of one version of a board. Runs in a task; what it raises is kept as that board's error."""
        raise NotImplementedError

    def label(self, board: str) -> str:
        """The board's name in the rows, where the feed knows it by another."""
        return board

    def schema(self) -> str:
        return _DDL

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self)


def _dealt(feed: BoardFeed, boards: list[tuple[str, int, int]]) -> list[Boards]:
    size = int(feed.options.get("boardsPerTask") or max(feed.per_task, -(-len(boards) // 1024)))
    return [Boards(boards[i : i + size]) for i in range(0, len(boards), size)]


def _fetched(feed: BoardFeed, partition: Boards) -> Iterator[tuple]:
    for board, place, version in partition.boards:
        payload, error = None, None
        try:
            payload = feed.fetch(board, version)
        except Exception as exc:  # the feed's own failure is data: it stays with the board
            error = f"{type(exc).__name__}: {exc}"
        at = datetime.fromtimestamp(version / 1000, timezone.utc)
        yield feed.name(), feed.label(board), place, at, error is None, error, payload


class _Batch(DataSourceReader):
    def __init__(self, feed: BoardFeed):
        self.feed = feed

    def partitions(self) -> list[Boards]:
        return _dealt(self.feed, [(b, i, v) for i, (b, v) in enumerate(self.feed.versions().items())])

    def read(self, partition: Boards) -> Iterator[tuple]:
        # A feed without boards still has one, empty, task.
        return _fetched(self.feed, partition) if isinstance(partition, Boards) else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, feed: BoardFeed):
        self.feed = feed

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {b: [i, v] for i, (b, v) in enumerate(self.feed.versions().items())}

    def partitions(self, start: dict, end: dict) -> list[Boards]:
        return _dealt(self.feed, [(b, i, v) for b, (i, v) in end.items() if start.get(b, [None, None])[1] != v])

    def read(self, partition: Boards) -> Iterator[tuple]:
        return _fetched(self.feed, partition)

    def commit(self, end: dict) -> None:
        """Versions are kept by whoever lands them."""


def _opened(path: str) -> tuple[FileSystem, str]:
    """File system and path of a folder given as a path or an address."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return FileSystem.from_uri(path)


def _folder(name: str, value: object) -> str:
    """A folder's name as ``partitionBy`` gives it."""
    text = "" if value is None else re.sub(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", str(value))
    return f"{name}={text or '__HIVE_DEFAULT_PARTITION__'}"


def land_payloads(df: DataFrame, path: str) -> None:
    """Rows (value, fetched_ms, board), one for each board and version, as ``FolderFeed`` reads them.

    With a file a board the cost is that of making files: tasks, dealt by number, write them where they stay, without a checksum file
    and without a second move by the driver. A file appears whole, and one that a task writes again replaces itself."""
    def write(rows: Iterator[Row]) -> None:
        system, top = _opened(path)
        for row in rows:
            folder = f"{top}/{_folder('fetched_ms', row.fetched_ms)}/{_folder('board', row.board)}"
            system.create_dir(folder, recursive=True)
            hidden = f"{folder}/.{os.urandom(6).hex()}"
            with system.open_output_stream(hidden) as out:
                out.write(f"{row.value or ''}\n".encode())
            system.move(hidden, f"{folder}/part-00000.txt")

    df.repartition(wide(df.sparkSession), "board").foreachPartition(write)


class FolderFeed(BoardFeed):
    """Payloads in a shared folder, as ``land_payloads`` or ``df.write.partitionBy("fetched_ms", "board").text(path)`` lays them down: option ``path``.

    A payload may have several lines and lie in several files, which are joined in the order of their names. Boards are read in the
    order of their folders' names."""

    #: Reading a small file costs a thousandth of starting a task and writing its output.
    per_task = 1024

    @classmethod
    def name(cls) -> str:
        return "board_folder"

    def versions(self) -> dict[str, int]:
        system, path = _opened(self.options["path"])
        newest: dict[str, int] = {}
        for when in system.get_file_info(FileSelector(path)):
            if when.base_name.startswith("fetched_ms="):
                version = int(when.base_name.split("=", 1)[1])
                for board in system.get_file_info(FileSelector(when.path)):
                    if board.base_name.startswith("board="):
                        newest[board.base_name] = max(version, newest.get(board.base_name, version))
        return dict(sorted(newest.items()))

    def label(self, board: str) -> str:
        return unquote(board[len("board="):])

    def fetch(self, board: str, version: int) -> str:
        system, path = _opened(self.options["path"])
        found = system.get_file_info(FileSelector(f"{path}/fetched_ms={version}/{board}"))
        files = sorted(f.path for f in found if f.is_file and not f.base_name.startswith((".", "_")))
        if not files:
            raise FileNotFoundError(f"no payload of {self.label(board)}")
        out = []
        for name in files:
            with system.open_input_stream(name) as lines:
                out.append(lines.read().decode("utf-8"))
        return "".join(out)
