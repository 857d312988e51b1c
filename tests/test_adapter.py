"""The feed adapter: batch and stream, boards that fail, versions."""
import pytest
from pyspark.sql import functions as F

from vacantia.sources import feeds
from vacantia.sources.adapter import BoardFeed, FolderFeed, land_payloads


class Shelf(BoardFeed):
    """Boards and versions from an option; board ``down`` cannot be fetched."""

    @classmethod
    def name(cls):
        return "shelf"

    def versions(self):
        return {b: int(v) for b, v in (x.split(":") for x in self.options["boards"].split(",") if x)}

    def fetch(self, board, version):
        if board == "down":
            raise OSError("no route")
        return f'[{{"id": "{board}-{version}", "text": "Potter"}}]'


@pytest.mark.parametrize("size", ["1", "2", "100"])
def test_a_failing_board_stays_alone(spark, size):
    spark.dataSource.register(Shelf)
    raw = spark.read.format("shelf").option("boards", "b:5,down:6,a:7").option("boardsPerTask", size).load()
    assert raw.rdd.getNumPartitions() == -(-3 // int(size))
    rows = {r["board"]: r for r in feeds.isolate(raw.withColumn("source", F.lit("lever"))).collect()}
    assert [rows[b]["board_ord"] for b in ("b", "down", "a")] == [0, 1, 2]
    assert (rows["down"]["ok"], rows["down"]["error"], rows["down"]["payload"]) == (False, "OSError: no route", None)
    assert rows["a"]["ok"] and rows["a"]["error"] is None and '"a-7"' in rows["a"]["payload"]


def test_no_boards(spark):
    spark.dataSource.register(Shelf)
    assert spark.read.format("shelf").option("boards", "").load().count() == 0


def test_stream_reads_changed_boards_once_and_goes_on_after_a_restart(spark, tmp_path):
    spark.dataSource.register(Shelf)
    out, at = str(tmp_path / "out"), str(tmp_path / "at")
    for boards in ("", "a:1,b:1", "a:1,b:1", "a:1,b:3,down:2", "b:3,c:4", "a:1,b:3,c:4"):
        stream = spark.readStream.format("shelf").option("boards", boards).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["board"], r["ms"], r["ok"]) for r in spark.read.parquet(out).withColumn("ms", F.unix_millis("fetched_at")).collect())
    assert set(got) == {("a", 1, True), ("b", 1, True), ("b", 3, True), ("c", 4, True), ("down", 2, False)}
    assert [g for g in got if g[0] != "a"] == sorted(set(g for g in got if g[0] != "a"))


def test_folder_of_payloads(spark, tmp_path):
    path = str(tmp_path / "boards")
    rows = [(1, "a b/ü", "[1"), (1, "a b/ü", ",2]"), (2, "x=%", "{}"), (1, "x=%", "old")]
    spark.createDataFrame(rows, "fetched_ms long, board string, value string").coalesce(1).write.partitionBy("fetched_ms", "board").text(path)
    (tmp_path / "boards" / "fetched_ms=3" / "board=empty").mkdir(parents=True)
    spark.dataSource.register(FolderFeed)
    got = {r["board"]: r for r in spark.read.format("board_folder").option("path", path).load().collect()}
    assert got["a b/ü"]["payload"].split() == ["[1", ",2]"] and got["x=%"]["payload"] == "{}\n"
    assert (got["empty"]["ok"], got["empty"]["error"]) == (False, "FileNotFoundError: no payload of empty")


def test_payloads_landed_by_tasks_lie_as_spark_writes_them(spark, tmp_path):
    rows = [(1, "a b/ü", "[1]"), (2, "a b/ü", "[2]"), (1, "x=%", "{}"), (1, "q:'*?\\\"#{[]^\x01~", "y"), (1, None, "z"), (1, "none", None)]
    df = spark.createDataFrame(rows, "fetched_ms long, board string, value string")
    mine, plain = str(tmp_path / "mine"), str(tmp_path / "plain")
    for _ in range(2):  # what is landed again replaces itself
        land_payloads(df, mine)
    df.write.partitionBy("fetched_ms", "board").text(plain)
    spark.dataSource.register(FolderFeed)
    got, want = (sorted(map(tuple, spark.read.format("board_folder").option("path", p).load().collect())) for p in (mine, plain))
    assert got == want and len(got) == 5


def test_tasks_of_many_boards_are_bounded(spark):
    from vacantia.sources.adapter import _dealt

    for boards in (0, 1, 17, 16_385, 120_000):
        tasks = _dealt(Shelf({}), [(str(i), i, 1) for i in range(boards)])
        assert len(tasks) <= 1024 and [b for t in tasks for b, _, _ in t.boards] == [str(i) for i in range(boards)]
        assert all(len(t.boards) <= max(16, -(-boards // 1024)) for t in tasks)


def test_tasks_of_a_folder_read_many_boards():
    from vacantia.sources.adapter import _dealt

    for boards in (16_000, 720_000):  # reading a file is cheap beside a task of a stream, which also writes a file
        tasks = _dealt(FolderFeed({"path": "/x"}), [(str(i), i, 1) for i in range(boards)])
        assert len(tasks) == -(-boards // 1024) and [b for t in tasks for b, _, _ in t.boards] == [str(i) for i in range(boards)]
