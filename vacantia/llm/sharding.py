"""Shards of near equal bytes by histogram sort.

Rows are sorted by (key, tie) and cut where the bytes below reach equal shares. Splitters are found without sorting: every
round counts, in each partition, the exact bytes and rows below a set of candidate boundaries, sums these small histograms,
and puts new candidates inside the interval that must hold each splitter, until no splitter is further from its share than the
tolerance or than one row allows. The boundaries asked for belong to the shards alone, so their number doesn't depend on the data.
Then rows move once, into ranges of (key, tie) of ``part_rows`` rows, about, so no task sorts a whole shard. As shards follow the same
order and the histogram tells how many rows lie below each, a slot is the position in that order less the rows below the shard.

The tie is the row's number in a table written once to the shared folder: rows of one key (or copies, or repeated ids) are cut
between like any others, and a lost executor doesn't change it. Law: ``bytes``. A splitter may be off by less than the larger of
``tolerance`` times a shard's share and one row.

Defined results: a null text has no bytes (size 16, crc32 of nothing), a null key sorts first. Repeated rows each get a slot.
Empty tables give empty tables; with fewer rows than shards some shards stay empty. Other columns are ignored."""
from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.common import append, pick, table
from vacantia.operators.positions import with_position
from vacantia.session import cut, wide

SHARDS = 40
TOLERANCE = 1e-4
#: Candidates per unsettled splitter and round.
PROBES = 24
#: Rows that one task sorts, about.
PART_ROWS = 4_000_000
_SIGN = np.uint64(1 << 63)


def _packed(batch: pa.RecordBatch) -> np.ndarray:
    """(key, tie) as 16 bytes each, whose order as text is the order of the pairs."""
    key = batch.column("_key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ _SIGN
    tie = batch.column("_tie").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return np.ascontiguousarray(np.stack([key, tie], axis=1).astype(">u8")).view("S16").ravel()


def _bytes(boundaries: list[int]) -> np.ndarray:
    return np.array([b.to_bytes(16, "big") for b in boundaries], dtype="S16")


def _below(rows: DataFrame, boundaries: list[int]) -> tuple[list[int], list[int]]:
    """Bytes and rows strictly below each boundary (sorted), counted exactly in every partition and summed."""
    held = rows.sparkSession.sparkContext.broadcast(_bytes(boundaries))

    def count(batches):
        n = len(held.value) + 1
        size, many = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            at = np.searchsorted(held.value, _packed(batch), side="right")
            np.add.at(size, at, batch.column("size").to_numpy())
            many += np.bincount(at, minlength=n)
        got = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(size[got]), pa.array(many[got])], names=["at", "size", "n"])

    found = rows.select("_key", "_tie", "size").mapInArrow(count, "at long, size long, n long").groupBy("at").agg(
        F.sum("size").alias("size"), F.sum("n").alias("n")).collect()
    size, many = np.zeros(len(boundaries) + 1, np.int64), np.zeros(len(boundaries) + 1, np.int64)
    for r in found:
        size[r["at"]], many[r["at"]] = r["size"], r["n"]
    return np.cumsum(size)[:-1].tolist(), np.cumsum(many)[:-1].tolist()


def splitters(rows: DataFrame, parts: int, tolerance: float = TOLERANCE) -> tuple[list[int], list[int]]:
    """``parts - 1`` boundaries between parts of near equal bytes, and the rows below each."""
    ends = rows.agg(F.min("_key"), F.max("_key"), F.sum("size"), F.count(F.lit(1))).first()
    if not ends[3] or parts < 2:
        return [], []
    total = ends[2]
    low, high = ((ends[0] + (1 << 63)) << 64), ((ends[1] + (1 << 63) + 1) << 64)
    known = {low: (0, 0), high: (total, ends[3])}  # boundary -> bytes and rows below
    slack = tolerance * total / parts
    while True:
        places, sizes = zip(*sorted((b, known[b][0]) for b in known))
        ask: set[int] = set()
        for i in range(1, parts):
            goal = total * i / parts
            j = bisect.bisect_left(sizes, goal)
            a, b = (places[j - 1], places[j]) if j else (places[0], places[0])
            if sizes[j] - goal <= slack or (j and goal - sizes[j - 1] <= slack) or b - a <= 1:
                continue
            step = max(1, (b - a) // (PROBES + 1))
            ask.update(range(a + step, b, step))
        if not ask:
            break
        asked = sorted(ask)
        known.update(zip(asked, zip(*_below(rows, asked))))
    out = []
    for i in range(1, parts):
        goal = total * i / parts
        j = bisect.bisect_left(sizes, goal)
        out.append(min(places[max(0, j - 1) : j + 1], key=lambda b: (abs(known[b][0] - goal), b)))
    return out, [known[b][1] for b in out]


def shard(rows: DataFrame, key: str, size: str, shards: int = SHARDS, part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` with shard and slot, near equal in the sum of ``size``; ``key`` (a long) orders rows over the shards.

    Columns named shard or slot are replaced."""
    spark, names = rows.sparkSession, [n for n in rows.columns if n.lower() not in ("shard", "slot")]
    rows = cut(rows.select(
        *[F.col(f"`{n}`").alias(f"_c{i}") for i, n in enumerate(names)], F.col(f"`{size}`").cast("bigint").alias("size"),
        F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(-(1 << 63))).alias("_key"), F.monotonically_increasing_id().alias("_tie")))
    bounds, before = splitters(rows, shards)
    starts = [0, *before]
    held = spark.sparkContext.broadcast((_bytes(bounds), np.array(starts + [starts[-1]] * (shards - len(starts)), np.int64)))
    parts = max(wide(spark), -(-rows.count() // part_rows))
    placed = with_position(rows, [F.col("_key"), F.col("_tie")], "_place", parts)

    def place(batch: pa.RecordBatch) -> list:
        bounds, starts = held.value
        at = np.searchsorted(bounds, _packed(batch), side="right")
        return [pa.array(at), pa.array(batch.column("_place").to_numpy() - 1 - starts[at])]

    found = append(placed, "shard int, slot bigint", place, ("_key", "_tie", "_place"))
    return found.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)], "shard", "slot")


def query(spark: SparkSession, sf: str) -> DataFrame:
    docs = pick(table(spark, sf, "documents"), doc_id="doc_id", text="text")
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(content) + 16).cast("bigint").alias("size"), F.crc32(content).alias("text_crc32"))
    return shard(rows, "doc_id", "size").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op9_sharding": (query, None)}
