"""Line deduplication by content-defined chunks of lines.

A text is cut into chunks of lines where a rolling hash over the last two line hashes hits a target (on average every second
line), and around long lines, which stand for several wrapped ones. Boundaries depend on the lines beside them only, so an
inserted or removed line shifts no other chunk and a passage is cut alike wherever it occurs. A short passage may hold no whole
chunk, so every two neighbouring short lines (blank ones between them aside) are a chunk as well. Chunks, and the lines in them, are
then counted over all documents by hash and bytes: grouping by the text itself is the byte comparison, and a hash that two
different texts share is left alone. The occurrence in the smallest doc_id (there the first one) stays. Elsewhere a repeated
chunk grows over the repeated lines beside it, which gives the ragged ends of its passage, and the run is removed if it spans
two lines or a long one and has ``min_words`` words. So short common lines stay where they stand.

Chunks are combined in each task before they are shuffled, so a passage in a third of all rows is a few rows; its occurrences
are joined by hash with the written table of repeated ones, a join that adaptive execution can split. Texts move once, to be joined with what goes.

Defined results: null and empty texts are returned as they are. Texts are cut whole, whatever their length. Rows that repeat a
doc_id count as one document: repeated rows keep the same lines. A null doc_id sorts last; where all occurrences have one, none
goes. Empty tables give empty tables. Other columns pass through; ``n_lines``, ``n_removed`` and ``emptied`` are replaced."""
from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.common import append, arrow_type, table
from vacantia.session import cut

#: One boundary in so many lines, on average.
TARGET = 2
#: Words from which a line is a chunk of its own.
LONG = 25
#: Words that a removed run has at least.
MIN_WORDS = 25


def line_chunks(lines: list[str], target: int = TARGET, long: int = LONG) -> list[tuple[int, int]]:
    """Chunks as (first line, end) pairs."""
    out, start, before = [], 0, 0
    size = [len(x.split()) for x in lines]
    for i, line in enumerate(lines):
        h = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
        rolled = (before * 0x9E3779B97F4A7C15 + h) & 0xFFFFFFFFFFFFFFFF
        before = h
        last = i + 1 == len(lines)
        if last or size[i] >= long or size[i + 1] >= long or (rolled >> 32) % target == 0:
            out.append((start, i + 1))
            start = i + 1
    return out


def _hash(chunk: str) -> int:
    return xxhash.xxh3_64_intdigest(chunk.encode("utf-8", "surrogatepass")) - (1 << 63)


def _pieces(lines: list[str]):
    """(first line, lines, text) of every chunk of several lines, of every line, and (0 lines) of every pair of short neighbours.

    A pair is named by the hashes of its lines: where both are repeated, each hash stands for one text."""
    for a, b in line_chunks(lines):
        if b - a > 1:
            yield a, b - a, "\n".join(lines[a:b])
        for i in range(a, b):
            yield i, 1, lines[i]
    for i, j in _pairs(lines):
        yield i, 0, f"\n{_hash(lines[i]):x} {_hash(lines[j]):x}"


def _pairs(lines: list[str]) -> list[tuple[int, int]]:
    """Neighbouring lines that aren't blank, without long ones, which are chunks of their own."""
    sized = [(i, n) for i, x in enumerate(lines) if (n := len(x.split()))]
    return [(i, j) for (i, n), (j, m) in zip(sized, sized[1:]) if n < LONG and m < LONG]


def _chunks(docs: DataFrame, with_text: bool) -> DataFrame:
    """(rk, doc_id, at, n, h[, chunk]) of every chunk and line."""
    kind = docs.schema["doc_id"].dataType
    names = ["rk", "doc_id", "at", "n", "h"] + ["chunk"] * with_text
    types = [pa.int64(), arrow_type(kind), pa.int32(), pa.int32(), pa.int64()] + [pa.string()] * with_text

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                cols: list[list] = [[] for _ in names]
                part = batch.slice(lo, 1000)
                for rk, doc, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                    for at, n, chunk in _pieces(text.split("\n") if text else []):
                        for c, x in zip(cols, (rk, doc, at, n, _hash(chunk), chunk)):
                            c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    ddl = f"rk long, doc_id {kind.simpleString()}, at int, n int, h long" + ", chunk string" * with_text
    return docs.select("rk", "doc_id", "text").mapInArrow(run, ddl)


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated runs removed from ``text``, and n_lines, n_removed (lines) and emptied (nothing is left).

    Columns named like the new ones are replaced; any other passes through."""
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed", "emptied")]
    docs = docs.select(*[F.col(f"`{c}`").alias("text" if c == text else f"_c{i}") for i, c in enumerate(names)], F.col(f"`{doc_id}`").alias("doc_id"))
    row = F.xxhash64("doc_id", "text")
    slim = docs.select(row.alias("rk"), "doc_id", "text")
    counted = _chunks(slim, True).groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    repeated = cut(counted.groupBy("h").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.min("first").alias("first")).where("n > 1 and kinds = 1"))
    mine = F.col("first").isNull() | F.coalesce(F.col("doc_id") == F.col("first"), F.lit(False))
    marks = _chunks(slim, False).join(repeated.select("h", "first"), "h").groupBy("rk").agg(
        F.collect_set(F.struct("at", "n", mine.alias("mine"))).alias("_marks"))
    rows = docs.withColumn("_rk", row)
    joined = rows.join(marks.withColumnRenamed("rk", "_rk"), "_rk", "left")

    def clean(batch: pa.RecordBatch) -> list:
        out: list[list] = [[], [], [], []]
        for old, marks in zip(batch.column("text").to_pylist(), batch.column("_marks").to_pylist()):
            lines = old.split("\n") if old else []
            gone = _removed(lines, {(m["at"], m["n"]): m["mine"] for m in marks or ()}, min_words)
            left = [x for i, x in enumerate(lines) if i not in gone]
            for c, x in zip(out, ("\n".join(left) if gone else old, len(lines), len(gone), bool(gone) and not any(x.strip() for x in left))):
                c.append(x)
        return out

    done = append(joined, "text string, n_lines long, n_removed long, emptied boolean", clean, ("_rk", "_marks", "doc_id"))
    return done.select(*[F.col("text" if c == text else f"_c{i}").alias(c) for i, c in enumerate(names)], "n_lines", "n_removed", "emptied")


def _removed(lines: list[str], marks: dict[tuple[int, int], bool], min_words: int) -> set[int]:
    """Lines to remove, given the repeated chunks and lines (first line, lines -> whether the kept one is in this document)."""
    if not marks:
        return set()
    seen: set[str] = set()
    twice: set[int] = set()
    again, core = [False] * len(lines), [False] * len(lines)
    for at, n, text in _pieces(lines):
        if (at, n) in marks and (text in seen or not marks[at, n]):
            if n == 0:
                twice.add(at)
            for i in range(at, at + n):
                again[i] = True
        seen.add(text)
    for a, b in line_chunks(lines):
        core[a:b] = [(a, b - a) in marks and all(again[a:b])] * (b - a)
    for i, j in _pairs(lines):
        if i in twice and all(again[i : j + 1]):
            core[i] = core[j] = True
    gone: set[int] = set()
    start = 0
    while start < len(lines):
        end = start
        while end < len(lines) and again[end]:
            end += 1
        if any(core[start:end]):
            words = [len(x.split()) for x in lines[start:end]]
            if sum(words) >= min_words and (end - start > 1 or words[0] >= LONG):
                gone.update(range(start, end))
        start = end + 1
    return gone


def query(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_removed", "emptied")


QUERIES = {"op8_line_dedup": (query, None)}
