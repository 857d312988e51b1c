"""Benchmark decontamination as a prefix-filtered containment join.

Every benchmark item is a set of windows of ``size`` words (a shorter item is one window). A document contains a window only
if it contains *all* its words, so the prefix that must be joined is a single word; ordered by rarity over all documents,
it is the window's rarest one. A document word that is some window's rarest word proposes a start position (its place less
the word's place in the window); starts that would leave the document are dropped by the length bound, the rest are verified
word by word against the windows. Nothing but words of the document's own text is ever compared with a window, so copies,
frequent passages and frequent words cost time in proportion to the text only, and no pair is shuffled.

The benchmark is taken in blocks of at most ``block_bytes`` of text, each handed to the tasks as a broadcast of that size; the
documents pass through all blocks in one narrow stage. A benchmark of any size thus takes bounded memory on the driver.

Defined results: null or empty texts have no words, contain nothing and are never contaminated; an item without words has no
window. Items that share an id count once. A null item id is written as an empty string. Texts of any length are read whole.
Repeated rows are judged alike. Empty tables give empty tables, an empty benchmark hits nothing. Other columns pass through
(``decontaminate``) or are ignored (``hits``); clashing ones are replaced."""
from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.common import append, pick, plain_words, table

SIZE = 13
_STATE = ("_spans", "_items")


def _windows(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """The distinct windows of an item."""
    if len(words) <= size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def _frequency(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each word of a block occurs; at most one row per block word and batch is shuffled."""
    wanted = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                seen.update(wanted.value.intersection(plain_words(text)))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])

    rows = docs.select("text").mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["w"]): r["n"] for r in rows}


def _index(block: list[tuple[str, list[bytes]]], often: dict[bytes, int], size: int):
    """(rarest word -> distinct (place, length), window -> items) of a block."""
    windows: dict[tuple, set] = {}
    for item, words in block:
        for w in _windows(words, size):
            windows.setdefault(w, set()).add(item)
    places: dict[bytes, set] = {}
    for w in windows:
        rare = min(range(len(w)), key=lambda i: (often.get(w[i], 0), w[i], i))
        places.setdefault(w[rare], set()).add((rare, len(w)))
    return {k: tuple(sorted(v)) for k, v in places.items()}, {k: tuple(sorted(v)) for k, v in windows.items()}


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    """Disjoint ascending spans as a flat list of starts and ends."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def hits(docs: DataFrame, items: DataFrame, size: int = SIZE, block_bytes: int = 16 << 20, keep_text: bool = True) -> DataFrame:
    """``docs`` (with a string column ``text``) with n_words, n_hit, n_items, item_ids (sorted) and contaminated."""
    spark = docs.sparkSession
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    out = docs.drop(*_STATE)
    for i in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect()
        block = [(r["item_id"] or "", plain_words(r["text"])) for r in rows]
        often = _frequency(docs, {w for _, words in block for w in words})
        index = spark.sparkContext.broadcast(_index(block, often, size))
        drop = ("text",) if i == blocks - 1 and not keep_text else ()
        out = append(out, "n_words bigint, n_hit bigint, _spans binary, _items array<string>", lambda b, index=index: _scan(b, *index.value), drop)
    ids = F.array_sort(F.array_distinct("_items"))
    return out.withColumn("n_items", F.size(ids).cast("bigint")).withColumn("item_ids", ids).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).drop(*_STATE)


def _scan(batch: pa.RecordBatch, places: dict, windows: dict) -> list:
    """Spans and items of one block, added to those of the blocks before it."""
    out: list[list] = [[], [], [], []]
    first = _STATE[0] not in batch.schema.names
    olds = [(b"", [])] * batch.num_rows if first else list(zip(*(batch.column(c).to_pylist() for c in _STATE)))
    for text, (spans, items) in zip(batch.column("text").to_pylist(), olds):
        words = plain_words(text)
        n, new, found = len(words), [], set()
        for p in [p for p, w in enumerate(words) if w in places]:
            for place, length in places[words[p]]:
                start = p - place
                if start >= 0 and start + length <= n:
                    got = windows.get(tuple(words[start : start + length]))
                    if got:
                        new.append((start, start + length))
                        found.update(got)
        flat = np.frombuffer(spans, np.int64).tolist()
        if new:
            flat = _merge(new + list(zip(flat[::2], flat[1::2])))
            items = sorted(found.union(items))
        for column, value in zip(out, (n, sum(flat[1::2]) - sum(flat[::2]), np.array(flat, dtype=np.int64).tobytes(), items)):
            column.append(value)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows, with the columns it had, whatever their names."""
    inner = docs.toDF(*["text" if c == text else f"_c{i}" for i, c in enumerate(docs.columns)])
    got = hits(inner, pick(items, item_id=item_id, text=item_text).withColumn("item_id", F.col("item_id").cast("string")))
    return got.where(~F.col("contaminated")).select(*inner.columns).toDF(*docs.columns)


def query(spark: SparkSession, sf: str) -> DataFrame:
    items = pick(table(spark, sf, "benchmark"), item_id="item_id", text="text").withColumn("item_id", F.col("item_id").cast("string"))
    got = hits(pick(table(spark, sf, "documents"), doc_id="doc_id", text="text"), items, keep_text=False)
    digest = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return got.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k)),
m AS (SELECT rid, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
h AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT rid, k, i FROM m)) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""

QUERIES = {"op7_decontamination": (query, SQL)}
