"""Best-fit-decreasing packing of tokenised documents into sequences of fixed capacity.

Documents become token ids (vocabulary of a public tokenizer) followed by a separator id. A longer one is cut into pieces of
full capacity, the first piece taking the remainder. The packing is best-fit decreasing over *all* pieces: a segment
tree over the remaining capacities finds the tightest open sequence in logarithmic time. Pieces of equal length are
interchangeable, so the plan is made for runs of them: it needs only how many pieces have each length (at most ``capacity``
numbers) and gives the same sequences as the document-by-document pass, in work that doesn't depend on the number of documents.
The plan is a list of segments (pieces a..b of length L go to sequences s.. at offset o), at most one per pair of length and
remaining capacity and free range, and is broadcast; each piece finds its segment by binary search.

The place of a piece among those of its length comes from two levels: pieces are dealt to salted groups of bounded size, ordered
inside a group, and offset by the group counts before it. A length that a third of all pieces share is thus spread out.

Defined results: a null text counts as empty and gives one piece that holds the separator only. Texts are tokenised whole. Rows
that repeat a doc_id are packed as documents of their own. Empty tables give empty tables. Other columns are ignored."""
from __future__ import annotations

import base64
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.llm.common import append, arrow_type, pick, table
from vacantia.session import cut

CAPACITY = 2048
SEPARATOR = 0
#: Pieces in one ordered group, about.
GROUP = 1_000
#: A run of white space from this length on is encoded by ``tokenizers``: ``tiktoken`` panics within one of about a million.
SPACES = 100_000
#: White space as both libraries have it.
_SPACE_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}")


@cache
def _slow():
    """The ``tokenizers`` model; special strings in a text are ordinary text."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    return model


def _parts(text: str, spaces: int = SPACES):
    """(text, whether it is a long run of white space) in order; the split before the merges is the same in the parts as in the whole.

    A run is a token of its own up to its last character, which is left to what follows."""
    at = 0
    if len(text) >= spaces:
        for m in _SPACE_RUN.finditer(text):
            if m.end() - m.start() >= spaces:
                end = m.end() - (m.end() < len(text))
                yield text[at : m.start()], False
                yield text[m.start() : end], True
                at = end
    yield text[at:], False


@cache
def encoder(path: str):
    """text -> its ids as little-endian bytes; loaded once in a worker, however many tasks it runs.

    The vocabulary comes as ranks, which give the ids of the ``tokenizers`` file of the same name in a fifth of its time (a test
    holds them against each other). Long runs of white space, which the ranks' library can't split, go through that file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    model = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> bytes:
        got = [_slow().encode(part, add_special_tokens=False).ids if run else model.encode_ordinary(part) for part, run in _parts(text)]
        return b"".join(np.array(ids, dtype="<u4").tobytes() for ids in got)

    return encode


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (binary, little-endian) of every piece of ``docs(doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    types = [arrow_type(docs.schema["doc_id"].dataType), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo in range(0, len(texts), 500):
                rows: list[list] = [[] for _ in names]
                for doc, got in zip(ids[lo : lo + 500], map(encode, texts[lo : lo + 500])):
                    got += SEPARATOR.to_bytes(4, "little")
                    n = len(got) // 4
                    first = n % capacity or capacity
                    for k, start in enumerate([0, *range(first, n, capacity)]):
                        end = first if k == 0 else start + capacity
                        part = got[4 * start : 4 * end]
                        for column, value in zip(rows, (doc, k, start, end - start, zlib.crc32(part), part)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary")


class Tightest:
    """Segment tree over capacities 0..n: which are open, and the smallest open one not below a bound."""

    def __init__(self, n: int):
        self.half = 1 << n.bit_length()
        self.any = np.zeros(2 * self.half, dtype=bool)

    def set(self, capacity: int, is_open: bool) -> None:
        i = self.half + capacity
        self.any[i] = is_open
        while i > 1:
            i //= 2
            now = self.any[2 * i] or self.any[2 * i + 1]
            if self.any[i] == now:
                break
            self.any[i] = now

    def at_least(self, capacity: int) -> int | None:
        i = self.half + capacity
        if self.any[i]:
            return capacity
        while i > 1:  # up to the first open right neighbour, then down its left side
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.half:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.half
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing for ``counts`` pieces of each length.

    Rows (length, first piece, pieces, first sequence, offset): piece ``first + i`` of that length is the next of sequence
    ``first sequence + i``."""
    tree, free = Tightest(capacity), {}  # remaining capacity -> ranges (first sequence, how many)
    made, out = 0, []

    def put(left: int, start: int, n: int) -> None:
        if left and n:
            if not free.get(left):
                tree.set(left, True)
            free.setdefault(left, []).append((start, n))

    for length in sorted(counts, reverse=True):
        place, todo = 0, counts[length]
        while todo:
            left = tree.at_least(length)
            if left is None:  # no open sequence fits: the rest fills new ones of its own, layer by layer
                per = capacity // length
                full, rest = divmod(todo, per)
                for k in range(per):
                    take = full + (k < rest)
                    if take:
                        out.append((length, place, take, made, k * length))
                    place += take
                put(capacity - per * length, made, full)
                put(capacity - rest * length, made + full, min(rest, 1))
                made += full + min(rest, 1)
                break
            start, n = free[left].pop()
            take = min(n, todo)
            if take < n:
                free[left].append((start + take, n - take))
            if not free[left]:
                tree.set(left, False)
            out.append((length, place, take, start, capacity - left))
            put(left - length, start, take)
            place, todo = place + take, todo - take
    return np.array(out, dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ids_crc32, ...) with sequence_id and offset; written once to the shared folder.

    Columns named sequence_id or offset are replaced; any other passes through."""
    spark, own = pieces.sparkSession, ("doc_id", "piece", "length", "ids_crc32")
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    inner = {c: c if c in own else f"_c{i}" for i, c in enumerate(names)}
    pieces = cut(pieces.select(*[F.col(f"`{c}`").alias(x) for c, x in inner.items()]))
    sizes = cut(pieces.groupBy("length").agg(F.count(F.lit(1)).alias("_all")))  # at most one row per length
    counts = {r["length"]: r["_all"] for r in sizes.collect()}
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.ceil(F.col("_all") / group)).cast("int")
    salted = pieces.join(F.broadcast(sizes), "length").withColumn("_salt", salt).drop("_all")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")).select(
        "length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    placed = salted.withColumn("_i", F.row_number().over(inside)).join(starts, ["length", "_salt"]).withColumn(
        "_place", F.col("_start") + F.col("_i") - 1).drop("_i", "_salt", "_start")
    segments = plan(counts, capacity)
    keys = segments[:, 0] * (1 << 40) + segments[:, 1]
    order = np.argsort(keys)
    held = spark.sparkContext.broadcast((keys[order], segments[order]))

    def find(batch: pa.RecordBatch) -> list:
        keys, rows = held.value
        length, place = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_place"))
        at = np.searchsorted(keys, length * (1 << 40) + place, side="right") - 1
        return [pa.array(rows[at, 3] + place - rows[at, 1]), pa.array(rows[at, 4])]

    found = append(placed, "sequence_id bigint, offset bigint", find, drop=("_place",))
    return found.select(*[F.col(x).alias(c) for c, x in inner.items()], "sequence_id", "offset")


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf: str) -> DataFrame:
    docs = pick(table(spark, sf, "documents"), doc_id="doc_id", text="text")
    return pack(pieces(docs, tokenizer_path()).drop("ids")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op10_best_fit_packing": (query, None)}
