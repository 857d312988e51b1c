"""Hard negatives by an inverted multi-index, exact by certified bounds.

Vectors are whole numbers (components times ``SCALE``, rounded down); the score of two rows is their inner product. Anchors look
for their best rows of the same label (positives) and, for each of these, for the best rows of other labels whose score lies in a
window given in per cent of the positive's.

Index: two codebooks of ``CODES`` words, one for each half of the components, are fitted (k-means) on a bounded sample of
``SAMPLE`` rows. All rows are indexed: dealt to slices, and in a slice to the cell of their two words, with the exact radius of
every word. For an anchor ``a`` no row of cell (i, j) scores above the sum of two half bounds ``a1.c1 + |a1| r1`` and
``a2.c2 + |a2| r2``, nor below the same with minus signs. The multi-sequence walk sorts both lists of half bounds and pops
cells from a heap in falling order of their sum. It stops once the next bound is below what every window has certain: its lower
edge, or its k-th best row so far. Cells that lie above all windows are passed over.

The sample serves a second time as a pilot: the k-th best row of a window within the sample bounds the k-th best of all from below,
so each slice starts with a good stopping score. The pilot only saves work; results equal an exhaustive search (a test
compares them), that is a recall of 1.

Scale: the search is a stated query set (one row in a hundred) against all rows, in blocks. A task holds one slice and reads a bounded chunk
of anchors as a stream; slices come back with at most k rows per window, which are merged by anchor. No row is broadcast but
the sample. A label of a third of all rows changes nothing, as rows are dealt by their number.

Defined results: rows without id, label or vector, or with a component that is null or not finite, take no part. Scaled components
are held within ±2**24. Shorter vectors count as filled up with zeros. Ties go to the smaller id; rows that repeat an id are
rows of their own, each an anchor if its id says so. Empty tables give empty tables. Other columns are ignored."""
from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.llm.common import pick, table
from vacantia.session import cut, wide

SCALE = 256
EDGE = 1 << 24
#: Rows of the fitting and pilot sample, words per half, rounds of k-means.
SAMPLE, CODES, ROUNDS = 8192, 16, 8
#: Rows of a slice and anchors of a chunk, at most about.
SLICE, CHUNK = 131_072, 50_000
#: Rows scored at once while cells are walked.
BATCH = 384
POSITIVES, NEGATIVES = 5, 10
#: A negative's score in per cent of the positive's.
LOW, HIGH = 30, 90
_NONE, _ALL = -(1 << 62), 1 << 62

c = F.col


# --- the index of one slice -----------------------------------------------------------------------

@dataclass
class Books:
    """Codebooks of both halves (words x components)."""

    first: np.ndarray
    second: np.ndarray

    @property
    def cut(self) -> int:
        return self.first.shape[1]


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmax(x @ words.T - (words * words).sum(axis=1) / 2, axis=1)


def _k_means(x: np.ndarray, codes: int) -> np.ndarray:
    """Words for the rows ``x``; starts from rows at even steps in the order of their first principal direction."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    spread = x - x.mean(axis=0)
    axis = np.linalg.eigh(spread.T @ spread)[1][:, -1] if x.shape[1] else np.zeros(0)
    words = x[np.argsort(spread @ axis, kind="stable")[np.linspace(0, len(x) - 1, min(codes, len(x))).astype(int)]].copy()
    for _ in range(ROUNDS):
        at = _nearest(x, words)
        for k in range(len(words)):
            if (at == k).any():
                words[k] = x[at == k].mean(axis=0)
    return words


def fit(x: np.ndarray, codes: int = CODES) -> Books:
    half = x.shape[1] // 2
    return Books(_k_means(x[:, :half].astype(float), codes), _k_means(x[:, half:].astype(float), codes))


class Slice:
    """Rows in their cells."""

    def __init__(self, books: Books, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray):
        self.books, half = books, books.cut
        one, two = _nearest(x[:, :half], books.first), _nearest(x[:, half:], books.second)
        cell = one * len(books.second) + two
        order = np.argsort(cell, kind="stable")
        self.x, self.ids, self.rows, self.labels = x[order], ids[order], rows[order], labels[order]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=len(books.first) * len(books.second)))])
        self.radii = [self._radii(x[:, :half], one, books.first), self._radii(x[:, half:], two, books.second)]

    @staticmethod
    def _radii(x: np.ndarray, at: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Distance of the farthest row of each word; -1 for words without rows."""
        out = np.full(len(words), -1.0)
        np.maximum.at(out, at, np.sqrt(((x - words[at]) ** 2).sum(axis=1)))
        return out

    def half_bounds(self, anchors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(upper, lower) bounds per anchor and word, for each half; words without rows have an upper bound of -inf."""
        half, out = self.books.cut, []
        for part, words, radii in ((anchors[:, :half], self.books.first, self.radii[0]), (anchors[:, half:], self.books.second, self.radii[1])):
            mid, reach = part @ words.T, np.sqrt((part * part).sum(axis=1))[:, None] * radii
            slack = 1e-9 * (np.abs(mid) + reach) + 1e-6  # for rounding
            out.append((np.where(radii < 0, -np.inf, mid + reach + slack), mid - reach - slack))
        return out


def falling_cells(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) over two lists of half bounds, in falling order of the sum (multi-sequence walk); pairs with -inf are left out."""
    one, two = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    one, two = one[first[one] > -np.inf], two[second[two] > -np.inf]
    if not len(one) or not len(two):
        return
    a, b, i_of, j_of = first[one].tolist(), second[two].tolist(), one.tolist(), two.tolist()
    heap = [(-(a[0] + b[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, i_of[i], j_of[j]
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))


class Best:
    """The k best rows (score, then smaller id, then smaller row) whose score lies in lo..hi."""

    def __init__(self, lo: int, hi: int, k: int):
        self.lo, self.hi, self.k = (lo if lo <= hi else _ALL), hi, k  # an empty window keeps no walk going
        self.held: np.ndarray = np.zeros((0, 3), np.int64)  # score, id, row

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        fit = (scores >= self.lo) & (scores <= self.hi)
        if fit.any():
            both = np.concatenate([self.held, np.stack([scores[fit], ids[fit], rows[fit]], axis=1)])
            self.held = both[np.lexsort((both[:, 2], both[:, 1], -both[:, 0]))[: self.k]]
            if len(self.held) == self.k:
                self.lo = int(self.held[-1, 0])


def search(index: Slice, anchor: np.ndarray, bounds: list[tuple[np.ndarray, np.ndarray]], wanted: list[Best], label: int, row: int, same: bool) -> None:
    """Fill ``wanted`` from the slice. ``bounds``: the anchor's (upper, lower) of both halves; ``row`` itself is left out."""
    top = max(w.hi for w in wanted)
    lower = (bounds[0][1].tolist(), bounds[1][1].tolist())
    wide_j, ends, chosen, many = len(bounds[1][0]), index.ends, [], 0

    def score() -> None:
        at = np.concatenate([np.arange(a, b) for a, b in chosen])
        at = at[((index.labels[at] == label) == same) & (index.rows[at] != row)]
        scores = np.rint(index.x[at] @ anchor).astype(np.int64) if index.x.dtype == np.float64 else index.x[at] @ anchor
        for w in wanted:
            w.add(scores, index.ids[at], index.rows[at])

    floor = min(w.lo for w in wanted)
    for bound, i, j in falling_cells(bounds[0][0], bounds[1][0]):
        if bound < floor:
            break
        cell = i * wide_j + j
        if ends[cell] == ends[cell + 1] or lower[0][i] + lower[1][j] > top:
            continue
        chosen.append((ends[cell], ends[cell + 1]))
        many += ends[cell + 1] - ends[cell]
        if many >= BATCH:
            score()
            chosen, many, floor = [], 0, min(w.lo for w in wanted)
    if chosen:
        score()


def pilot(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, anchor: np.ndarray, wanted: list[Best], label: int, row: int, same: bool) -> list[int]:
    """Lower edges of ``wanted`` that the sample makes certain."""
    at = np.flatnonzero(((labels == label) == same) & (rows != row))
    scores = np.rint(x[at] @ anchor).astype(np.int64) if x.dtype == np.float64 else x[at] @ anchor
    out = []
    for w in wanted:
        fit = scores[(scores >= w.lo) & (scores <= w.hi)]
        out.append(int(np.partition(fit, len(fit) - w.k)[len(fit) - w.k]) if len(fit) >= w.k else w.lo)
    return out


# --- Arrow batches ----------------------------------------------------------------------------------------

def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of ``dim`` components, filled up with zeros."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(ends)
    if len(sizes) and (sizes == dim).all():
        return values[ends[0] : ends[-1]].reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        out[i, : b - a] = values[a:b]
    return out


def exact_kind(x: np.ndarray, largest: int) -> np.ndarray:
    """As float64 where all sums of products stay exact in it, else as whole numbers."""
    return x.astype(np.float64 if largest * largest * max(1, x.shape[1]) < 1 << 52 else np.int64)


_FOUND = "unit long, a_row long, a_id long, w int, score long, id long, row long"


def _searcher(books, dim: int, largest: int, k: int, same: bool):
    """mapInArrow body over rows sorted by (unit, kind): the slice's rows (kind 0), then anchors (kind 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, parts, index = None, [], None
        for batch in batches:
            units, kinds = batch.column("unit").to_numpy(), batch.column("kind").to_numpy()
            breaks = np.flatnonzero((np.diff(units) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *breaks], [*breaks, len(units)]):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                if units[a] != unit:
                    unit, parts, index = units[a], [], None
                x = exact_kind(matrix(piece.column("v"), dim), largest)
                ids, rows, labels = (piece.column(n).to_numpy() for n in ("id", "row", "label"))
                if kinds[a] == 0:
                    parts.append((x, ids, rows, labels))
                    continue
                if index is None and parts:
                    index = Slice(books.value, *(np.concatenate(p) for p in zip(*parts)))
                    parts = []
                if index is None:
                    continue  # anchors of a slice without rows
                bounds, out = index.half_bounds(x.astype(float)), []
                for n, (los, his) in enumerate(zip(piece.column("lo").to_pylist(), piece.column("hi").to_pylist())):
                    wanted = [Best(lo, hi, k) for lo, hi in zip(los, his)]
                    search(index, x[n], [(u[n], l[n]) for u, l in bounds], wanted, labels[n], rows[n], same)
                    out += [(unit, rows[n], ids[n], w, *held) for w, best in enumerate(wanted) for held in best.held.tolist()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*out), [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3)],
                                                     names=["unit", "a_row", "a_id", "w", "score", "id", "row"])

    return run


def _pilots(anchors: DataFrame, held, dim: int, largest: int, k: int, same: bool) -> DataFrame:
    """``anchors`` with the lower edges (``lo``) raised to what the sample makes certain."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, ids, rows, labels = held.value
        x = exact_kind(x, largest)
        for batch in batches:
            mine, out = exact_kind(matrix(batch.column("v"), dim), largest), []
            for n, (row, label, los, his) in enumerate(zip(*(batch.column(f).to_pylist() for f in ("row", "label", "lo", "hi")))):
                out.append(pilot(x, ids, rows, labels, mine[n], [Best(lo, hi, k) for lo, hi in zip(los, his)], label, row, same))
            yield batch.set_column(batch.schema.get_field_index("lo"), "lo", pa.array(out, pa.list_(pa.int64())))

    return anchors.mapInArrow(run, anchors.schema)


# --- the search over all rows -----------------------------------------------------------------------------

@dataclass
class Index:
    """All rows (row, id, label, v), written once, with codebooks and sample as bounded broadcasts."""

    rows: DataFrame
    books: object
    sample: object
    dim: int
    largest: int
    many: int


def build(df: DataFrame, id: str, label: str, vector: str) -> Index:
    spark = df.sparkSession
    v = F.transform(c(f"`{vector}`"), lambda x: F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), F.floor(x.cast("double") * SCALE))).cast("bigint"))
    sound = F.forall(c(f"`{vector}`"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.where(c(f"`{id}`").isNotNull() & c(f"`{label}`").isNotNull() & c(f"`{vector}`").isNotNull() & sound).select(
        c(f"`{id}`").cast("bigint").alias("id"), c(f"`{label}`").cast("bigint").alias("label"), v.alias("v"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    facts = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.greatest(F.coalesce(F.array_max("v"), F.lit(0)), -F.coalesce(F.array_min("v"), F.lit(0))))).first()
    many, dim, largest = facts[0], facts[1] or 0, facts[2] or 0
    part = rows.orderBy(F.xxhash64("id", "row"), "row").limit(SAMPLE).toArrow()  # bounded
    x = matrix(part.column("v").combine_chunks(), dim) if part.num_rows else np.zeros((0, dim), np.int64)
    sample = (x, *(part.column(n).to_numpy() for n in ("id", "row", "label")))
    return Index(rows, spark.sparkContext.broadcast(fit(x)), spark.sparkContext.broadcast(sample), dim, largest, many)


def best(index: Index, anchors: DataFrame, n_anchors: int, k: int, same: bool, slice_rows: int = SLICE, chunk: int = CHUNK) -> DataFrame:
    """The k best rows per anchor and window: a_row, a_id, w, score, id, row, place (from 1).

    ``anchors``: row, id, label, v, lo and hi (lists: the windows)."""
    spark = index.rows.sparkSession
    slices = max(wide(spark), -(-index.many // slice_rows))
    chunks = max(1, -(-n_anchors // chunk))
    ready = _pilots(anchors.select("row", "id", "label", "v", "lo", "hi"), index.sample, index.dim, index.largest, k, same)

    def dealt(df: DataFrame, kind: int, unit: Column) -> DataFrame:
        edges = [c(n) if kind else F.lit(None).cast("array<bigint>").alias(n) for n in ("lo", "hi")]
        return df.select(F.explode(unit).alias("unit"), F.lit(kind).alias("kind"), "row", "id", "label", "v", *edges)

    mine = F.pmod(F.xxhash64("row"), F.lit(slices)) * chunks
    theirs = F.pmod(F.xxhash64("row"), F.lit(chunks))
    both = dealt(index.rows, 0, F.sequence(mine, mine + chunks - 1)).unionByName(
        dealt(ready, 1, F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda s: s * chunks + theirs)))
    units = both.repartitionById(slices * chunks, c("unit").cast("int")).sortWithinPartitions("unit", "kind")
    found = units.mapInArrow(_searcher(index.books, index.dim, index.largest, k, same), _FOUND)
    order = Window.partitionBy("a_row", "w").orderBy(c("score").desc(), "id", "row")
    return found.withColumn("place", F.row_number().over(order)).where(c("place") <= k).drop("unit")


def mine(df: DataFrame, id: str, label: str, vector: str, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors, rows whose id divides by ``every``."""
    index = build(df, id, label, vector)
    anchors = index.rows.where(c("id") % every == 0)
    n_anchors = anchors.count()
    open_window = anchors.withColumn("lo", F.array(F.lit(_NONE))).withColumn("hi", F.array(F.lit(_ALL)))
    close = cut(best(index, open_window, n_anchors, positives, True).select("a_row", "a_id", "place", c("score").alias("p_score"), c("id").alias("p_id")))
    # whole scores s with low * p <= 100 * s <= high * p
    p = lambda x: x["p_score"]
    windows = close.groupBy("a_row").agg(F.array_sort(F.collect_list(F.struct("place", "p_score"))).alias("of")).select(
        c("a_row").alias("row"), F.transform("of", lambda x: -F.floor(-(p(x) * low) / 100)).alias("lo"), F.transform("of", lambda x: F.floor(p(x) * high / 100)).alias("hi"))
    far = best(index, anchors.join(windows, "row"), n_anchors, negatives, False).select(
        c("a_row").alias("n_row"), (c("w") + 1).alias("n_of"), c("place").alias("rank"), c("id").alias("negative_id"), c("score").alias("negative_score"))
    return close.join(far, (c("a_row") == c("n_row")) & (c("place") == c("n_of"))).select(
        c("a_id").alias("anchor_id"), c("p_id").alias("positive_id"), "rank", "negative_id", c("p_score").alias("positive_score"), "negative_score")


def query(spark: SparkSession, sf: str) -> DataFrame:
    rows = pick(table(spark, sf, "embeddings"), vec_id="vec_id", label="label", vector="embedding")
    noisy = F.when(c("vec_id") % 7 == 0, F.pmod(c("label") + 1, F.lit(10))).otherwise(c("label"))
    return mine(rows.select("vec_id", noisy.alias("label"), "vector"), "vec_id", "label", "vector")


SQL = """WITH rows_in AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows_in a JOIN rows_in b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
close AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT c.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY c.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM close c JOIN scored s ON s.anchor_id = c.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY c.anchor_id, positive_id ORDER BY score DESC, other_id) <= 10"""

QUERIES = {"op13_hard_negatives": (query, SQL)}
