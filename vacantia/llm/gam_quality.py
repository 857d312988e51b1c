"""Quality classifier: a generalised additive model with pairwise interactions.

Every numeric feature of a text is cut into bins at quantiles of the training rows. Boosting goes round the features in a cycle:
each turn fits one shallow tree on one feature's bins to the current gradients and adds its leaves, damped, to that
feature's look-up table. The pairs whose joint table explains most of what is left then get tables of their own in the
same way. A score is the sum of one entry per feature and pair, found by vectorised binning, through the logistic function; each
table can be read (and plotted) by itself.

Labels are read only from rows whose crc32 of the id isn't a multiple of 5; features of at most about ``sample`` of them (chosen by a
hash of the id) are gathered to fit. Scores use the text alone. Without labels every score is 0, with labels of one kind
their share.

Defined results: null and empty texts have features of 0 and a score. Texts are read whole. Repeated rows are scored alike; of
several labels of an id the higher counts. Empty tables give empty tables. Other columns pass through; clashing ones are replaced."""
from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.common import append, held_out, pick, table
from vacantia.llm.quality_rules import STOP_WORDS

SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, RATE = 150, 0.15
THRESHOLD = 0.3
_STOP = frozenset(STOP_WORDS)
_MARKS = re.compile(r"[#*$%&|<>]")
_ENDS = re.compile(r"[.!?]+")
FEATURES = (
    "words", "mean_word", "spread_word", "symbols_per_word", "bars_per_word", "exclaims_per_word", "upper_share", "digit_share",
    "letter_share", "distinct_share", "top_word_share", "stop_share", "stop_kinds", "repeat_pair_share", "lines", "dup_line_share",
    "words_per_line", "short_line_share", "words_per_sentence", "same_neighbour_share", "unpunctuated_line_share", "capital_start_share",
)


def features(text: str | None) -> list[float]:
    """The FEATURES of one text."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    sizes = np.fromiter(map(len, words), np.int32, n)
    lower = [w.strip(".,;:!?\"'()").lower() for w in words]
    seen = Counter(lower)
    stops = [w for w in seen if w in _STOP]
    pairs = Counter(zip(lower, lower[1:]))
    raw = text.split("\n")
    lines = [x for x in raw if x and not x.isspace()]
    per_line = [x.count(" ") + 1 for x in lines]
    ascii_text = text.encode("utf-8", "surrogatepass")
    letters = np.frombuffer(ascii_text, np.uint8)
    upper = int(((letters >= 65) & (letters <= 90)).sum())
    low = int(((letters >= 97) & (letters <= 122)).sum()) + int((letters >= 192).sum())
    digits = int(((letters >= 48) & (letters <= 57)).sum())
    return [
        float(n), float(sizes.mean()), float(sizes.std()), len(_MARKS.findall(text)) / n, text.count("|") / n, text.count("!") / n,
        upper / chars, digits / chars, (upper + low) / chars, len(seen) / n, max(seen.values()) / n, sum(seen[w] for w in stops) / n,
        float(len(stops)), sum(c for c in pairs.values() if c > 1) / n, float(len(lines)), 1.0 - len(set(lines)) / len(lines),
        n / len(lines), sum(c < 5 for c in per_line) / len(lines), n / max(1, len(_ENDS.findall(text))),
        sum(a == b for a, b in zip(lower, lower[1:])) / n, sum(x.rstrip()[-1] not in ".!?:" for x in lines) / len(lines),
        sum(x.lstrip()[0].isupper() for x in lines) / len(lines),
    ]


@dataclass
class Gam:
    """Bin edges and look-up tables."""

    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    joint: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of features."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        total = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            total += t[np.searchsorted(self.edges[j], x[:, j], side="right")]
        cells = {j: np.searchsorted(self.coarse[j], x[:, j], side="right") for p in self.pairs for j in p}
        for (a, b), t in zip(self.pairs, self.joint):
            total += t[cells[a], cells[b]]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
    """Edges between at most ``bins`` groups of about equal numbers of rows."""
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int = 3) -> np.ndarray:
    """Leaf value of every bin of a tree of a few splits over ordered bins."""
    parts = [(0, len(g))]
    cg, ch = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))

    def best(lo: int, hi: int) -> tuple[float, int]:
        at = np.arange(lo + 1, hi)
        if not len(at):
            return 0.0, lo
        gl, hl, gt, ht = cg[at] - cg[lo], ch[at] - ch[lo], cg[hi] - cg[lo], ch[hi] - ch[lo]
        gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
        k = int(np.argmax(gain))
        return float(gain[k]), int(at[k])

    while len(parts) < leaves:
        options = [(*best(lo, hi), lo, hi) for lo, hi in parts]
        gain, at, lo, hi = max(options)
        if gain <= 1e-9:
            break
        parts.remove((lo, hi))
        parts += [(lo, at), (at, hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best pair of cuts of a joint table (two levels, four leaves)."""
    cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    best, out = 0.0, np.zeros_like(g)
    total = cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
    parts_g = [cg[:-1, :-1], cg[:-1, -1:] - cg[:-1, :-1], cg[-1:, :-1] - cg[:-1, :-1]]
    parts_h = [ch[:-1, :-1], ch[:-1, -1:] - ch[:-1, :-1], ch[-1:, :-1] - ch[:-1, :-1]]
    parts_g.append(cg[-1, -1] - sum(parts_g))
    parts_h.append(ch[-1, -1] - sum(parts_h))
    if parts_g[0].size:
        gain = sum(a**2 / (b + ridge) for a, b in zip(parts_g, parts_h)) - total
        i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
        best = float(gain[i, j])
        leaf = [a[i, j] / (b[i, j] + ridge) for a, b in zip(parts_g, parts_h)]
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return best, out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, pairs: int = PAIRS, ridge: float = 2.0) -> Gam:
    """A model of rows ``x`` and labels ``y`` (0 or 1)."""
    if not len(y) or y.min() == y.max():
        return Gam(constant=float(y.mean()) if len(y) else 0.0)
    m = Gam([_cuts(v, BINS) for v in x.T], [_cuts(v, PAIR_BINS) for v in x.T])
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    cells = [np.searchsorted(e, v, side="right") for e, v in zip(m.edges, x.T)]
    m.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    total = np.full(len(y), m.base)

    def slopes():
        p = 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, t in enumerate(m.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(cells[j], g, len(t)), np.bincount(cells[j], h, len(t)), ridge)
            t += step
            total += step[cells[j]]
    wide = [np.searchsorted(e, v, side="right") for e, v in zip(m.coarse, x.T)]
    shape = [len(e) + 1 for e in m.coarse]
    g, h = slopes()

    def joint(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(wide[a] * shape[b] + wide[b], v, shape[a] * shape[b]).reshape(shape[a], shape[b])

    gains = [(_quadrants(joint(a, b, g), joint(a, b, h), ridge)[0], a, b) for a in range(len(shape)) for b in range(a)]
    m.pairs = [(a, b) for gain, a, b in sorted(gains, reverse=True)[:pairs] if gain > 0]
    m.joint = [np.zeros((shape[a], shape[b])) for a, b in m.pairs]
    for _ in range(rounds // 2):
        for (a, b), t in zip(m.pairs, m.joint):
            g, h = slopes()
            step = rate * _quadrants(joint(a, b, g), joint(a, b, h), ridge)[1]
            t += step
            total += step[wide[a], wide[b]]
    return m


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Gam:
    """The model of ``docs(doc_id, text)`` and ``labels(doc_id, label)``."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, sample / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * share))  # about `sample` rows

    def run(batches):
        for batch in batches:
            x = [features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], names=["x", "y"])

    rows = docs.join(F.broadcast(chosen), "doc_id").select("text", "label").mapInArrow(run, "x array<double>, y int").collect()
    x = np.array([r["x"] for r in rows], dtype=float).reshape(-1, len(FEATURES))
    return boost(x, np.array([1.0 if r["y"] == 1 else 0.0 for r in rows]))


def score(docs: DataFrame, model: Gam, text: str = "text", threshold: float = THRESHOLD, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold``)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list:
        x = np.array([features(t) for t in batch.column(text).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
        s = held.value.score(x)
        return [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))]

    return append(docs, "score double, predicted int", run, drop)


def query(spark: SparkSession, sf: str) -> DataFrame:
    docs = pick(table(spark, sf, "documents"), doc_id="doc_id", text="text")
    model = fit(docs, pick(table(spark, sf, "labels"), doc_id="doc_id", label="quality"))
    scored = score(docs, model, drop=("text",))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op6_gam_quality": (query, None)}
