"""Toxicity scores from a lexicon matched by Levenshtein automata.

The lexicon (whole terms and stems) is learned from labelled rows: words and prefixes that occur far more often in toxic rows
than elsewhere. All its Levenshtein automata run at once against a trie of the terms; the states met are kept as a table of
transitions, so a word costs a few look-ups and most words leave the table after two or three characters. That catches
misspelled terms (one edit from 5 letters, two from 9; a swap of neighbours is one edit), except spellings that clean labelled
rows use too. Every hit is weighed by its context: beside a word that talks about words, or in a short quotation, it counts less, the
more so the shorter the quotation is; one of more than two windows counts like any text. Logistic weights of the few resulting counts come from the same labelled rows.

Labels are read only from rows whose crc32 of the id isn't a multiple of 5, of these at most about ``sample`` rows (chosen by a
hash of the id). Scores use the text alone. Without labels, or with labels of one kind only, every score is the share of toxic
labels (0 without any).

Defined results: null and empty texts have no hits and get a score like any clean text. Texts are read whole. Repeated rows are
scored alike; of several labels of an id the higher counts. Empty tables give empty tables. Other columns pass through; clashing
ones are replaced."""
from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.common import append, held_out, pick, table
from vacantia.session import cut

#: Labelled rows used at most, about.
SAMPLE = 20_000
#: Words on either side of a hit that its context weight looks at.
WINDOW = 6
QUOTED = 0.25
_WORD = re.compile(r"[^\W_]+")
#: Quotations: paired marks, and apostrophes only where they stand at the edge of a word. Longer ones have no bearing on a hit.
_QUOTES = re.compile(
    r"(?<!\w)\"(?=\S)[^\"]{1,400}(?<=\S)\"(?!\w)|[“„][^“”„]{1,400}[”“]|«[^«»]{1,400}»|`[^`]{1,400}`"
    r"|(?<!\w)[‘'](?=\S)(?:[^‘’'\n]|(?<=\w)[’'](?=\w)){1,400}?(?<=\S)[’'](?!\w)"
)
#: Words that announce talk about a word.
_ABOUT = frozenset("word words term terms slur insult quote quoted quotes called phrase wort begriff zitat mot terme palabra término".split())


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def quotations(text: str) -> list[tuple[int, int, int]]:
    """(start, end, words) of the quotations of a text, in order."""
    return [(m.start(), m.end(), len(_WORD.findall(m.group()))) for m in _QUOTES.finditer(text)]


class Automaton:
    """Trie of terms and stems with the Levenshtein automata of all terms, made deterministic as words come in."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: dict[int, str] = {}
        self.stem: dict[int, str] = {}
        for words, ends in ((terms, self.term), (stems, self.stem)):
            for w in words:
                node = 0
                for c in w:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                    node = self.children[node][c]
                ends[node] = w
        self.edits = [0] * len(self.children)  # most edits any term below a node allows
        for w in terms:
            node, allowed = 0, self.allowed(w)
            for c in ("", *w):
                node = self.children[node][c] if c else node
                self.edits[node] = max(self.edits[node], allowed)
        self.start = self._close({(0, 0, "")})
        self.next: dict[tuple, frozenset] = {}
        self.memo: dict[str, tuple | None] = {}

    @staticmethod
    def allowed(term: str) -> int:
        return 0 if len(term) < 5 else 1 if len(term) < 9 else 2

    def _close(self, states: set) -> frozenset:
        """With the characters of a term that the word leaves out."""
        todo = list(states)
        while todo:
            node, e, wait = todo.pop()
            if node >= 0 and not wait:
                for child in self.children[node].values():
                    new = (child, e + 1, "")
                    if e + 1 <= self.edits[child] and new not in states:
                        states.add(new)
                        todo.append(new)
        return frozenset(states)

    def _step(self, states: frozenset, c: str) -> frozenset:
        out = set()
        for node, e, wait in states:
            if node < 0:  # inside a word that began with a stem
                out.add((node, e, wait))
                continue
            if wait:  # second half of a swap
                if wait == c:
                    out.add((node, e, ""))
                continue
            for name, child in self.children[node].items():
                if name == c:
                    out.add((child, e, ""))
                    if e == 0 and child in self.stem:
                        out.add((-child, 0, ""))
                elif e + 1 <= self.edits[child]:
                    out.add((child, e + 1, ""))
                    far = self.children[child].get(c)
                    if far is not None and e + 1 <= self.edits[far]:
                        out.add((far, e + 1, name))
            if e + 1 <= self.edits[node]:
                out.add((node, e + 1, ""))
        return self._close(out)

    def find(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term, or (stem, 0)."""
        if word in self.memo:
            return self.memo[word]
        states = self.start
        for c in word:
            key = (states, c)
            states = self.next.get(key)
            if states is None:
                states = self._step(key[0], c)
                if len(self.next) < 500_000:
                    self.next[key] = states
            if not states:
                break
        best = None
        for node, e, wait in states:
            name = self.stem.get(-node) if node < 0 else self.term.get(node) if not wait else None
            if name is not None and e <= (0 if node < 0 else self.allowed(name)):
                got = (e, -len(name), name)
                best = got if best is None or got < best else best
        if len(self.memo) > 300_000:
            self.memo.clear()
        self.memo[word] = out = best and (best[2], best[0])
        return out

    def __getstate__(self):
        return {**self.__dict__, "memo": {}, "next": {}}


@dataclass
class Model:
    """Terms with their weights, spellings that are clean, and the logistic weights."""

    weight: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    clean: frozenset[str] = frozenset()
    coef: tuple[float, ...] = ()
    base: float = 0.0
    _auto: Automaton | None = None

    @property
    def auto(self) -> Automaton:
        if self._auto is None:
            self._auto = Automaton(list(self.weight), list(self.stems))
        return self._auto

    def __getstate__(self):
        return {**self.__dict__, "_auto": None}

    def features(self, text: str | None) -> list[float]:
        """[any hit, log of the weighed hits, log of the hits that are no quotation, hits per 100 words]."""
        found = [] if not text else words_of(text)
        hits = {w: h for w in set(found) if (h := self.auto.find(w)) and not (h[1] and w in self.clean)}
        if not hits:
            return [0.0, 0.0, 0.0, 0.0]
        total = open_ = 0.0
        spans = [(m.start(), m.end(), w) for m, w in zip(_WORD.finditer(text), found)]
        quotes = quotations(text)
        for i, (start, _, w) in enumerate(spans):
            if w in hits:
                name, edits = hits[w]
                value = (self.weight.get(name) or self.stems.get(name, 0.0)) * 0.7**edits
                meant = self._meant(spans, i, quotes, start)
                total += value * (QUOTED + (1.0 - QUOTED) * meant)
                open_ += meant
        return [min(1.0, total / 3.0), math.log1p(total), math.log1p(open_), 100.0 * open_ / len(found)]

    @staticmethod
    def _meant(spans: list, i: int, quotes: list[tuple[int, int, int]], start: int) -> float:
        """How far a hit speaks for its text: 0 for a word that is quoted or talked about, rising with the length of the quotation to
        1 for words in quotations of more than two windows, and outside of any."""
        if any(spans[j][2] in _ABOUT for j in range(max(0, i - 3), i)):
            return 0.0
        k = bisect.bisect_right(quotes, (start, 1 << 62, 0)) - 1
        return min(1.0, (quotes[k][2] - 1) / (2 * WINDOW)) if k >= 0 and start < quotes[k][1] else 1.0

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.coef:
            return np.full(len(texts), self.base)
        x = np.array([self.features(t) for t in texts], dtype=float).reshape(-1, 4)
        return 1.0 / (1.0 + np.exp(-np.clip(x @ np.array(self.coef[1:]) + self.coef[0], -30, 30)))


def _prefixes(text: str) -> set[str]:
    """Distinct words and (with a closing ``~``) their prefixes of 3 to 8 letters."""
    words = set(words_of(text))
    return words.union(w[:k] + "~" for w in words for k in range(3, min(9, len(w))))


def _counts(rows: DataFrame, wanted: frozenset | None, least: int = 1) -> dict[str, int]:
    """In how many rows each word or prefix (of ``wanted``) occurs, from ``least`` on; combined per batch before the shuffle."""

    def run(batches):
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                got = _prefixes(text or "")
                seen.update(got if wanted is None else got & wanted)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])

    got = rows.select("text").mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return {r["w"]: r["n"] for r in got.where(F.col("n") >= least).collect()}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of ``docs(doc_id, text)`` and ``labels(doc_id, label)``."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    n = known.count()
    share = min(1.0, sample / max(1, n))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * share))  # about `sample` rows
    rows = cut(docs.join(F.broadcast(chosen), "doc_id").select("text", "label"))
    toxic, clean = rows.where("label = 1"), rows.where("label <> 1")
    nt, nc = toxic.count(), clean.count()
    if not nt or not nc:
        return Model(base=nt / max(1, nt + nc))
    hot = _counts(toxic, None, max(5, nt // 200))  # a share of the rows, so their number doesn't grow with the table
    cold = _counts(clean, frozenset(hot))
    odds = {w: math.log((n + 0.5) / (nt + 1)) - math.log((cold.get(w, 0) + 0.5) / (nc + 1)) for w, n in hot.items()}
    good = sorted((w for w in hot if odds[w] >= 3.0), key=lambda w: (-hot[w], w.endswith("~"), -len(w), w))
    # which rows each candidate covers, from the rows of the sample alone
    covers: dict[str, set] = {w: set() for w in good}
    wanted = frozenset(good)
    for i, r in enumerate(toxic.toLocalIterator()):
        for w in _prefixes(r["text"] or "") & wanted:
            covers[w].add(i)
    covered: set[int] = set()
    for w in good:  # frequent words first: stems are for the rows beyond them
        if not w.endswith("~") and hot[w] >= max(5, nt // 50):
            covered |= covers[w]
    stems: list[str] = []
    for w in good:
        new = covers[w] - covered
        if w.endswith("~") and len(new) >= max(4, nt // 200):
            stems.append(w)
            covered |= covers[w]
    begun = tuple(s[:-1] for s in stems)
    terms = [w for w in good if not w.endswith("~") and not w.startswith(begun)]
    model = Model({t: odds[t] for t in terms}, {s[:-1]: odds[s] for s in stems})

    def spellings(batches):
        for batch in batches:
            found = {w for t in batch.column(0).to_pylist() for w in words_of(t or "") if (h := model.auto.find(w)) and h[1]}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["w"])

    model.clean = frozenset(r["w"] for r in clean.select("text").mapInArrow(spellings, "w string").distinct().collect())

    def features(batches):
        for batch in batches:
            x = [model.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], names=["x", "y"])

    got = rows.mapInArrow(features, "x array<double>, y int").collect()
    x, y = np.array([r["x"] for r in got]), np.array([1.0 if r["y"] == 1 else 0.0 for r in got])
    model.coef = tuple(float(c) for c in _logistic(x, y))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Weights (intercept first) by Newton steps on the ridge-penalised log-likelihood."""
    a = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9), a.T @ (y - p) - penalty * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list:
        s = held.value.score(batch.column(text).to_pylist())
        return [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))]

    return append(docs, "score double, predicted int", run, drop)


def query(spark: SparkSession, sf: str) -> DataFrame:
    docs = pick(table(spark, sf, "documents"), doc_id="doc_id", text="text")
    model = fit(docs, pick(table(spark, sf, "labels"), doc_id="doc_id", label="toxic"))
    scored = score(docs, model, drop=("text",))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op4_toxicity": (query, None)}
