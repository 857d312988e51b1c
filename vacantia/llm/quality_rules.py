"""Quality rules as one projection: counts of words, symbols and repeated lines and windows against a threshold table.

Only built-in functions are used: no user function, no shuffle, one pass over the text. Repeated 3-word windows are found
by sorting 64-bit numbers (hash above, position below); windows that look equal are then compared by their words, so
the count is exact, and a text costs n log n whatever its length.

Defined results: a null or blank text has no words, counts of 0 and ``base_failed``. Texts of any length are read whole.
Repeated rows are judged alike, each on its own. Empty tables give empty tables. Other columns are ignored."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.text import let
from vacantia.llm.common import SPACE, SPACE_CHARS, pick

SYMBOLS = "#*$%&|<>"
#: Frequent function words; in a text of running sentences they make up a good share of the words. Case and marks around them don't count.
STOP_WORDS = (
    "the of and to in is that for on with as was are this be by it at from or "
    "der die und das von zu mit ist im den nicht ein eine auf für "
    "de la le les et des en un une que est pour dans par "
    "el los las del se por con una para su"
).split()


@dataclass(frozen=True)
class Rule:
    """``value`` (SQL over the base columns) must lie in [low, high] for a text to be kept."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None

    def fails(self) -> Column:
        value = F.expr(self.value)
        out = F.lit(False)
        if self.low is not None:
            out = out | (value < self.low)
        if self.high is not None:
            out = out | (value > self.high)
        return F.coalesce(out, F.lit(False))


#: The threshold table of the registered query.
RULES = (
    Rule("mean_word", "word_chars / n_words", 2.0, 20.0),
    Rule("symbols", "n_symbols / n_words", high=0.2),
    Rule("stop_words", "n_stop_words / n_words", low=0.06),
    Rule("dup_lines", "n_dup_lines / n_lines", high=0.5),
    Rule("upper", "n_upper / word_chars", high=0.5),
)


def _windows_twice(w: Column) -> Column:
    """Number of words of ``w`` inside 3-word windows that occur at least twice."""

    def of(w: Column) -> Column:
        n = F.size(w)
        bits = F.length(F.bin(n.cast("bigint")))
        return let(bits, lambda b: marked(w, n, b))

    def marked(w: Column, n: Column, bits: Column) -> Column:
        low = F.expr("1L") * F.pow(F.lit(2.0), bits).cast("bigint") - 1
        at = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        codes = let(low, lambda m: F.sort_array(F.transform(
            F.sequence(F.lit(0), n - 3), lambda i: at(i).bitwiseAND(F.bitwise_not(m)).bitwiseOR(i.cast("bigint")))))
        return let(codes, lambda s: let(_neighbours(s, lambda x: F.call_function("shiftright", x, bits)), lambda c: F.when(
            F.size(c) > 0, exact(w, c, low)).otherwise(0)))

    def exact(w: Column, codes: Column, low: Column) -> Column:
        def gram(x: Column) -> Column:
            return let(x.bitwiseAND(low).cast("int"), lambda p: F.struct(
                F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2)).alias("g"), p.alias("p")))

        same = let(F.sort_array(F.transform(codes, gram)), lambda s: _neighbours(s, lambda x: x["g"]))
        places = F.sort_array(F.transform(same, lambda x: x["p"]))
        steps = let(places, lambda p: F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return F.when(F.size(w) >= 3, let(w, of)).otherwise(0)


def _neighbours(s: Column, key) -> Column:
    """Entries of the sorted array ``s`` whose key an entry beside them shares."""
    return F.filter(s, lambda x, i: (key(x) == key(F.get(s, i - 1))) | (key(x) == key(F.get(s, i + 1))))


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, the counts, ``failed`` (names of the rules it breaks), base_failed, kept."""
    t = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(t, F.lit(SPACE_CHARS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    solid = F.translate(t, SPACE_CHARS, "")
    stop = rf"(?<!\p{{L}})(?:{'|'.join(dict.fromkeys(STOP_WORDS))})(?!\p{{L}})"
    counts = F.struct(
        F.size("w").cast("bigint").alias("n_words"),
        F.length(solid).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("lines"),
        _windows_twice(F.col("w")).cast("bigint").alias("n_repeat_words"),
        F.regexp_count(F.lower(t), F.lit(stop)).cast("bigint").alias("n_stop_words"),
        F.regexp_count(t, F.lit("[A-Z]")).cast("bigint").alias("n_upper"),
    )
    base = (
        pick(docs, doc_id=doc_id, text=text).withColumn("w", words).select("doc_id", counts.alias("c")).select("doc_id", "c.*")
        .withColumn("n_lines", F.col("lines.n").cast("bigint"))
        .withColumn("n_dup_lines", (F.col("lines.n") - F.col("lines.d")).cast("bigint")).drop("lines")
        .withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    )
    safe = F.when(F.col("n_words") > 0, F.filter(F.array(*[F.when(r.fails(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull()))
    return base.withColumn("failed", F.coalesce(safe, F.array().cast("array<string>"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_upper", "n_lines",
        "failed", "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))


def quality_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same result in DuckDB SQL; the windows are grouped instead of sorted."""
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    fails = []
    for r in rules:
        value = r.value.replace(" /", "::DOUBLE /")
        part = [f"({value}) < {r.low}"] * (r.low is not None) + [f"({value}) > {r.high}"] * (r.high is not None)
        fails.append("coalesce(" + " OR ".join(part) + ", FALSE)")
    stops = ", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
n AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
b AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(translate(text, {blank}, ''))::BIGINT AS word_chars,
  (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(regexp_extract_all(lower(text), '\p{{L}}+'), lambda x: list_contains([{stops}], x)))::BIGINT AS n_stop_words,
  length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, len(l)::BIGINT AS n_lines
  FROM w LEFT JOIN n USING (rid)),
f AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed,
  n_words > 0 AND ({' OR '.join(fails)}) AS rule_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rule_failed AS kept FROM f
"""


def query(spark, sf: str) -> DataFrame:
    from vacantia.llm.common import table

    return quality(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op3_quality_rules": (query, quality_sql())}
