"""Target employers by a containment index, for target lists of any size.

A company and a target match when the words of one are all among the words of the other. Whichever is contained has its rarest
word in common with the other, so the contained side is indexed by that word alone and the containing side is looked up by each of
its words. The rarest word is the one that the fewest containing names have; a name with a word that none of them has is contained
in nothing and leaves before the join. Names are joined once each, however many rows bear them. Names without a word, and nulls,
match nothing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.names import name_tokens
from vacantia.operators.criteria import Criteria, at_target

INLINE_TARGETS = 64  # so many targets are a predicate on the scan, more of them a join; the rows are the same


def _names(df: DataFrame, column: str) -> DataFrame:
    """Distinct names with their words."""
    return df.select(F.col(column).alias("name")).distinct().withColumn("tokens", name_tokens(F.col("name"))).where(F.size("tokens") > 0)


def _index(inner: DataFrame, outer: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """Names by their rarest word, containing names by each word, and the condition under which one lies in the other."""
    outer = outer.select(F.col("name").alias("outer"), F.col("tokens").alias("outer_tokens"), F.explode("tokens").alias("outer_word"))
    often = outer.groupBy("outer_word").agg(F.count(F.lit(1)).alias("n"))
    words = inner.select("name", "tokens", F.explode("tokens").alias("word"))
    words = words.join(often, words["word"] == often["outer_word"], "left")
    inner = words.groupBy(F.col("name").alias("inner"), F.col("tokens").alias("inner_tokens")).agg(
        F.min_by("word", F.struct("n", "word")).alias("inner_word"), F.count("n").alias("known"))
    inner = inner.where(F.col("known") == F.size("inner_tokens")).drop("known")
    inside = (F.col("inner_word") == F.col("outer_word")) & (F.size(F.array_except("inner_tokens", "outer_tokens")) == 0)
    return inner, outer, inside


def target_links(companies: DataFrame, targets: DataFrame, company: str = "company", target: str = "target") -> DataFrame:
    """(company, target) for each distinct pair of matching names."""
    have, want = _names(companies, company), _names(targets, target)
    held, holding, inside = _index(want, have)
    below = holding.join(held, inside).select(F.col("outer").alias("company"), F.col("inner").alias("target"))
    held, holding, inside = _index(have, want)
    above = holding.join(held, inside).select(F.col("inner").alias("company"), F.col("outer").alias("target"))
    return below.unionByName(above).distinct()


def at_targets(df: DataFrame, targets: DataFrame, company: str = "company", target: str = "target") -> DataFrame:
    """The rows of ``df`` whose company matches any target. Only whether there is one is asked, so no pairs are made."""
    have, want = _names(df, company), _names(targets, target)
    held, holding, inside = _index(want, have)
    below = holding.join(held, inside, "left_semi").select(F.col("outer").alias("_at_target"))
    held, holding, inside = _index(have, want)
    above = held.join(holding, inside, "left_semi").select(F.col("inner").alias("_at_target"))
    found = below.unionByName(above).distinct()
    return df.join(found, F.col(company) == F.col("_at_target"), "left_semi")


def only_targets(df: DataFrame, criteria: Criteria) -> DataFrame:
    """The rows at the target employers of ``criteria``; all rows where it names none."""
    targets = sorted({t.strip() for t in criteria.target_companies if t.strip()})
    if len(targets) <= INLINE_TARGETS:
        return df.where(at_target(criteria))
    return at_targets(df, df.sparkSession.createDataFrame([(t,) for t in targets], "target string"))
