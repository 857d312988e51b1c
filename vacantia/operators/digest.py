"""Digest tables: groups, source health, funnel, scoring outcome and the send decision."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia.operators.positions import with_position
from vacantia.session import cut


def group_sizes(df: DataFrame) -> DataFrame:
    """Rows per source, largest group first, then by name."""
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


def digest_order(df: DataFrame) -> DataFrame:
    """Ranked postings in presentation order: ``position`` overall and ``place`` in the group.

    Groups by size then name; inside a group newest first, undated last, ties by relevance. The group counts, one row per source,
    tell how many rows stand before a group, so the wide rows are sorted once and joined with nothing else."""
    before = Window.orderBy(F.desc("group_size"), "source").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut(df.groupBy("source").agg(F.count(F.lit(1)).alias("group_size")).withColumn("_before", F.coalesce(F.sum("group_size").over(before), F.lit(0))))
    order = [F.col("_before"), F.desc_nulls_last("posted_date"), F.desc("relevance"), F.col("ord")]
    placed = with_position(df.withColumnRenamed("source", "_source").join(sizes, F.col("_source").eqNullSafe(F.col("source"))).drop("_source"), order)
    return placed.withColumn("place", F.col("position") - F.col("_before")).select(*df.columns, "group_size", "position", "place")


def source_health(log: DataFrame, rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Per enabled source: ok, count, error, near_empty.

    ``log``: source, board, board_ord, ok, error per fetched board; ``rows``: postings kept per
    source (source, n); ``sources``: the registry (source, source_ord, is_scraped). A board feed
    fails only when every board failed; only then are its board names put into the message."""
    per = log.groupBy("source").agg(
        F.count(F.lit(1)).alias("boards"),
        F.count_if(~F.col("ok")).alias("bad"),
        F.min_by("error", F.when(~F.col("ok"), F.col("board_ord"))).alias("first_error"),
    )
    down = per.where(F.col("bad") == F.col("boards")).select("source")
    listed = F.array_sort(F.collect_list(F.struct("board_ord", "board")))
    names = log.join(down, "source", "left_semi").groupBy("source").agg(
        F.array_join(F.transform(listed, lambda s: s["board"]), ", ").alias("names"))
    joined = sources.join(per, "source", "left").join(names, "source", "left").join(rows, "source", "left")
    failed = F.coalesce(F.col("bad") == F.col("boards"), F.lit(False))
    text = F.concat(F.lit("RuntimeError: all "), F.col("boards"), F.lit(" "), F.col("source"),
                    F.lit(" board(s) failed: "), F.col("names"))
    n = F.when(failed, F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).cast("bigint")
    return joined.select(
        "source", "source_ord", (~failed).alias("ok"), n.alias("count"),
        F.when(failed, F.when(F.col("is_scraped"), F.col("first_error")).otherwise(text)).alias("error"),
        (~failed & (n == 0)).alias("near_empty"),
    )


# The stages whose row counts a run reports.
STAGES = ("fetched", "after_dedup", "after_filter", "seen_skipped", "llm_scored", "after_llm", "new")


def funnel(spark, stages: dict[str, DataFrame]) -> DataFrame:
    """One row with a count per stage; stages left out count 0."""
    tagged = None
    for name, df in stages.items():
        one = df.select(F.lit(name).alias("stage"))
        tagged = one if tagged is None else tagged.unionByName(one)
    return tagged.agg(*[F.count_if(F.col("stage") == s).alias(s) for s in STAGES])


def score_outcome(scored: DataFrame) -> DataFrame:
    """Scored and failed rows of a batch with the first error in arrival order."""
    bad = F.col("score_error").isNotNull()
    out = scored.agg(
        F.count_if(F.col("llm_score").isNotNull() & ~bad).alias("scored"),
        F.count_if(bad).alias("failed"),
        F.min_by("score_error", F.when(bad, F.col("ord"))).alias("error"),
    )
    return out.withColumn("systemic", (F.col("failed") > 0) & (F.col("scored") == 0))


# The texts of the subject line and of a dead source's error.
def run_decision(health: DataFrame, new_rows: DataFrame, prefix: str = "[Job Digest]", send_empty_digest: bool = False,
                 send_on_total_failure: bool = True) -> DataFrame:
    """One row: all_failed, new, send and subject. ``new_rows`` has one row with column ``new``."""
    state = health.agg(F.count(F.lit(1)).alias("attempted"), F.count_if(~F.col("ok")).alias("bad"))
    all_failed = (F.col("attempted") > 0) & (F.col("attempted") == F.col("bad"))
    flags = state.select(all_failed.alias("all_failed"), F.lit(1).alias("one"))
    # Both sides are a single aggregated row.
    both = flags.join(new_rows.select("new", F.lit(1).alias("one")), "one")
    send = F.when(F.col("new") > 0, True).when(F.col("all_failed"), send_on_total_failure).otherwise(send_empty_digest)
    plural = F.when(F.col("new") == 1, "").otherwise("s")
    subject = F.when(F.col("all_failed"), F.lit(f"{prefix} ⚠ all sources failed")).otherwise(
        F.concat(F.lit(f"{prefix} "), F.col("new"), F.lit(" new job"), plural))
    return both.select("all_failed", "new", send.alias("send"), subject.alias("subject"))
