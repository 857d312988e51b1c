"""Board-level operators: row caps and company-to-board resolution."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions.names import slug_candidates


def cap_per_board(df: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of each (source, board) in feed order.

    The literal limit lets Spark cut every board inside the map tasks before the shuffle."""
    order = Window.partitionBy("source", "board").orderBy("ord")
    return df.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= limit).drop("_rn")


def resolve_boards(companies: DataFrame, boards: DataFrame) -> DataFrame:
    """(company, ats, slug, open_count): per company and board vendor the first slug that exists.

    ``companies``: company; ``boards``: ats, slug, open_count. Slugs compare case-sensitively."""
    tries = companies.select("company").distinct().select(
        "company", F.posexplode(slug_candidates(F.col("company"))).alias("pos", "slug"))
    hits = tries.join(boards, "slug")
    best = hits.groupBy("company", "ats").agg(F.min_by(F.struct("slug", "open_count"), "pos").alias("b"))
    return best.select("company", "ats", "b.slug", "b.open_count")
