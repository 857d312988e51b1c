"""Row positions in a global order without a single-task window."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.session import cut

_LOW_BITS = (1 << 33) - 1


def with_position(df: DataFrame, order: list[Column], name: str = "position", parts: int | None = None) -> DataFrame:
    """1-based position in the global ``order`` (which must be total), sorted in ``parts`` ranges where given.

    A range-partitioned sort numbers the rows of each partition; the partition offsets are one row
    per partition, so their running sum is small whatever the data size."""
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order) if parts else df.orderBy(*order)
    placed = cut(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33).alias("_part")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = placed.withColumn("_part", F.shiftright("_mid", 33)).join(F.broadcast(starts), "_part")
    place = F.col("_start") + F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)) + 1
    return out.withColumn(name, place.cast("bigint")).drop("_mid", "_part", "_start")
