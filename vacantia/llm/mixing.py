"""Mixing sources to target weights by Pareto order sampling.

Targets: all sources together give ``share`` times all words. Each source's target is its part of that by weight, but at most
``limit`` times its own words; the excess goes to the others by weight until no target is above its limit. As the level at which
sources reach their limit grows in the order of limit over weight, one pass over the sources (one row each) in that order
settles all rounds at once.

Copies: a document is expected ``e = least(limit, level * preference)`` times, with the level of each source chosen so that the
expected words meet its target. Preferences are read in steps of 1/64, so a source has at most 64 cells of equal ``e``. The
whole part of ``e`` is certain. The rest ``p`` is the inclusion probability of one more copy: documents are ranked by their random
odds ``u / (1 - u)`` over their inclusion odds ``p / (1 - p)`` (Pareto order sampling, Rosén 1997), and each source takes the
lowest ranks up to its residual words. The sample has a fixed size *in words*: it ends at the document boundary nearest to the
residual, so a source misses its target by at most half of one document.

The last rank taken is found without sorting: ranks are 48-bit keys, and each round sums the words of the next 12 bits below the
prefix that holds the boundary (a radix selection), with partial sums before every shuffle. A source with a third of all rows is
thus only ever aggregated. Copies of a document share rank and size; they are counted, not listed.

Random odds come from md5 over seed and id, so reruns agree whatever the partitioning. Everything is DataFrame functions.

Defined results: a null text or one without words has size 0 and takes 0 words. A null id counts as an id of its own, a null source
as a source that stands last. Repeated rows are documents of their own; among equal rows it isn't defined which one gets a copy.
Empty tables give empty tables. Other columns pass through; columns named like new ones are replaced."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.llm.common import pick, table
from vacantia.operators.positions import with_position
from vacantia.session import cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0
STEPS = 64
KEY_BITS, DIGIT_BITS = 48, 12
#: Ranks left in a boundary interval from which on they are ordered one by one.
FEW = 10_000
NEW = ("source_size", "target", "copies", "taken")

c = F.col


def words(text: Column) -> Column:
    """Number of words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def short_first(size: Column) -> Column:
    """Preference of the registered mix: 8/8 for a document of no words down to 8/23 for 20,000 words, by the binary digits of its size."""
    return 8.0 / (8 + F.when(size > 0, F.length(F.bin(size))).otherwise(0))


def _targets(sizes: DataFrame, weights: tuple, share: float, limit: float) -> DataFrame:
    """One row per source: s_no (place in code point order, null last), source_size, target. ``sizes``: source, source_size."""
    by_name = Window.orderBy(c("source").asc_nulls_last())
    listed = sizes.withColumn("s_no", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(c("s_no") - 1, F.lit(len(weights))) + 1))
    cap = c("source_size") * limit
    level = Window.orderBy(cap / c("weight"), "s_no")
    before, after = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    step = listed.withColumn("left", left).withColumn("open", F.sum("weight").over(after)).withColumn(
        "full", cap * c("open") <= c("weight") * c("left"))
    # the first source that isn't full has the level of all that follow
    rest = F.max(F.when(~c("full"), F.struct(c("open"), c("left")))).over(everything)
    return step.withColumn("target", F.when(c("full"), cap).otherwise(c("weight") * rest["left"] / rest["open"])).select(
        "source", "s_no", "source_size", "target")


def _cells(sums: DataFrame, targets: DataFrame, limit: float) -> DataFrame:
    """Certain copies and inclusion probability per source and preference. ``sums``: source, pref, cell_size."""
    cells = sums.withColumnRenamed("source", "of").join(targets, c("of").eqNullSafe(c("source"))).drop("of")
    falling = Window.partitionBy("s_no").orderBy(c("pref").desc())
    before, after = falling.rowsBetween(Window.unboundedPreceding, -1), falling.rowsBetween(0, Window.unboundedFollowing)
    per_source = Window.partitionBy("s_no")
    cells = cells.withColumn("left", c("target") - F.coalesce(F.sum("cell_size").over(before), F.lit(0)) * limit).withColumn(
        "open", F.sum(c("pref") * c("cell_size")).over(after)).withColumn("full", c("open") * limit <= c("pref") * c("left"))
    rest = F.max(F.when(~c("full"), F.struct(c("open"), c("left")))).over(per_source)
    expected = F.when(c("full"), F.lit(limit)).otherwise(F.least(F.lit(limit), c("pref") * rest["left"] / rest["open"]))
    return cells.withColumn("e", F.greatest(F.coalesce(expected, F.lit(0.0)), F.lit(0.0))).withColumn("sure", F.floor("e").cast("int")).withColumn(
        "p", c("e") - c("sure")).withColumn("residual", c("target") - F.sum(c("sure") * c("cell_size")).over(per_source)).select(
        "source", "s_no", "pref", "source_size", "target", "sure", "p", "residual")


def _rank(id_text: Column, p: Column, seed: str) -> Column:
    """Random odds over inclusion odds as a whole number below 2**48; null where nothing is left to chance."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_text).cast("binary")), 1, 13), 16, 10).cast("double")
    u = (bits + 0.5) / float(1 << 52)
    q = (u / (1 - u)) * ((1 - p) / p)
    return F.when(p > 0, F.floor(q / (1 + q) * float(1 << KEY_BITS)).cast("bigint"))


def _boundaries(rows: DataFrame, residuals: DataFrame, few: int) -> DataFrame:
    """Where each source's sample ends: s_no, key, id, size of the last copies looked at, how many of its ``n`` rows are taken (``k``).

    ``rows``: s_no, key, id, size; ``residuals``: s_no, residual."""
    state = residuals.select("s_no", c("residual").alias("goal"), F.lit(0).cast("bigint").alias("prefix"))
    bits = 0

    def inside() -> DataFrame:
        return rows.join(state, "s_no").where(F.shiftright("key", KEY_BITS - bits) == c("prefix"))

    def crossing(sums: DataFrame, *order: str) -> DataFrame:
        """The last of the ordered sums before which the goal isn't reached, or the first one."""
        upto = Window.partitionBy("s_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
        reached = sums.where((c("before") < c("goal")) | (c("before") == 0))
        last = F.max(F.struct(*order, *[x for x in reached.columns if x not in order])).alias("x")
        return reached.groupBy("s_no").agg(last).select("x.*").withColumn("goal", c("goal") - c("before"))

    while bits < KEY_BITS:
        bits += DIGIT_BITS
        digit = F.shiftright("key", KEY_BITS - bits).alias("digit")
        sums = rows.join(state, "s_no").where(F.shiftright("key", KEY_BITS - bits + DIGIT_BITS) == c("prefix")).groupBy("s_no", "goal", digit).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("many"))
        found = cut(crossing(sums, "digit").select("s_no", "goal", c("digit").alias("prefix"), "many"))
        state = found.drop("many")
        if (found.agg(F.max("many")).first()[0] or 0) <= few:
            break
    groups = inside().groupBy("s_no", "goal", "key", "id", "size").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    last = crossing(groups, "key", "id", "size")
    k = F.when(c("size") > 0, F.least(c("n"), F.greatest(F.lit(0), F.floor(c("goal") / c("size") + 0.5)))).otherwise(0)
    return last.select("s_no", c("key").alias("b_key"), c("id").alias("b_id"), c("size").alias("b_size"), c("n").alias("b_n"), k.cast("bigint").alias("b_k"))


def mix(df: DataFrame, id: str, source: str, size: str, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT,
        preference: Column | None = None, seed: str = "mix", few: int = FEW) -> DataFrame:
    """``df`` with source_size, target (of its source), copies and taken (copies times size).

    ``preference`` (over 0, at most 1, in steps of 1/64) is an expression over the columns of ``df``; without it all documents of a
    source have the same chance. Pass slim rows: they are written once and read several times."""
    names = [n for n in df.columns if n.lower() not in NEW]
    held = [c(f"`{n}`").alias(f"_c{i}") for i, n in enumerate(names)]
    steps = F.lit(STEPS) if preference is None else F.least(F.lit(STEPS), F.greatest(F.lit(1), F.ceil(preference * STEPS)))
    slim = cut(df.select(
        *held, F.coalesce(c(f"`{id}`").cast("string"), F.lit("-")).alias("id"), c(f"`{source}`").cast("string").alias("of"),
        F.coalesce(c(f"`{size}`").cast("bigint"), F.lit(0).cast("bigint")).alias("size"), F.coalesce(steps, F.lit(STEPS)).cast("int").alias("step")))
    sums = cut(slim.groupBy(c("of").alias("source"), c("step").alias("pref")).agg(F.sum("size").alias("cell_size")))
    targets = _targets(sums.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, share, limit)
    cells = cut(_cells(sums, targets, limit))
    rows = slim.join(cells, c("of").eqNullSafe(c("source")) & (c("step") == c("pref"))).withColumn("key", _rank(c("id"), c("p"), seed))

    ends = cut(_boundaries(rows.where(c("key").isNotNull()).select("s_no", "key", "id", "size"), cells.select("s_no", "residual").distinct(), few))
    judged = rows.join(ends.withColumnRenamed("s_no", "b_no"), c("s_no") == c("b_no"), "left")
    place, end = F.struct("key", "id", "size"), F.struct("b_key", "b_id", "b_size")
    more = F.when(c("key").isNull() | c("b_no").isNull() | (place > end), 0).when(place < end, 1)
    judged = judged.withColumn("more", F.coalesce(more, F.when(c("b_k") == c("b_n"), 1).when(c("b_k") == 0, 0)))
    out = judged.where(c("more").isNotNull())
    if not ends.where("b_k > 0 and b_k < b_n").isEmpty():
        # equal rows of which some get a copy: numbered over all partitions
        equal = judged.where(c("more").isNull())
        equal = with_position(equal.withColumn("salt", F.monotonically_increasing_id()), [c("s_no"), c("salt")], "at")
        first = equal.groupBy("s_no").agg(F.min("at").alias("first")).withColumnRenamed("s_no", "f_no")
        equal = equal.join(first, c("s_no") == c("f_no")).withColumn("more", F.when(c("at") - c("first") < c("b_k"), 1).otherwise(0))
        out = out.unionByName(equal.select(*out.columns))
    copies = (c("sure") + c("more")).cast("int")
    return out.select(*[c(f"_c{i}").alias(n) for i, n in enumerate(names)], "source_size", "target", copies.alias("copies"), (copies * c("size")).alias("taken"))


def query(spark: SparkSession, sf: str) -> DataFrame:
    docs = pick(table(spark, sf, "documents"), doc_id="doc_id", source="source", text="text")
    slim = docs.select("doc_id", "source", words(c("text")).alias("size"))
    return mix(slim, "doc_id", "source", "size", preference=short_first(c("size"))).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


SQL = rf"""WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sized AS (SELECT *, CAST(least({STEPS}, ceil(8.0::DOUBLE / (8 + CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END) * {STEPS})) AS INTEGER) AS pref FROM docs),
named AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS s_no FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(s_no - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM named),
level AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, s_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
  sum(weight) OVER (ORDER BY cap / weight, s_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM weighed),
filled AS (SELECT *, cap * open <= weight * room AS is_full FROM level),
targets AS (SELECT source, s_no, source_size, CASE WHEN is_full THEN cap ELSE
    weight * (SELECT arg_max(room, open) FROM filled WHERE NOT is_full) / (SELECT max(open) FROM filled WHERE NOT is_full) END AS target FROM filled),
sums AS (SELECT source, pref, sum(size) AS cell_size FROM sized GROUP BY source, pref),
cells AS (SELECT t.*, pref, cell_size, target - 2.0::DOUBLE * coalesce(sum(cell_size) OVER (PARTITION BY s_no ORDER BY pref DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
  sum(pref * cell_size) OVER (PARTITION BY s_no ORDER BY pref DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM sums JOIN targets t ON t.source IS NOT DISTINCT FROM sums.source),
cells2 AS (SELECT *, open * 2.0::DOUBLE <= pref * room AS is_full FROM cells),
rest AS (SELECT s_no, max(open) AS open, arg_max(room, open) AS room FROM cells2 WHERE NOT is_full GROUP BY s_no),
chances AS (SELECT x.*, greatest(coalesce(CASE WHEN is_full THEN 2.0 ELSE least(2.0, pref * r.room / r.open) END, 0), 0)::DOUBLE AS e FROM cells2 x LEFT JOIN rest r USING (s_no)),
split AS (SELECT *, floor(e) AS sure, e - floor(e) AS p, target - sum(floor(e) * cell_size) OVER (PARTITION BY s_no) AS residual FROM chances),
drawn AS (SELECT d.doc_id, d.size, s.*, (CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '-')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN split s ON s.source IS NOT DISTINCT FROM d.source AND s.pref = d.pref),
odds AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS q FROM drawn),
ranked AS (SELECT *, CASE WHEN p > 0 THEN coalesce(sum(size) OVER (PARTITION BY s_no, p > 0 ORDER BY CAST(floor(q / (1 + q) * 281474976710656.0::DOUBLE) AS BIGINT),
  coalesce(CAST(doc_id AS VARCHAR), '-'), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS below FROM odds)
SELECT doc_id, size, source_size, target, CAST(sure + CASE WHEN size > 0 AND below + size / 2.0::DOUBLE <= residual THEN 1 ELSE 0 END AS INTEGER) AS copies,
  CAST(sure + CASE WHEN below + size / 2.0::DOUBLE <= residual THEN 1 ELSE 0 END AS BIGINT) * size AS taken FROM ranked"""

QUERIES = {"op11_mixing": (query, SQL)}
