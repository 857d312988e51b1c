"""The containment index of target employers against the plain rule."""
import random

import pytest
from pyspark.sql import functions as F

from vacantia.functions.names import company_matches
from vacantia.operators import targets as T
from vacantia.operators.criteria import Criteria

WORDS = ["Inc", "red", "widget", "Bolt", "north", "GmbH", "42", "ün", "data", "clay"]


def names(seed, n, longest):
    """Names of few words, so that many contain each other; a third of them hold the same word."""
    draw = random.Random(seed)
    out = [draw.choice([" ", ", ", "-"]).join(draw.sample(WORDS, draw.randint(1, longest)) + ["Inc"] * (i % 3 == 0)) for i in range(n)]
    return out + [None, "", "  ", "!?", "é", out[0], out[0].upper()]


def words(name):
    import re
    return set(re.findall("[a-z0-9]+", (name or "").lower()))


def fits(a, b):
    a, b = words(a), words(b)
    return bool(a and b and (a <= b or b <= a))


@pytest.mark.parametrize("longest,width", [(3, 2), (2, 4)])
def test_links_and_rows_equal_the_plain_rule(spark, longest, width):
    have, want = names(longest, 60, longest), names(width + 7, 25, width)
    rows = spark.createDataFrame(list(enumerate(have)), "key long, company string")
    aims = spark.createDataFrame([(w,) for w in want], "target string")
    links = [tuple(r) for r in T.target_links(rows, aims).collect()]
    assert sorted(links) == sorted({(h, w) for h in have for w in want if fits(h, w)})
    kept = [r["key"] for r in T.at_targets(rows, aims).collect()]
    assert sorted(kept) == [k for k, h in enumerate(have) if any(fits(h, w) for w in want)]


def test_predicate_and_join_keep_the_same_rows(spark, monkeypatch):
    rows = spark.createDataFrame(list(enumerate(names(5, 80, 3))), "key long, company string")
    crit = Criteria(target_companies=("red widget", "Clay, 42 north", " ", "data"))
    one = sorted(r["key"] for r in T.only_targets(rows, crit).collect())
    monkeypatch.setattr(T, "INLINE_TARGETS", 0)
    assert sorted(r["key"] for r in T.only_targets(rows, crit).collect()) == one
    assert sorted(r["key"] for r in rows.where(
        company_matches(F.col("company"), "red widget") | company_matches(F.col("company"), "Clay, 42 north") | company_matches(F.col("company"), "data")).collect()) == one
    assert T.only_targets(rows, Criteria(target_companies=(" ",))).count() == rows.count()


def test_no_targets_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "Acme")], "key long, company string")
    none = spark.createDataFrame([], "target string")
    assert T.at_targets(rows, none).isEmpty() and T.target_links(rows, none).isEmpty()
    assert T.at_targets(rows.limit(0), spark.createDataFrame([("Acme",)], "target string")).isEmpty()


def test_plan_does_not_grow_with_the_targets(spark):
    rows = spark.range(1000).select("id", F.concat(F.lit("Company "), F.col("id")).alias("company"))

    def plan(n):
        crit = Criteria(target_companies=tuple(f"Company {i} Holding" for i in range(n)))
        return T.only_targets(rows, crit)

    size = lambda df: df._jdf.queryExecution().executedPlan().toString().count("\n")
    few, many = plan(100), plan(100_000)
    assert size(few) == size(many) and "Cartesian" not in many._jdf.queryExecution().executedPlan().toString()
    assert many.count() == 1000
