"""Mixing against a plain sequential version, and its odds."""
import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vacantia.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, limit=2.0):
    """Reshare round by round until no source is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= limit * sizes[s]}
        if not over:
            target.update({s: weight[s] * level for s in free})
            break
        target.update({s: limit * sizes[s] for s in over})
        free -= over
    return target


def plain_level(docs, target, limit=2.0):
    """Expected copies by bisection: docs are (size, preference)."""
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(limit, mid * p) * s for s, p in docs) < target:
            low = mid
        else:
            high = mid
    return high


def plain_mix(rows, preference, seed="mix"):
    """{row number: copies}; rows are (id, source, size)."""
    by = defaultdict(list)
    for i, r in enumerate(rows):
        by[r[1]].append(i)
    targets = plain_targets({s: sum(rows[i][2] for i in ids) for s, ids in by.items()})
    out = {}
    for source, ids in by.items():
        level = plain_level([(rows[i][2], preference(rows[i][2])) for i in ids], targets[source] - 1e-7)
        e = {i: min(2.0, level * preference(rows[i][2])) for i in ids}
        sure = {i: int(e[i] + 1e-7) for i in ids}
        goal, ranked = targets[source] - sum(sure[i] * rows[i][2] for i in ids), []
        for i in ids:
            p = e[i] - sure[i]
            if p > 1e-6:
                name = str(rows[i][0]) if rows[i][0] is not None else "-"
                u = (int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                ranked.append((u / (1 - u) * (1 - p) / p, name, rows[i][2], i))
        below = 0
        for _, _, size, i in sorted(ranked):
            sure[i] += bool(size) and below + size / 2 <= goal
            below += size
        out.update(sure)
    return targets, out


SCHEMA = "id long, src string, n long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.mark.parametrize("few", [10_000, 1])
def test_equals_plain_version(spark, few):
    dice = random.Random(3)
    rows = [(i, dice.choice(["a", "B", "é", None, "hot", "hot", "hot"]), dice.choice([0, 1, 5, 50, dice.randrange(3000)])) for i in range(600)]
    prefer = lambda n: 0.25 if n > 1000 else 0.5 if n > 100 else 1.0
    got = mixing.mix(frame(spark, rows), "id", "src", "n", few=few,
                     preference=F.when(F.col("n") > 1000, 0.25).when(F.col("n") > 100, 0.5).otherwise(1.0)).collect()
    targets, copies = plain_mix(rows, prefer)
    assert len(got) == len(rows)
    for r in got:
        assert r["target"] == pytest.approx(targets[r["src"]])
        assert (r["id"], r["taken"]) == (r["id"], copies[r["id"]] * r["n"] if r["n"] else 0)
        assert r["taken"] <= 2 * r["n"]


def test_words_meet_the_targets_within_half_a_document(spark):
    dice = random.Random(4)
    rows = [(i, "s" + str(i % 7), dice.randrange(1, 400)) for i in range(1500)]
    got = mixing.mix(frame(spark, rows), "id", "src", "n", preference=mixing.short_first(F.col("n"))).groupBy("src").agg(
        F.sum("taken").alias("t"), F.first("target").alias("target"), F.max("n").alias("most")).collect()
    assert len(got) == 7 and all(abs(r["t"] - r["target"]) <= r["most"] / 2 for r in got)


def test_inclusion_follows_the_odds(spark):
    """Over many seeds a document's extra copy comes about as often as its inclusion probability says."""
    rows = [(i, "a" if i < 40 else "b", 100) for i in range(80)]
    times = defaultdict(int)
    for seed in range(15):
        for r in mixing.mix(frame(spark, rows), "id", "src", "n", share=0.5, preference=F.when(F.col("id") % 4 == 0, 0.25).otherwise(1.0), seed=str(seed)).collect():
            times[r["id"] % 4 == 0, r["src"]] += r["copies"]
    targets = plain_targets({"a": 4000, "b": 4000}, share=0.5)
    level = plain_level([(100, 0.25 if i % 4 == 0 else 1.0) for i in range(40)], targets["b"])
    assert times[True, "b"] / (15 * 10) == pytest.approx(level * 0.25, abs=0.08)
    assert times[False, "b"] / (15 * 30) == pytest.approx(level, abs=0.08)


def test_equal_rows_of_a_hot_id(spark):
    """A third of all rows are one row: the boundary falls inside them and each copy still counts once."""
    rows = [(None, "hot", 10)] * 400 + [(i, "hot", 10) for i in range(300)] + [(i, "x", 10) for i in range(300)]
    for seed in ("mix", "other"):
        got = mixing.mix(frame(spark, rows), "id", "src", "n", few=1, share=0.9, seed=seed).collect()
        assert len(got) == len(rows)
        for source in ("hot", "x"):
            mine = [r for r in got if r["src"] == source]
            assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 5
        assert max(r["copies"] for r in got) <= 2


def test_nulls_empty_tables_and_clashing_columns(spark):
    rows = [(1, None, None, "x"), (None, "a", 5, "y"), (2, "a", 0, None)]
    extra = ["taken", "key", "s_no", "more", "_c0", "e", "p", "salt", "at", "of", "step", "b_key", "TARGET"]
    df = spark.createDataFrame(rows, "id long, src string, n long, z string")
    for name in extra:
        df = df.withColumn(name, F.lit("mine"))
    got = mixing.mix(df, "id", "src", "n")
    kept = [x for x in extra if x not in ("taken", "TARGET")]
    assert set(got.columns) == {"id", "src", "n", "z", *kept, *mixing.NEW}
    out = got.collect()
    assert len(out) == 3 and all(r[x] == "mine" for r in out for x in kept)
    assert {(r["id"], r["taken"]) for r in out if r["n"] != 5} == {(1, 0), (2, 0)}
    assert mixing.mix(df.limit(0), "id", "src", "n").count() == 0


def test_sizes_of_texts(spark):
    texts = [None, "", " \t\n", "one", "a b\x0bc d", "word " * 50_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(mixing.words(F.col("t"))).collect()] == [0, 0, 0, 1, 3, 50_000]


def test_no_python_in_the_plan(spark):
    df = frame(spark, [(i, "a", i) for i in range(50)])
    plan = mixing.mix(df, "id", "src", "n")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
