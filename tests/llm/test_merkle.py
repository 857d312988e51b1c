"""Merkle manifests against a tree kept as plain lists."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_levels(digests):
    levels = [list(digests)]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def plain_siblings(levels, i):
    out = []
    for level in levels[:-1]:
        other = i ^ 1
        out.append((level[other], other > i) if other < len(level) else None)
        i //= 2
    return out


def plain_fold(digest, siblings):
    for s in siblings:
        digest = sha(digest if s is None else digest + s[0] if s[1] else s[0] + digest)
    return digest


@pytest.mark.parametrize("levels", range(1, 12))
def test_layout_is_van_emde_boas(levels):
    """Every node has its own place, and each half-height subtree is stored in one piece."""
    places = [merkle.address(levels, d, np.arange(1 << d)) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range((1 << levels) - 1))

    def pieces(levels, depth, index, top):
        """Places below (depth, index) form one run; the same for both halves."""
        mine = np.concatenate([merkle.address(top, depth + d, np.arange(index << d, (index + 1) << d)) for d in range(levels)])
        assert mine.max() - mine.min() == len(mine) - 1
        if levels > 1:
            upper = levels // 2
            pieces(upper, depth, index, top)
            for k in range(1 << upper):
                pieces(levels - upper, depth + upper, (index << upper) + k, top)

    pieces(levels, 0, 0, levels)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 17, 100, 255, 256])
def test_block_equals_plain_tree(n):
    digests = [sha(str(i)) for i in range(n)]
    levels = plain_levels(digests)
    height = merkle.height_of(n)
    nodes = merkle.build_block(bytes.fromhex("".join(digests)), height)
    assert nodes[0].tobytes().hex() == levels[-1][0]
    for i, path in enumerate(merkle.block_paths(nodes, height, n)):
        want = plain_siblings(levels, i)
        assert merkle.proof_text(path.tobytes()) == "".join(s[0] for s in want if s)
        assert merkle.fold(digests[i], path.tobytes()) == levels[-1][0]


def check(got, rows):
    """``rows``: (group, id, leaf, now) tuples."""
    groups = sorted({r[0] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: sorted((r[1:] for r in rows if r[0] == g), key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for g in groups}
    levels = {g: plain_levels([r[1] for r in trees[g]]) for g in groups}
    crown = plain_levels([levels[g][-1][0] for g in groups])
    want = []
    for k, g in enumerate(groups):
        for i, (doc, leaf, now) in enumerate(trees[g]):
            path = plain_siblings(levels[g], i) + plain_siblings(crown, k)
            folded = plain_fold(now, path)
            want.append((doc, leaf, levels[g][-1][0], crown[-1][0], sha("".join(s[0] for s in path if s)), folded, folded == crown[-1][0]))
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def leaves(spark, rows):
    return spark.createDataFrame(rows, "g string, id long, leaf string, now string").repartition(5)


@pytest.mark.parametrize("height", [1, 2, 8])
def test_audit_equals_plain_trees(spark, height):
    """Small blocks make many tiers; groups of one row, a hot group, a null group, null and repeated ids, equal rows."""
    dice = random.Random(height)
    rows = [(dice.choice(["de", "en", "en", "en", None, "zz"]), dice.choice([None, dice.randrange(60)])) for _ in range(150)] + [("only", 5), ("é", 1), ("", 2)]
    rows = [(g, i, sha(f"{g}{i}{k % 140}"), sha(f"{g}{i}{k % 140}" + "x" * (k % 140 % 9 == 0))) for k, (g, i) in enumerate(rows)]
    made = merkle.manifest(leaves(spark, rows), "g", "id", "leaf", "id", "now", height=height)
    check(merkle.audit(made).collect(), rows)
    assert made.stored().where("part = 'tree' and tier = 0").count() == len(made.tiers[0].collect())


def test_many_groups_and_full_blocks(spark):
    rows = [(f"g{k:03d}", i, sha(f"{k}-{i}"), sha(f"{k}-{i}")) for k, n in enumerate([4, 8, 16, 1, 3] * 3 + [65]) for i in range(n)]
    check(merkle.audit(merkle.manifest(leaves(spark, rows), "g", "id", "leaf", "id", "now", height=2)).collect(), rows)


def test_one_row_and_no_rows(spark):
    rows = [("a", 1, sha("x"), sha("y"))]
    check(merkle.audit(merkle.manifest(leaves(spark, rows), "g", "id", "leaf", "id", "now")).collect(), rows)
    assert merkle.audit(merkle.manifest(leaves(spark, rows).limit(0), "g", "id", "leaf", "id", "now")).count() == 0


def test_row_digests(spark):
    """Nulls, empty and very long texts, and neighbours that would run together without lengths; other columns are ignored."""
    long = "é\n" * 60_000
    values = [(1, "a", None), (1, "", "x"), (None, "1:a", long), (11, "", "")]
    df = spark.createDataFrame([(*v, "z") for v in values], "a long, b string, t string, leaf string")
    plain = lambda *xs: sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in xs))
    assert [r[0] for r in df.select(merkle.row_digest(F.col("a"), F.col("b"), F.col("t"))).collect()] == [plain(*v) for v in values]


def test_clashing_columns_are_ignored(spark):
    rows = [("a", i, sha(str(i)), sha(str(i))) for i in range(20)]
    df = leaves(spark, rows)
    for name in ("_group", "_order", "_salt", "_x0", "_x1", "place", "tree", "i", "n", "_mid", "_part", "root", "members"):
        df = df.withColumn(name, F.lit("mine"))
    check(merkle.audit(merkle.manifest(df, "g", "id", "leaf", "id", "now", height=2)).collect(), rows)
