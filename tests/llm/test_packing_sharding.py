"""Packing and sharding: exact round trips, laws, and plain passes."""
import bisect
import random
import zlib

import numpy as np
import pytest

from vacantia.llm.packing import encoder, pack, pieces, plan, tokenizer_path
from vacantia.llm.sharding import shard


def plain_bfd(lengths, capacity):
    free, made = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(free, n)
        left = free.pop(i) if i < len(free) else capacity
        made += left == capacity
        if left > n:
            bisect.insort(free, left - n)
    return made


def check(rows, capacity):
    """rows: (length, sequence, offset); sequences are filled from 0 without a gap."""
    by = {}
    for n, s, o in rows:
        by.setdefault(s, []).append((o, n))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_plan_equals_plain_pass():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([1, 7, 16, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
        rows = [(n, s + i, o) for n, _, k, s, o in plan({n: lengths.count(n) for n in set(lengths)}, capacity).tolist() for i in range(k)]
        assert sorted(r[0] for r in rows) == sorted(lengths)
        assert check(rows, capacity) == plain_bfd(lengths, capacity)


def test_ids_are_those_of_the_other_library():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    encode = encoder(tokenizer_path())
    for t in ["", " ", "a  b", "it's 'tis\n\n x", "\tq   z", "<|endoftext|> x", "éü 漢字 🙂", "#### $$$", "a" * 3000, "x\r\n  y \0 z"]:
        assert np.frombuffer(encode(t), "<u4").tolist() == model.encode(t, add_special_tokens=False).ids


def test_long_runs_of_white_space_are_encoded():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    encode, n = encoder(tokenizer_path()), 1_200_000
    for t in ["it's a" + " " * n + "b 's", "\n" * (n + 1) + "<|endoftext|>\u3000\xa0", "x" + " \n\t" * (n // 3)]:
        assert np.array_equal(np.frombuffer(encode(t), "<u4"), model.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("group", [3, 1000])
def test_pack_round_trip(spark, docs_of, group):
    rng = random.Random(2)
    words = "the cat sat on mats when dogs ran by rivers".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 3, 3, 20, 90])))) for i in range(120)] + [(5, "the"), (5, "the"), (None, None), (999, "cat " * 500)]
    capacity = 64
    parts = pieces(docs_of(rows), tokenizer_path(), capacity)
    got = pack(parts, capacity, group).collect()
    assert check([(r.length, r.sequence_id, r.offset) for r in got], capacity) == plain_bfd([r.length for r in got], capacity)
    encode, by = encoder(tokenizer_path()), {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for doc, text in rows:
        if doc == 5:
            continue
        want = encode(text or "") + bytes(4)
        mine = sorted(by[doc], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and b"".join(bytes(r.ids) for r in mine) == want
        assert all(r.length == capacity for r in mine[1:]) and all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in mine)
        assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
    assert len(by[5]) == 3 and pack(pieces(docs_of([]), tokenizer_path())).collect() == []


@pytest.mark.parametrize("part_bytes", [300, 1 << 20])
def test_shards_obey_the_law(spark, part_bytes):
    rng = random.Random(4)
    rows = [(rng.choice([7, 7, 7, i, -i, 2**62 - i, None]), rng.choice([16, 16, 40, 200])) for i in range(1500)]
    df = spark.createDataFrame(rows, "k long, size long").repartition(5)
    got = shard(df, "k", "size", 8, part_bytes).collect()
    assert sorted((r.k is None, r.k or 0, r.size) for r in got) == sorted((k is None, k or 0, s) for k, s in rows)
    total = sum(s for _, s in rows)
    for s in range(8):
        mine = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r.size for r in mine) - total / 8) <= 2 * 200 + 1
    order = [(r.k if r.k is not None else -(2**63)) for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_few_and_no_rows(spark):
    assert shard(spark.createDataFrame([], "k long, size long"), "k", "size").collect() == []
    got = shard(spark.createDataFrame([(1, 16), (1, 16), (None, 16)], "k long, size long, ".rstrip(", ")), "k", "size", 40).collect()
    assert len({(r.shard, r.slot) for r in got}) == 3
