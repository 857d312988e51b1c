"""Near-duplicate join against brute force: near copies, copies, hot groups, tiny and odd texts."""
import random

import numpy as np
import pytest

from vacantia.llm.common import space_words
from vacantia.llm.parity_join import (
    Bands, _Hashes, distance, near_duplicates, part_keys, shingle_hashes, shingle_set, sketch,
)


def brute(rows, percent=80):
    """(doc_id, n_shingles, component) of rows with distinct ids."""
    sets = {d: shingle_set(space_words(t)) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return sorted((d, len(sets[d]), root(d)) for d in ids)


def text(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        i = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.4:
            words[i] = f"x{rng.randrange(10**6)}"
        elif kind < 0.7:
            words.insert(i, f"y{rng.randrange(10**6)}")
        elif len(words) > 1:
            del words[i]
    return " ".join(words)


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(docs_of, seed):
    rng = random.Random(seed)
    rows = []
    for size in (1, 3, 5, 6, 8, 12, 20, 40, 90, 200, 400):
        for _ in range(4):
            base = text(rng, size)
            rows += [base, base, *(edited(rng, base, rng.randint(1, max(1, size // 18))) for _ in range(5))]
    rows += ["", None, "  \n", "A b C", "a B c", "one two three four five six"]
    shared = text(rng, 60)  # a passage in many documents that are no copies
    rows += [text(rng, rng.randint(20, 60)) + " " + shared + " " + text(rng, rng.randint(20, 60)) for _ in range(60)]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    assert result(near_duplicates(docs_of(rows))) == brute(rows)


def test_hot_group_that_links_through_its_centre(docs_of):
    rng = random.Random(5)
    base = text(rng, 220, 5000)
    rows = [(7, base)] + [(10 + i, edited(rng, base, 4)) for i in range(250)] + [(1000 + i, base) for i in range(150)]
    assert result(near_duplicates(docs_of(rows))) == brute(rows)


def test_groups_larger_than_a_unit(docs_of, monkeypatch):
    """Near copies of which many link with no centre, compared in several units."""
    from vacantia.llm import parity_join

    monkeypatch.setattr(parity_join, "BLOCK", 40)
    rng = random.Random(6)
    base = text(rng, 150, 5000)
    rows = [(i, edited(rng, base, rng.choice([1, 2, 4, 7, 9]))) for i in range(260)]
    rows += [(300 + i, edited(rng, rows[rng.randrange(260)][1], 2)) for i in range(60)]
    assert result(near_duplicates(docs_of(rows))) == brute(rows)


def test_odd_rows(docs_of):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, None), (2, "A B\tC d e f"), (4, "z " * 30000)]
    got = result(near_duplicates(docs_of(rows[:2] + rows[3:])))
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 1, 4)]
    extra = near_duplicates(docs_of([(*r, 9, 8) for r in rows], ", key long, N_shingles long")).collect()
    assert [(r.n_shingles, r.component_id) for r in extra if r.doc_id is None] == [(2, None)] and len(extra) == 6


def test_empty_table(docs_of):
    assert near_duplicates(docs_of([])).collect() == []


def test_pigeonhole_and_hamming_bound():
    rng, bands, known = random.Random(3), Bands(), _Hashes()
    linked = 0
    for _ in range(1500):
        base = text(rng, rng.choice([2, 6, 8, 10, 15, 25, 50, 120, 300]), 10**6)
        a, b = (shingle_hashes(space_words(t), known) for t in (base, edited(rng, base, rng.randint(0, 1 + len(base.split()) // 40))))
        inter = len(np.intersect1d(a, b))
        assert distance(sketch(a), sketch(b)) <= len(a) + len(b) - 2 * inter
        if 100 * inter >= 80 * (len(a) + len(b) - inter):
            linked += 1
            assert len(a) + len(b) - 2 * inter <= bands.allowed(len(a), len(b))
            (ka, sa), (kb, sb) = part_keys(a, bands), part_keys(b, bands)
            group = min(bands.of(len(a)), bands.of(len(b))) % 2
            same = np.intersect1d(ka, kb)
            assert np.sum(same % np.uint64(2) == group) >= max(1, min(sa[group], sb[group]))
    assert linked > 300


def test_partners_are_in_neighbouring_bands():
    bands = Bands()
    for a in range(1, 3000):
        assert bands.of(a * 100 // 80) - bands.of(a) in (0, 1)


def test_two_texts_under_one_id(spark, docs_of):
    """Each text of an id links for itself, and the id joins what they link with."""
    import random

    rng = random.Random(9)
    base = lambda n: [f"w{rng.randrange(10_000)}" for _ in range(n)]
    a, b, c = base(100), base(400), base(60)
    near = lambda w, k: " ".join(w[:k] + ["changed"] + w[k + 1 :])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 50)), (3, near(b, 200)), (4, " ".join(c)), (5, None), (5, near(c, 30)), (6, "x"), (6, "x"), (7, "")]
    for shift in (0, 2**62):  # numbers for the rows of repeated ids come from above or from below
        got = sorted((r.doc_id - shift, r.component_id - shift) for r in near_duplicates(docs_of([(i + shift, t) for i, t in rows])).collect())
        assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (6, 6), (6, 6), (7, 7)]
