"""Url filter and quality rules against plain Python."""
import random
import re
from collections import Counter

import xxhash

from vacantia.llm import url_filter
from vacantia.llm.quality_rules import STOP_WORDS, quality
from vacantia.llm.url_filter import ALLOW, BLOCK, LISTED, Digest, judge


def plain(url, entries):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest, re.S).group()
        path = re.match(r"[^?#]*", rest[len(host):], re.S).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for e, kind in entries:
        h, slash, p = e.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(e), len(h), kind, e))
    rules = [f for f in fits if f[2] != LISTED]
    best = max(rules, default=None)
    verdict = ("block" if best[2] == BLOCK else "allow") if best else "block" if fits else "allow"
    return host, path, best and best[3], verdict


URLS = [
    None, "", "no scheme", "http://", "http://org", "http://org/", "https://A.Example.ORG/es/x?y#z", "http://example.org/en/15", "http://example.org/en/2",
    "ftp://x.com/fr/1", "http://com/de/", "http://xcom/de/", "http://b.com/de", "http://www.casino-win.example.net/", "http://casino-win.example.net?x=/de/",
    "http://notcasino-win.example.net/", "http://ads-track.example.org/en/1", "http://é.com/fr/é\nx", "a://b://c.org/d", "http://x.com/fr" + "/long" * 9000, "http://ÀB.ORG/q",
]


def test_judge_matches_plain_python(spark):
    entries = [*url_filter.RULES, *((h, LISTED) for h in url_filter.HOSTS)]
    rows = list(enumerate(URLS)) + [(3, "http://org/"), (3, "http://org/"), (None, "http://z.com/de/1")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, RULE string")
    got = judge(df, url_filter.as_entries(spark)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=key) == sorted(((i, *plain(u, entries)) for i, u in rows), key=key)


def test_other_rules_blocks_and_empty_lists(spark):
    rng = random.Random(1)
    entries = sorted({(f"{rng.choice('abc')}.{rng.choice('de')}{rng.choice(['', '/', '/p', '/pq'])}", rng.choice([ALLOW, BLOCK, LISTED])) for _ in range(30)})
    entries = list({e: k for e, k in entries}.items())
    urls = [(i, f"http://{rng.choice(['', 'z.'])}{rng.choice('abc')}.{rng.choice('de')}{rng.choice(['', '/', '/p', '/pqr'])}") for i in range(80)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    old = url_filter.build
    try:
        url_filter.build = lambda s, e: old(s, e, 7)  # several digest files
        got = judge(pages, spark.createDataFrame(entries, "entry string, kind int")).collect()
    finally:
        url_filter.build = old
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got} == {(i, *plain(u, entries)) for i, u in urls}
    none = judge(pages, spark.createDataFrame([], "entry string, kind int"))
    assert {r.verdict for r in none.collect()} == {"allow"} and judge(pages.limit(0), spark.createDataFrame(entries, "entry string, kind int")).collect() == []


def test_hosts_of_any_length(spark):
    """Only suffixes that an entry could be are looked at, so a host of 200,000 characters costs no more than it holds."""
    assert list(url_filter.suffixes("a.bb.ccc.d", 5)) == ["ccc.d", "d"] and list(url_filter.suffixes("ccc.d", 5)) == ["ccc.d", "d"]
    assert list(url_filter.suffixes("a..b", 2)) == [".b", "b"] and list(url_filter.suffixes("a", 0)) == []
    entries = [("example.org/es/", BLOCK), ("org/", ALLOW), ("bad.net", url_filter.LISTED)]
    hosts = ["a." * 100_000 + "example.org", "x" * 200_000 + ".bad.net", "." * 100_000 + "org", "a." * 100_000 + "b"]
    urls = [(i, f"http://{h}/es/{'p' * 1000}") for i, h in enumerate(hosts)]
    got = judge(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(entries, "entry string, kind int")).collect()
    assert {(r.page_id, r.rule, r.verdict) for r in got} == {(0, "example.org/es/", "block"), (1, None, "block"), (2, "org/", "allow"), (3, None, "allow")}


def test_equal_hashes_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda b: 5)
    (tmp_path / "d").write_bytes(b"".join(url_filter._file([(b"a.b", BLOCK), (b"c.d/", ALLOW)])))
    import numpy as np

    words = [b"c.d/", b"e", b"a.b"]
    assert sorted(Digest(str(tmp_path / "d")).find(words, np.full(3, 5, np.uint64))) == [(0, ALLOW), (2, BLOCK)]


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice = {g for g, c in Counter(grams).items() if c > 1}
    covered = {p for i, g in enumerate(grams) if g in twice for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    base = n < 50 or 100 * len(covered) > 50 * n
    chars, symbols, dup = sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines))
    stops = sum(x in STOP_WORDS for x in re.findall(r"[^\W\d_]+", (text or "").lower()))
    upper = sum("A" <= c <= "Z" for c in text or "")
    ok = n > 0 and 2 <= chars / n <= 20 and symbols / n <= 0.2 and stops / n >= 0.06 and dup / len(lines) <= 0.5 and upper / chars <= 0.5
    return n, chars, symbols, dup, len(covered), base, not base and ok


def test_quality_matches_plain_python(spark, docs_of):
    rng = random.Random(7)
    texts = [None, "", " \n\t", "a", "a b", "a b a b", "a b c a b c", "x\x1cy z", "é漢🙂 " * 60, "a a a a a", "A\x0bB\x0cC\rD\n\nA\x0bB\x0cC\rD\n"]
    for _ in range(150):
        vocabulary = ["the", "of", "und", *(f"w{i}" for i in range(rng.choice([2, 10, 400])))]
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\n", "$ ", "\t"]) for _ in range(rng.choice([3, 60, 300])))
        texts.append(text + rng.choice(["", "\n", "# | <b>", text[:200]]))
    texts += ["The OF, und. (Und) " * 3 + " ".join(f"v{i}" for i in range(k)) for k in (150, 250)] + ["the of " + "word%d " * 5 % tuple(range(5)) * 40, "Q" * 200_000, "the of and " + " ".join(f"v{i % 30000}" for i in range(70_000))]
    rows = list(enumerate(texts)) + [(0, texts[20]), (None, texts[21])]
    got = quality(docs_of([(*r, 1, "z") for r in rows], ", N_words int, w string")).collect()
    key = lambda r: tuple(str(x) for x in r)
    have = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got]
    assert sorted(have, key=key) == sorted(((i, *counts(t)) for i, t in rows), key=key)
    assert quality(docs_of([])).collect() == []


def test_quality_stays_in_the_jvm(docs_of):
    plan = quality(docs_of([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
