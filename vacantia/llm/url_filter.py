"""URL filter over a sorted digest array.

Every entry (``host`` or ``host/path-prefix``) is kept as its 64-bit xxhash in a sorted array, with the full string beside
it. The file goes to every executor once; tasks map it into memory, so all workers of a machine share its pages and no
worker holds a copy. A batch of urls is turned into candidate keys (each parent domain times each path length that some
entry has), probed by one vectorised binary search, and every hit is confirmed against the stored string, so two strings
with one hash never stand for each other. A list longer than ``block`` entries becomes several files, written one after
the other, which bounds what the driver holds.

Verdict: a *rule* (allow or block) that fits wins over the plain *list* of blocked entries; among rules the longest string
wins, then the longer host. Without a rule, a url is blocked if a listed entry fits its host or a parent domain.

Defined results: a null url or one without ``://`` has empty host and path, fits nothing and is allowed. Urls of any length
are read whole. Repeated rows are judged alike. Empty tables give empty tables; an empty list allows all. Other columns
are ignored."""
from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.common import append, ascii_lower, pick, share_file, table

ALLOW, BLOCK, LISTED = 0, 1, 2

#: The rules of the registered query: (string, kind).
RULES = (
    ("org/", ALLOW), ("example.org/es/", BLOCK), ("example.org/en/1", BLOCK), ("com/fr/", ALLOW), ("com/de/", BLOCK),
)
#: The blocked hosts of the registered query (a parameter; any host or host/path-prefix may be listed).
HOSTS = tuple(
    f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for top in ("com", "net", "org")
)


def host_path(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: lower-cased up to the first of ``/?#``, then up to the first of ``?#``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def _file(entries: list[tuple[bytes, int]]) -> Iterable[bytes]:
    """One digest file: count, size of the strings, then sorted keys, string ends, kinds and strings."""
    keys = np.array([xxhash.xxh64_intdigest(e) for e, _ in entries], dtype=np.uint64)
    order = np.argsort(keys, kind="stable")
    ends = np.cumsum([len(entries[i][0]) for i in order], dtype=np.int64) if len(order) else np.zeros(0, np.int64)
    yield np.array([len(entries), ends[-1] if len(ends) else 0], dtype=np.int64).tobytes()
    yield keys[order].tobytes()
    yield ends.tobytes()
    yield np.array([entries[i][1] for i in order], dtype=np.uint8).tobytes()
    yield b"".join(entries[i][0] for i in order)


class Digest:
    """A digest file, mapped into memory."""

    def __init__(self, path: str):
        n, size = (int(x) for x in np.fromfile(path, np.int64, 2))
        self.keys = self._part(path, np.uint64, n, 16)
        self.ends = self._part(path, np.int64, n, 16 + 8 * n)
        self.kinds = self._part(path, np.uint8, n, 16 + 16 * n)
        self.blob = self._part(path, np.uint8, size, 16 + 17 * n)

    @staticmethod
    def _part(path: str, kind, n: int, at: int):
        return np.memmap(path, dtype=kind, mode="r", offset=at, shape=(n,)) if n else np.zeros(0, kind)

    def find(self, words: list[bytes], keys: np.ndarray) -> Iterable[tuple[int, int]]:
        """(place in ``words``, kind) of every word that is stored; equal hashes are told apart by their strings."""
        at = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys) if len(self.keys) else ():
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:
                start = int(self.ends[j - 1]) if j else 0
                if self.blob[start : int(self.ends[j])].tobytes() == words[i]:
                    yield int(i), int(self.kinds[j])
                j += 1


def build(spark: SparkSession, entries: DataFrame, block: int = 2_000_000) -> tuple[list[str], list[int], int]:
    """Digest files of ``entries(entry string, kind int)`` on every executor, the path lengths that entries have and their longest host.

    At most ``block`` entries are on the driver at a time, whatever their number."""
    entries = entries.where("entry is not null").distinct()
    cut = F.locate("/", "entry")
    path = F.when(cut > 0, F.length("entry") - cut + 1).otherwise(0)
    row = entries.agg(F.count(F.lit(1)).alias("n"), F.collect_set(path).alias("k"), F.max(F.length("entry") - path).alias("host")).first()
    parts, names = max(1, -(-row["n"] // block)), []
    for i in range(parts):
        rows = entries.where(F.pmod(F.xxhash64("entry"), F.lit(parts)) == i).collect()
        names.append(share_file(spark, f"url-digest-{os.urandom(6).hex()}-{i}", _file([(r["entry"].encode(), r["kind"]) for r in rows])))
    return names, sorted(row["k"]), row["host"] or 0


def suffixes(host: str, longest: int) -> Iterable[str]:
    """The host and its parent domains, longest first, as far as they have at most ``longest`` characters."""
    if len(host) <= longest:
        yield host
    at = host.find(".", max(0, len(host) - longest - 1))
    while at >= 0:
        yield host[at + 1 :]
        at = host.find(".", at + 1)


def judge(pages: DataFrame, entries: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, host, path, rule, verdict, listed (the listed entry that fits, else null) of every row of ``pages``."""
    names, lengths, longest = build(pages.sparkSession, entries)
    open_files: dict[str, Digest] = {}

    def probe(batch: pa.RecordBatch) -> list:
        found = [open_files.get(n) or open_files.setdefault(n, Digest(SparkFiles.get(n))) for n in names]
        hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
        words, owner, rank = [], [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            if not host:
                continue
            ends = [path[:k].encode() for k in lengths if k <= len(path)]
            for name in suffixes(host, longest):
                for end in ends:
                    words.append(name.encode() + end)
                    owner.append(i)
                    rank.append(len(name))
        keys = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
        rule: list = [None] * len(hosts)
        listed: list = [None] * len(hosts)
        for digest in found:
            for w, kind in digest.find(words, keys):
                text = words[w].decode()
                got, best = (len(text), rank[w], kind, text), listed if kind == LISTED else rule
                if best[owner[w]] is None or got[:3] > best[owner[w]][:3]:
                    best[owner[w]] = got
        verdict = [
            ("block" if r[2] == BLOCK else "allow") if r else ("block" if x else "allow") for r, x in zip(rule, listed)
        ]
        return [[r and r[3] for r in rule], verdict, [x and x[3] for x in listed]]

    rows = pick(pages, page_id=page_id, url=url)
    host, path = host_path(F.col("url"))
    return append(rows.withColumn("host", host).withColumn("path", path), "rule string, verdict string, listed string", probe)


def as_entries(spark: SparkSession, rules=RULES, hosts=HOSTS) -> DataFrame:
    return spark.createDataFrame([*rules, *((h, LISTED) for h in hosts)], "entry string, kind int")


def query(spark: SparkSession, sf: str) -> DataFrame:
    return judge(table(spark, sf, "pages"), as_entries(spark)).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    rules = ", ".join(f"('{s}', {k})" for s, k in RULES)
    hosts = ", ".join(f"('{h}')" for h in HOSTS)
    fits = "(p.host = {0} OR ends_with(p.host, '.' || {0}))"
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT row_number() OVER () AS rid, page_id, rest, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw FROM u),
p AS (SELECT rid, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM h),
r AS (SELECT *, regexp_extract(rule, '^[^/]*') AS rhost, substr(rule, instr(rule, '/')) AS rpath FROM (VALUES {rules}) v(rule, kind)),
m AS (SELECT rid, rule, kind FROM p JOIN r ON {fits.format('rhost')} AND starts_with(p.path, rpath)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(rule) DESC, length(rhost) DESC) = 1),
b AS (SELECT DISTINCT rid FROM p JOIN (VALUES {hosts}) v(name) ON {fits.format('name')})
SELECT page_id, host, path, rule, CASE WHEN m.kind = {ALLOW} THEN 'allow' WHEN m.kind = {BLOCK} THEN 'block'
  WHEN b.rid IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN m USING (rid) LEFT JOIN b USING (rid)
"""


QUERIES = {"op1_url_filter": (query, _sql())}
