"""Near-duplicate join on word shingles by parity sketches.

A sketch XORs every shingle of a document into one of its words, so two sketches differ in at most as many places as the sets'
symmetric difference has members: the Hamming distance bounds it from below. A Jaccard similarity of ``percent`` allows only
``d = (a + b)(100 - percent) / (100 + percent)`` members to differ. So if the sketch is cut into ``k > d`` parts, two linked
documents agree in some part (pigeonhole); with ``k`` a little larger than ``d`` they agree in a part that isn't empty.

* **Size bands.** Linked sizes differ by at most 100 / percent, so bands of that ratio make partners lie in the same or in
  neighbouring bands. A document gives the parts of its own band and of the one below; ``k`` follows from the band.
* **Part keys.** The sketch of parts is held sparse: a part is the XOR of 64-bit mixes of its shingles. Keys that
  occur once in the corpus, nearly all, are dropped in a first pass: each batch sends its keys, dealt to buckets, as packed
  arrays, and a bucket sorts its arrays and returns the keys it saw again. A key that is frequent within a batch is returned
  through spread buckets, and only a mark goes to its own one, so that no bucket has to hold a hot key.
* **Frequent keys.** As ``k`` exceeds ``d``, linked documents share not one key but at least as many as a document's non-empty
  parts exceed ``d``. So each document leaves out its most frequent keys, one less than that number: parts that lie in a
  passage of many documents pair nobody.
* **Copies** (equal sets) become one class before anything is paired.
* **Links.** The members of a part are compared with one pivot, the member that shares most parts with others. Components of
  those links leave few parts with members of several components. There, in units of at most ``BLOCK`` members a side, the dense
  sketches of those outside the largest component are held against the others' by vectorised XOR, and only pairs that pass
  the Hamming bound leave the task. So no link between components is lost, and no group is expanded into rows of pairs.
* **Verification.** A pair first has to pass the Hamming bound of two dense parity sketches, then its shingles are compared as
  words.

Defined results: null and blank texts have no shingles, link with nothing and are their own component. Rows that share a doc_id
count as one document with the links of all its rows; a null doc_id links with nothing and has a null component. Texts are read
whole. Repeated rows each give a row. Empty tables give empty tables. Other columns are ignored."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.llm.common import pick, space_words, table
from vacantia.operators.graph import components
from vacantia.session import cut, scratch_path

PERCENT = 80
WORDS = 5
#: Occurrences of a part key within one batch from which it is spread over buckets.
HOT = 64
#: Documents of one packed slice.
SLICE = 2_500
#: Members of a part key on either side of one unit of comparison.
BLOCK = 4_000
#: Bytes of text per bucket of part keys, about.
BUCKET_BYTES = 4 << 20
_U = np.uint64
_MARK = -(1 << 63)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing permutation (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Hashes(dict):
    """64-bit hashes of words, kept while they fit."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(words: list[bytes], known: dict, size: int = WORDS) -> np.ndarray:
    """Distinct shingles as sorted 64-bit hashes; fewer words than ``size`` are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(size, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return np.unique(out)


def shingle_set(words: list[bytes], size: int = WORDS) -> set[tuple[bytes, ...]]:
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size))))


class Bands:
    """Size bands and the parts of each, for one threshold."""

    def __init__(self, percent: int = PERCENT):
        self.percent, self.edges = percent, [1, 2]

    def of(self, n: int) -> int:
        while self.edges[-1] <= n:
            self.edges.append(max(self.edges[-1] + 1, (self.edges[-1] - 1) * 100 // self.percent + 1))
        return int(np.searchsorted(self.edges, n, side="right")) - 1

    def allowed(self, a: int, b: int) -> int:
        """Largest symmetric difference of linked sets of these sizes."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def parts(self, band: int) -> tuple[int, int]:
        """(parts, most of them that may differ) for pairs whose smaller set lies in ``band``."""
        a = self.edges[band + 1] - 1
        d = self.allowed(a, a * 100 // self.percent)
        return d + 5 + d * 15 // 100, d


def part_keys(u: np.ndarray, bands: Bands) -> tuple[np.ndarray, list[int]]:
    """Part keys of a set of shingles, for its own band and the one below; the last bit is the band's parity.

    Also, for even and odd bands, how many of these keys any linked document shares at least."""
    own, out, mixed, shared = bands.of(len(u)), [], mix(u ^ _U(0x5851F42D4C957F2D)), [1, 1]
    for band in (own, own - 1) if own else (own,):
        k, d = bands.parts(band)
        part = (u >> _U(32)) * _U(k) >> _U(32)  # ascending, as u is sorted
        start = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        value, name = np.bitwise_xor.reduceat(mixed, start), part[start]
        if len(start) > d:  # at most d parts differ, so agreement lies in others than empty ones
            shared[band % 2] = len(start) - d
        else:
            empty = np.setdiff1d(np.arange(k, dtype=np.uint64), name, assume_unique=True)
            value, name = np.concatenate([value, np.zeros(len(empty), np.uint64)]), np.concatenate([name, empty])
        out.append(mix(value ^ mix(name + _U((band + 1) << 32))) & ~_U(1) | _U(band % 2))
    return np.concatenate(out), shared


def sketch(u: np.ndarray) -> bytes:
    """Dense parity sketch with the next power of two above twice the set's size as bits."""
    bits = max(256, 1 << (2 * len(u) - 1).bit_length())
    place = mix(u ^ _U(0xD1342543DE82EF95)) & _U(bits - 1)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch with its upper halves XORed onto its first ``size`` bytes, which keeps parities."""
    x = np.frombuffer(sketch, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_PACKED = "bucket int, kind int, a binary, b binary, c binary, d binary, e binary, f binary, sketches array<binary>"
_TABLE = "key long, doc long, n long, d1 long, d2 long, even long, odd long, sketch binary"


def _pack(buckets: int, percent: int):
    """Tasks of the first pass: texts -> packed part keys by bucket (kind 0; 1: known to be repeated) and documents (kind 2)."""

    def run(batches):
        known, bands = _Hashes(), Bands(percent)
        slices = (b.slice(lo, SLICE) for b in batches for lo in range(0, b.num_rows, SLICE))
        for turn, batch in enumerate(slices):
            docs, sizes, d1, d2, sketches, keys, owner = [], [], [], [], [], [], []
            classes: dict[tuple, list] = {}  # of copies within a slice only the smallest id goes on
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                u = shingle_hashes(space_words(text), known)
                m = mix(u)
                one, two = int(m.sum()), int(np.bitwise_xor.reduce(mix(m ^ _U(1)))) if len(u) else 0
                docs.append(doc), sizes.append(len(u)), d1.append(one), d2.append(two), sketches.append(sketch(u) if len(u) else b"")
                if len(u):
                    held = classes.setdefault((one, two), [doc, u])
                    held[0] = min(held[0], doc)
            shared = {}
            for name, (doc, u) in classes.items():
                key, shared[name] = part_keys(u, bands)
                keys.append(key)
                owner.append(np.full(len(key), doc, np.int64))
            even, odd = zip(*(shared.get(name, (1, 1)) for name in zip(d1, d2))) if docs else ((), ())
            rows: list[tuple] = []
            if keys:
                key, own = np.concatenate(keys), np.concatenate(owner)
                _, at, many = np.unique(key, return_inverse=True, return_counts=True)
                hot = many[at] >= HOT
                marks = np.unique(key[hot])
                spread = (np.arange(hot.sum()) * 7919 + turn) % buckets
                rows += _dealt(key[hot], own[hot], spread, 1)
                key = np.concatenate([key[~hot], marks])
                own = np.concatenate([own[~hot], np.full(len(marks), _MARK, np.int64)])
                rows += _dealt(key, own, (key >> _U(40)).astype(np.int64) % buckets, 0)
            arrays = [np.array(x, np.int64) for x in (docs, sizes)] + [np.array(x, np.uint64) for x in (d1, d2)] + [np.array(x, np.int64) for x in (even, odd)]
            rows.append((int(docs[0] + turn) % buckets if docs else 0, 2, *(x.tobytes() for x in arrays), sketches))
            cols = list(zip(*rows))
            types = [pa.int32(), pa.int32(), *[pa.binary()] * 6, pa.list_(pa.binary())]
            for lo in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 64], t) for c, t in zip(cols, types)],
                                                 names=["bucket", "kind", *"abcdef", "sketches"])

    return run


def _dealt(key: np.ndarray, own: np.ndarray, bucket: np.ndarray, kind: int) -> list[tuple]:
    order = np.argsort(bucket, kind="stable")
    key, own, bucket = key[order], own[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(key) else []
    return [
        (int(bucket[lo]), kind, key[lo:hi].tobytes(), own[lo:hi].tobytes(), *[b""] * 4, None)
        for lo, hi in zip(cuts, [*cuts[1:], len(key)])
    ]


def _repeated(batches):
    """Tasks behind the exchange: packed rows -> part keys seen for at least two documents, and the documents themselves."""
    names = ["key", "doc", "n", "d1", "d2", "even", "odd", "sketch"]

    def out(key, doc):
        none = pa.nulls(len(key), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(_signed(key)), pa.array(doc), *[none] * 5, pa.nulls(len(key), pa.binary())], names=names)

    keys, docs = [], []
    for batch in batches:
        for row in batch.to_pylist():
            a, b = np.frombuffer(row["a"], np.uint64), np.frombuffer(row["b"], np.int64)
            if row["kind"] == 0:
                keys.append(a), docs.append(b)
            elif row["kind"] == 1:
                yield out(a, b)
            else:
                rest = (pa.array(np.frombuffer(row[c], np.int64)) for c in "cdef")
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(b), pa.int64()), pa.array(_signed(a)), pa.array(b), *rest, pa.array(row["sketches"], pa.binary())], names=names)
    if keys:
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        many = np.diff(np.append(start, len(key)))
        again = np.repeat(doc[start] != doc[start + many - 1], many) & (doc != _MARK)
        for lo in range(0, len(key), 200_000):
            part = again[lo : lo + 200_000]
            yield out(key[lo : lo + 200_000][part], doc[lo : lo + 200_000][part])


def _first_pass(docs: DataFrame, percent: int) -> DataFrame:
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(wide, -(-size // (4 * BUCKET_BYTES)))
    packed = docs.mapInArrow(_pack(8 * tasks, percent), _PACKED).repartition(tasks, "bucket")
    path = scratch_path(spark, "parity")
    packed.mapInArrow(_repeated, _TABLE).write.parquet(path)
    return spark.read.parquet(path)


def _verify(pairs: DataFrame, meta: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct ``pairs(u, v)`` that are linked."""
    bands = Bands(percent)
    one = meta.select(F.col("doc").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su"))
    two = meta.select(F.col("doc").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv"))
    sized = pairs.join(one, "u").join(two, "v").where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent)

    def near(batches):
        for batch in batches:
            nu, nv, su, sv = (batch.column(c).to_pylist() for c in ("nu", "nv", "su", "sv"))
            keep = [distance(x, y) <= bands.allowed(a, b) for a, b, x, y in zip(nu, nv, su, sv)]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    close = cut(sized.mapInArrow(near, "u long, v long"))
    wanted = close.select("u").union(close.select("v")).distinct()
    texts = cut(docs.join(wanted.withColumnRenamed("u", "doc_id"), "doc_id", "left_semi"))
    both = (
        close.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("tu")), "u")
        .join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tv")), "v")
    )

    def same(batches):
        last, held = None, set()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("tu").to_pylist(), batch.column("tv").to_pylist()):
                if y != last:
                    last, held = y, shingle_set(space_words(y))
                mine = shingle_set(space_words(x))
                inter = len(mine & held)
                keep.append(bool(mine) and inter * 100 >= (len(mine) + len(held) - inter) * percent)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return cut(both.select("u", "v", "tu", "tv").mapInArrow(same, "u long, v long").distinct())


def _across(placed: DataFrame, reps: DataFrame, bands: Bands) -> DataFrame:
    """Pairs (u, v) of different components that share a part key and pass the bounds of size and Hamming distance.

    ``placed``: key, doc, comp. A group of several blocks of members becomes a unit for every two of its blocks."""
    many = placed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = placed.join(many, "key").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "doc", "comp")
    rows = rows.join(reps.select("doc", "n", "sketch"), "doc").select("key", "lo", "hi", "block", "doc", "comp", "n", "sketch")

    def pairs(unit: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        block, doc, comp, n = (np.array(c, np.int64) for c in list(zip(*unit))[:4])
        size = min(len(r[4]) for r in unit)
        bits = np.stack([folded(r[4], size) for r in unit]).view(np.uint64)
        names, at, count = np.unique(comp, return_inverse=True, return_counts=True)
        small = at != np.argmax(count)
        us, vs = [], []
        two = block.min() != block.max()
        for i in np.flatnonzero(small):
            y = np.flatnonzero((comp != comp[i]) & (~small | (np.arange(len(doc)) > i)) & ((block != block[i]) | (not two)))
            y = y[np.minimum(n[y], n[i]) * 100 >= np.maximum(n[y], n[i]) * bands.percent]
            y = y[np.bitwise_count(bits[y] ^ bits[i]).sum(axis=1) <= (n[y] + n[i]) * (100 - bands.percent) // (100 + bands.percent)]
            us.append(np.full(len(y), doc[i]))
            vs.append(doc[y])
        return np.concatenate(us), np.concatenate(vs)

    def run(batches):
        names = ["key", "lo", "hi", "block", "doc", "comp", "n", "sketch"]
        last, unit, found, seen = None, [], [], set()

        def close() -> None:
            if len({r[2] for r in unit}) > 1:
                fresh = [p for p in zip(*(x.tolist() for x in pairs(unit))) if p not in seen]
                if len(seen) < 500_000:  # pairs meet in many parts; what isn't remembered is made distinct later
                    seen.update(fresh)
                found.extend(fresh)
            unit.clear()

        def out():
            u, v = zip(*found) if found else ((), ())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            for *name, block, doc, comp, n, sketch in zip(*(batch.column(c).to_pylist() for c in names)):
                if name != last:
                    close()
                    last = name
                unit.append((block, doc, comp, n, sketch))
            if len(found) > 10_000:
                yield out()
        close()
        yield out()

    width = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(width, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "u long, v long")


def _shared(keys: DataFrame) -> DataFrame:
    """(key, c rows) of the keys that several documents have."""
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``. Rows of one id are linked with each other."""
    docs = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    nameless, named = docs.where("doc_id is null"), docs.where("doc_id is not null")
    again = cut(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id"))
    known = _Hashes()

    def alone(batches):
        for b in batches:
            n = [len(shingle_hashes(space_words(t), known)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int64())], names=["doc_id", "n_shingles", "component_id"])

    out = _components(named, percent) if again.isEmpty() else _of_repeated_ids(named, again, percent)
    return out.unionByName(nameless.mapInArrow(alone, "doc_id long, n_shingles long, component_id long"))


def _of_repeated_ids(docs: DataFrame, again: DataFrame, percent: int) -> DataFrame:
    """Components where some ids (``again``) have several rows: these rows take part under numbers that no id has."""
    ends = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    row = F.monotonically_increasing_id()
    number = F.lit(ends["hi"]) + 1 + row if ends["hi"] < (1 << 61) else F.lit(ends["lo"]) - 1 - row
    several = cut(docs.join(again, "doc_id").withColumn("number", number))
    rows = docs.join(again, "doc_id", "left_anti").unionByName(several.select(F.col("number").alias("doc_id"), "text"))
    found = cut(_components(rows, percent))
    held = found.join(several.select("doc_id", "number").withColumnRenamed("doc_id", "id"), found.doc_id == F.col("number"), "left").select(
        F.coalesce("id", "doc_id").alias("doc_id"), "n_shingles", F.col("component_id").alias("part"))
    held = cut(held)
    # parts that meet in an id are one
    meet = held.join(again, "doc_id").groupBy("doc_id").agg(F.min("part").alias("u")).join(held, "doc_id").select("u", F.col("part").alias("v")).where("u <> v").distinct()
    whole = components(meet).select(F.col("node").alias("part"), "comp")
    named = held.join(whole, "part", "left").withColumn("comp", F.coalesce("comp", "part"))
    first = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return named.join(first, "comp").select("doc_id", "n_shingles", "component_id")


def _components(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id of rows whose ids are all different."""
    bands = Bands(percent)
    found = _first_pass(docs, percent)
    meta = found.where("key is null").drop("key")
    full = meta.where("n > 0")
    classes = cut(full.groupBy("d1", "d2").agg(F.min("doc").alias("rep")))
    own = full.join(classes, ["d1", "d2"]).where("doc = rep")
    reps = cut(own.groupBy("doc").agg(*[F.max(c).alias(c) for c in ("n", "even", "odd", "sketch")]))
    keys = found.where("key is not null").select("key", "doc").join(reps.select("doc", "even", "odd"), "doc")
    keys = keys.join(_shared(keys).select("key", "c"), "key")
    # Linked documents share so many keys that each can do without its most frequent ones, all but one of that number: the
    # rarest of the shared keys is in neither's rest.
    parity = F.col("key").bitwiseAND(F.lit(1))
    rank = F.row_number().over(Window.partitionBy("doc", parity).orderBy(F.desc("c"), "key"))
    keys = keys.withColumn("_rank", rank).where(F.col("_rank") >= F.when(parity == 0, F.col("even")).otherwise(F.col("odd"))).select("key", "doc")
    keys = cut(keys)
    keys = cut(keys.join(_shared(keys).select("key", "c"), "key"))
    score = keys.groupBy("doc").agg(F.sum("c").alias("s"))
    central = keys.join(score, "doc").groupBy("key").agg(F.max_by("doc", F.struct("s", -F.col("doc"))).alias("v"))
    star = keys.join(central, "key").select(F.col("doc").alias("u"), "v").where("u <> v").distinct()
    links = _verify(star, reps, docs, percent)
    groups = components(links)
    placed = keys.select("key", "doc").join(groups.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    # Parts of two members have been compared, and of parts with the same members one will do.
    member = [F.xxhash64("doc", F.lit(i)) for i in range(2)]
    mixed = placed.groupBy("key").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c"), F.bit_xor(member[0]).alias("x"),
        F.sum(F.call_function("shiftright", member[1], F.lit(24))).alias("y"))
    mixed = mixed.where("lo < hi and c > 2").groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key")
    placed = cut(placed.join(mixed, "key", "left_semi"))
    rest = _across(placed, reps, bands).distinct()
    more = _verify(rest, reps, docs, percent)
    if more.take(1):
        groups = components(links.union(more))
    comp = groups.select(F.col("node").alias("rep"), "comp")
    label = full.join(classes, ["d1", "d2"]).join(comp, "rep", "left").groupBy("doc").agg(F.min(F.coalesce("comp", "rep")).alias("comp"))
    return meta.select("doc", "n").join(label, "doc", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("comp", "doc").alias("component_id"))


def query(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS node, doc_id AS comp FROM d UNION SELECT e.v, r.comp FROM r JOIN e ON e.u = r.node WHERE r.comp < e.v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.comp AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(comp) AS comp FROM r GROUP BY node) c ON c.node = d.doc_id
"""

QUERIES = {"op2_parity_join": (query, SQL)}
