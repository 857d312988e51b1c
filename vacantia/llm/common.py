"""Helpers shared by the text operators: columns computed in Arrow batches, words, shared files."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.session import checkpoint_dir

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes that are no part of a letter-or-digit word: ASCII other than 0-9, A-Z (lower-cased) and a-z.
_FOLD = bytes(
    b if b >= 128 or chr(b).isdigit() or chr(b).islower() else ord(chr(b).lower()) if chr(b).isupper() else 32 for b in range(256)
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the wanted columns, under the operator's own names, so that no other column can clash with them."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in names.items()])


def append(df: DataFrame, fields: str, fn: Callable[[pa.RecordBatch], list], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns ``fields`` (DDL) that ``fn`` computes from each Arrow batch.

    Columns of ``df`` of the same name (in any case) are replaced; those in ``drop`` are left out."""
    new = T._parse_datatype_string(fields)
    gone = {n.lower() for n in new.names} | {n.lower() for n in drop}
    kept = [f for f in df.schema.fields if f.name.lower() not in gone]
    names = [f.name for f in kept]
    types = [arrow_type(f.dataType) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pa.array(x, t) if not isinstance(x, pa.Array) else x.cast(t) for x, t in zip(fn(batch), types)]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + made, names=names + new.names)

    return df.mapInArrow(run, T.StructType(kept + new.fields))


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def space_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8 (bytes know no other cases or blanks)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text divides by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def share_file(spark: SparkSession, name: str, chunks: Iterator[bytes]) -> str:
    """Write a file to the shared folder and hand it to every executor; ``SparkFiles.get`` of the result finds it there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark), name)
    out = path.getFileSystem(conf).create(path, True)
    try:
        for chunk in chunks:
            for i in range(0, len(chunk), 1 << 20):
                out.write(bytearray(chunk[i : i + (1 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name
