"""The corpus pipeline: documents in, packed training sequences out.

Stages, each over all that the one before it kept:

1. ``toxicity`` drops documents that the learned lexicon model judges toxic.
2. ``line_dedup`` removes passages that repeat across documents; documents of which nothing is left go.
3. ``near_duplicates`` keeps one document (the smallest doc_id, the first of repeated rows) of each group of near copies.
4. ``decontamination`` drops documents that contain benchmark passages.
5. ``packing`` tokenises the rest and packs it into sequences.

All but the last return the columns of ``documents`` (``n_chars`` follows the text). SQL can't express the stages, so
``ORACLE_SQL`` is None and the tests compare them with brute force."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.llm import decontaminate, line_dedup, packing, parity_join, toxicity
from vacantia.llm.common import pick, table
from vacantia.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't judged toxic. The model learns from the labelled rows of the table it filters."""
    labels = pick(table(spark, sf_dir, "labels"), doc_id="doc_id", label="toxic")
    model = toxicity.fit(pick(docs, doc_id="doc_id", text="text"), labels)
    inner = docs.toDF(*["text" if c == "text" else f"_c{i}" for i, c in enumerate(docs.columns)])
    return toxicity.score(inner, model).where("predicted = 0").select(*inner.columns).toDF(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand in an earlier document; those left empty by it go."""
    clean = line_dedup.line_dedup(docs).where(~F.col("emptied"))
    size = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return clean.select(*[(size.cast("bigint") if c == "n_chars" else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; documents without words or without an id all stay."""
    names, docs = docs.columns, docs.toDF(*[c if c in ("doc_id", "text") else f"_c{i}" for i, c in enumerate(docs.columns)])
    marks = parity_join.near_duplicates(docs).where("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(marks, F.col("doc_id") == F.col("_gone"), "left_anti")
    # rows that repeat a doc_id with words are copies or one document: one of them stays
    worded = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    again = left.where(worded).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_id"))
    single = left.join(again, F.col("doc_id") == F.col("_id"), "left_anti")
    several = left.join(again, F.col("doc_id") == F.col("_id"), "left_semi")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
    return single.unionByName(several.withColumn("_rank", rank).where("_rank = 1").drop("_rank")).toDF(*names)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated: benchmark windows cover less than a twentieth of their words."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    pieces = packing.pieces(pick(docs, doc_id="doc_id", text="text"), packing.tokenizer_path()).drop("ids")
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
