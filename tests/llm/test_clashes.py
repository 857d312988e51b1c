"""Every operator and pipeline stage with extra columns that bear the names used inside."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vacantia.llm import decontaminate, gam_quality, html_main, line_dedup, mixing, packing, parity_join, quality_rules, sharding, toxicity, url_filter

INNER = (
    "_rk _marks _gone _id _rank _n _start _salt _i _place _key _tie _part _mid _c0 _c1 _all _title rk at h n rep comp node "
    "key doc d1 d2 even odd sketch u v c label score_ first kinds mine rows place tree block unit kind row w host path rule verdict listed"
).split()
TEXT = "a line of some words that stand in it and go on\nanother line, the second one, with other words in it\n"


def crowded(df):
    """``df`` with all inner names as columns of its own."""
    return df.select("*", *[F.lit(f"mine {x}").alias(x) for x in INNER if x not in df.columns])


def kept(df):
    return all(r[x] == f"mine {x}" for r in df.collect() for x in INNER)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, TEXT + f"own {i} words only here " * 6, "en", f"s{i % 2}", 5) for i in range(6)] + [(1, None, None, None, None), (2, TEXT * 3, "de", "s1", 1)]
    return crowded(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_filtering_stages_pass_columns_through(spark, docs, name, stage, tmp_path):
    for table, rows, ddl in (("labels", [(0, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int"), ("benchmark", [("b", "no such words stand in any document of this test at all, none")], "item_id string, text string")):
        crowded(spark.createDataFrame(rows, ddl)).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and kept(out)


def test_operators_pass_or_ignore_columns(spark, docs):
    n = docs.count()
    assert kept(line_dedup.line_dedup(docs)) and line_dedup.line_dedup(docs).count() == n
    assert parity_join.near_duplicates(docs).count() == n and quality_rules.quality(docs).count() == n
    labels = spark.createDataFrame([(0, 0), (3, 1), (4, 1)], "doc_id long, label int")
    slim = docs.select("doc_id", "text")
    assert kept(toxicity.score(docs, toxicity.fit(slim, labels)))
    sized = docs.withColumn("size", F.lit(10))
    shards = sharding.shard(sized, "doc_id", "size", 3)
    assert shards.columns == [*sized.columns, "shard", "slot"] and kept(shards) and shards.count() == n
    pieces = crowded(packing.pieces(slim, packing.tokenizer_path()))
    packed = packing.pack(pieces)
    assert packed.columns == [*pieces.columns, "sequence_id", "offset"] and kept(packed) and packed.count() == pieces.count()
    mixed = mixing.mix(sized, "doc_id", "source", "size")
    assert kept(mixed) and mixed.count() == n
    items = crowded(spark.createDataFrame([("b", "some words")], "item_id string, text string"))
    assert decontaminate.decontaminate(docs, items).count() <= n


def test_pages(spark):
    pages = crowded(spark.createDataFrame([(1, "http://a.b/c", "<p>x"), (2, None, None)], "page_id long, url string, html string"))
    entries = spark.createDataFrame([("a.b/", 1)], "entry string, kind int")
    assert url_filter.judge(pages, entries).count() == 2 and html_main.extract(pages).count() == 2
