"""The normalised posting row and the raw landing record."""
from __future__ import annotations

from pyspark.sql import types as T

# Feed order of a run.
SCRAPED_SOURCES = ("linkedin", "indeed", "glassdoor", "google", "ziprecruiter")
BOARD_SOURCES = ("greenhouse", "lever", "ashby", "workday")
SOURCES = SCRAPED_SOURCES + BOARD_SOURCES

ORD = T.StructType([
    T.StructField("source_ord", T.IntegerType()),
    T.StructField("board_ord", T.IntegerType()),
    T.StructField("row_ord", T.LongType()),
])

POSTING = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("salary", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("description_snippet", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("posted_date", T.TimestampType()),
    T.StructField("is_remote", T.BooleanType()),
    T.StructField("job_type", T.StringType()),
    T.StructField("job_level", T.StringType()),
    T.StructField("salary_min_amount", T.DoubleType()),
    T.StructField("salary_max_amount", T.DoubleType()),
    T.StructField("flags", T.ArrayType(T.StringType())),
    T.StructField("skills", T.ArrayType(T.StringType())),
    T.StructField("relevance", T.DoubleType()),
    T.StructField("llm_score", T.IntegerType()),
    T.StructField("llm_verdict", T.StringType()),
    T.StructField("llm_reason", T.StringType()),
    T.StructField("ord", ORD),
])

# One landed payload per fetched board.
RAW = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("board", T.StringType()),
    T.StructField("board_ord", T.IntegerType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("ok", T.BooleanType()),
    T.StructField("error", T.StringType()),
    T.StructField("payload", T.StringType()),
])

SEEN = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("first_seen", T.StringType()),
])
