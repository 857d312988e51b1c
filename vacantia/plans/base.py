"""Shared inputs of the registered queries: the test tables and the postings view over them."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.schema import POSTING

NOW = datetime(2024, 1, 3, 12, 0, 0)
NOW_SQL = "TIMESTAMP '2024-01-03 12:00:00'"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table; times without a zone are UTC."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    for col, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(col, F.col(col).cast("timestamp"))
    return df


def micros(name: str):
    return F.unix_micros(F.col(name))


def postings(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a posting; the same view as ``POSTINGS_SQL``."""
    docs = table(spark, sf, "documents")
    events = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    people = table(spark, sf, "customer").select("c_custkey", "c_name")
    n_people = people.count()
    df = (
        docs.join(events, docs.doc_id == events.event_id)
        .join(labels, "doc_id", "left")
        .join(people, F.col("doc_id") % n_people == people.c_custkey)
    )
    doc = F.col("doc_id")
    pay = F.when(doc % 3 != 0, F.round(F.col("value") * 1000))
    kind = F.create_map(*[F.lit(x) for x in ("view", "Full-time", "click", "part_time", "purchase", "Contractor", "signup", "")])
    place = F.when(F.col("lang") == "en", "Remote - US").when(F.col("lang") == "fr", "Paris, France").when(
        F.col("lang") == "de", "Sydney, Australia").otherwise("")
    empty = F.array().cast("array<string>")
    cols = {
        "job_id": doc.cast("string"),
        "title": F.substring_index("text", ".", 1),
        "company": F.col("c_name"), "location": place,
        "salary": F.when(pay.isNotNull(), F.concat(F.lit("$"), pay.cast("bigint").cast("string"))),
        "description": F.col("text"), "description_snippet": F.lit(""),
        "url": F.concat(F.lit("https://example.com/jobs/"), doc.cast("string")),
        "posted_date": F.when(doc % 11 != 0, F.col("ts")),
        "is_remote": F.when((F.col("lang") == "en") & (doc % 2 == 0), True).when(doc % 5 == 0, False),
        "job_type": F.try_element_at(kind, F.col("event_type")),
        "salary_max_amount": pay, "flags": empty, "skills": empty, "relevance": F.lit(0.0),
        "llm_score": F.col("quality") * 60 + 20, "source": F.col("source"),
        "ord": F.struct(F.lit(0).alias("source_ord"), F.lit(0).alias("board_ord"), doc.alias("row_ord")),
    }
    return df.select(*[cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in POSTING.fields])


POSTINGS_SQL = """
postings AS (
  SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS job_id, split_part(d.text, '.', 1) AS title,
    c.c_name AS company,
    CASE d.lang WHEN 'en' THEN 'Remote - US' WHEN 'fr' THEN 'Paris, France' WHEN 'de' THEN 'Sydney, Australia' ELSE '' END AS location,
    CASE WHEN d.doc_id % 3 <> 0 THEN '$' || CAST(CAST(round(e.value * 1000) AS BIGINT) AS VARCHAR) END AS salary,
    d.text AS description, d.source,
    CASE WHEN d.doc_id % 11 <> 0 THEN CAST(e.ts AS TIMESTAMP) END AS posted_date,
    CASE WHEN d.lang = 'en' AND d.doc_id % 2 = 0 THEN TRUE WHEN d.doc_id % 5 = 0 THEN FALSE END AS is_remote,
    CASE e.event_type WHEN 'view' THEN 'Full-time' WHEN 'click' THEN 'part_time' WHEN 'purchase' THEN 'Contractor' WHEN 'signup' THEN '' END AS job_type,
    CAST(NULL AS DOUBLE) AS salary_min_amount,
    CASE WHEN d.doc_id % 3 <> 0 THEN round(e.value * 1000) END AS salary_max_amount,
    CAST(l.quality * 60 + 20 AS INTEGER) AS llm_score
  FROM documents d JOIN events e ON e.event_id = d.doc_id
  LEFT JOIN labels l ON l.doc_id = d.doc_id
  JOIN customer c ON c.c_custkey = d.doc_id % (SELECT count(*) FROM customer)
)"""


def with_postings(body: str) -> str:
    return f"WITH {POSTINGS_SQL}\n{body}"


# Unicode word match for the SQL side, whose \\b is ASCII only.
def word_sql(text: str, term: str) -> str:
    return f"regexp_matches({text}, '(^|[^\\p{{L}}\\p{{N}}_]){term}($|[^\\p{{L}}\\p{{N}}_])')"


def word_count_sql(text: str, term: str) -> str:
    return f"len(list_filter(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: w = '{term}'))"


def count_sql(text: str, term: str) -> str:
    return f"CAST((length({text}) - length(replace({text}, '{term}', ''))) / {len(term)} AS BIGINT)"
