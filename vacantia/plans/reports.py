"""Registered queries for health, funnel, digest, scoring and the whole run."""
from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.functions import quality_flags
from vacantia.operators import criteria as K
from vacantia.operators import digest as D
from vacantia.operators.scoring import attach_scores, score_rows, scoring_budget
from vacantia.functions.terms import WORD_TERMS
from vacantia.operators.seen import SeenTable, seen_ids
from vacantia.plans.base import NOW, NOW_SQL, POSTINGS_SQL, micros, postings, table, with_postings
from vacantia.plans.daily import ScoreSettings, publish, run_postings
from vacantia.plans.filters import FULL, FULL_WHERE, RANK, RELEVANCE_SQL
from vacantia.plans.merging import _TITLE_TEXT, _greedy_sql
from vacantia.session import scratch_path

c = F.col

# --- source health: events as a fetch log, three boards per source -----------------------------


def _fetch_log(spark, sf):
    k = c("event_id")
    return table(spark, sf, "events").select(
        F.concat(F.lit("s"), F.floor(k / 3)).alias("source"), F.concat(F.lit("b"), k % 3).alias("board"), (k % 3).cast("int").alias("board_ord"),
        (c("event_type") != "error").alias("ok"), F.when(c("event_type") == "error", F.concat(F.lit("E"), k)).alias("error"), "event_type", k.alias("k"))


def _health(spark, sf):
    log = _fetch_log(spark, sf)
    rows = log.where("event_type = 'view'").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    registry = log.groupBy("source").agg(F.min("k").alias("k")).select(
        "source", (c("k") / 3).cast("int").alias("source_ord"), (F.floor(c("k") / 3) % 2 == 0).alias("is_scraped"))
    return D.source_health(log.drop("event_type", "k"), rows, registry)


HEALTH_SQL = """SELECT 's' || n AS source, CAST(n AS INTEGER) AS source_ord, bad < boards AS ok, CAST(CASE WHEN bad < boards THEN views ELSE 0 END AS BIGINT) AS count,
  CASE WHEN bad = boards THEN CASE WHEN n % 2 = 0 THEN first_error ELSE 'RuntimeError: all ' || boards || ' s' || n || ' board(s) failed: ' || names END END AS error,
  bad < boards AND views = 0 AS near_empty FROM (SELECT event_id // 3 AS n, count(*) AS boards, count(*) FILTER (WHERE event_type = 'error') AS bad,
    count(*) FILTER (WHERE event_type = 'view') AS views, min_by('E' || event_id, CASE WHEN event_type = 'error' THEN event_id END) AS first_error,
    string_agg('b' || event_id % 3, ', ' ORDER BY event_id) AS names FROM events GROUP BY 1)"""


def source_health(spark, sf):
    return _health(spark, sf)


def run_decision(spark, sf):
    new = postings(spark, sf).where(K.recent(FULL, F.lit(NOW))).agg(F.count(F.lit(1)).alias("new"))
    return D.run_decision(_health(spark, sf), new)


DECISION_SQL = with_postings(f""", h AS ({HEALTH_SQL}), n AS (SELECT count(*) AS new FROM postings WHERE posted_date IS NULL OR posted_date >= {NOW_SQL} - INTERVAL 36 HOURS),
a AS (SELECT count(*) > 0 AND bool_and(NOT ok) AS all_failed FROM h)
SELECT all_failed, new, CASE WHEN new > 0 THEN TRUE WHEN all_failed THEN TRUE ELSE FALSE END AS send,
  CASE WHEN all_failed THEN '[Job Digest] ⚠ all sources failed' ELSE '[Job Digest] ' || new || ' new job' || CASE WHEN new = 1 THEN '' ELSE 's' END END AS subject FROM a, n""").replace(")\n, h", "), h")


# --- digest ------------------------------------------------------------------------------------

def _ranked(spark, sf):
    flagged = postings(spark, sf).withColumn("flags", quality_flags(c("salary"), c("posted_date")))
    return K.rank_postings(flagged, RANK, F.lit(NOW))


def digest_groups(spark, sf):
    return D.group_sizes(postings(spark, sf))


def digest_order(spark, sf):
    return D.digest_order(_ranked(spark, sf)).select("job_id", "source", "group_size", "position", "place")


_ORDER = "n DESC, source, posted_date DESC NULLS LAST, r DESC, doc_id"
DIGEST_SQL = with_postings(f"""SELECT job_id, source, n AS group_size, row_number() OVER (ORDER BY {_ORDER}) AS position,
  row_number() OVER (PARTITION BY source ORDER BY posted_date DESC NULLS LAST, r DESC, doc_id) AS place
  FROM (SELECT *, {RELEVANCE_SQL} AS r, count(*) OVER (PARTITION BY source) AS n FROM postings)""")


def digest_sink(spark, sf):
    path = scratch_path(spark, "digest")
    D.digest_order(_ranked(spark, sf)).write.parquet(path)
    return spark.read.parquet(path).select("job_id", "source", "group_size", "position", "place")


# --- scoring -----------------------------------------------------------------------------------

def _title_scorer(row: dict, ideal_role: str) -> dict:
    """Deterministic stand-in for a relevance model."""
    title = row["title"]
    if len(title) % 10 == 3:
        raise RuntimeError(f"no score for {row['job_id']}")
    return {"score": len(title) * 3 - 10, "verdict": "strong" if len(title) % 4 == 0 else "?", "reason": f" {ideal_role} "}


BUDGET = 500


def _scored(spark, sf):
    rows = postings(spark, sf)
    scores = score_rows(scoring_budget(rows, None), _title_scorer, "data")
    return attach_scores(rows, scores)


_SCORE_SQL = f"""scored AS (SELECT p.* EXCLUDE (llm_score), b.doc_id IS NOT NULL AS tried, CASE WHEN b.doc_id IS NOT NULL AND length(title) % 10 <> 3
    THEN greatest(0, least(100, length(title) * 3 - 10)) END AS llm_score
  FROM postings p LEFT JOIN (SELECT doc_id FROM postings) b USING (doc_id))"""


def scored_rows(spark, sf):
    return _scored(spark, sf).select("job_id", "llm_score", "llm_verdict", "llm_reason", "score_error")


SCORED_SQL = f"""WITH {POSTINGS_SQL}, {_SCORE_SQL}
SELECT job_id, CAST(llm_score AS INTEGER) AS llm_score, CASE WHEN llm_score IS NULL THEN NULL WHEN length(title) % 4 = 0 THEN 'strong' WHEN llm_score >= 67 THEN 'strong'
  WHEN llm_score >= 34 THEN 'maybe' ELSE 'weak' END AS llm_verdict, CASE WHEN llm_score IS NOT NULL THEN 'data' END AS llm_reason,
  CASE WHEN tried AND llm_score IS NULL THEN 'RuntimeError: no score for ' || job_id END AS score_error FROM scored"""


def score_budget(spark, sf):
    return scoring_budget(postings(spark, sf), BUDGET).select("job_id")


def score_batch(spark, sf):
    return D.score_outcome(_scored(spark, sf))


SCORE_BATCH_SQL = f"""WITH {POSTINGS_SQL}, {_SCORE_SQL}
SELECT count(llm_score) AS scored, count(*) FILTER (WHERE tried AND llm_score IS NULL) AS failed,
  min_by('RuntimeError: no score for ' || job_id, CASE WHEN tried AND llm_score IS NULL THEN doc_id END) AS error,
  count(*) FILTER (WHERE tried AND llm_score IS NULL) > 0 AND count(llm_score) = 0 AS systemic FROM scored"""


def score_rank(spark, sf):
    kept = _scored(spark, sf).where(K.above_score(40)).withColumn("flags", quality_flags(c("salary"), c("posted_date")))
    return K.rank_postings(kept, RANK, F.lit(NOW)).select("job_id", "llm_score", F.round("relevance", 6).alias("relevance"))


SCORE_RANK_SQL = f"""WITH {POSTINGS_SQL}, {_SCORE_SQL}
SELECT job_id, CAST(llm_score AS INTEGER) AS llm_score, round({RELEVANCE_SQL}, 6) AS relevance FROM scored WHERE llm_score IS NULL OR llm_score >= 40"""


# --- the whole run -------------------------------------------------------------------------------

def _run(spark, sf):
    seen = seen_ids(table(spark, sf, "labels").where("quality = 0").select(c("doc_id").cast("string").alias("job_id")))
    return run_postings(postings(spark, sf), FULL, NOW, seen)


def daily_run(spark, sf):
    return _run(spark, sf).ranked.select(
        "job_id", "source", "salary", micros("posted_date").alias("posted_us"), F.round("relevance", 6).alias("relevance"),
        F.array_join("flags", ",").alias("flags"), F.array_join("skills", ",").alias("skills"))


def funnel(spark, sf):
    return _run(spark, sf).funnel


_FULL_NICE = " + ".join(
    f"CASE WHEN contains(lower(title), '{t}') THEN 1.5::DOUBLE WHEN contains(lower(description), '{t}') THEN 0.75::DOUBLE ELSE 0 END" for t in FULL.nice_to_have)
_FULL_MUST = " + ".join(
    f"CASE WHEN contains(lower(title), '{t}') THEN 3.0::DOUBLE ELSE 0 END + 0.5::DOUBLE * least((length(lower(description)) - length(replace(lower(description), '{t}', ''))) / {len(t)}, 5)::DOUBLE"
    for t in FULL.must_have)
_MERGED = f"""merged AS (SELECT m.win_id AS job_id, m.title, m.salary, m.salary_max_amount, m.is_remote, nullif(m.job_type, '-') AS job_type,
  make_timestamp(m.posted_us) AS posted_date, p.description, p.location, p.source, p.llm_score,
  concat_ws(',', CASE WHEN p.salary IS NULL THEN 'no_salary' END, CASE WHEN p.posted_date IS NULL THEN 'no_date' END) AS flags
  FROM m JOIN postings p ON p.job_id = m.win_id),
passed AS (SELECT * FROM merged WHERE {FULL_WHERE}), seen AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM labels WHERE quality = 0)"""
_POINTS = f"""{_FULL_MUST} + {_FULL_NICE} + CASE WHEN posted_date IS NOT NULL THEN greatest(0.0::DOUBLE, 5.0::DOUBLE - greatest(0.0::DOUBLE,
  (epoch_us({NOW_SQL}) - epoch_us(posted_date)) / 1e6::DOUBLE / 3600.0::DOUBLE) / 24.0::DOUBLE) ELSE 0 END
  - 0.5::DOUBLE * CASE flags WHEN '' THEN 0 WHEN 'no_salary,no_date' THEN 2 ELSE 1 END + coalesce(llm_score / 20.0::DOUBLE, 0)"""


def _run_sql(tail: str, head: str = POSTINGS_SQL) -> str:
    body = _greedy_sql(head.strip(), "postings", _TITLE_TEXT, "doc_id")
    return body[: body.rindex("SELECT win_id AS job_id")].rstrip() + f",\n{_MERGED}\n{tail}"


DAILY_SQL = _run_sql(f"""SELECT job_id, source, salary, CASE WHEN posted_date IS NOT NULL THEN epoch_us(posted_date) END AS posted_us, round({_POINTS}, 6) AS relevance, flags, '' AS skills
  FROM passed WHERE job_id NOT IN (SELECT id FROM seen)""")
FUNNEL_SQL = _run_sql("""SELECT (SELECT count(*) FROM postings) AS fetched, (SELECT count(*) FROM merged) AS after_dedup, (SELECT count(*) FROM passed) AS after_filter,
  (SELECT count(*) FROM passed WHERE job_id IN (SELECT id FROM seen)) AS seen_skipped, 0::BIGINT AS llm_scored,
  (SELECT count(*) FROM passed WHERE job_id NOT IN (SELECT id FROM seen)) AS after_llm, (SELECT count(*) FROM passed WHERE job_id NOT IN (SELECT id FROM seen)) AS new""")

# --- what a run publishes ------------------------------------------------------------------------
# Each posting names one technology, so that the skills of the digest are checked too.

_WORDS, _SHOWN = [aliases[0].upper() for _, aliases in WORD_TERMS], [name for name, _ in WORD_TERMS]


def publish_run(spark, sf):
    """A scored run, published and read back: digest with skills, health, outcome, decision and the ids recorded, as (part, key, value)."""
    word = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (c("ord.row_ord") % len(_WORDS) + 1).cast("int"))
    rows = postings(spark, sf).withColumn("description", F.concat("description", F.lit(" We use "), word, F.lit(", daily.")))
    store, out = SeenTable(spark, scratch_path(spark, "seen")), scratch_path(spark, "published")
    store.add(table(spark, sf, "labels").where("quality = 0").select(
        c("doc_id").cast("string").alias("job_id"), *[F.lit("").alias(x) for x in ("title", "company", "source", "first_seen")]), "earlier")
    run = run_postings(rows, FULL, NOW, store.load(), ScoreSettings(_title_scorer, "data", min_score=40, max_jobs=None))
    run.health = _health(spark, sf)
    publish(run, out, store, "b1", NOW)

    def part(name, *cols):
        df = store.records().where("batch_id = 'b1'") if name == "recorded" else spark.read.parquet(f"{out}/{name}/batch_id=b1")
        key, value = cols
        return df.select(F.lit(name).alias("part"), key.cast("string").alias("key"), value.cast("string").alias("value"))

    return (part("digest", c("job_id"), F.array_join("skills", ","))
            .unionByName(part("health", c("source"), F.concat_ws("|", "ok", "count", "near_empty", "error")))
            .unionByName(part("outcome", c("error"), F.concat_ws("|", "scored", "failed", "systemic")))
            .unionByName(part("decision", c("subject"), F.concat_ws("|", "all_failed", "new", "send")))
            .unionByName(part("funnel", F.lit("counts"), F.concat_ws("|", *D.STAGES)))
            .unionByName(part("recorded", c("job_id"), c("first_seen"))))


_SKILLED = POSTINGS_SQL.replace("d.text AS description", f"d.text || ' We use ' || ({_WORDS!r})[d.doc_id % {len(_WORDS)} + 1] || ', daily.' AS description")
PUBLISH_SQL = _run_sql(f"""SELECT * FROM (WITH fresh AS (SELECT job_id, title, length(title) % 10 = 3 AS bad, greatest(0, least(100, length(title) * 3 - 10)) AS points
    FROM passed WHERE job_id NOT IN (SELECT id FROM seen)),
  kept AS (SELECT * FROM fresh WHERE bad OR points >= 40), h AS ({HEALTH_SQL}), n AS (SELECT count(*) AS new FROM kept), a AS (SELECT bool_and(NOT ok) AS all_failed FROM h)
  SELECT 'digest' AS part, job_id AS key, ({_SHOWN!r})[CAST(job_id AS BIGINT) % {len(_SHOWN)} + 1] AS value FROM kept
  UNION ALL SELECT 'health', source, concat_ws('|', ok, count, near_empty, error) FROM h
  UNION ALL SELECT 'outcome', min_by('RuntimeError: no score for ' || job_id, CAST(job_id AS BIGINT)) FILTER (WHERE bad),
    concat_ws('|', count(*) FILTER (WHERE NOT bad), count(*) FILTER (WHERE bad), count(*) FILTER (WHERE bad) > 0 AND count(*) FILTER (WHERE NOT bad) = 0) FROM fresh
  UNION ALL SELECT 'decision', CASE WHEN all_failed THEN '[Job Digest] ⚠ all sources failed' ELSE '[Job Digest] ' || new || ' new job' || CASE WHEN new = 1 THEN '' ELSE 's' END END,
    concat_ws('|', all_failed, new, new > 0 OR all_failed) FROM a, n
  UNION ALL SELECT 'funnel', 'counts', concat_ws('|', (SELECT count(*) FROM postings), (SELECT count(*) FROM merged), (SELECT count(*) FROM passed),
    (SELECT count(*) FROM passed WHERE job_id IN (SELECT id FROM seen)), (SELECT count(*) FROM fresh WHERE NOT bad), n.new, n.new) FROM n
  UNION ALL SELECT 'recorded', job_id, '2024-01-03T12:00:00.000000+00:00' FROM kept, a, n WHERE new > 0 OR all_failed)""", _SKILLED)

QUERIES = {
    "daily_run": (daily_run, DAILY_SQL),
    "funnel": (funnel, FUNNEL_SQL),
    "publish_run": (publish_run, PUBLISH_SQL),
    "source_health": (source_health, HEALTH_SQL),
    "run_decision": (run_decision, DECISION_SQL),
    "digest_groups": (digest_groups, with_postings("SELECT source, count(*) AS n FROM postings GROUP BY source")),
    "digest_order": (digest_order, DIGEST_SQL),
    "digest_sink": (digest_sink, DIGEST_SQL),
    "scored_rows": (scored_rows, SCORED_SQL),
    "score_budget": (score_budget, with_postings(f"SELECT job_id FROM postings ORDER BY doc_id LIMIT {BUDGET}")),
    "score_batch": (score_batch, SCORE_BATCH_SQL),
    "score_rank": (score_rank, SCORE_RANK_SQL),
}
