"""Registered queries for criteria predicates, relevance and seen/target joins."""
from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.functions import quality_flags
from vacantia.operators import criteria as K
from vacantia.operators.seen import drop_seen, seen_ids
from vacantia.operators.targets import at_targets, target_links
from vacantia.plans.base import NOW, NOW_SQL, count_sql, postings, table, with_postings, word_count_sql, word_sql

c = F.col
FULL = K.Criteria(
    must_have=("e", "on"), nice_to_have=("the", "que"), exclude=("thand", "der"), match_mode="substring",
    location_excludes=("Australia",), work_mode="any", experience_level="mid", date_posted_hours=36, salary_min=20000, job_type="full-time")

_T, _D = "lower(title)", "lower(description)"


def _filter(crit: K.Criteria, part):
    """A query that keeps the ids passing one compiled predicate."""
    def query(spark, sf):
        return postings(spark, sf).where(part(crit)).select("job_id")
    return query


def _now(part):
    return lambda crit: part(crit, F.lit(NOW))


def _sql(where: str) -> str:
    return with_postings(f"SELECT job_id FROM postings WHERE {where}")


MUST_SQL = f"(contains({_T}, 'the') OR contains({_D}, 'the')) AND (contains({_T}, 'ou') OR contains({_D}, 'ou'))"
WORD_TITLE_SQL = word_sql(_T, "the")
EXCLUDE_SQL = f"NOT ({word_sql(_T, 'thand')} OR {word_sql(_T, 'der')} OR {word_sql(_T, 'of the')})"
BLOCK_SQL = "NOT contains(location, 'Australia') AND NOT contains(location, 'France')"
ALLOW_SQL = "location = '' OR contains(location, 'US')"
_REMOTE = "(coalesce(is_remote, FALSE) OR contains(lower(location), 'remote'))"
JOB_TYPE_SQL = "job_type IS NULL OR job_type = '' OR job_type = 'Full-time'"
_SENIOR = " OR ".join(f"contains({_T}, '{w}')" for w in K.SENIOR_WORDS)
MID_SQL = f"(contains({_T} || ' ', 'mid') OR contains({_T} || ' ', 'intermediate') OR NOT ({_SENIOR}))"
RECENT_SQL = f"posted_date IS NULL OR posted_date >= {NOW_SQL} - INTERVAL 36 HOURS"
SALARY_SQL = "salary_max_amount IS NULL OR salary_max_amount >= 20000"
FULL_WHERE = " AND ".join(f"({x})" for x in (
    f"(contains({_T}, 'e') OR contains({_D}, 'e')) AND (contains({_T}, 'on') OR contains({_D}, 'on'))",
    f"NOT ({word_sql(_T, 'thand')} OR {word_sql(_T, 'der')})", "NOT contains(location, 'Australia')",
    JOB_TYPE_SQL, MID_SQL, RECENT_SQL, SALARY_SQL))

RANK = K.Criteria(must_have=("the", "en"), nice_to_have=("ou", "que"), match_mode="substring")
RANK_WORD = K.Criteria(must_have=("the", "of"), nice_to_have=("and",), match_mode="word")


def _flagged(spark, sf):
    return postings(spark, sf).withColumn("flags", quality_flags(c("salary"), c("posted_date")))


def relevance(spark, sf):
    return _flagged(spark, sf).select("job_id", F.round(K.relevance(RANK, F.lit(NOW)), 6).alias("relevance"))


def relevance_word(spark, sf):
    return _flagged(spark, sf).select("job_id", F.round(K.relevance(RANK_WORD, F.lit(NOW), 0.5), 6).alias("relevance"))


_COMMON_POINTS = f"""CASE WHEN posted_date IS NOT NULL THEN greatest(0.0::DOUBLE, 5.0::DOUBLE - greatest(0.0::DOUBLE,
    (epoch_us({NOW_SQL}) - epoch_us(posted_date)) / 1e6::DOUBLE / 3600.0::DOUBLE) / 24.0::DOUBLE) ELSE 0 END
  - 0.5::DOUBLE * (CASE WHEN salary IS NULL THEN 1 ELSE 0 END + CASE WHEN posted_date IS NULL THEN 1 ELSE 0 END)"""


def _points(weight: float) -> str:
    return f"{_COMMON_POINTS} + coalesce({weight}::DOUBLE * (llm_score / 20.0::DOUBLE), 0)"


RELEVANCE_SQL = f"""{' + '.join(f'''CASE WHEN contains({_T}, '{t}') THEN 3.0::DOUBLE ELSE 0 END + 0.5::DOUBLE * least({count_sql(_D, t)}, 5)''' for t in ('the', 'en'))}
  + {' + '.join(f'''CASE WHEN contains({_T}, '{t}') THEN 1.5::DOUBLE WHEN contains({_D}, '{t}') THEN 0.75::DOUBLE ELSE 0 END''' for t in ('ou', 'que'))} + {_points(1.0)}"""
RELEVANCE_WORD_SQL = f"""{' + '.join(f'''CASE WHEN {word_sql(_T, t)} THEN 3.0::DOUBLE ELSE 0 END + 0.5::DOUBLE * least({word_count_sql(_D, t)}, 5)''' for t in ('the', 'of'))}
  + CASE WHEN {word_sql(_T, 'and')} THEN 1.5::DOUBLE WHEN {word_sql(_D, 'and')} THEN 0.75::DOUBLE ELSE 0 END + {_points(0.5)}"""


def rank_topk(spark, sf):
    return K.rank_postings(_flagged(spark, sf), RANK, F.lit(NOW), top=50).select("job_id", F.round("relevance", 6).alias("relevance"))


def filter_rank(spark, sf):
    kept = K.filter_postings(_flagged(spark, sf), FULL, F.lit(NOW))
    return K.rank_postings(kept, RANK, F.lit(NOW)).select("job_id", F.round("relevance", 6).alias("relevance"))


def seen_antijoin(spark, sf):
    seen = seen_ids(table(spark, sf, "labels").select(c("doc_id").cast("string").alias("job_id")))
    return drop_seen(postings(spark, sf), seen).select("job_id", "source")


def target_companies(spark, sf):
    crit = K.Criteria(target_companies=("Customer 000000007", "red widget", "000000042", " "))
    people = table(spark, sf, "customer").select(c("c_custkey").alias("key"), c("c_name").alias("company"))
    parts = table(spark, sf, "part").select(c("p_partkey").alias("key"), F.concat_ws(" ", "p_brand", "p_name").alias("company"))
    return people.unionByName(parts).where(K.at_target(crit)).select("key", "company")


_TARGETS = ("['customer', '000000007']", "['red', 'widget']", "['000000042']")
TARGET_SQL = f"""WITH x AS (SELECT c_custkey AS key, c_name AS company FROM customer UNION ALL SELECT p_partkey, p_brand || ' ' || p_name FROM part),
y AS (SELECT *, regexp_extract_all(lower(company), '[a-z0-9]+') AS t FROM x)
SELECT key, company FROM y WHERE len(t) > 0 AND ({' OR '.join(f'list_has_all(t, {w}) OR list_has_all({w}, t)' for w in _TARGETS)})"""



def _employers(spark, sf):
    """Names of customers, suppliers and branded parts, with their rows; and a long list of targets, some wider than a name, some narrower."""
    people, makers, parts = (table(spark, sf, t) for t in ("customer", "supplier", "part"))
    names = people.select(c("c_custkey").alias("key"), c("c_name").alias("company")).unionByName(
        makers.select(c("s_suppkey").alias("key"), c("s_name").alias("company"))).unionByName(
        parts.select(c("p_partkey").alias("key"), F.concat_ws(" ", "p_brand", "p_name").alias("company")))
    targets = people.where("c_custkey % 3 = 0").select(F.concat(c("c_name"), F.lit(" Holding, Inc.")).alias("target")).unionByName(
        makers.where("s_suppkey % 2 = 0").select(F.substring_index("s_name", "#", -1).alias("target"))).unionByName(
        parts.where("p_partkey % 5 = 0").select(F.concat_ws(" / ", "p_name", F.substring_index("p_brand", "#", -1)).alias("target")))
    return names, targets


def target_index(spark, sf):
    """Per company name the targets it matches, by the containment index."""
    links = target_links(*_employers(spark, sf))
    return links.groupBy("company").agg(F.count(F.lit(1)).alias("targets"), F.min("target").alias("first_target"))


def target_rows(spark, sf):
    """Rows at any of the targets."""
    return at_targets(*_employers(spark, sf)).select("key", "company")


_EMPLOYERS_SQL = """x AS (SELECT c_custkey AS key, c_name AS company FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier
  UNION ALL SELECT p_partkey, p_brand || ' ' || p_name FROM part),
g AS (SELECT c_name || ' Holding, Inc.' AS target FROM customer WHERE c_custkey % 3 = 0 UNION SELECT split_part(s_name, '#', 2) FROM supplier WHERE s_suppkey % 2 = 0
  UNION SELECT p_name || ' / ' || split_part(p_brand, '#', 2) FROM part WHERE p_partkey % 5 = 0),
y AS (SELECT DISTINCT company, regexp_extract_all(lower(company), '[a-z0-9]+') AS t FROM x), h AS (SELECT target, regexp_extract_all(lower(target), '[a-z0-9]+') AS w FROM g),
links AS (SELECT company, target FROM y, h WHERE list_has_all(t, w) OR list_has_all(w, t))"""
TARGET_INDEX_SQL = f"WITH {_EMPLOYERS_SQL} SELECT company, count(*) AS targets, min(target) AS first_target FROM links GROUP BY company"
TARGET_ROWS_SQL = f"WITH {_EMPLOYERS_SQL} SELECT key, company FROM x WHERE company IN (SELECT company FROM links)"

QUERIES = {
    "filter_must_have": (_filter(K.Criteria(must_have=("the", " ", "OU")), K.must_have), _sql(MUST_SQL)),
    "filter_must_have_word_title": (
        _filter(K.Criteria(must_have=("The",), match_mode="word", match_fields="title"), K.must_have), _sql(WORD_TITLE_SQL)),
    "filter_exclude": (_filter(K.Criteria(exclude=("thand", "Der", "of the", "")), K.not_excluded), _sql(EXCLUDE_SQL)),
    "filter_location_block": (_filter(K.Criteria(location_excludes=("Australia", "france", "aus")), K.in_location), _sql(BLOCK_SQL)),
    "filter_location_allow": (_filter(K.Criteria(location_includes=("US",)), K.in_location), _sql(ALLOW_SQL)),
    "filter_location_both": (
        _filter(K.Criteria(location_includes=("US", "Paris"), location_excludes=("France",)), K.in_location), _sql(ALLOW_SQL)),
    "filter_work_remote": (_filter(K.Criteria(work_mode="remote"), K.in_work_mode), _sql(_REMOTE)),
    "filter_work_onsite": (_filter(K.Criteria(work_mode="onsite"), K.in_work_mode), _sql(f"NOT {_REMOTE}")),
    "filter_job_type": (_filter(K.Criteria(job_type="Full Time"), K.of_job_type), _sql(JOB_TYPE_SQL)),
    "filter_experience": (_filter(K.Criteria(experience_level=" Mid"), K.of_experience), _sql(MID_SQL)),
    "filter_recency": (_filter(K.Criteria(date_posted_hours=36), _now(K.recent)), _sql(RECENT_SQL)),
    "filter_salary": (_filter(K.Criteria(salary_min=20000), K.pays_enough), _sql(SALARY_SQL)),
    "filter_all": (_filter(FULL, _now(K.matches)), _sql(FULL_WHERE)),
    "score_floor": (
        lambda spark, sf: postings(spark, sf).where(K.above_score(50)).select("job_id", "llm_score"),
        with_postings("SELECT job_id, llm_score FROM postings WHERE llm_score IS NULL OR llm_score >= 50")),
    "relevance": (relevance, with_postings(f"SELECT job_id, round({RELEVANCE_SQL}, 6) AS relevance FROM postings")),
    "relevance_word": (relevance_word, with_postings(f"SELECT job_id, round({RELEVANCE_WORD_SQL}, 6) AS relevance FROM postings")),
    "rank_topk": (rank_topk, with_postings(
        f"SELECT job_id, round(r, 6) AS relevance FROM (SELECT *, {RELEVANCE_SQL} AS r FROM postings) ORDER BY r DESC, doc_id LIMIT 50")),
    "filter_rank": (filter_rank, with_postings(f"SELECT job_id, round({RELEVANCE_SQL}, 6) AS relevance FROM postings WHERE {FULL_WHERE}")),
    "seen_antijoin": (seen_antijoin, with_postings(
        "SELECT job_id, source FROM postings WHERE job_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)")),
    "target_companies": (target_companies, TARGET_SQL),
    "target_index": (target_index, TARGET_INDEX_SQL),
    "target_rows": (target_rows, TARGET_ROWS_SQL),
}
