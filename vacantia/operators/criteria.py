"""Search criteria compiled to one Spark predicate and one relevance expression."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.names import company_matches, normalize_job_type
from vacantia.functions.pay import salary_value
from vacantia.functions.terms import any_term, term_count, term_present
from vacantia.functions.text import trim_ws

# Hints per experience level and the words that mark a senior title.
EXPERIENCE_HINTS = {
    "entry": ("intern", "junior", "entry", "new grad", "graduate", "associate"),
    "junior": ("junior", "entry", "associate", "jr"),
    "mid": ("mid", "intermediate"),
    "senior": ("senior", "sr", "staff", "principal", "lead"),
    "lead": ("lead", "principal", "staff", "manager", "head", "director"),
}
SENIOR_WORDS = ("senior", "staff", "principal", "lead", "head", "director", "vp", "manager")
EARLY_LEVELS = ("entry", "junior", "mid")


@dataclass(frozen=True)
class Criteria:
    must_have: tuple[str, ...] = ()
    nice_to_have: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    target_companies: tuple[str, ...] = ()
    match_mode: str = "substring"  # or "word"
    match_fields: str = "title_and_description"  # or "title"
    location: str | None = None
    location_includes: tuple[str, ...] = ()
    location_excludes: tuple[str, ...] = ()
    work_mode: str = "any"  # any, remote, hybrid, onsite
    experience_level: str | None = None
    date_posted_hours: int | None = None
    salary_min: int | None = None
    job_type: str | None = None

    @property
    def search_term(self) -> str:
        return " ".join(t.strip() for t in self.must_have if t.strip())


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def must_have(c: Criteria) -> Column:
    return _all([term_present(t, F.col("title"), F.col("description"), c.match_mode, c.match_fields)
                 for t in c.must_have if t.strip()])


def not_excluded(c: Criteria) -> Column:
    return ~any_term(c.exclude, F.col("title"))


def in_location(c: Criteria) -> Column:
    """Blank locations pass; the block list wins; a set allow list must match."""
    place = trim_ws(F.coalesce(F.col("location"), F.lit("")))
    allowed = any_term(c.location_includes, place) if c.location_includes else F.lit(True)
    return (place == "") | (~any_term(c.location_excludes, place) & allowed)


def in_work_mode(c: Criteria) -> Column:
    remote = F.coalesce(F.col("is_remote"), F.lit(False)) | F.lower(F.coalesce("location", F.lit(""))).contains("remote")
    return {"remote": remote, "onsite": ~remote}.get(c.work_mode, F.lit(True))


def of_job_type(c: Criteria) -> Column:
    """Only a known, different type is dropped."""
    if not c.job_type:
        return F.lit(True)
    want, have = normalize_job_type(F.lit(c.job_type)), normalize_job_type(F.col("job_type"))
    return F.coalesce((want == "") | (have == "") | (want == have), F.lit(True))


def of_experience(c: Criteria) -> Column:
    if not c.experience_level:
        return F.lit(True)
    level = c.experience_level.strip().lower()
    title = F.lower(F.coalesce(F.col("title"), F.lit("")))
    text = F.concat(title, F.lit(" "), F.lower(F.coalesce(F.col("job_level"), F.lit(""))))
    if level not in EARLY_LEVELS:
        return F.lit(True)
    hinted = any_term(EXPERIENCE_HINTS[level], text, mode="substring")
    return hinted | ~any_term(SENIOR_WORDS, title, mode="substring")


def recent(c: Criteria, now: Column) -> Column:
    if not c.date_posted_hours:
        return F.lit(True)
    edge = now - F.make_dt_interval(hours=F.lit(c.date_posted_hours))
    return F.col("posted_date").isNull() | (F.col("posted_date") >= edge)


def pays_enough(c: Criteria) -> Column:
    if not c.salary_min:
        return F.lit(True)
    pay = salary_value(F.col("salary_min_amount"), F.col("salary_max_amount"))
    return pay.isNull() | (pay >= F.lit(float(c.salary_min)))


def at_target(c: Criteria) -> Column:
    """Any of the configured target employers; no targets means every company."""
    targets = [t.strip() for t in c.target_companies if t.strip()]
    if not targets:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [company_matches(F.col("company"), t) for t in targets])


def matches(c: Criteria, now: Column) -> Column:
    """The full predicate, cheap tests first (codegen short-circuits the conjunction)."""
    return _all([recent(c, now), pays_enough(c), in_work_mode(c), of_job_type(c), in_location(c),
                 of_experience(c), not_excluded(c), must_have(c)])


def filter_postings(df: DataFrame, c: Criteria, now: Column) -> DataFrame:
    return df.where(matches(c, now))


def above_score(minimum: int | None) -> Column:
    """Unscored rows stay; scored rows need ``minimum``."""
    if minimum is None:
        return F.lit(True)
    return F.col("llm_score").isNull() | (F.col("llm_score") >= minimum)


# Relevance weights.
TITLE_HIT, TEXT_HIT, TEXT_HITS_MAX = 3.0, 0.5, 5
NICE_TITLE, NICE_TEXT = 1.5, 0.75
FRESH_POINTS, FLAG_COST, SCORE_UNIT = 5.0, 0.5, 20.0


def relevance(c: Criteria, now: Column, score_weight: float = 1.0) -> Column:
    """Keyword density, recency, quality flags and, where present, the relevance score."""
    title, text, none = F.col("title"), F.col("description"), F.lit("")
    points = F.lit(0.0)
    for term in (t for t in c.must_have if t.strip()):
        hit = term_present(term, title, none, c.match_mode, "title")
        points = points + F.when(hit, TITLE_HIT).otherwise(0.0)
        hits = F.least(term_count(term, text, none, c.match_mode, "title"), F.lit(TEXT_HITS_MAX))
        points = points + F.lit(TEXT_HIT) * hits
    for term in (t for t in c.nice_to_have if t.strip()):
        in_title = term_present(term, title, none, c.match_mode, "title")
        in_text = term_present(term, text, none, c.match_mode, "title")
        points = points + F.when(in_title, NICE_TITLE).when(in_text, NICE_TEXT).otherwise(0.0)
    hours = (F.unix_micros(now) - F.unix_micros("posted_date")) / F.lit(1e6) / F.lit(3600.0)
    fresh = F.greatest(F.lit(0.0), F.lit(FRESH_POINTS) - F.greatest(F.lit(0.0), hours) / F.lit(24.0))
    points = points + F.when(F.col("posted_date").isNotNull(), fresh).otherwise(0.0)
    points = points - F.lit(FLAG_COST) * F.coalesce(F.size("flags"), F.lit(0))
    scored = F.lit(float(score_weight)) * (F.col("llm_score") / F.lit(SCORE_UNIT))
    return points + F.coalesce(scored, F.lit(0.0))


def rank_postings(df: DataFrame, c: Criteria, now: Column, score_weight: float = 1.0,
                  top: int | None = None) -> DataFrame:
    """Relevance descending, arrival order on ties; ``top`` turns the sort into a top-k."""
    ranked = df.withColumn("relevance", relevance(c, now, score_weight)).orderBy(F.desc("relevance"), "ord")
    return ranked if top is None else ranked.limit(top)
