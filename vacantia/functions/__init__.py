"""Column functions; every one takes and returns Columns so that Catalyst sees through them."""
from vacantia.functions.dates import parse_epoch_ms, parse_iso, parse_relative_posted
from vacantia.functions.names import (
    canonical_url, company_matches, dedup_key, name_tokens, normalize_job_type, parse_workday_url,
    pretty_company, safe_url, slug_candidates, stable_job_id,
)
from vacantia.functions.pay import (
    coerce_amount, enrich_salary, extract_salary, format_salary, interval_suffix, quality_flags, salary_value,
)
from vacantia.functions.scores import coerce_score, scoring_text
from vacantia.functions.terms import any_term, extract_terms, term_count, term_present
from vacantia.functions.text import falsy_to_null, make_snippet, snippet_of, strip_html, trim_ws

__all__ = [
    "any_term", "canonical_url", "coerce_amount", "coerce_score", "company_matches", "dedup_key",
    "enrich_salary", "extract_salary", "extract_terms", "falsy_to_null", "format_salary",
    "interval_suffix", "make_snippet", "name_tokens", "normalize_job_type", "parse_epoch_ms",
    "parse_iso", "parse_relative_posted", "parse_workday_url", "pretty_company", "quality_flags",
    "safe_url", "salary_value", "scoring_text", "slug_candidates", "snippet_of", "stable_job_id",
    "strip_html", "term_count", "term_present", "trim_ws",
]
