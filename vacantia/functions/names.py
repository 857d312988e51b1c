"""Identifiers, URLs, company names and board slugs."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions.pay import lookup
from vacantia.functions.text import WS, falsy_to_null, lit_or_col, trim_ws

# Job-type aliases after removing '-', '_' and blanks.
JOB_TYPE_ALIASES = {
    "full": "fulltime", "fulltime": "fulltime", "part": "parttime", "parttime": "parttime",
    "contract": "contract", "contractor": "contract", "temp": "temporary", "temporary": "temporary",
    "intern": "internship", "internship": "internship",
}
# Fixed value: a path part that names a language, maybe with a region.
_LOCALE = "^[a-z]{2}([-_][A-Za-z]{2})?$"


def canonical_url(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.substring_index(c, "#", 1), "/+$", ""))


def safe_url(c: Column) -> Column:
    """The trimmed link when it is http(s), else ``#``."""
    url = trim_ws(c)
    return F.when(F.lower(url).rlike("^https?://"), url).otherwise(F.lit("#"))


def stable_job_id(source: Column | str, native_id: Column, url: Column, company: Column,
                  title: Column, location: Column) -> Column:
    """16 hex digits of the feed's own id, else of the URL, else of company, title and location."""
    source = lit_or_col(source)
    basis = F.coalesce(
        F.concat(source, F.lit(":"), falsy_to_null(native_id)),
        F.concat(source, F.lit(":"), canonical_url(falsy_to_null(url))),
        F.lower(F.concat(source, F.lit(":"), F.concat_ws("|", company, title, location))),
    )
    return F.substring(F.sha1(basis), 1, 16)


def normalize_job_type(c: Column) -> Column:
    key = F.translate(F.lower(trim_ws(falsy_to_null(c))), "-_ ", "")
    return F.coalesce(lookup(JOB_TYPE_ALIASES, key), key)


def pretty_company(slug: Column) -> Column:
    """Readable name from a board slug: title case only when the slug is all lower case."""
    cleaned = trim_ws(F.translate(slug, "-_", "  "))
    words = F.split(cleaned, r"(?<=[^\p{L}])(?=\p{L})")
    titled = F.array_join(F.transform(
        words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")
    all_lower = (cleaned == F.lower(cleaned)) & (cleaned != F.upper(cleaned))
    return F.when(all_lower, titled).otherwise(F.coalesce(falsy_to_null(cleaned), slug))


def name_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0))


def company_matches(company: Column, target: Column | str) -> Column:
    """Whole-token containment either way."""
    have = F.coalesce(name_tokens(company), F.array().cast("array<string>"))
    want = F.coalesce(name_tokens(lit_or_col(target)), F.array().cast("array<string>"))
    inside = (F.size(F.array_except(have, want)) == 0) | (F.size(F.array_except(want, have)) == 0)
    return (F.size(have) > 0) & (F.size(want) > 0) & inside


def slug_candidates(name: Column) -> Column:
    """Ordered distinct board slugs to try for a company name."""
    name = trim_ws(name)
    low = F.lower(name)
    tries = F.array(
        F.regexp_replace(low, "[^a-z0-9]", ""),
        F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", ""),
        F.regexp_replace(name, f"[{WS}]+", ""),
        name,
    )
    return F.array_distinct(F.filter(tries, lambda s: s != ""))


def parse_workday_url(url: Column) -> Column:
    """Struct of host, tenant and site from a career-site or service URL."""
    full = F.when(url.contains("//"), url).otherwise(F.concat(F.lit("https://"), url))
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)"
    host = F.regexp_extract(full, pattern, 1)
    parts = F.filter(F.split(F.regexp_extract(full, pattern, 2), "/"), lambda p: p != "")
    at = F.array_position(parts, "cxs")
    first_label = F.substring_index(host, ".", 1)
    site = F.try_element_at(F.filter(parts, lambda p: ~p.rlike(_LOCALE)), F.lit(1))
    tenant_in = F.try_element_at(parts, (at + 1).cast("int"))
    site_in = F.try_element_at(parts, (at + 2).cast("int"))
    service = at > 0
    return F.struct(
        host.alias("host"),
        F.when(service, F.coalesce(tenant_in, first_label)).otherwise(first_label).alias("tenant"),
        F.coalesce(F.when(service, site_in).otherwise(site), F.lit("")).alias("site"),
    )


def dedup_key(company: Column, title: Column, location: Column) -> Column:
    return trim_ws(F.lower(F.concat_ws(" ", company, title, location)))
