"""Registered queries for the column functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from vacantia import functions as V
from vacantia.functions.terms import WORD_TERMS
from vacantia.plans.base import (
    NOW, NOW_SQL, count_sql, micros, postings, table, with_postings, word_count_sql, word_sql,
)

c = F.col

_CLEAN_SQL = r"""trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
  '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'), '[\s\x{00a0}]+', ' ', 'g'))"""


def strip_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", V.strip_html(c("html")).alias("text"))


def strip_html_escaped(spark, sf):
    escaped = F.replace(F.replace(F.replace(c("html"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return table(spark, sf, "pages").select("page_id", V.strip_html(escaped, escaped=True).alias("text"))


def snippet(spark, sf):
    return table(spark, sf, "pages").select("page_id", V.make_snippet(c("html")).alias("snippet"))


SNIPPET_SQL = f"""WITH t AS (SELECT page_id, {_CLEAN_SQL} AS s FROM pages)
SELECT page_id, CASE WHEN length(s) <= 300 THEN s
  ELSE regexp_replace(regexp_replace(substr(s, 1, 300), ' [^ ]*$', ''), '[.,;:—-]+$', '') || '…' END AS snippet FROM t"""


def canonical_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", V.canonical_url(F.concat(c("url"), F.lit("//#Top"))).alias("url"))


def stable_id(spark, sf):
    pages = table(spark, sf, "pages").withColumn("page_id", c("page_id"))
    native = F.when(c("page_id") % 3 == 0, c("page_id").cast("string")).otherwise("")
    url = F.when(c("page_id") % 3 == 1, c("url"))
    got = V.stable_job_id("board", native, url, F.lit("Acme"), c("url"), F.lit("Remote"))
    return pages.select("page_id", got.alias("job_id"))


STABLE_ID_SQL = r"""SELECT page_id, substr(sha1(CASE page_id % 3 WHEN 0 THEN 'board:' || page_id
  WHEN 1 THEN 'board:' || lower(regexp_replace(split_part(url, '#', 1), '/+$', ''))
  ELSE lower('board:Acme|' || url || '|Remote') END), 1, 16) AS job_id FROM pages"""


def safe_url(spark, sf):
    url = F.when(c("page_id") % 4 == 0, F.concat(F.lit("javascript:"), c("url"))).when(
        c("page_id") % 4 == 1, F.concat(F.lit("  "), F.upper(c("url")))).when(c("page_id") % 4 == 2, c("url"))
    return table(spark, sf, "pages").select("page_id", V.safe_url(url).alias("href"))


def board_url_parse(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), c("c_nationkey") == c("n_nationkey"))
    slug = F.lower(F.replace(c("c_name"), F.lit("#"), F.lit("-")))
    host = F.concat(slug, F.lit(".wd5.example.com"))
    url = (
        F.when(c("c_custkey") % 3 == 0, F.concat(F.lit("https://"), host, F.lit("/en-US/"), c("n_name"), F.lit("?q=1")))
        .when(c("c_custkey") % 3 == 1, F.concat(F.lit("https://"), host, F.lit("/wday/cxs/t"), c("c_nationkey"), F.lit("/"), c("n_name"), F.lit("/jobs")))
        .otherwise(F.concat(host, F.lit("/"), c("n_name"), F.lit("/job/x")))
    )
    return rows.select("c_custkey", V.parse_workday_url(url).alias("p")).select("c_custkey", "p.*")


BOARD_URL_SQL = """SELECT c_custkey, lower(replace(c_name, '#', '-')) || '.wd5.example.com' AS host,
  CASE WHEN c_custkey % 3 = 1 THEN 't' || c_nationkey ELSE lower(replace(c_name, '#', '-')) END AS tenant,
  n_name AS site FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def coerce_amount(spark, sf):
    text = F.when(c("c_custkey") % 10 == 0, F.lit("n/a")).otherwise(c("c_acctbal").cast("string"))
    return table(spark, sf, "customer").select(
        "c_custkey", V.coerce_amount(c("c_acctbal") - 5000).alias("amount"), V.coerce_amount(text, text=True).alias("from_text"))


COERCE_SQL = """SELECT c_custkey, CASE WHEN c_acctbal - 5000 > 0 THEN c_acctbal - 5000 END AS amount,
  CASE WHEN c_custkey % 10 <> 0 AND c_acctbal > 0 THEN c_acctbal END AS from_text FROM customer"""


def amount_format(spark, sf):
    low = F.when(c("p_partkey") % 5 != 0, c("p_retailprice") * c("p_size"))
    high = F.when(c("p_partkey") % 7 != 0, c("p_retailprice") * c("p_size") * F.lit(1.5))
    cur = F.element_at(F.array(*[F.lit(x) for x in ("USD", "eur", "GBP", "CHF", "")]), (c("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", V.format_salary(low, high, "yearly", cur).alias("pay"))


def _money(x: str) -> str:
    short = f"CAST(CAST(round_even({x} / 1000, 0) AS BIGINT) AS VARCHAR) || 'k'"
    return f"CASE WHEN {x} >= 1000 THEN sym || {short} ELSE sym || CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR) END"


AMOUNT_SQL = f"""WITH t AS (SELECT p_partkey,
  CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice * p_size END AS lo,
  CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice * p_size * CAST(1.5 AS DOUBLE) END AS hi,
  CASE p_partkey % 5 WHEN 1 THEN '€' WHEN 2 THEN '£' WHEN 3 THEN 'CHF ' ELSE '$' END AS sym FROM part)
SELECT p_partkey, CASE WHEN lo IS NULL AND hi IS NULL THEN NULL
  WHEN lo IS NOT NULL AND hi IS NOT NULL AND lo <> hi THEN ({_money('lo')}) || '–' || ({_money('hi')}) || '/yr'
  ELSE ({_money('coalesce(lo, hi)')}) || '/yr' END AS pay FROM t"""

_TOKENS = ("per-year-salary", "Hourly", "per-month-wage", " weekly ", "whenever")
_SUFFIX = ("/yr", "/hr", "/mo", "/wk", "")


def interval_suffix(spark, sf):
    token = F.element_at(F.array(*[F.lit(t) for t in _TOKENS]), (c("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", V.interval_suffix(token).alias("suffix"))


INTERVAL_SQL = "SELECT o_orderkey, CASE o_orderkey % 5 " + " ".join(
    f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SUFFIX)) + " END AS suffix FROM orders"


def parse_times(spark, sf):
    e = table(spark, sf, "events")
    kind = c("event_id") % 4
    text = (
        F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(kind == 1, F.date_format(c("ts") - F.expr("INTERVAL 4 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'-04:00'"))
        .when(kind == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise("not a date")
    )
    ms = F.when(c("event_id") % 5 == 0, F.lit("x")).otherwise(F.unix_millis("ts").cast("string"))
    out = e.select("event_id", V.parse_iso(text).alias("iso"), V.parse_epoch_ms(ms, text=True).alias("ms"))
    return out.select("event_id", micros("iso").alias("iso_us"), micros("ms").alias("ms_us"))


PARSE_SQL = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts)
  WHEN 2 THEN epoch_us(date_trunc('day', ts)) END AS iso_us,
  CASE WHEN event_id % 5 <> 0 THEN epoch_us(ts) // 1000 * 1000 END AS ms_us FROM events"""


def parse_relative(spark, sf):
    n = c("event_id") % 40
    text = F.when(n == 0, "Posted Today").when(n == 1, "Posted Yesterday").when(
        n < 20, F.concat(F.lit("Posted "), n, F.lit("+ Days Ago"))).when(
        n < 39, F.concat(F.lit("posted "), n - 19, F.lit(" months ago"))).otherwise("Recently")
    got = V.parse_relative_posted(text, F.lit(NOW))
    return table(spark, sf, "events").select("event_id", F.unix_micros(got).alias("posted_us"))


RELATIVE_SQL = f"""SELECT event_id, CASE WHEN event_id % 40 = 39 THEN NULL ELSE epoch_us({NOW_SQL}) -
  86400000000 * CASE WHEN event_id % 40 < 20 THEN event_id % 40 ELSE 30 * (event_id % 40 - 19) END END AS posted_us FROM events"""

_KINDS = ("Full-time", "PART_TIME", "contractor", "Temp", "Intern", "")
_NORMAL = ("'fulltime'", "'parttime'", "'contract'", "'temporary'", "'internship'", "NULL")


def job_type_norm(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (c("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, sf, "orders").select(
        "o_orderkey", V.normalize_job_type(kind).alias("kind"), V.normalize_job_type(c("o_orderpriority")).alias("other"))


JOB_TYPE_SQL = "SELECT o_orderkey, CASE o_orderkey % 6 " + " ".join(
    f"WHEN {i} THEN {s}" for i, s in enumerate(_NORMAL)
) + " END AS kind, replace(replace(replace(lower(o_orderpriority), '-', ''), '_', ''), ' ', '') AS other FROM orders"


def term_present(spark, sf):
    t, d = c("title"), c("description")
    return postings(spark, sf).select(
        "job_id", V.term_present("the", t, d).alias("anywhere"), V.term_present("the", t, d, "word").alias("word"),
        V.term_present("the", t, d, "word", "title").alias("title_word"), V.term_present("en", t, d, "substring", "title").alias("title_sub"),
        V.term_present("  ", t, d).alias("blank"))


TERM_SQL = with_postings(f"""SELECT job_id, contains(lower(title), 'the') OR contains(lower(description), 'the') AS anywhere,
  {word_sql('lower(title)', 'the')} OR {word_sql('lower(description)', 'the')} AS word,
  {word_sql('lower(title)', 'the')} AS title_word, contains(lower(title), 'en') AS title_sub, FALSE AS blank FROM postings""")


def term_count(spark, sf):
    t, d = c("title"), c("description")
    return postings(spark, sf).select(
        "job_id", V.term_count("ou", t, d).cast("bigint").alias("anywhere"), V.term_count("the", t, d, "word").cast("bigint").alias("word"),
        V.term_count("en", t, d, "substring", "title").cast("bigint").alias("title_sub"))


TERM_COUNT_SQL = with_postings(f"""SELECT job_id, {count_sql('lower(title)', 'ou')} + {count_sql('lower(description)', 'ou')} AS anywhere,
  CAST({word_count_sql('lower(title)', 'the')} + {word_count_sql('lower(description)', 'the')} AS BIGINT) AS word,
  {count_sql('lower(title)', 'en')} AS title_sub FROM postings""")

# A dictionary of corpus words in the shape of the technology dictionary.
_WORDS = tuple((w.upper(), (w,)) for w in ("the", "and", "of", "for", "que", "und", "les", "der", "with", "are", "los"))
_MARKS = (("OU", ("ou",)), ("TION", ("tion", "cion")))


def extract_terms(spark, sf):
    got = V.extract_terms(F.concat_ws("\n", "title", "description"), 8, _MARKS, _WORDS, {})
    return postings(spark, sf).select("job_id", F.array_join(got, ",").alias("terms"))


_TERM_CASES = ", ".join(
    [f"CASE WHEN {' OR '.join(f'''contains(s, '{a}')''' for a in aliases)} THEN '{n}' END" for n, aliases in _MARKS]
    + [f"CASE WHEN {word_sql('s', aliases[0])} THEN '{n}' END" for n, aliases in _WORDS])
EXTRACT_TERMS_SQL = with_postings(f"""SELECT job_id, array_to_string(list_filter([{_TERM_CASES}], lambda x: x IS NOT NULL)[1:8], ',') AS terms
  FROM (SELECT job_id, lower(title || chr(10) || description) AS s FROM postings)""")

# Fixed technology dictionary over texts that mention its entries.
_TECH = [aliases[0] for _, aliases in WORD_TERMS]
_SHOWN = [name for name, _ in WORD_TERMS]


def tech_terms(spark, sf):
    words = F.array(*[F.lit(w) for w in _TECH])
    pick = lambda k: F.element_at(words, ((c("event_id") * k) % len(_TECH) + 1).cast("int"))
    text = F.concat(F.lit("We use "), F.upper(pick(1)), F.lit(", "), pick(7), F.lit(" and C#/"), pick(11), F.lit("."), c("event_type"))
    return table(spark, sf, "events").select("event_id", F.array_join(V.extract_terms(text), ",").alias("terms"))


TECH_SQL = f"""WITH n AS (SELECT event_id, list_sort(list_distinct([event_id % {len(_TECH)}, event_id * 7 % {len(_TECH)}, event_id * 11 % {len(_TECH)}])) AS k FROM events)
SELECT event_id, array_to_string(['C#'] || list_transform(k, lambda i: {_SHOWN!r}[i + 1]), ',') AS terms FROM n"""


def extract_salary(spark, sf):
    lo, hi = (c("event_id") % 300 + 5).cast("bigint"), (c("event_id") % 70 + c("event_id") % 300 + 5).cast("bigint")
    dash = F.element_at(F.array(F.lit(" - "), F.lit("–"), F.lit(" to ")), (c("event_id") % 3 + 1).cast("int"))
    text = F.when(c("event_id") % 2 == 0, F.concat(F.lit("Pay $"), lo, F.lit("k"), dash, F.lit("$"), hi, F.lit("K a year, not $1k - $2k"))).otherwise(
        F.concat(F.lit("Pay: $ "), lo, F.lit(",000"), dash, hi, F.lit(",000; ask")))
    own = F.when(c("event_id") % 7 == 0, F.lit("$1"))
    return table(spark, sf, "events").select(
        "event_id", V.extract_salary(text).alias("found"), V.enrich_salary(own, text).alias("salary"))


EXTRACT_SALARY_SQL = """WITH t AS (SELECT event_id, event_id % 300 + 5 AS lo, event_id % 70 + event_id % 300 + 5 AS hi FROM events),
u AS (SELECT *, CASE WHEN lo >= 10 THEN CASE WHEN lo = hi THEN '$' || lo || 'k' ELSE '$' || lo || 'k–$' || hi || 'k' END END AS found FROM t)
SELECT event_id, found, CASE WHEN event_id % 7 = 0 THEN '$1' ELSE found END AS salary FROM u"""


def pretty_company(spark, sf):
    slug = F.when(c("p_partkey") % 2 == 0, F.replace(c("p_name"), F.lit(" "), F.lit("-"))).otherwise(
        F.concat(c("p_size"), F.replace(c("p_name"), F.lit(" "), F.lit("_"))))
    return table(spark, sf, "part").select(
        "p_partkey", V.pretty_company(slug).alias("company"), V.pretty_company(c("p_brand")).alias("brand"))


_TITLE = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
PRETTY_SQL = f"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN {_TITLE} ELSE p_size || {_TITLE} END AS company,
  p_brand AS brand FROM part"""


def slug_candidates(spark, sf):
    name = F.concat(c("p_brand"), F.lit(" "), c("p_name"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(V.slug_candidates(name), "|").alias("slugs"))


SLUG_SQL = r"""WITH t AS (SELECT p_partkey, p_brand || ' ' || p_name AS n FROM part)
SELECT p_partkey, regexp_replace(lower(n), '[^a-z0-9]', '', 'g') || '|' || regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g')
  || '|' || replace(n, ' ', '') || '|' || n AS slugs FROM t"""


def company_match(spark, sf):
    company = F.concat(c("p_brand"), F.lit(", "), c("p_name"))
    return table(spark, sf, "part").select(
        "p_partkey", V.company_matches(company, "Brand 2").alias("brand_two"), V.company_matches(company, "WIDGET").alias("widget"),
        V.company_matches(company, "The Brand#17 red widget Company").alias("long_target"), V.company_matches(company, "##").alias("empty_target"))


def _match(target: str) -> str:
    return f"(list_has_all(t, {target}) OR list_has_all({target}, t))"


COMPANY_SQL = rf"""WITH x AS (SELECT p_partkey, regexp_extract_all(lower(p_brand || ', ' || p_name), '[a-z0-9]+') AS t FROM part)
SELECT p_partkey, {_match("['brand', '2']")} AS brand_two, {_match("['widget']")} AS widget,
  {_match("['the', 'brand', '17', 'red', 'widget', 'company']")} AS long_target, FALSE AS empty_target FROM x"""


def flags(spark, sf):
    return postings(spark, sf).select("job_id", F.array_join(V.quality_flags(c("salary"), c("posted_date")), ",").alias("flags"))


FLAGS_SQL = with_postings("""SELECT job_id, concat_ws(',', CASE WHEN salary IS NULL THEN 'no_salary' END,
  CASE WHEN posted_date IS NULL THEN 'no_date' END) AS flags FROM postings""")


def dedup_key(spark, sf):
    return postings(spark, sf).select("job_id", V.dedup_key(c("company"), c("title"), c("location")).alias("key"))


DEDUP_KEY_SQL = with_postings(
    r"SELECT job_id, regexp_replace(lower(company || ' ' || title || ' ' || location), '^\s+|\s+$', '', 'g') AS key FROM postings")


def score_coerce(spark, sf):
    n = c("doc_id") * 37 % 211 - 50
    text = F.when(c("doc_id") % 9 == 0, F.lit("n/a")).otherwise(n.cast("string"))
    verdict = F.when(c("doc_id") % 4 == 0, F.lit(" Strong ")).when(c("doc_id") % 4 == 1, F.lit("great"))
    s = V.coerce_score(text, verdict, F.concat(F.lit("  q"), c("quality"), F.lit(" ")))
    return table(spark, sf, "labels").select("doc_id", s.alias("s")).select("doc_id", "s.*")


SCORE_SQL = """WITH t AS (SELECT doc_id, quality, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE greatest(0, least(100, doc_id * 37 % 211 - 50)) END AS n FROM labels)
SELECT doc_id, CAST(n AS INTEGER) AS score, CASE WHEN doc_id % 4 = 0 THEN 'strong' WHEN n >= 67 THEN 'strong' WHEN n >= 34 THEN 'maybe' ELSE 'weak' END AS verdict,
  'q' || quality AS reason FROM t"""


def scoring_text(spark, sf):
    got = V.scoring_text(c("title"), c("company"), c("location"), c("salary"), c("description"))
    return postings(spark, sf).select("job_id", got.alias("text"))


SCORING_TEXT_SQL = with_postings(r"""SELECT job_id, 'Title: ' || title || chr(10) || 'Company: ' || company || chr(10) || 'Location: ' || location
  || CASE WHEN salary IS NOT NULL THEN chr(10) || 'Salary: ' || salary ELSE '' END
  || CASE WHEN regexp_replace(description, '^\s+|\s+$', '', 'g') <> '' THEN chr(10) || chr(10) || 'Description:' || chr(10)
     || substr(regexp_replace(description, '^\s+|\s+$', '', 'g'), 1, 1500) ELSE '' END AS text FROM postings""")


def salary_value(spark, sf):
    low = F.when(c("doc_id") % 2 == 0, F.lit(10.0) * (c("doc_id") + 1))
    high = F.when(c("doc_id") % 3 == 0, F.lit(20.0) * (c("doc_id") + 1))
    return table(spark, sf, "labels").select("doc_id", V.salary_value(low, high).alias("pay"))


SALARY_VALUE_SQL = """SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 20.0::DOUBLE * (doc_id + 1) END,
  CASE WHEN doc_id % 2 = 0 THEN 10.0::DOUBLE * (doc_id + 1) END) AS pay FROM labels"""

QUERIES = {
    "strip_html": (strip_html, f"SELECT page_id, {_CLEAN_SQL} AS text FROM pages"),
    "strip_html_escaped": (strip_html_escaped, f"SELECT page_id, {_CLEAN_SQL} AS text FROM pages"),
    "snippet": (snippet, SNIPPET_SQL),
    "canonical_url": (canonical_url, r"SELECT page_id, lower(regexp_replace(split_part(url || '//#Top', '#', 1), '/+$', '')) AS url FROM pages"),
    "stable_id": (stable_id, STABLE_ID_SQL),
    "safe_url": (safe_url, "SELECT page_id, CASE page_id % 4 WHEN 1 THEN upper(url) WHEN 2 THEN url ELSE '#' END AS href FROM pages"),
    "board_url_parse": (board_url_parse, BOARD_URL_SQL),
    "coerce_amount": (coerce_amount, COERCE_SQL),
    "amount_format": (amount_format, AMOUNT_SQL),
    "interval_suffix": (interval_suffix, INTERVAL_SQL),
    "parse_times": (parse_times, PARSE_SQL),
    "parse_relative": (parse_relative, RELATIVE_SQL),
    "job_type_norm": (job_type_norm, JOB_TYPE_SQL),
    "term_present": (term_present, TERM_SQL),
    "term_count": (term_count, TERM_COUNT_SQL),
    "extract_terms": (extract_terms, EXTRACT_TERMS_SQL),
    "tech_terms": (tech_terms, TECH_SQL),
    "extract_salary": (extract_salary, EXTRACT_SALARY_SQL),
    "pretty_company": (pretty_company, PRETTY_SQL),
    "slug_candidates": (slug_candidates, SLUG_SQL),
    "company_match": (company_match, COMPANY_SQL),
    "flags": (flags, FLAGS_SQL),
    "dedup_key": (dedup_key, DEDUP_KEY_SQL),
    "score_coerce": (score_coerce, SCORE_SQL),
    "scoring_text": (scoring_text, SCORING_TEXT_SQL),
    "salary_value": (salary_value, SALARY_VALUE_SQL),
}
