"""Registered queries for the feed readers; payloads are built from the tables, a few rows per board."""
from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.operators.boards import cap_per_board, resolve_boards
from vacantia.plans.base import NOW, NOW_SQL, micros, postings, table, with_postings
from vacantia.plans.scalars import _CLEAN_SQL
from vacantia.operators.criteria import Criteria
from vacantia.plans.daily import run_landing
from vacantia.schema import RAW
from vacantia.session import scratch_path
from vacantia.sources import feeds
from vacantia.sources.adapter import FolderFeed, land_payloads
from vacantia.sources.registry import READERS, FeedSettings, Landing, register_feed

c = F.col
PER_BOARD = 5


def _payloads(df, source: str, key: str, item, wrap: bool = True, broken=None):
    """One landed record per board of ``PER_BOARD`` consecutive keys."""
    board = F.floor(c(key) / PER_BOARD).cast("bigint")
    grouped = df.select(board.alias("n"), F.struct(c(key).alias("k"), item.alias("v")).alias("kv")).groupBy("n").agg(
        F.transform(F.array_sort(F.collect_list("kv")), lambda s: s["v"]).alias("items"))
    body = F.to_json(F.struct(c("items").alias("jobs"))) if wrap else F.to_json("items")
    if broken is not None:
        body = F.when(broken(c("n")), F.lit("{oops")).otherwise(body)
    return grouped.select(
        F.lit(source).alias("source"), F.concat(F.lit("board-"), c("n")).alias("board"), c("n").cast("int").alias("board_ord"),
        F.lit(NOW).alias("fetched_at"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), body.alias("payload"))


def _show(df, *extra):
    return df.select("job_id", "title", "company", "location", "description", "description_snippet", "url", "salary",
                     micros("posted_date").alias("posted_us"), "is_remote", "job_type", "salary_min_amount", "salary_max_amount",
                     c("ord.source_ord").alias("source_ord"), c("ord.board_ord").alias("board_ord"), c("ord.row_ord").alias("row_ord"))


def _snip(s: str) -> str:
    return (f"CASE WHEN length({s}) <= 300 THEN {s} ELSE regexp_replace(regexp_replace(substr({s}, 1, 300), ' [^ ]*$', ''), "
            f"'[.,;:—-]+$', '') || '…' END")


def _twin(inner: str, source_ord: int) -> str:
    """Common outer query: ``inner`` yields key, the fields, native id basis and text."""
    return f"""SELECT substr(sha1(basis), 1, 16) AS job_id, title, company, location, description, {_snip('snip')} AS description_snippet,
  url, salary, posted_us, is_remote, job_type, lo AS salary_min_amount, hi AS salary_max_amount, {source_ord} AS source_ord,
  CAST(key // {PER_BOARD} AS INTEGER) AS board_ord, key % {PER_BOARD} AS row_ord FROM ({inner})"""


def _clean(x: str) -> str:
    return _CLEAN_SQL.replace("(html,", f"({x},")


# --- greenhouse: pages ---------------------------------------------------------------------

def _greenhouse_raw(spark, sf):
    escaped = F.replace(F.replace(F.replace(c("html"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    k = c("page_id")
    at = F.date_format(F.lit(NOW) - F.make_dt_interval(hours=(k % 50).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'-05:00'")
    item = F.struct(
        k.alias("id"), F.when(k % 7 != 0, F.concat(F.lit("Role "), k)).alias("title"),
        F.when(k % 3 != 2, F.struct(F.when(k % 3 == 0, "Remote - EU").otherwise("Berlin").alias("name"))).alias("location"),
        c("url").alias("absolute_url"), escaped.alias("content"), F.when(k % 2 == 0, at).alias("first_published"),
        F.lit("2024-01-01").alias("updated_at"))
    return _payloads(table(spark, sf, "pages"), "greenhouse", "page_id", item)


def feed_greenhouse(spark, sf):
    raw = feeds.isolate(_greenhouse_raw(spark, sf))
    meta = raw.where(c("board_ord") % 2 == 0).select("board", F.concat(F.lit("Name "), c("board_ord")).alias("name"))
    return _show(feeds.read_greenhouse(raw, meta))


GREENHOUSE_SQL = _twin(f"""SELECT page_id AS key, 'greenhouse:' || page_id AS basis, CASE WHEN page_id % 7 = 0 THEN 'Untitled' ELSE 'Role ' || page_id END AS title,
  CASE WHEN page_id // 5 % 2 = 0 THEN 'Name ' ELSE 'Board ' END || page_id // 5 AS company,
  CASE page_id % 3 WHEN 0 THEN 'Remote - EU' WHEN 1 THEN 'Berlin' ELSE '' END AS location, {_clean('html')} AS description, {_clean('html')} AS snip, url,
  CAST(NULL AS VARCHAR) AS salary, CASE WHEN page_id % 2 = 0 THEN epoch_us({NOW_SQL}) + 18000000000 - page_id % 50 * 3600000000 ELSE epoch_us(TIMESTAMP '2024-01-01') END AS posted_us,
  CASE WHEN page_id % 3 = 0 THEN TRUE END AS is_remote, CAST(NULL AS VARCHAR) AS job_type, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi
  FROM pages""", 5)


# --- lever and ashby: documents --------------------------------------------------------------

def _lever_raw(spark, sf):
    k = c("doc_id")
    pay = F.struct((k % 90 * 1000 + 500).alias("min"), F.when(k % 4 != 0, (k % 90 + 30) * 1000).alias("max"),
                   F.lit("per-year-salary").alias("interval"), F.lit("EUR").alias("currency"))
    item = F.struct(
        F.concat(F.lit("id-"), k).alias("id"), F.concat(F.lit("Engineer "), k).alias("text"),
        F.struct(F.when(k % 3 == 0, "Remote").otherwise(c("lang")).alias("location"), F.lit("Full-time").alias("commitment")).alias("categories"),
        F.when(k % 2 == 0, F.concat(F.lit("https://x/"), k)).alias("hostedUrl"), F.concat(F.lit("https://y/"), k).alias("applyUrl"),
        (k * 1000 + 1700000000000).alias("createdAt"), F.when(k % 2 == 0, c("text")).alias("descriptionPlain"),
        F.concat(F.lit("<p>Job</p><b>"), c("source"), F.lit(" &amp; co</b>")).alias("description"),
        F.when(k % 5 == 0, "Remote").otherwise("on-site").alias("workplaceType"), F.when(k % 6 != 0, pay).alias("salaryRange"))
    # Every seventh board does not return a list.
    raw = _payloads(table(spark, sf, "documents"), "lever", "doc_id", item, wrap=False)
    return raw.withColumn("payload", F.when(c("board_ord") % 7 == 6, F.lit('{"error":"x"}')).otherwise(c("payload")))


def feed_lever(spark, sf):
    return _show(feeds.read_lever(feeds.isolate(_lever_raw(spark, sf))))


_K = "CAST(round_even({x} / 1000.0::DOUBLE, 0) AS BIGINT) || 'k'"
_DOC_CLEAN = _clean("text")
LEVER_SQL = _twin(f"""SELECT doc_id AS key, 'lever:id-' || doc_id AS basis, 'Engineer ' || doc_id AS title, 'Board ' || doc_id // 5 AS company,
  CASE WHEN doc_id % 3 = 0 THEN 'Remote' ELSE lang END AS location, CASE WHEN doc_id % 2 = 0 AND text <> '' THEN text ELSE 'Job ' || source || ' & co' END AS description,
  CASE WHEN doc_id % 2 = 0 AND text <> '' THEN {_DOC_CLEAN} ELSE 'Job ' || source || ' & co' END AS snip,
  CASE WHEN doc_id % 2 = 0 THEN 'https://x/' ELSE 'https://y/' END || doc_id AS url,
  CASE WHEN doc_id % 6 <> 0 THEN CASE WHEN doc_id % 90 < 1 THEN '€' || (doc_id % 90 * 1000 + 500) ELSE '€' || {_K.format(x='(doc_id % 90 * 1000 + 500)')} END
    || CASE WHEN doc_id % 4 <> 0 THEN '–€' || (doc_id % 90 + 30) || 'k' ELSE '' END || '/yr' END AS salary,
  (doc_id * 1000 + 1700000000000) * 1000 AS posted_us, CASE WHEN doc_id % 5 = 0 OR doc_id % 3 = 0 THEN TRUE END AS is_remote, 'Full-time' AS job_type,
  CASE WHEN doc_id % 6 <> 0 THEN (doc_id % 90 * 1000 + 500)::DOUBLE END AS lo, CASE WHEN doc_id % 6 <> 0 AND doc_id % 4 <> 0 THEN ((doc_id % 90 + 30) * 1000)::DOUBLE END AS hi
  FROM documents WHERE doc_id // 5 % 7 <> 6""", 6)


def _ashby_raw(spark, sf):
    k = c("doc_id")
    pay = F.struct(F.when(k % 4 == 0, "€76K – €185K").otherwise("").alias("compensationTierSummary"),
                   F.when(k % 4 == 1, "$1K").alias("scrapeableCompensationSalarySummary"))
    item = F.struct(
        k.alias("id"), c("source").alias("title"), F.when(k % 2 == 0, "remote, EU").otherwise("Rome").alias("location"),
        F.lit("").alias("jobUrl"), F.concat(F.lit("https://a/"), k).alias("applyUrl"), F.lit("2024-03-04T14:29:08.532+00:00").alias("publishedAt"),
        F.concat(F.lit("<div>Hi "), k, F.lit("</div>")).alias("descriptionHtml"), F.when(k % 3 == 0, c("text")).alias("descriptionPlain"),
        F.when(k % 6 == 0, F.lit(False)).when(k % 6 == 1, F.lit(True)).alias("isRemote"), F.lit("FullTime").alias("employmentType"),
        F.when(k % 5 == 1, F.lit(False)).when(k % 5 == 2, F.lit(True)).alias("isListed"), F.when(k % 8 != 7, pay).alias("compensation"))
    return _payloads(table(spark, sf, "documents"), "ashby", "doc_id", item, broken=lambda n: n % 9 == 8)


def feed_ashby(spark, sf):
    # Unlisted items go; row positions count listed ones.
    return _show(feeds.read_ashby(feeds.isolate(_ashby_raw(spark, sf))))


ASHBY_SQL = _twin(f"""SELECT doc_id AS key, 'ashby:' || doc_id AS basis, CASE WHEN source = '' THEN 'Untitled' ELSE source END AS title, 'Board ' || doc_id // 5 AS company,
  CASE WHEN doc_id % 2 = 0 THEN 'remote, EU' ELSE 'Rome' END AS location, CASE WHEN doc_id % 3 = 0 AND text <> '' THEN text ELSE 'Hi ' || doc_id END AS description,
  CASE WHEN doc_id % 3 = 0 AND text <> '' THEN {_DOC_CLEAN} ELSE 'Hi ' || doc_id END AS snip, 'https://a/' || doc_id AS url,
  CASE doc_id % 8 WHEN 0 THEN '€76K – €185K' WHEN 4 THEN '€76K – €185K' WHEN 1 THEN '$1K' WHEN 5 THEN '$1K' END AS salary,
  epoch_us(TIMESTAMP '2024-03-04 14:29:08.532') AS posted_us, CASE WHEN doc_id % 6 = 0 THEN FALSE WHEN doc_id % 6 = 1 OR doc_id % 2 = 0 THEN TRUE END AS is_remote,
  'FullTime' AS job_type, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi
  FROM documents WHERE doc_id % 5 <> 1 AND doc_id // 5 % 9 <> 8""", 7).replace(
    f"key % {PER_BOARD} AS row_ord", f"CASE key % {PER_BOARD} WHEN 0 THEN 0 ELSE key % {PER_BOARD} - 1 END AS row_ord")


# --- workday: orders with a detail page for two of three --------------------------------------

def _workday(spark, sf):
    orders = table(spark, sf, "orders")
    k = c("o_orderkey")
    path = F.concat(F.lit("/job/R"), k)
    item = F.struct(
        F.concat(F.lit("List "), c("o_orderpriority")).alias("title"), F.when(k % 11 != 0, path).alias("externalPath"),
        F.when(k % 2 == 0, "Remote").otherwise("Oslo").alias("locationsText"), F.concat(F.lit("Posted "), k % 9 + 1, F.lit(" Days Ago")).alias("postedOn"),
        F.array(F.concat(F.lit("B"), k)).alias("bulletFields"))
    raw = _payloads(orders, "workday", "o_orderkey", item)
    raw = raw.withColumn("payload", F.replace(c("payload"), F.lit('{"jobs":'), F.lit('{"total":9,"jobPostings":')))
    site = F.concat(F.lit("https://acme"), c("board_ord"), F.lit(".wd1.example.com/en-US/Careers"))
    raw = raw.withColumn("board", site)
    info = F.struct(F.struct(
        F.when(k % 4 == 0, F.concat(F.lit("Detail "), k)).alias("title"), F.concat(F.lit("<p>Status <b>"), c("o_orderstatus"), F.lit("</b></p>")).alias("jobDescription"),
        F.when(k % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("startDate"), F.lit("").alias("location"), F.lit("Full time").alias("timeType"),
        F.when(k % 7 == 0, F.concat(F.lit("https://z/"), k)).alias("externalUrl"), F.when(k % 2 == 0, F.concat(F.lit("J"), k)).alias("jobReqId"),
        F.concat(F.lit("I"), k).alias("id"), F.when(k % 9 == 0, "Fully Remote").alias("remoteType")).alias("jobPostingInfo"))
    details = orders.where(k % 3 != 2).select(
        F.concat(F.lit("https://acme"), F.floor(k / PER_BOARD), F.lit(".wd1.example.com/en-US/Careers")).alias("board"), path.alias("external_path"),
        (k % 3 == 0).alias("ok"), F.to_json(info).alias("payload"))
    return raw, details


def feed_workday(spark, sf):
    raw, details = _workday(spark, sf)
    return _show(feeds.read_workday(feeds.isolate(raw), details, F.lit(NOW)))


_HAS = "(o_orderkey % 3 = 0 AND o_orderkey % 11 <> 0)"
WORKDAY_SQL = _twin(f"""SELECT o_orderkey AS key, 'workday:' || CASE WHEN {_HAS} THEN CASE WHEN o_orderkey % 2 = 0 THEN 'J' ELSE 'I' END ELSE 'B' END || o_orderkey AS basis,
  CASE WHEN {_HAS} AND o_orderkey % 4 = 0 THEN 'Detail ' || o_orderkey ELSE 'List ' || o_orderpriority END AS title, 'Acme' || o_orderkey // 5 AS company,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Remote' ELSE 'Oslo' END AS location, CASE WHEN {_HAS} THEN 'Status ' || o_orderstatus ELSE '' END AS description,
  CASE WHEN {_HAS} THEN 'Status ' || o_orderstatus ELSE '' END AS snip, CASE WHEN {_HAS} AND o_orderkey % 7 = 0 THEN 'https://z/' || o_orderkey
    ELSE 'https://acme' || o_orderkey // 5 || '.wd1.example.com/Careers' || CASE WHEN o_orderkey % 11 <> 0 THEN '/job/R' || o_orderkey ELSE '' END END AS url,
  CAST(NULL AS VARCHAR) AS salary, CASE WHEN {_HAS} AND o_orderkey % 5 <> 0 THEN epoch_us(o_orderdate) ELSE epoch_us({NOW_SQL}) - (o_orderkey % 9 + 1) * 86400000000 END AS posted_us,
  CASE WHEN {_HAS} AND (o_orderkey % 9 = 0 OR o_orderkey % 2 = 0) THEN TRUE END AS is_remote, CASE WHEN {_HAS} THEN 'fulltime' END AS job_type,
  CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi FROM orders""", 8)


def feed_workday_list_only(spark, sf):
    """Boards whose posting pages were not fetched."""
    return _show(feeds.read_workday(feeds.isolate(_workday(spark, sf)[0]), None, F.lit(NOW)))


WORKDAY_LIST_SQL = WORKDAY_SQL.replace(_HAS, "FALSE")


# --- scraped rows: documents with their event ---------------------------------------------------

def _scraped(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "events"), c("doc_id") == c("event_id"))
    k = c("doc_id")
    return docs.select(
        F.when(k % 4 != 0, k).alias("id"), F.when(k % 5 != 0, c("source")).alias("title"), F.when(k % 6 != 0, F.concat(F.lit("Co "), k)).alias("company"),
        F.when(k % 3 == 0, "Oslo").alias("location"), F.concat(F.lit("https://j/"), k).alias("job_url"), F.when(k % 2 == 0, F.concat(F.lit("https://d/"), k)).alias("job_url_direct"),
        F.concat(F.lit("<p>"), c("text"), F.lit("</p>")).alias("description"), F.when(k % 3 == 0, F.lit(float("nan"))).otherwise(c("value") * 0 + k % 50 * 2000).alias("min_amount"),
        F.when(k % 4 == 0, F.lit(float("nan"))).otherwise(c("value") * 0 + 250000).alias("max_amount"), F.lit("yearly").alias("interval"), F.lit(None).cast("string").alias("currency"),
        (k % 2 == 0).alias("is_remote"), F.lit("fulltime").alias("job_type"), F.lit("senior").alias("job_level"), c("ts").cast("date").alias("date_posted"), k.alias("row_ord"))


def feed_rows(spark, sf):
    return _show(feeds.read_board_rows(_scraped(spark, sf), "indeed")).drop("board_ord")


ROWS_SQL = _twin(f"""SELECT *, CASE WHEN doc_id % 4 <> 0 THEN 'indeed:' || doc_id ELSE 'indeed:' || url END AS basis FROM (SELECT doc_id AS key, doc_id, CASE WHEN doc_id % 5 <> 0 THEN source ELSE 'Untitled' END AS title,
  CASE WHEN doc_id % 6 <> 0 THEN 'Co ' || doc_id ELSE 'Unknown' END AS company, CASE WHEN doc_id % 3 = 0 THEN 'Oslo' ELSE '' END AS location,
  '<p>' || text || '</p>' AS description, {_clean("'<p>' || text || '</p>'")} AS snip, CASE WHEN doc_id % 2 = 0 THEN 'https://d/' ELSE 'https://j/' END || doc_id AS url,
  CASE WHEN doc_id % 3 <> 0 AND doc_id % 50 > 0 THEN '$' || (doc_id % 50 * 2) || 'k' || CASE WHEN doc_id % 4 <> 0 THEN '–$250k' ELSE '' END || '/yr' WHEN doc_id % 4 <> 0 THEN '$250k/yr' END AS salary,
  epoch_us(date_trunc('day', e.ts)) AS posted_us, doc_id % 2 = 0 AS is_remote, 'fulltime' AS job_type,
  CASE WHEN doc_id % 3 <> 0 AND doc_id % 50 > 0 THEN (doc_id % 50 * 2000)::DOUBLE END AS lo, CASE WHEN doc_id % 4 <> 0 THEN 250000::DOUBLE END AS hi
  FROM documents JOIN events e ON e.event_id = doc_id)""", 1).replace(
    f"CAST(key // {PER_BOARD} AS INTEGER) AS board_ord, key % {PER_BOARD} AS row_ord", "key AS row_ord")


def union_feeds(spark, sf):
    raw = feeds.isolate(_greenhouse_raw(spark, sf).unionByName(_lever_raw(spark, sf)).unionByName(_ashby_raw(spark, sf)))
    both = feeds.union_feeds(
        feeds.read_board_rows(_scraped(spark, sf), "indeed"), feeds.read_greenhouse(raw), feeds.read_lever(raw), feeds.read_ashby(raw))
    return both.groupBy("source", c("ord.source_ord").alias("source_ord")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("job_id").alias("ids"), F.sum(F.length("description")).alias("chars"))


UNION_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS source, {i} AS source_ord, count(*) AS n, count(DISTINCT job_id) AS ids, CAST(sum(length(description)) AS BIGINT) AS chars FROM ({sql})"
    for name, i, sql in (("indeed", 1, ROWS_SQL), ("greenhouse", 5, GREENHOUSE_SQL), ("lever", 6, LEVER_SQL), ("ashby", 7, ASHBY_SQL)))


def feed_isolation(spark, sf):
    """Which landed boards are readable; every sixth fetch failed, every ninth payload is broken."""
    raw = _ashby_raw(spark, sf)
    raw = raw.withColumn("ok", c("board_ord") % 6 != 5).withColumn("error", F.when(~c("ok"), F.lit("HTTPError: 404")))
    return feeds.isolate(raw).select("board", "ok", "error")


ISOLATION_SQL = """SELECT 'board-' || n AS board, n % 6 <> 5 AND n % 9 <> 8 AS ok,
  CASE WHEN n % 6 = 5 THEN 'HTTPError: 404' WHEN n % 9 = 8 THEN 'ValueError: unreadable payload' END AS error
  FROM (SELECT DISTINCT doc_id // 5 AS n FROM documents)"""


def per_board_limit(spark, sf):
    rows = postings(spark, sf).withColumn("board", c("source"))
    return cap_per_board(rows, 5).select("source", "job_id")


PER_BOARD_SQL = with_postings(
    "SELECT source, job_id FROM postings QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5")


def company_boards(spark, sf):
    """Companies are brand and part name; boards exist for some spellings of them."""
    part = table(spark, sf, "part")
    name = F.concat_ws(" ", "p_brand", "p_name")
    companies = part.select(name.alias("company"))
    kebab = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    plain = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    slug = F.when(c("p_size") % 4 == 0, kebab).when(c("p_size") % 4 == 1, plain).when(c("p_size") % 4 == 2, F.replace(name, F.lit(" "), F.lit(""))).otherwise(F.upper(name))
    ats = F.element_at(F.array(F.lit("greenhouse"), F.lit("lever"), F.lit("ashby")), (c("p_size") % 3 + 1).cast("int"))
    boards = part.select(ats.alias("ats"), slug.alias("slug"), c("p_size")).groupBy("ats", "slug").agg(F.count_if(c("p_size") > 25).alias("open_count"))
    return resolve_boards(companies, boards)


BOARDS_SQL = r"""WITH t AS (SELECT *, p_brand || ' ' || p_name AS n FROM part),
b AS (SELECT CASE p_size % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'ashby' END AS ats,
  CASE p_size % 4 WHEN 0 THEN regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g') WHEN 1 THEN regexp_replace(lower(n), '[^a-z0-9]', '', 'g')
    WHEN 2 THEN replace(n, ' ', '') ELSE upper(n) END AS slug, count(*) FILTER (WHERE p_size > 25) AS open_count FROM t GROUP BY 1, 2),
x AS (SELECT DISTINCT n AS company FROM t),
y AS (SELECT company, unnest([regexp_replace(lower(company), '[^a-z0-9]', '', 'g'), regexp_replace(lower(company), '[^a-z0-9]+', '-', 'g'),
  replace(company, ' ', ''), company]) AS slug, unnest([0, 1, 2, 3]) AS pos FROM x)
SELECT company, ats, slug, open_count FROM y JOIN b USING (slug) QUALIFY row_number() OVER (PARTITION BY company, ats ORDER BY pos) = 1"""

def target_run(spark, sf):
    """Landed scraped rows to ranked targets: a board's limit counts target rows only, wherever they stand."""
    rows = _scraped(spark, sf).withColumn("title", F.sha1(c("row_ord").cast("string")))
    landing = Landing(spark.createDataFrame([], RAW), tabular={"indeed": rows})
    run = run_landing(spark, landing, {"indeed": FeedSettings(True, limit=40)}, Criteria(target_companies=TARGETS), NOW)
    return run.ranked.select("job_id", "company")


TARGETS = ("Co 9", "Co 25", "Co 199")
TARGET_SQL = f"""SELECT job_id, company FROM ({ROWS_SQL}) WHERE company IN ({', '.join(f"'{x}'" for x in TARGETS)})"""


def custom_feed(spark, sf):
    """A feed of a user's own, without configured boards: every landed payload of its name is read."""
    def read(landing, settings, now):
        rows = landing.raw.where((c("source") == "ownfeed") & c("ok"))
        item = F.from_json("payload", "struct<id:string,name:string>")
        return feeds.as_posting(
            rows, job_id=item["id"], title=F.sha1(item["id"]), company=item["name"], location=F.lit(""), description=F.lit(""),
            source=F.lit("ownfeed"), url=F.lit(""), description_snippet=F.lit(""),
            ord=F.struct(F.lit(feeds.source_position("ownfeed")).alias("s"), c("board_ord").cast("int").alias("b"), F.lit(0).cast("bigint").alias("r")))

    k = c("p_partkey")
    raw = table(spark, sf, "part").select(
        F.lit("ownfeed").alias("source"), F.concat(F.lit("b"), k).alias("board"), k.cast("int").alias("board_ord"), F.lit(NOW).alias("fetched_at"),
        (k % 4 != 0).alias("ok"), F.when(k % 4 == 0, "IOError: x").alias("error"), F.to_json(F.struct(k.cast("string").alias("id"), F.md5(k.cast("string")).alias("name"))).alias("payload"))
    register_feed("ownfeed", read)
    try:
        run = run_landing(spark, Landing(raw), {"ownfeed": FeedSettings(True)}, Criteria(), NOW)
    finally:
        READERS.pop("ownfeed")
    return run.ranked.select("job_id", "source").join(run.health.select("source", "count"), "source")


CUSTOM_SQL = """SELECT CAST(p_partkey AS VARCHAR) AS job_id, 'ownfeed' AS source, count(*) OVER () AS count FROM part WHERE p_partkey % 4 <> 0"""

# --- the feed adapter: payloads in a folder, 50 events a board -----------------------------------------

_BOARD_EVENTS = 50


def _land_events(spark, sf, path: str, version: int, only=None) -> None:
    """One version of each board; every seventh board is unreadable."""
    k = c("event_id")
    n = F.floor(k / _BOARD_EVENTS)
    rows = table(spark, sf, "events").where(F.lit(True) if only is None else only(n))
    item = F.struct(k.alias("k"), F.struct(k.cast("string").alias("id"), F.concat(c("event_type"), F.lit(f" {version}")).alias("text")).alias("v"))
    body = F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]))  # of 50 rows
    boards = rows.groupBy(n.alias("n")).agg(body.alias("items")).select(
        F.when(c("n") % 7 == 0, "{oops").otherwise(c("items")).alias("value"), F.lit(version).alias("fetched_ms"), F.concat(F.lit("team "), c("n"), F.lit("/x")).alias("board"))
    land_payloads(boards, path)


def feed_source(spark, sf):
    """Boards by the adapter, a third of them landed twice: postings of the newest version of the readable ones."""
    path = scratch_path(spark, "boards")
    _land_events(spark, sf, path, 1)
    _land_events(spark, sf, path, 2, lambda n: n % 3 == 0)
    spark.dataSource.register(FolderFeed)
    raw = spark.read.format("board_folder").option("path", path).load().withColumn("source", F.lit("lever"))
    return feeds.read_lever(feeds.isolate(raw)).select("job_id", "title", "source")


FEED_SOURCE_SQL = f"""SELECT 'lever' AS source, event_type || CASE WHEN n % 3 = 0 THEN ' 2' ELSE ' 1' END AS title, substr(sha1('lever:' || event_id), 1, 16) AS job_id
  FROM (SELECT *, event_id // {_BOARD_EVENTS} AS n FROM events) WHERE n % 7 <> 0"""


def stream_source(spark, sf):
    """The adapter as a stream that is started once for each landing: every board, then those that were landed again."""
    path, out, checkpoint = (scratch_path(spark, x) for x in ("boards", "out", "ckpt"))
    spark.dataSource.register(FolderFeed)
    for version, only in ((1, None), (2, lambda n: n % 3 == 0)):
        _land_events(spark, sf, path, version, only)
        stream = spark.readStream.format("board_folder").option("path", path).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    read = feeds.isolate(spark.read.parquet(out).withColumn("source", F.lit("lever")))
    return read.select("board", "board_ord", F.unix_millis("fetched_at").alias("fetched_ms"), "ok")


STREAM_SOURCE_SQL = f"""WITH b AS (SELECT DISTINCT event_id // {_BOARD_EVENTS} AS n FROM events),
p AS (SELECT n, 'team ' || n || '/x' AS board, CAST(row_number() OVER (ORDER BY 'board=team ' || n || '%2Fx') - 1 AS INTEGER) AS board_ord FROM b)
SELECT board, board_ord, v AS fetched_ms, n % 7 <> 0 AS ok FROM p, (VALUES (1::BIGINT), (2)) AS t(v) WHERE v = 1 OR n % 3 = 0"""


QUERIES = {
    "feed_greenhouse": (feed_greenhouse, GREENHOUSE_SQL),
    "feed_lever": (feed_lever, LEVER_SQL),
    "feed_ashby": (feed_ashby, ASHBY_SQL),
    "feed_workday": (feed_workday, WORKDAY_SQL),
    "feed_workday_list_only": (feed_workday_list_only, WORKDAY_LIST_SQL),
    "target_run": (target_run, TARGET_SQL),
    "custom_feed": (custom_feed, CUSTOM_SQL),
    "feed_source": (feed_source, FEED_SOURCE_SQL),
    "stream_source": (stream_source, STREAM_SOURCE_SQL),
    "feed_rows": (feed_rows, ROWS_SQL),
    "union_feeds": (union_feeds, UNION_SQL),
    "feed_isolation": (feed_isolation, ISOLATION_SQL),
    "per_board_limit": (per_board_limit, PER_BOARD_SQL),
    "company_boards": (company_boards, BOARDS_SQL),
}
