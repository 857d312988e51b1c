"""Landed board payloads to postings, one function per feed.

Input is one record per fetched board (schema ``RAW``). A payload is parsed once, to the variant column ``body``; readers take typed
fields out of it, so a missing field, and one of another type, is NULL. The per-board row limit is applied to the array before it
is exploded: it needs no shuffle and no window."""
from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import (
    coerce_amount, falsy_to_null, format_salary, make_snippet, normalize_job_type, parse_epoch_ms,
    parse_iso, parse_relative_posted, parse_workday_url, pretty_company, snippet_of, stable_job_id, strip_html,
)
from vacantia.schema import BOARD_SOURCES, POSTING, SOURCES
from vacantia.session import cut, stored

# Items of the feeds. Ids, amounts and epochs may arrive as number or text, so they are read as text.
GREENHOUSE = """array<struct<id:string,title:string,location:struct<name:string>,
 absolute_url:string,content:string,first_published:string,updated_at:string>>"""
LEVER = """array<struct<id:string,text:string,categories:struct<location:string,commitment:string>,
 hostedUrl:string,applyUrl:string,createdAt:string,descriptionPlain:string,description:string,
 workplaceType:string,salaryRange:struct<min:string,max:string,interval:string,currency:string>>>"""
ASHBY = """array<struct<id:string,title:string,location:string,jobUrl:string,applyUrl:string,
 publishedAt:string,descriptionHtml:string,descriptionPlain:string,isRemote:boolean,employmentType:string,
 isListed:boolean,compensation:struct<compensationTierSummary:string,
 scrapeableCompensationSalarySummary:string>>>"""
WORKDAY_LIST = """array<struct<title:string,externalPath:string,locationsText:string,
 postedOn:string,bulletFields:array<string>>>"""
WORKDAY_DETAIL = """struct<title:string,jobDescription:string,startDate:string,
 location:string,timeType:string,externalUrl:string,jobReqId:string,id:string,remoteType:string>"""


def _either(*cols: Column) -> Column:
    """First non-empty text, else the empty text."""
    return F.coalesce(*[falsy_to_null(c) for c in cols], F.lit(""))


def source_position(source: str) -> int:
    """Run order of a feed; feeds of users follow the built-in ones, in one place each."""
    return SOURCES.index(source) if source in SOURCES else len(SOURCES) + zlib.crc32(source.encode()) % 1_000_000


def _ord(source: str, board_ord: Column, row_ord: Column) -> Column:
    return F.struct(
        F.lit(source_position(source)).alias("source_ord"), board_ord.cast("int").alias("board_ord"),
        row_ord.cast("bigint").alias("row_ord"))


def _true_or_null(c: Column) -> Column:
    return F.when(c, F.lit(True))


def as_posting(df: DataFrame, **cols: Column) -> DataFrame:
    """Project onto the posting schema; columns not given get their neutral value."""
    neutral = {
        "flags": F.array().cast("array<string>"), "skills": F.array().cast("array<string>"),
        "relevance": F.lit(0.0), "board": F.col("board"),
    }
    out = []
    for f in POSTING.fields:
        value = cols.get(f.name, neutral.get(f.name, F.lit(None)))
        out.append(value.cast(f.dataType).alias(f.name))
    return df.select(*out)


def latest_landed(raw: DataFrame) -> DataFrame:
    """Of a board that was landed several times, the latest record (of equal times, any one).

    The winners are chosen from slim rows (board, time, hash); payloads are neither sorted nor shuffled but filtered where they are
    read. Only records that are equal in all of that are told apart by moving them."""
    mark = F.xxhash64("payload", "error")
    slim = raw.groupBy(F.col("source").alias("_source"), F.col("board").alias("_board"), F.col("fetched_at").alias("_at"), mark.alias("_mark")).agg(
        F.count(F.lit(1)).alias("_copies"))
    best = cut(slim.groupBy("_source", "_board").agg(F.max(F.struct("_at", "_mark", "_copies")).alias("b")).select("_source", "_board", "b.*"))
    same = (F.col("source").eqNullSafe(F.col("_source")) & F.col("board").eqNullSafe(F.col("_board"))
            & F.col("fetched_at").eqNullSafe(F.col("_at")) & (mark == F.col("_mark")))
    single = raw.join(best.where("_copies = 1"), same).select(raw["*"])
    several = best.where("_copies > 1")
    if several.isEmpty():
        return single
    return single.unionByName(raw.join(several, same).select(raw["*"]).dropDuplicates(["source", "board"]))


def isolate(raw: DataFrame) -> DataFrame:
    """``raw`` with ``body``, the parsed payload of a board feed (NULL where it isn't JSON), with ``usable``, whether the fetch went
    through and the address can be used, and with ``ok`` narrowed to payloads their feed can read; the rest carries an error.

    Object feeds need a JSON object, the array feed any JSON, and a workday board a usable URL. Readers select by ``usable``, which
    costs nothing, and find no items in an unreadable body; so a plan that reads a feed parses each payload once."""
    object_feed = F.col("source").isin("greenhouse", "ashby", "workday")
    where = parse_workday_url(F.col("board"))
    url_ok = (F.col("source") != "workday") | ((where["host"] != "") & (where["tenant"] != "") & (where["site"] != ""))
    starts_well = ~object_feed | F.ltrim(F.coalesce("payload", F.lit(""))).startswith("{")
    usable = F.coalesce(F.col("ok") & url_ok & starts_well, F.lit(False))
    body = F.when(F.col("source").isin(*BOARD_SOURCES), F.try_parse_json("payload"))
    rows = raw.withColumn("usable", usable).withColumn("body", body)
    ok = F.col("usable") & (~F.col("source").isin(*BOARD_SOURCES) | F.col("body").isNotNull())
    error = F.when(~ok, F.coalesce("error", F.lit("ValueError: unreadable payload")))
    return rows.withColumn("error", error).withColumn("ok", ok)


def parse_once(log: DataFrame) -> DataFrame:
    """What ``isolate`` gave, written feed by feed: readers scan the bodies of their feed only, counts of boards none.

    The text of a parsed payload isn't written again."""
    text = F.when(~F.col("source").isin(*BOARD_SOURCES), F.col("payload"))
    return stored(log.withColumn("payload", text), "landed", "source")


def _items(raw: DataFrame, source: str, path: str, schema: str, limit: int | None, keep=None) -> DataFrame:
    """One row per array item of the feed's readable boards, in feed order. Items that are no objects are left out."""
    picked = raw.where((F.col("source") == source) & F.col("usable"))
    items = F.filter(F.try_variant_get("body", path, schema), lambda x: x.isNotNull() if keep is None else x.isNotNull() & keep(x))
    if limit is not None:
        items = F.slice(items, 1, limit)
    return picked.select("board", "board_ord", F.posexplode(items).alias("pos", "item"))


def read_greenhouse(raw: DataFrame, meta: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """``meta`` holds (board, name); boards without a name get a readable slug."""
    rows = _items(raw, "greenhouse", "$.jobs", GREENHOUSE, limit)
    slug = pretty_company(F.col("board"))
    company = slug
    if meta is not None:
        rows = rows.join(meta.select("board", F.col("name").alias("board_name")), "board", "left")
        company = F.coalesce(falsy_to_null(F.col("board_name")), slug)
    i = F.col("item")
    title = F.coalesce(falsy_to_null(i["title"]), F.lit("Untitled"))
    location, url = _either(i["location"]["name"]), _either(i["absolute_url"])
    # Clean the text once and cut the snippet from the clean text.
    rows = rows.withColumn("company", company).withColumn("text", strip_html(i["content"], escaped=True))
    return as_posting(
        rows, title=title, company=F.col("company"), location=location, description=F.col("text"),
        description_snippet=snippet_of(F.col("text")), url=url, source=F.lit("greenhouse"),
        posted_date=parse_iso(_either(i["first_published"], i["updated_at"])),
        job_id=stable_job_id("greenhouse", i["id"], url, F.col("company"), title, location),
        is_remote=_true_or_null(F.lower(location).contains("remote")),
        ord=_ord("greenhouse", F.col("board_ord"), F.col("pos")))


def read_lever(raw: DataFrame, limit: int | None = None) -> DataFrame:
    rows = _items(raw, "lever", "$", LEVER, limit)
    i = F.col("item")
    title = F.coalesce(falsy_to_null(i["text"]), F.lit("Untitled"))
    location, url = _either(i["categories"]["location"]), _either(i["hostedUrl"], i["applyUrl"])
    pay = i["salaryRange"]
    low, high = coerce_amount(pay["min"], text=True), coerce_amount(pay["max"], text=True)
    company = pretty_company(F.col("board"))
    remote = (F.lower(_either(i["workplaceType"])) == "remote") | F.lower(location).contains("remote")
    markup = falsy_to_null(i["descriptionPlain"])
    rows = rows.withColumn("html_text", strip_html(F.when(markup.isNull(), i["description"])))
    plain = F.coalesce(markup, F.col("html_text"))
    snippet = F.when(markup.isNull(), snippet_of(F.col("html_text"))).otherwise(make_snippet(markup))
    return as_posting(
        rows, title=title, company=company, location=location, description=plain, description_snippet=snippet,
        url=url, source=F.lit("lever"), posted_date=parse_epoch_ms(i["createdAt"], text=True),
        job_id=stable_job_id("lever", i["id"], url, company, title, location), is_remote=_true_or_null(remote),
        salary=format_salary(low, high, pay["interval"], pay["currency"]), salary_min_amount=low,
        salary_max_amount=high, job_type=i["categories"]["commitment"],
        ord=_ord("lever", F.col("board_ord"), F.col("pos")))


def read_ashby(raw: DataFrame, limit: int | None = None) -> DataFrame:
    rows = _items(raw, "ashby", "$.jobs", ASHBY, limit, lambda x: ~x["isListed"].eqNullSafe(F.lit(False)))
    i = F.col("item")
    title = F.coalesce(falsy_to_null(i["title"]), F.lit("Untitled"))
    location, url = _either(i["location"]), _either(i["jobUrl"], i["applyUrl"])
    company = pretty_company(F.col("board"))
    pay = i["compensation"]
    markup = falsy_to_null(i["descriptionPlain"])
    rows = rows.withColumn("html_text", strip_html(F.when(markup.isNull(), i["descriptionHtml"])))
    snippet = F.when(markup.isNull(), snippet_of(F.col("html_text"))).otherwise(make_snippet(markup))
    return as_posting(
        rows, title=title, company=company, location=location,
        description=F.coalesce(markup, F.col("html_text")), description_snippet=snippet,
        url=url, source=F.lit("ashby"), posted_date=parse_iso(i["publishedAt"]),
        job_id=stable_job_id("ashby", i["id"], url, company, title, location),
        is_remote=F.coalesce(i["isRemote"], _true_or_null(F.lower(location).contains("remote"))),
        salary=F.coalesce(falsy_to_null(pay["compensationTierSummary"]),
                          falsy_to_null(pay["scrapeableCompensationSalarySummary"])),
        job_type=i["employmentType"], ord=_ord("ashby", F.col("board_ord"), F.col("pos")))


def _latest_details(details: DataFrame) -> DataFrame:
    """(board, path, info, has_info): the latest readable page of each posting; of equal times, any one.

    A page is parsed in one projection. The latest one is kept by an aggregation of its fields, so pages that a landing repeats
    shrink before the shuffle; nothing is sorted."""
    at = F.col("fetched_at").cast("timestamp") if "fetched_at" in details.columns else F.lit(None).cast("timestamp")
    whole = F.ltrim("payload").startswith("{")
    pages = details.where(F.col("ok") & whole & (F.col("external_path") != "")).select(
        "board", F.col("external_path").alias("path"), at.alias("at"), F.xxhash64("payload").alias("mark"),
        F.try_parse_json("payload").alias("body"))
    # One expression, so that the page is parsed once: unreadable pages carry no struct.
    page = F.when(F.col("body").isNotNull(), F.struct(F.try_variant_get("body", "$.jobPostingInfo", WORKDAY_DETAIL).alias("info")))
    pages = pages.select("board", "path", "at", "mark", page.alias("page"))
    readable = F.when(F.col("page").isNotNull(), F.struct(F.coalesce("at", F.timestamp_seconds(F.lit(-62135596800))), "mark"))
    best = pages.groupBy("board", "path").agg(F.max_by("page", readable).alias("page"))
    return best.where("page IS NOT NULL").select("board", "path", F.col("page.info").alias("info"), F.lit(True).alias("has_info"))


def read_workday(raw: DataFrame, details: DataFrame | None, now: Column, limit: int | None = None) -> DataFrame:
    """List rows left-joined with their detail record; detail fields win when present.

    ``details``: board, external_path, ok, payload and, where pages are fetched again, fetched_at (the latest readable page
    of a posting counts). Without any, the list fields stand alone."""
    rows = _items(raw, "workday", "$.jobPostings", WORKDAY_LIST, limit)
    i = F.col("item")
    rows = rows.withColumn("path", _either(i["externalPath"]))
    if details is None:
        details = raw.sparkSession.createDataFrame([], "board string, external_path string, ok boolean, payload string")
    rows = rows.join(_latest_details(details), ["board", "path"], "left")
    d = F.col("info")
    rows = rows.withColumn("site", parse_workday_url(F.col("board"))).withColumn(
        "text", strip_html(d["jobDescription"]))
    base = F.concat(F.lit("https://"), F.col("site.host"), F.lit("/"), F.col("site.site"))
    title = F.coalesce(falsy_to_null(d["title"]), falsy_to_null(i["title"]), F.lit("Untitled"))
    location = _either(d["location"], i["locationsText"])
    url = _either(d["externalUrl"], F.concat(base, F.col("path")))
    company = pretty_company(F.col("site.tenant"))
    req = F.coalesce(falsy_to_null(d["jobReqId"]), falsy_to_null(d["id"]), F.try_element_at(i["bulletFields"], F.lit(1)))
    remote = F.lower(_either(d["remoteType"])).contains("remote") | F.lower(location).contains("remote")
    return as_posting(
        rows, title=title, company=company, location=location, description=F.col("text"),
        description_snippet=snippet_of(F.col("text")), url=url, source=F.lit("workday"),
        posted_date=F.coalesce(parse_iso(d["startDate"]), parse_relative_posted(i["postedOn"], now)),
        job_id=stable_job_id("workday", req, url, company, title, location),
        is_remote=_true_or_null(F.col("has_info") & remote), job_type=normalize_job_type(d["timeType"]),
        ord=_ord("workday", F.col("board_ord"), F.col("pos")))


def _text(c: Column) -> Column:
    """Text of a tabular cell; NaN and missing are NULL."""
    text = c.cast("string")
    return F.when(F.typeof(c).isin("double", "float") & (text == "NaN"), F.lit(None)).otherwise(text)


def read_board_rows(df: DataFrame, source: str) -> DataFrame:
    """Scraped board rows: id, title, company, location, job_url, job_url_direct, description,
    min_amount, max_amount, interval, currency, is_remote, job_type, job_level, date_posted, plus
    ``row_ord``. Missing columns count as missing values. Descriptions keep their markup."""
    types = dict(df.dtypes)

    def cell(name: str) -> Column:
        return _text(F.col(name)) if name in types else F.lit(None).cast("string")

    def amount(name: str) -> Column:
        return coerce_amount(F.col(name), text=types[name] == "string") if name in types else F.lit(None).cast("double")

    title = F.coalesce(falsy_to_null(cell("title")), F.lit("Untitled"))
    company = F.coalesce(falsy_to_null(cell("company")), F.lit("Unknown"))
    location, url = _either(cell("location")), _either(cell("job_url_direct"), cell("job_url"))
    low, high = amount("min_amount"), amount("max_amount")
    posted = F.lit(None).cast("timestamp")
    if "date_posted" in types:
        raw = F.col("date_posted")
        posted = parse_iso(raw) if types["date_posted"] == "string" else raw.cast("timestamp")
    text = _either(cell("description"))
    board = F.col("board") if "board" in types else F.lit(source)
    return as_posting(
        df.withColumn("board", board), title=title, company=company, location=location, description=text,
        description_snippet=make_snippet(text), url=url, source=F.lit(source), posted_date=posted,
        job_id=stable_job_id(source, cell("id"), url, company, title, location),
        salary=format_salary(low, high, cell("interval"), cell("currency")), salary_min_amount=low, salary_max_amount=high,
        is_remote=F.col("is_remote").cast("boolean") if "is_remote" in types else F.lit(None),
        job_type=falsy_to_null(cell("job_type")), job_level=falsy_to_null(cell("job_level")),
        ord=_ord(source, F.lit(0), F.col("row_ord")))


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """All feeds in one table; ``ord`` keeps feed, board and row order."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)
