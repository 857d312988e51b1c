from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vacantia import functions as V
from tests.helpers import NOW


def one(spark, expr, *cols):
    schema = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(cols))
    df = spark.createDataFrame([tuple(v for v, _ in cols)], schema)
    return df.select(expr(*[F.col(f"c{i}") for i in range(len(cols))]).alias("x")).first()["x"]


def many(spark, expr, values, kind="string"):
    """Evaluate ``expr`` over a column of values, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, c {kind}")
    return [r["x"] for r in df.select("i", expr(F.col("c")).alias("x")).orderBy("i").collect()]


def test_strip_html(spark):
    assert many(spark, lambda c: V.strip_html(c, True), ["&lt;div&gt;Salt &amp; vinegar&lt;/div&gt;"]) == ["Salt & vinegar"]
    cases = {
        "<li>Close &lt;table&gt; first</li>": "Close <table> first", None: "", "": "",
        "a&nbsp;&nbsp;b c\x1dd": "a b c d", "&amp;lt;": "&lt;", "caf&eacute; &notin; &#8364;&#x41;": "café ∉ €A",
        "x &amp;copy; &copy;": "x &copy; ©", "AT&T; R&D": "AT&T; R&D", "&NotAnEntity; ok": "&NotAnEntity; ok",
        "<script>var t=1;</script>done": "var t=1; done",
    }
    import html
    import re
    for raw in cases:  # the table itself must agree with the plain definition
        if raw:
            plain = re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", raw))).strip()
            assert plain == cases[raw]
    assert many(spark, V.strip_html, list(cases)) == list(cases.values())


def test_all_entities_without_leaving_the_jvm(spark):
    import html
    import random
    from html.entities import html5

    from vacantia.functions.text import unescape_entities
    rng = random.Random(1)
    texts = ["&" + k for k in html5] + ["&#0;", "&#128;", "&#xD800;", "&#1114112;", "&#99999999999999999999;", "&#13;", "&#11;", "&#xFDD0;", "&#x1F600;", "&#;", "&copy2", "&acE;"]
    texts += ["".join(rng.choice(["&", "#", "x", "amp", "lt", "not", "in", ";", " ", "a", "1", "é", "copy", "\n"]) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    assert many(spark, unescape_entities, texts) == [html.unescape(t) for t in texts]
    df = spark.range(3).select(F.concat(F.lit("a &eacute; b"), F.col("id")).alias("c"))
    plan = df.select(V.make_snippet(F.col("c"), escaped=True))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "InPandas" not in plan


def test_snippet(spark):
    text = "word, " * 80
    out = many(spark, V.make_snippet, [text, "short"])
    cut = text.strip()[:300].rsplit(" ", 1)[0].rstrip(".,;:—-") + "…"
    assert out == [cut, "short"]


def test_interval_suffix(spark):
    # Interval names and suffixes.
    cases = {"per-year-salary": "/yr", "per-hour-wage": "/hr", "per-month-salary": "/mo", "yearly": "/yr", "hourly": "/hr",
             " Annually ": "/yr", "per_day_wage": "", "bogus": "", "": "", "wk": "/wk", None: "", "per-week": "/wk"}
    assert many(spark, V.interval_suffix, list(cases)) == list(cases.values())


def test_format_salary(spark):
    df = spark.createDataFrame([
        (100.0, 100.0, "per-hour-wage", "USD", "$100/hr"), (130000.0, 170000.0, "yearly", "usd", "$130k–$170k/yr"),
        (122500.0, None, None, "EUR", "€122k"), (None, 123500.0, None, "CHF", "CHF 124k"), (None, None, "yearly", "USD", None),
        (float("nan"), -1.0, None, None, None), (999.5, 1000.0, "hourly", None, "$1000–$1k/hr"), (50.5, None, "", "", "$50"),
        (76000.0, 185000.0, None, "GBP", "£76k–£185k"),
    ], "lo double, hi double, per string, cur string, want string")
    rows = df.select("want", V.format_salary(F.col("lo"), F.col("hi"), F.col("per"), F.col("cur")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_ids_and_urls(spark):
    import hashlib
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()[:16]
    rows = [("lever", "7", "U", "c", "t", "l"), ("lever", "", "HTTP://X/a//#f", "c", "t", "l"), ("lever", None, "", "C", "T", "L")]
    df = spark.createDataFrame(rows, "s string, n string, u string, c string, t string, l string")
    got = [r[0] for r in df.select(V.stable_job_id(*[F.col(x) for x in "snuctl"])).collect()]
    assert got == [sha("lever:7"), sha("lever:http://x/a"), sha("lever:c|t|l")]
    cases = {"https://roles.example/7": "https://roles.example/7", " http://roles.example ": "http://roles.example",
             "javascript:void(0)": "#", "data:text/plain,hi": "#", "": "#", None: "#"}
    assert many(spark, V.safe_url, list(cases)) == list(cases.values())


def test_dates(spark):
    cases = {
        "2025-02-03T08:00:00-05:00": datetime(2025, 2, 3, 13), "2023-11-12T01:02:03.045+00:00": datetime(2023, 11, 12, 1, 2, 3, 45000),
        "2026-05-20": datetime(2026, 5, 20), "2026-05-20T01:02:03Z": datetime(2026, 5, 20, 1, 2, 3), "20260520T0102": datetime(2026, 5, 20, 1, 2),
        "2026-05-20 01:02:03.123456789": datetime(2026, 5, 20, 1, 2, 3, 123456), "junk": None, "": None, None: None, "2026": None,
        "2026-13-01": None, "2026-05": None, "  2026-05-20  ": datetime(2026, 5, 20),
    }
    assert many(spark, V.parse_iso, list(cases)) == list(cases.values())
    ms = many(spark, lambda c: V.parse_epoch_ms(c, text=True), ["1600000000123", "0", "-5", "x", None])
    assert ms == [datetime(2020, 9, 13, 12, 26, 40, 123000), None, None, None, None]
    rel = many(spark, lambda c: V.parse_relative_posted(c, F.lit(NOW)),
               ["Posted Today", "Posted Yesterday", "Posted 5 Days Ago", "Posted 30+ Days Ago", "Posted 2 months ago", "soon", None])
    assert [None if r is None else (NOW - r).days for r in rel] == [0, 1, 5, 30, 60, None, None]


def test_names(spark):
    assert many(spark, V.pretty_company, ["acme-corp", "1password", "Ashby", "o'neil_co", "-", "x2y z"]) == [
        "Acme Corp", "1Password", "Ashby", "O'Neil Co", "-", "X2Y Z"]
    assert many(spark, V.normalize_job_type, ["Full-time", "Part_Time", "contractor", "Temp", "intern", "per diem", "", None, "-"]) == [
        "fulltime", "parttime", "contract", "temporary", "internship", "perdiem", None, None, ""]
    assert many(spark, V.slug_candidates, ["Blue Fern", "Quartz", "!"]) == [
        ["bluefern", "blue-fern", "BlueFern", "Blue Fern"], ["quartz", "Quartz"], ["!"]]
    pairs = [("Zephyr", "Zephyr", True), ("Zephyr Ltd.", "Zephyr", True), ("Boreal.com", "Boreal", True), ("tundra", "Tundra", True),
             ("Cordial GmbH", "Cord", False), ("Tundra Corporation", "Tundra", True), ("", "Zephyr", False), (None, "Zephyr", False)]
    df = spark.createDataFrame(pairs, "c string, t string, w boolean")
    assert all(r["w"] == r["g"] for r in df.select("w", V.company_matches(F.col("c"), F.col("t")).alias("g")).collect())


def test_workday_url(spark):
    cases = {
        "https://orchid.wd5.myworkdayjobs.com/en-US/OrchidJobs": ("orchid.wd5.myworkdayjobs.com", "orchid", "OrchidJobs"),
        "https://orchid.wd5.myworkdayjobs.com/OrchidJobs/job/DE-BE/Gardener_R-88": ("orchid.wd5.myworkdayjobs.com", "orchid", "OrchidJobs"),
        "https://willow.wd1.myworkdayjobs.com/wday/cxs/willow/Roles/jobs": ("willow.wd1.myworkdayjobs.com", "willow", "Roles"),
        "x.wd1.myworkdayjobs.com/en_US": ("x.wd1.myworkdayjobs.com", "x", ""),
    }
    assert [tuple(r) for r in many(spark, V.parse_workday_url, list(cases))] == list(cases.values())


def test_terms(spark):
    def terms(text):
        return many(spark, V.extract_terms, [text])[0]
    got = terms("We keep PostgreSQL and a few Go workers, with Python on top; Kubernetes on AWS.")
    assert got == ["Python", "Go", "AWS", "Kubernetes", "PostgreSQL"]
    assert terms("Ship ASP.NET apps: C#, .NET, some Node.js.") == [".NET", "C#", "ASP.NET", "Node.js"]
    assert terms("You know JavaScript, then React.") == ["JavaScript", "React"]
    assert terms("go to golang") == ["Go"] and terms("we go, Go-getter") == []
    many_terms = terms("python Python AWS GCP Azure Docker Kafka Spark Redis MySQL React Vue Angular")
    assert many_terms == ["Python", "React", "Angular", "Vue", "AWS", "GCP", "Azure", "Docker"]
    assert terms("") == [] and terms(None) == [] and terms("friendly people, good coffee") == []
    df = spark.createDataFrame([("Éclair chef", "rf rf Performance .net")], "t string, d string")
    t, d = F.col("t"), F.col("d")
    row = df.select(
        V.term_present("rf", t, d, "word").alias("a"), V.term_present("rf", t, d, "word", "title").alias("b"),
        V.term_present("clair", t, d, "word").alias("c"), V.term_present(" ", t, d).alias("e"),
        V.term_count("rf", t, d).alias("f"), V.term_count("rf", t, d, "word").alias("g"), V.term_present(".net", t, d, "word").alias("h"),
    ).first()
    assert tuple(row) == (True, False, False, False, 3, 2, False)


def test_extract_salary(spark):
    cases = {
        "We offer $130,000 - $170,000 a year.": "$130k–$170k", "Between $91k–$99k, plus shares": "$91k–$99k",
        "Pay on request.": None, "Lunch is $7 - $9.": None, "We pay $140,000.": None, None: None,
        "$130,000\xa0-\u2009$170,000": "$130k–$170k", "$\u202f91k to\xa099k": "$91k–$99k",
        "$200k to $100k, later $100k to $120k": None, "$ 90K TO $ 110K": "$90k–$110k",
    }
    assert many(spark, V.extract_salary, list(cases)) == list(cases.values())


def test_coerce_score(spark):
    df = spark.createDataFrame([("250", "bogus", "x"), ("-5", "", ""), ("50", None, " y "), ("n/a", "Strong", None), ("50.7", None, None)], "s string, v string, r string")
    got = [tuple(r[0]) for r in df.select(V.coerce_score(F.col("s"), F.col("v"), F.col("r"))).collect()]
    assert got == [(100, "strong", "x"), (0, "weak", ""), (50, "maybe", "y"), (0, "strong", ""), (0, "weak", "")]


def test_scoring_text(spark):
    df = spark.createDataFrame([("T", "C", "L", None, " body "), ("T", "C", "L", "$1", " ")], "t string, c string, l string, s string, d string")
    got = [r[0] for r in df.select(V.scoring_text(*[F.col(x) for x in "tclsd"])).collect()]
    assert got == ["Title: T\nCompany: C\nLocation: L\n\nDescription:\nbody", "Title: T\nCompany: C\nLocation: L\nSalary: $1"]
