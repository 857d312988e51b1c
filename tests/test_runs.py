"""Golden table cases: filters, runs, scoring, health, seen table, feeds, plans."""
import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import NOW, frame, posting
from vacantia.operators.criteria import Criteria, filter_postings, rank_postings
from vacantia.operators.digest import run_decision, source_health
from vacantia.operators.seen import SeenTable
from vacantia.plans.daily import ScoreSettings, publish, run_landing, run_postings
from vacantia.schema import RAW
from vacantia.sources import feeds
from vacantia.sources.registry import FeedSettings, Landing

ENG = [posting(i, title=t, company=c) for i, t, c in (
    ("junior", "Junior Web Engineer", "Alpha"), ("plain", "Web Engineer", "Bravo"), ("ii", "Systems Engineer II", "Charlie"),
    ("principal", "Principal Engineer", "Delta"), ("senior", "Senior Web Engineer", "Echo"), ("mgr", "Engineering Manager, Tools", "Foxtrot"),
    ("mech", "Ceramic Engineer", "Golf"), ("perf", "Build Engineer", "Hotel"), ("rf", "UI Engineer", "India"))]
PLACES = [posting(i, title="Web Engineer", location=p) for i, p in (
    ("us", "Austin, TX"), ("remote", "Remote - US"), ("blank", " "), ("india", "Pune, India"), ("aus", "Perth, Australia"))]
PAY = [posting("hi", salary="$200k", salary_max=200000.0), posting("lo", salary="$80k", salary_max=80000.0), posting("none"),
       posting("nodate", posted_date=None), posting("old", posted_date=NOW - timedelta(hours=169)), posting("low_only", salary_min=150000.0)]
WORK = [posting("r", is_remote=True, location="X"), posting("o", is_remote=False, location="NYC"), posting("u", is_remote=None, location="Oslo"),
        posting("l", is_remote=None, location="remote EU"), posting("ft", job_type="Full-time", location="X"), posting("pt", job_type="part time", location="X")]


@pytest.mark.parametrize("rows,criteria,want", [
    (ENG, Criteria(must_have=("engineer",), match_fields="title", experience_level="mid"), {"junior", "plain", "ii", "mech", "perf", "rf"}),
    (ENG, Criteria(must_have=("engineer",), match_mode="word", match_fields="title"), {r["job_id"] for r in ENG} - {"mgr"}),
    (ENG, Criteria(exclude=("ui", "Ceramic", "")), {r["job_id"] for r in ENG} - {"rf", "mech"}),
    (ENG, Criteria(experience_level="senior"), {r["job_id"] for r in ENG}),
    (PLACES, Criteria(location_excludes=("India", "Australia")), {"us", "remote", "blank"}),
    (PLACES, Criteria(location_includes=("US",)), {"remote", "blank"}),
    (PLACES, Criteria(location_excludes=("US",)), {"us", "blank", "india", "aus"}),
    (PAY, Criteria(salary_min=100000, date_posted_hours=168), {"hi", "none", "nodate", "low_only"}),
    (PAY, Criteria(salary_min=0, date_posted_hours=0), {r["job_id"] for r in PAY}),
    (WORK, Criteria(work_mode="remote"), {"r", "l", "ft", "pt"}), (WORK, Criteria(work_mode="onsite"), {"o", "u"}),
    (WORK, Criteria(work_mode="hybrid", job_type="fulltime"), {"r", "o", "u", "l", "ft"}),
])
def test_filters(spark, rows, criteria, want):
    assert {r["job_id"] for r in filter_postings(frame(spark, rows), criteria, F.lit(NOW)).collect()} == want


def test_rank_prefers_fresh_and_is_stable(spark):
    rows = [posting("old", posted_date=NOW - timedelta(days=20)), posting("a"), posting("b"), posting("future", posted_date=NOW + timedelta(days=9))]
    assert [r["job_id"] for r in rank_postings(frame(spark, rows), Criteria(), F.lit(NOW)).collect()] == ["a", "b", "future", "old"]


def test_no_python_in_filter_and_rank_plans(spark):
    crit = Criteria(must_have=("engineer",), nice_to_have=("go",), exclude=("ui",), location_includes=("US",), date_posted_hours=1, salary_min=1)
    plan = rank_postings(filter_postings(frame(spark, ENG), crit, F.lit(NOW)), crit, F.lit(NOW))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def scorer(row, role):
    if "boom" in row["title"]:
        raise RuntimeError("boom")
    return {"score": 90 if "Web" in row["title"] else 10, "verdict": "", "reason": role}


def run(spark, rows, scoring=ScoreSettings(), seen=None, criteria=Criteria()):
    return run_postings(frame(spark, rows), criteria, NOW, seen, scoring)


def test_scoring_floor_and_outage(spark):
    rows = [posting("hi", title="Web Engineer"), posting("lo", title="Night Watch", company="Zed"), posting("bad", title="boom", company="Quux")]
    out = run(spark, rows, ScoreSettings(scorer, "data", min_score=40))
    assert {r["job_id"] for r in out.ranked.collect()} == {"hi", "bad"}
    assert out.outcome.first().asDict() == {"scored": 2, "failed": 1, "error": "RuntimeError: boom", "systemic": False}
    got = out.funnel.first().asDict()
    assert got == {"fetched": 3, "after_dedup": 3, "after_filter": 3, "seen_skipped": 0, "llm_scored": 2, "after_llm": 2, "new": 2}


def test_run_prepares_before_merging(spark):
    rows = [posting("1", description="pays $130,000 - $170,000 for Python work", salary=None), posting("1", description="x", salary="$9")]
    (row,) = run(spark, rows).ranked.collect()
    assert (row["salary"], row["flags"], row["skills"]) == ("$130k–$170k", [], ["Python"])


def test_publish_and_seen_across_runs(spark, tmp_path):
    store = SeenTable(spark, str(tmp_path / "seen"))
    rows = [posting("1", title="Rust Developer"), posting("2", title="Gardener", company="Other")]
    first = run(spark, rows, seen=store.load())
    assert publish(first, str(tmp_path / "out"), store, "0001", NOW)["send"]
    assert {r[0] for r in store.load().collect()} == {"1", "2"}
    second = run(spark, rows, seen=store.load())
    assert second.ranked.isEmpty() and second.funnel.first()["seen_skipped"] == 2
    assert not publish(second, str(tmp_path / "out"), store, "0002", NOW)["send"]


def test_seen_table(spark, tmp_path):
    store = SeenTable(spark, str(tmp_path / "a" / "seen"))
    assert store.load().isEmpty() and store.prune(90, NOW) == 0
    assert not store.record(frame(spark, []), "b0", NOW) and not (tmp_path / "a").exists()
    old, new = (NOW - timedelta(days=200)).isoformat(), NOW.isoformat()
    lines = [json.dumps({"job_id": "old", "first_seen": old}), json.dumps({"job_id": "recent", "first_seen": new}), "not a record", "", "5", '{"title": "T"}', "[]"]
    (tmp_path / "s.jsonl").write_text("\n".join(lines) + "\n")
    store.import_lines(str(tmp_path / "s.jsonl"))
    assert {r[0] for r in store.load().collect()} == {"old", "recent"}
    assert store.prune(0, NOW) == 0 and store.prune(90, NOW) == 1 and store.prune(90, NOW) == 0
    assert {r[0] for r in store.load().collect()} == {"recent"}
    assert {r["raw"] for r in store.records().collect()} == {None, "not a record", "5", '{"title": "T"}', "[]"}
    store.record(frame(spark, [posting("x")]), "b1", NOW)
    store.record(frame(spark, [posting("x")]), "b1", NOW)  # a replayed batch
    assert store.records().where("job_id = 'x'").count() == 1
    store.reset()
    store.reset()
    assert store.load().isEmpty()


def test_replay_after_prune_keeps_batches_apart(spark, tmp_path):
    store = SeenTable(spark, str(tmp_path / "seen"))
    for n, (batch, days) in enumerate((("b1", 200), ("b2", 10), ("b3", 0))):
        store.record(frame(spark, [posting(f"{batch}-{i}") for i in range(n + 2)]), batch, NOW - timedelta(days=days))
    assert store.prune(90, NOW) == 2
    assert {r[0] for r in store.load_without("b3").collect()} == {"b2-0", "b2-1", "b2-2"}
    store.record(frame(spark, [posting("b3-0")]), "b4", NOW)
    store.compact()
    store.compact()
    assert store.load().count() == 7 and store.load_without("b4").count() == 7 and store.load_without("b3").count() == 4
    for _ in range(6):
        store.compact()
    assert store.load().count() == 7
    assert len(list((tmp_path / "seen" / "data").iterdir())) == 5  # one folder for each of the last versions


def test_replay_of_a_pruned_batch_replaces_its_records(spark, tmp_path):
    """x and y published, pruned into one part, then the batch is replayed with x only: x stands once, y is free again."""
    store = SeenTable(spark, str(tmp_path / "seen"))
    store.record(frame(spark, [posting("old")]), "b1", NOW - timedelta(days=200))
    store.record(frame(spark, [posting("x"), posting("y")]), "b2", NOW)
    assert store.prune(90, NOW) == 1
    store.record(frame(spark, [posting("x")]), "b2", NOW)
    assert [(r["job_id"], r["batch_id"]) for r in store.records().collect()] == [("x", "b2")]
    store.compact()
    assert not store.record(frame(spark, []), "b2", NOW)  # published nothing this time
    assert store.load().isEmpty()


def test_writers_do_not_lose_each_other(spark, tmp_path):
    path = str(tmp_path / "seen")
    one, two = SeenTable(spark, path), SeenTable(spark, path)
    one.record(frame(spark, [posting("a"), posting("gone")]), "b1", NOW - timedelta(days=200))
    one.record(frame(spark, [posting("b")]), "b2", NOW)
    reader = one.load()
    put, calls = one._put, []

    def late(version, parts):
        """Another writer commits between the look at the newest version and the put."""
        calls.append(version)
        if len(calls) == 1:
            two.record(frame(spark, [posting("c")]), "b3", NOW)
        put(version, parts)

    one._put = late
    one.record(frame(spark, [posting("d")]), "b4", NOW)
    assert len(calls) == 2 and {r[0] for r in one.load().collect()} == {"a", "gone", "b", "c", "d"}
    calls.clear()

    def replayed(version, parts):
        """A batch that a prune has read is replayed before the prune commits: the prune starts again."""
        calls.append(version)
        if len(calls) == 1:
            two.record(frame(spark, [posting("b"), posting("e")]), "b2", NOW)
        put(version, parts)

    one._put = replayed
    assert one.prune(90, NOW) == 2
    assert {r[0] for r in two.load().collect()} == {"b", "c", "d", "e"}
    assert {r[0] for r in reader.collect()} == {"a", "gone", "b"}  # as of its version
    one._put = put
    one._write(frame(spark, [posting("z")]).selectExpr("job_id", "title", "company", "source", "'' AS first_seen", "'b9' AS batch_id"))  # dies before its commit
    one.compact()
    assert two.load().count() == 4


def test_shared_folder_is_required_on_a_cluster(monkeypatch):
    from vacantia import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getCheckpointDir, getConf = staticmethod(lambda: None), staticmethod(Conf)

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def landing(spark, boards):
    rows = [(s, b, 0, NOW, ok, None if ok else "HTTPError: 404", json.dumps(p) if p is not None else None) for s, b, ok, p in boards]
    return spark.createDataFrame(rows, RAW)


def test_landing_run_and_health(spark):
    green = {"jobs": [{"id": 77, "title": "Web Engineer", "location": {"name": "Remote, EU"}, "absolute_url": "https://x/77",
                       "content": "&lt;p&gt;Tea &amp; cake&lt;/p&gt;", "first_published": "2026-04-02T09:30:00+02:00"}]}
    lever = [{"id": "k-9", "text": "Data Gardener", "categories": {"location": "Lisbon", "commitment": "Full-time"}, "hostedUrl": "https://l/1",
              "createdAt": 1600000000123, "descriptionPlain": "Water the data.", "workplaceType": "remote",
              "salaryRange": {"min": 90000, "max": "140000", "interval": "per-year-salary", "currency": "USD"}}]
    site = "https://x.wd1.myworkdayjobs.com/en-US/Careers"
    work = {"jobPostings": [{"title": "Potter", "externalPath": "/job/clay_R7", "locationsText": "Remote", "postedOn": "Posted Yesterday", "bulletFields": ["R7"]}]}
    raw = landing(spark, [("greenhouse", "x", True, green), ("greenhouse", "down", False, None), ("lever", "l", True, lever),
                          ("ashby", "a", True, ["not an object"]), ("ashby", "b", False, None), ("workday", site, True, work)])
    details = spark.createDataFrame([(site, "/job/clay_R7", False, None)], "board string, external_path string, ok boolean, payload string")
    settings = {"greenhouse": FeedSettings(True, 10, ("x", "down")), "lever": FeedSettings(True, 10, ("l",)), "ashby": FeedSettings(True, 10, ("a", "b")),
                "workday": FeedSettings(True, 10, (site,)), "indeed": FeedSettings(False)}
    out = run_landing(spark, Landing(raw, details), settings, Criteria(), NOW)
    rows = {r["source"]: r for r in out.ranked.collect()}
    assert rows["greenhouse"]["description"] == "Tea & cake" and rows["greenhouse"]["company"] == "X" and rows["greenhouse"]["is_remote"]
    assert (rows["lever"]["salary"], rows["lever"]["posted_date"].year, rows["lever"]["job_type"]) == ("$90k–$140k/yr", 2020, "Full-time")
    w = rows["workday"]
    assert (w["title"], w["url"], w["is_remote"], w["posted_date"]) == ("Potter", "https://x.wd1.myworkdayjobs.com/Careers/job/clay_R7", None, NOW - timedelta(days=1))
    health = {r["source"]: r for r in out.health.collect()}
    assert health["ashby"]["error"] == "RuntimeError: all 2 ashby board(s) failed: a, b" and not health["ashby"]["ok"]
    assert health["greenhouse"]["ok"] and health["greenhouse"]["count"] == 1 and len(health) == 4


# The subject lines.
@pytest.mark.parametrize("oks,new,args,want", [
    ([False], 0, {"send_on_total_failure": False, "send_empty_digest": True}, (True, False, "[Job Digest] ⚠ all sources failed")),
    ([False], 0, {}, (True, True, "[Job Digest] ⚠ all sources failed")), ([True, False], 0, {}, (False, False, "[Job Digest] 0 new jobs")),
    ([True], 1, {}, (False, True, "[Job Digest] 1 new job")), ([True], 0, {"send_empty_digest": True}, (False, True, "[Job Digest] 0 new jobs")),
])
def test_run_decision(spark, oks, new, args, want):
    health = spark.createDataFrame([(o,) for o in oks], "ok boolean")
    row = run_decision(health, spark.createDataFrame([(new,)], "new long"), **args).first()
    assert (row["all_failed"], row["send"], row["subject"]) == want


def test_store_is_not_shuffled_for_a_run(spark, tmp_path, monkeypatch):
    """The ids of a run go to the store; past the limit both sides are shuffled, with the same rows."""
    from vacantia.operators import seen as S

    store = SeenTable(spark, str(tmp_path / "seen"))
    store.record(frame(spark, [posting("a"), posting("b"), posting(""), posting(None)]), "b1", NOW)
    store.record(frame(spark, [posting("a"), posting("z")]), "b2", NOW)
    rows = frame(spark, [posting(i) for i in ("a", "a", "c", "", None, "z")])
    want = [("", False), ("a", True), ("a", True), ("c", False), ("z", True), (None, False)]
    plans = []
    real = S.cut

    def spied(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(S, "cut", spied)
    for limit in (S.BROADCAST_IDS, 1):
        monkeypatch.setattr(S, "BROADCAST_IDS", limit)
        got = [(r["job_id"], r["seen"]) for r in S.mark_seen(rows, store.load()).collect()]
        assert sorted(got, key=lambda r: (r[0] is None, r)) == want
    met = plans[1]
    assert "BroadcastHashJoin" in met and met.index("HashAggregate") < met.index("BroadcastHashJoin")
    below = met[met.index("BroadcastHashJoin"):]
    assert "Exchange hashpartitioning" not in below and "Exchange hashpartitioning" in plans[3][plans[3].index("Join"):]


def test_feeds_are_read_once_and_the_filter_runs_once(spark, monkeypatch):
    from vacantia.plans import daily

    calls = []
    real = daily.filter_postings
    monkeypatch.setattr(daily, "filter_postings", lambda *a: calls.append(1) or real(*a))
    out = run(spark, [posting("1"), posting("2", title="Gardener", company="Other")], seen=spark.createDataFrame([("2",), ("9",)], "job_id string"))
    plan = out.funnel._jdf.queryExecution().optimizedPlan().toString()
    assert len(calls) == 1 and "description" not in "".join(line for line in plan.split("\n") if "Filter" in line)
    assert out.funnel.first().asDict()["seen_skipped"] == 1 and out.fetched.count() == 2


def test_a_payload_is_parsed_once(spark):
    """One parse in the plan of each reader, and none in what a run reads after its landed table was written."""
    site = "https://x.wd1.myworkdayjobs.com/en-US/Careers"
    raw = landing(spark, [("greenhouse", "x", True, {"jobs": [{"id": 1, "title": "A"}]}), ("lever", "l", True, [{"id": "k"}]),
                          ("ashby", "a", True, {"jobs": [{"id": 2}]}), ("workday", site, True, {"jobPostings": [{"title": "P"}]})])
    log = feeds.isolate(raw)
    readers = (feeds.read_greenhouse, feeds.read_lever, feeds.read_ashby, lambda x: feeds.read_workday(x, None, F.lit(NOW)))
    for read in readers:
        plan = read(log)._jdf.queryExecution().optimizedPlan().toString()
        pages = "jobPostingInfo" in plan  # of another table: its payloads are parsed once too
        assert plan.count("parseJson(") == 1 + pages and "from_json" not in plan
    table = feeds.parse_once(log)
    for read in readers:
        plan = read(table)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("parseJson(") == ("jobPostingInfo" in plan) and "PartitionFilters: [isnotnull(source" in plan and read(table).count() == 1
    slim = table.select("source", "board", "ok")._jdf.queryExecution().executedPlan().toString()
    assert "body" not in slim and table.where("payload IS NOT NULL").count() == 0


def test_odd_payloads(spark):
    """Items that are no objects are left out alone, fields of another type are missing, boards without an array have no rows."""
    jobs = [{"id": 1, "title": "A", "location": "not an object"}, None, 7, {"id": "b", "title": ["x"], "location": {"name": "Rome"}}]
    raw = landing(spark, [("greenhouse", "x", True, {"jobs": jobs}), ("greenhouse", "none", True, {"jobs": None}),
                          ("greenhouse", "map", True, {"jobs": {"a": 1}}), ("greenhouse", "list", True, [1]), ("greenhouse", "down", False, {"jobs": jobs})])
    raw = raw.unionByName(raw.where("board = 'x'").withColumn("board", F.lit("bad")).withColumn("payload", F.lit("{oops")))
    log = feeds.isolate(raw)
    rows = {r["ord"]["row_ord"]: r for r in feeds.read_greenhouse(log).collect()}
    assert [(k, rows[k]["title"], rows[k]["location"]) for k in sorted(rows)] == [(0, "A", ""), (1, '["x"]', "Rome")]
    ok = {r["board"]: r["ok"] for r in log.collect()}
    assert ok == {"x": True, "none": True, "map": True, "list": False, "down": False, "bad": False}


def test_latest_page_of_a_posting(spark):
    """The latest readable page counts; unreadable later pages and postings without a path don't."""
    site = "https://x.wd1.myworkdayjobs.com/en-US/Careers"
    page = lambda t: json.dumps({"jobPostingInfo": {"title": t}})
    day = lambda n: NOW + timedelta(days=n)
    details = spark.createDataFrame([
        (site, "/a", True, page("old"), day(0)), (site, "/a", True, page("new"), day(1)), (site, "/a", True, page("new"), day(1)), (site, "/a", True, "{oops", day(2)),
        (site, "/a", False, page("failed"), day(3)), (site, "/b", True, page("undated"), None), (site, "", True, page("no path"), day(1)), (site, "/c", True, "{oops", day(1)),
    ], "board string, external_path string, ok boolean, payload string, fetched_at timestamp")
    got = {r["path"]: r["info"]["title"] for r in feeds._latest_details(details).collect()}
    assert got == {"/a": "new", "/b": "undated"}


def test_keyed_run_expires_restarts_and_keeps_its_state_small(spark, tmp_path, monkeypatch):
    from vacantia.streaming import incremental as I

    landed, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    words = {"a": "Baker", "b": "Quarry Foreman", "c": "Violin Teacher", "d": "Nurse", "e": "Harbour Pilot"}
    schema = frame(spark, []).schema

    def start(ids, day):
        if ids:
            frame(spark, [posting(i, title=words[i], company=words[i][::-1]) for i in ids]).coalesce(1).write.mode("append").parquet(landed)
        I.run_keyed(spark.readStream.schema(schema).parquet(landed), out, Criteria(), lambda batch: NOW + timedelta(days=day), checkpoint)

    def published():
        rows = spark.read.parquet(f"{out}/digest").select("job_id", "batch_id").collect()
        return ["".join(sorted(r["job_id"] for r in rows if r["batch_id"] == b)) for b in sorted({r["batch_id"] for r in rows})]

    def held():
        return {r[0] for r in spark.read.format("statestore").load(f"{checkpoint}/digest").select("key.job_id").collect()}

    (tmp_path / "in").mkdir()
    start("", 0)  # nothing landed so far
    real = I.digest_order
    monkeypatch.setattr(I, "digest_order", lambda *a: 1 / 0)
    with pytest.raises(Exception):
        start("ab", 0)  # the second stream fails after the first one has ended
    monkeypatch.setattr(I, "digest_order", real)
    start("", 0)
    assert published() == ["ab"]
    start("ac", 1)
    assert published() == ["ab", "c"] and held() == set("abc")
    start("ad", 300)
    assert published() == ["ab", "c", "d"] and held() == {"d"}
    start("ae", 301)
    assert published() == ["ab", "c", "d", "ae"] and held() == set("ade")
