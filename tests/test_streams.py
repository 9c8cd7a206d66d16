import pytest
from pyspark.sql import functions as F

from checks.catalog import _pages, _wanted_stream, claims_of
from crawlspark.operators.quota import first_claims, quota_decisions
from crawlspark.session import make_folder, scratch_path
from crawlspark.sources.tables import EVENTS
from crawlspark.streaming import export as export_stream
from crawlspark.streaming import quota as stream


@pytest.fixture
def split_events(spark):
    """The small event table as files that arrive one per batch, in time order."""
    path = scratch_path(spark, "split")
    table = spark.read.schema(EVENTS).parquet("/root/testdata/sf0.001/events.parquet")
    for i in range(4):
        table.filter(F.col("event_id").between(i * 250, i * 250 + 249)).coalesce(1).write.mode("append").parquet(path)
    return path, table


def decided(df):
    return sorted(tuple(str(v) for v in r) for r in df.select(
        "event_id", "day", "site_key", "decision", "used", "retry_after").collect())


@pytest.mark.parametrize("limit", [3, 20])
def test_quota_over_batches_equals_batch(spark, split_events, limit):
    path, table = split_events
    out = scratch_path(spark, "quota")
    got = stream.run_quota_stream(claims_of(stream.read_events(spark, path, files_per_batch=1)), out, limit)
    assert decided(got) == decided(quota_decisions(claims_of(table), limit))
    assert spark.read.parquet(f"{out}/state/v3").groupBy("day").count().filter(F.col("count") > limit).count() == 0


def test_a_batch_run_again_changes_nothing(spark, split_events):
    _, table = split_events
    claims = claims_of(table)
    step = stream.QuotaBatches(scratch_path(spark, "replay"), 5)
    first, second = claims.filter("event_id < 500"), claims.filter("event_id >= 500")
    step(first, 0)
    step(second, 1)
    before = decided(spark.read.parquet(f"{step.path}/decisions"))
    step(second, 1)
    assert decided(spark.read.parquet(f"{step.path}/decisions")) == before == decided(quota_decisions(claims, 5))


def test_the_state_keeps_days_and_two_versions(spark):
    step = stream.QuotaBatches(scratch_path(spark, "days"), 5)
    base = spark.range(1)
    for batch, day in enumerate(["2024-01-01", "2024-01-02", "2024-01-05", "2024-01-06"]):
        step(base.select(F.lit(batch).cast("bigint").alias("event_id"), F.lit(f"{day} 10:00:00").cast("timestamp_ntz").alias("ts"),
                         F.lit("https://a.be/").alias("url"), F.lit("discover").alias("op")), batch)
    kept = [str(r.day) for r in spark.read.parquet(f"{step.path}/state/v3").orderBy("day").collect()]
    assert kept == ["2024-01-01", "2024-01-02", "2024-01-05", "2024-01-06"]
    with pytest.raises(Exception):  # only the last two versions are kept
        spark.read.parquet(f"{step.path}/state/v1").count()


def test_future_and_late_events_open_no_new_slots(spark):
    step = stream.QuotaBatches(scratch_path(spark, "order"), 2)
    days = ["2024-01-02", "2099-01-01", "2024-01-02", "2024-01-01", "2024-01-02"]
    for batch, day in enumerate(days):
        step(spark.range(3).select((F.col("id") + 10 * batch).alias("event_id"), F.lit(f"{day} 10:00:00").cast("timestamp_ntz").alias("ts"),
                                   F.concat(F.lit(f"https://b{batch}x"), F.col("id"), F.lit(".be/")).alias("url"), F.lit("discover").alias("op")), batch)
    got = spark.read.parquet(f"{step.path}/decisions").filter("decision = 'claimed'").groupBy("day").count().collect()
    assert {str(r.day): r["count"] for r in got} == {"2024-01-02": 2, "2099-01-01": 2, "2024-01-01": 2}


def test_events_of_closed_days_are_set_aside(spark):
    step = stream.QuotaBatches(scratch_path(spark, "closed"), 2, keep_days=3)
    old = spark.range(4).select("id", F.when(F.col("id") < 1, F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")).otherwise(
        F.current_timestamp().cast("timestamp_ntz")).alias("ts"))
    step(old.select(F.col("id").alias("event_id"), "ts", F.concat(F.lit("https://c"), F.col("id"), F.lit(".be/")).alias("url"), F.lit("discover").alias("op")), 0)
    assert spark.read.parquet(f"{step.path}/late").count() == 1 and spark.read.parquet(f"{step.path}/decisions").count() == 3


def test_first_claims_once_per_day(spark, split_events):
    path, table = split_events
    got = stream.run_first_claims_stream(
        claims_of(stream.read_events(spark, path, files_per_batch=1)), scratch_path(spark, "first"))
    want = first_claims(claims_of(table)).select("day", "site_key")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_first_claims_keep_late_and_future_events(spark):
    path, out = scratch_path(spark, "times"), scratch_path(spark, "times-first")
    times = ["2024-03-05 10:00:00", "2099-01-01 00:00:00", "2024-03-05 11:00:00", "2024-01-01 09:00:00", "2024-03-06 10:00:00"]

    def arrive(files):
        for i in files:  # one file a batch: a site seen in every file and one of its own
            spark.createDataFrame([(2 * i, "https://same.be/"), (2 * i + 1, f"https://own{i}.be/")], "event_id bigint, url string").select(
                "event_id", F.lit(times[i]).cast("timestamp_ntz").alias("ts"), "url", F.lit("discover").alias("op")).coalesce(1).write.mode("append").parquet(path)

    def events():
        table = spark.read.parquet(path)
        return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)

    arrive(range(3))
    stream.run_first_claims_stream(events(), out)
    arrive(range(3, 5))
    got = stream.run_first_claims_stream(events(), out)  # goes on where the first run ended
    want = first_claims(spark.read.parquet(path)).select("day", "site_key")
    assert len(got.collect()) == 9 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    again = stream.run_first_claims_stream(events(), out)  # nothing new
    assert again.count() == 9


def test_a_batch_of_first_claims_run_again_changes_nothing(spark, split_events):
    _, table = split_events
    claims = claims_of(table)
    step = stream.FirstClaimBatches(scratch_path(spark, "first-again"))
    first, second = claims.filter("event_id < 500"), claims.filter("event_id >= 500")
    for batch, batch_id in ((first, 0), (second, 1), (second, 1)):
        step(batch, batch_id)
    got = step.rows(spark).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, first_claims(claims).select("day", "site_key").collect()))


def test_a_batch_reads_the_sightings_of_its_days_only(spark):
    step = stream.FirstClaimBatches(scratch_path(spark, "first-days"), compact_every=3)
    days = ["2024-03-01", "2024-03-02", "2024-03-01", "2024-03-03", "2024-03-01", "2024-03-01"]
    for batch, day in enumerate(days):
        step(spark.range(4).select("id", F.lit(f"{day} 10:00:00").cast("timestamp_ntz").alias("ts"), F.lit("discover").alias("op"), F.concat(
            F.lit("https://s"), F.col("id") * (batch + 1), F.lit(".be/")).alias("url")), batch)
    plan = step.before(spark, ["2024-03-01"], 6)._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "seen_day" in pruned and "2024-03-01" in pruned and "batch" in pruned
    want = {(d, f"s{i * (b + 1)}.be") for b, d in enumerate(days) for i in range(4)}
    got = [(str(r.day), r.site_key) for r in step.rows(spark).collect()]
    assert sorted(got) == sorted(want)
    # three batches of the first day were written together
    left = {r.batch for r in step.before(spark, ["2024-03-01"], 6).select("batch").distinct().collect()}
    assert left == {4, 5}


def test_empty_folders_and_runs_without_news(spark, split_events):
    """No file yet: an empty result. Nothing new: the result of the runs before."""
    empty = scratch_path(spark, "nothing")
    make_folder(spark, empty)
    path, table = split_events
    out = {k: scratch_path(spark, k) for k in ("quota", "first", "export", "progress")}
    claims = lambda folder: claims_of(stream.read_events(spark, folder))
    assert stream.run_quota_stream(claims(empty), scratch_path(spark, "q0")).collect() == []
    assert stream.run_first_claims_stream(claims(empty), scratch_path(spark, "f0")).collect() == []
    first = decided(stream.run_quota_stream(claims(path), out["quota"]))
    assert first == decided(stream.run_quota_stream(claims(path), out["quota"])) and first

    wanted, tables = _wanted_stream(spark, "/root/testdata/sf0.001")
    none = export_stream.read_requests(spark, empty)
    pages = _pages(spark, "/root/testdata/sf0.001", True)
    assert export_stream.run_progress_stream(none, *tables, scratch_path(spark, "p0")).collect() == []
    rows = export_stream.run_export_stream(none, *tables, pages, scratch_path(spark, "e0"))
    assert rows.collect() == []
    counts = sorted(map(tuple, export_stream.run_progress_stream(wanted, *tables, out["progress"]).collect()))
    assert counts and counts == sorted(map(tuple, export_stream.run_progress_stream(wanted, *tables, out["progress"]).collect()))
    done = export_stream.run_export_stream(wanted, *tables, pages, out["export"])
    assert done.schema == rows.schema and done.count() == sum(c[3] for c in counts)
    assert export_stream.run_export_stream(wanted, *tables, pages, out["export"]).count() == done.count()


# ------------------------------------------------------------------- requests joined with arriving pages


@pytest.fixture
def arriving(spark):
    """add(minute, requests, pages) lets rows arrive; run() takes in what is new and gives (rows, progress)."""
    asked, pages, out = (scratch_path(spark, k) for k in ("asked", "pages", "joined"))
    make_folder(spark, asked)
    make_folder(spark, pages)
    seeds = spark.createDataFrame([(1, "https://h.be/", "h.be")], "seed_id long, url string, host string")
    policy = spark.createDataFrame([], "site string, robots_status string, rules array<struct<rule_pos:bigint,allow:boolean,prefix:string>>")
    policy = spark.createDataFrame([("https://h.be", "parsed", [(1, False, "/no")])], policy.schema)
    answers = spark.createDataFrame([(f"https://h.be/{i}", 200, "text/html", 10) for i in range(9)], "url string, status int, content_type string, n_bytes long")
    at = lambda minute: F.timestamp_seconds(F.lit(1_700_000_000 + 60 * minute))

    def add(minute, requests=(), bodies=()):
        if requests:
            spark.createDataFrame([(1, p, f"https://h.be/{u}") for p, u in requests], "seed_id long, pos long, url string").withColumn(
                "asked_at", at(minute)).coalesce(1).write.mode("append").parquet(asked)
        if bodies:
            spark.createDataFrame([(f"https://h.be/{u}", f"<p>{t}</p>") for u, t in bodies], "url string, html string").withColumn(
                "arrived_at", at(minute)).coalesce(1).write.mode("append").parquet(pages)

    def run():
        rows = export_stream.joined_export(
            export_stream.read_timed_requests(spark, asked, 1), seeds, policy, answers,
            export_stream.read_arriving_pages(spark, pages, 1), before="30 minutes", wait="30 minutes", late="5 minutes")
        q = export_stream.start_joined_export(rows, out)
        q.awaitTermination()
        got = {r.pos: (r.text, r.error) for r in export_stream.joined_rows(spark, out).collect()}
        return got, q.recentProgress

    return add, run


def test_bodies_before_and_after_their_request(arriving):
    add, run = arriving
    assert run()[0] == {}
    add(0, bodies=[("0", "zero"), ("1#a", "one a")])
    add(10, requests=[(1, "0"), (2, "1"), (3, "2"), (4, "no"), (5, "3"), (6, "2")])
    got, _ = run()
    # the bodies were there; a refused request does not wait
    assert got == {1: ("zero", None), 2: ("one a", None), 4: (None, "robots")}
    add(20, bodies=[("2", "two"), ("1", "one")])
    got, progress = run()  # started again: state is carried over, files are not read again
    assert got == {1: ("zero", None), 2: ("one", None), 3: ("two", None), 6: ("two", None), 4: (None, "robots")}
    assert sum(p["numInputRows"] for p in progress) == 2
    assert max(s["numRowsTotal"] for p in progress for s in p["stateOperators"]) > 0
    add(300, requests=[(9, "no")], bodies=[("8", "eight")])
    got, progress = run()
    # the page that never came; and what the watermark passed is gone from both states
    assert got[5] == (None, "no_response") and set(got) == {1, 2, 3, 4, 5, 6, 9}
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= export_stream.SPREAD
    again, progress = run()
    assert again == got and sum(p["numInputRows"] for p in progress) == 0


def test_bodies_out_of_reach_are_not_joined(arriving):
    add, run = arriving
    add(0, bodies=[("0", "old")])
    add(40, requests=[(1, "0")])
    add(60, bodies=[("0", "in time")])
    add(80, bodies=[("0", "too late")])
    add(300, requests=[(9, "no")], bodies=[("8", "eight")])
    assert run()[0] == {1: ("in time", None), 9: (None, "robots")}


def test_the_join_reads_no_table_of_bodies(spark, arriving):
    add, run = arriving
    add(0, requests=[(p, "0") for p in range(50)], bodies=[("0", "zero")])
    got, _ = run()  # one address asked for by all
    assert got == {p: ("zero", None) for p in range(50)}
    for i in range(1, 4):
        add(i, bodies=[(str(i), "x")])
        _, progress = run()
        assert [s["numInputRows"] for p in progress for s in p["sources"] if s["numInputRows"]] == [1]
