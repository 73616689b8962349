import random
import re
import uuid
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clicktrail import operators as op
from clicktrail.plans import RealtimeAds
from clicktrail.sources import file_lines
from clicktrail.streaming import AreaRanks, ArrivalBuckets, BatchFolders, ClickGuard, last_minutes_of_buckets
from clicktrail.streaming.buckets import bucket_counts
from tests.rows import clicks
from tests.test_ads import brute_guard

NOW = {"availableNow": True}
PAIR = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])


@pytest.fixture
def root(spark):
    return f"{spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}"


def pairs(spark, **values):
    return spark.createDataFrame(list(values.items()), PAIR)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_batch_is_published_once_and_at_once(spark, root):
    folders = BatchFolders(spark, root, PAIR)
    assert folders.read().collect() == [] and folders.batch(0).collect() == [] and folders.complete() == []
    folders.publish(pairs(spark, a=1, b=2), 0)
    folders.publish(pairs(spark, a=999), 0)         # replay
    folders.publish_rows(pairs(spark, c=3), 1)
    folders.publish_rows(spark.createDataFrame([], PAIR), 2)
    assert folders.complete() == [0, 1]
    assert {tuple(r) for r in folders.read().collect()} == {("a", 1, 0), ("b", 2, 0), ("c", 3, 1)}
    assert [tuple(r) for r in folders.batch(1).collect()] == [("c", 3)]
    assert {r.k for r in folders.read(before=1).collect()} == {"a", "b"}


def test_what_a_lost_driver_left_aside_is_not_seen_and_written_again(spark, root):
    folders = BatchFolders(spark, root, PAIR)
    aside = Path(root) / "_aside" / "batch_id=0"
    aside.mkdir(parents=True)
    (aside / "part-0.parquet").write_bytes(b"cut short")
    assert folders.complete() == [] and folders.read().collect() == []
    folders.publish(pairs(spark, a=1), 0)
    assert [r.k for r in folders.read().collect()] == ["a"]


def start_guard(spark, root, **options):
    app = RealtimeAds(spark, root, **options)
    app.start_guard(file_lines(spark, f"{root}/log"), NOW).awaitTermination()
    return app


def kept(app):
    return Counter((r.user_id, r.ads_id) for r in app.guard.clean_clicks().collect())


def test_guard_batches_equal_the_rule(spark, root):
    rng = random.Random(2)
    rows = [(rng.randrange(5), rng.choice("aaaaabcdef"), rng.choice("xy")) for _ in range(120)]
    want, flags = brute_guard(rows, 4)
    assert flags
    for b in range(5):
        deliver(spark, clicks(spark, [(0, u, a) for bb, u, a in rows if bb == b]), root)
        app = start_guard(spark, root, threshold=4)
    assert {r.user_id: r.flag_batch for r in app.user_blacklist().collect()} == flags
    assert kept(app) == Counter((u, a) for _, u, a in want)


STEPS = ["clean.publish", "blacklist.publish_rows", "dropped.publish_rows", "storage.move", "after"]


@pytest.mark.parametrize("step", STEPS)
def test_a_driver_lost_at_any_step_changes_no_count(spark, root, monkeypatch, step):
    """The log comes in three batches; the driver is lost in the second, once before and once after the step."""
    rows = [(0, "u", "x")] * 3 + [(0, "v", "x")] * 2 + [(0, "w", "y")]
    listed = lambda: spark.createDataFrame([("w",)], "user_id string")
    for batch in range(3):
        deliver(spark, clicks(spark, rows), root)
        if batch == 1:
            for late in (False, True):
                app = RealtimeAds(spark, root, threshold=2, listed=listed)
                _lose(app, step, late, monkeypatch)
                with pytest.raises(Exception):
                    app.start_guard(file_lines(spark, f"{root}/log"), NOW).awaitTermination()
                monkeypatch.undo()
                # readers run on meanwhile
                for running in RealtimeAds(spark, root).start_counts(trigger=NOW, only=["area_city_ads_day_count", "last_hour"]):
                    running.awaitTermination()
        app = start_guard(spark, root, threshold=2, listed=listed)
    for running in app.start_counts(trigger=NOW):
        running.awaitTermination()
    # u is over the threshold in the second batch; it and v are counted otherwise as often as they come
    assert kept(app) == {("u", "x"): 6, ("v", "x"): 6}
    assert {(r.user_id, r.flag_batch) for r in app.user_blacklist().collect()} == {("u", 1), ("v", 2)}
    assert {(r.ads_id, r.click_count) for r in app.area_city_ads_day_count().collect()} == {("x", 12)}
    assert {(r.user_id, r.click_count) for r in app.user_ads_day_count().collect()} == {("u", 6), ("v", 6)}
    assert app.buckets.rows().agg(F.sum("click_count")).first()[0] == 12
    assert app.area_ads_top().first().top_ads == '[{"x":12}]'
    assert app.guard.dropped.read().agg(F.sum("n")).first()[0] == 3


def _lose(app, step, late, monkeypatch):
    def lost(*args):
        if late:
            real(*args)
        raise OSError("lost")

    if step == "after":
        owner, name = app.guard, "step"
        late = True
    elif step == "storage.move":
        owner, name = app.guard.clean.storage, "move"
    else:
        owner, name = getattr(app.guard, step.split(".")[0]), step.split(".")[1]
    real = getattr(owner, name)
    monkeypatch.setattr(owner, name, lost)


def test_a_list_that_changes_takes_effect_in_the_next_batch(spark, root):
    rows = [(0, "u", "x")] * 2 + [(0, "v", "x")]
    lists = [["u"], [], ["v"], ["none"], []]
    for names in lists:
        deliver(spark, clicks(spark, rows), root)
        app = start_guard(spark, root, threshold=3, listed=lambda: spark.createDataFrame([(n,) for n in names], "user_id string"))  # noqa: B023
    # u: listed in batch 0; 2 clicks each in 1, 2, 3; over 3 before batch 3, which flags it
    # v: not in batch 2; 1 in 0, 1, 3, 4, three before batch 4
    assert kept(app) == {("u", "x"): 6, ("v", "x"): 4}
    assert {(r.user_id, r.flag_batch) for r in app.user_blacklist().collect()} == {("u", 3)}


def test_a_batch_costs_what_its_own_keys_cost(spark, root):
    deliver(spark, clicks(spark, [(i, f"u{i}", "x") for i in range(500)]), root)
    start_guard(spark, root)
    deliver(spark, clicks(spark, [(0, "u1", "x"), (0, "u1", "x")]), root)
    app = RealtimeAds(spark, root)
    seen = []
    step = app.guard.step
    app.guard.step = lambda rows, batch_id: (seen.append(rows.count()), step(rows, batch_id))
    app.start_guard(file_lines(spark, f"{root}/log"), NOW).awaitTermination()
    assert seen == [3]          # two clicks and the total of their key
    # of the first batch's keys nothing was written again
    assert [sum(f.suffix == ".parquet" for f in Path(app.guard.blacklist.root).rglob("*"))] == [0]


def test_clicks_are_combined_before_the_shuffle(spark, root):
    guard = ClickGuard(spark, root)
    one = op.parse_ads_log(clicks(spark, [(0, "u", "x")]))
    assert len(re.findall("HashAggregate.*partial_count", plan(guard.with_totals(one)))) == 1


def deliver(spark, lines, root):
    lines.coalesce(1).write.mode("append").text(f"{root}/log")


def test_counted_clicks_can_be_dropped(spark, root):
    for part in range(3):
        deliver(spark, clicks(spark, [(part, "u", "x")]), root)
        app = start_guard(spark, root)
        for running in app.start_counts(trigger=NOW, only=["area_city_ads_day_count"]):
            running.awaitTermination()
        app.guard.drop_clean(part)
    assert app.guard.clean.complete() == [2]
    assert app.area_city_ads_day_count().first().click_count == 3


def test_stream_with_restarts_equals_batch(spark, root):
    rng = random.Random(3)
    places = [("north", "york"), ("north", "leeds"), ("south", "bath")]
    batches = [
        [(rng.randrange(7200), rng.choice("aaaabcde"), rng.choice("123"), *rng.choice(places)) for _ in range(40)]
        for _ in range(3)
    ]
    for batch in batches:
        deliver(spark, clicks(spark, batch), root)
        app = RealtimeAds(spark, root, threshold=3, k=2)     # a restart from the checkpoints
        app.start_guard(file_lines(spark, f"{root}/log"), NOW).awaitTermination()
        for running in app.start_counts(trigger=NOW):
            running.awaitTermination()

    numbered = [(b, *row) for b, batch in enumerate(batches) for row in batch]
    kept, flags = brute_guard([(b, u, a) for b, _, u, a, *_ in numbered], 3)
    assert flags and len(kept) < len(numbered)
    assert {r.user_id for r in app.user_blacklist().collect()} == set(flags)
    clean = op.parse_ads_log(clicks(spark, [row[1:] for row in numbered if row[2] not in flags or row[0] <= flags[row[2]]]))

    def same(a, b):
        assert Counter(map(tuple, a.select(*sorted(a.columns)).collect())) == Counter(
            map(tuple, b.select(*sorted(b.columns)).collect()))

    same(app.user_ads_day_count(), op.user_ads_day_count(clean))
    same(app.area_city_ads_day_count(), op.area_city_ads_day_count(clean))
    same(app.area_ads_top(), op.area_ads_top(op.area_city_ads_day_count(clean), 2))
    # all arrived within the hour, whatever their own times
    now = F.current_timestamp() + F.expr("INTERVAL 10 SECONDS")
    same(app.last_hour(now), op.last_hour_minutes(clean.withColumn("at", F.current_timestamp()), now, arrival="at"))
    # with no further clicks the window still moves on
    assert app.last_hour(now + F.expr("INTERVAL 61 MINUTES")).count() == 0


def test_both_forms_of_the_last_hour_take_the_same_window_and_lose_no_late_click(spark, root):
    rng = random.Random(4)
    first = datetime(2024, 1, 1, 10, 0, 0)
    # a click's own time, and when it arrives: some hours late, not in the order of time
    rows = [(rng.randrange(7200), rng.choice("123"), rng.randrange(5400)) for _ in range(300)]
    rng.shuffle(rows)
    app = RealtimeAds(spark, root)
    lines = clicks(spark, [(s, f"{arrived}", a) for s, a, arrived in rows])    # the user tells the arrival
    arrival = F.timestamp_seconds(F.unix_seconds(F.lit(first)) + F.col("user_id").cast("bigint"))
    for part in range(3):
        deliver(spark, lines.where(F.split("value", " ")[3].cast("int") % 3 == part), root)
        stream = op.parse_ads_log(file_lines(spark, f"{root}/log"))
        for running in app.start_counts(stream, NOW, arrival=F.expr("current_timestamp()"), only=["last_hour"]):
            running.awaitTermination()
    held = app.buckets.rows().agg(F.sum("click_count")).first()[0]
    assert held == len(rows)
    batch = op.parse_ads_log(lines).withColumn("arrival", arrival)
    kept_rows = ArrivalBuckets(spark, f"{root}/by-arrival")
    for third in range(3):
        kept_rows.add(batch.where(F.col("user_id").cast("int") % 3 == third), third)
        kept_rows.add(batch.where(F.col("user_id").cast("int") % 3 == third), third)    # replay
    buckets = bucket_counts(batch)
    for seconds in (1, 3605, 3599, 4247.5, 6003, 9999):
        as_of = first + timedelta(seconds=seconds)
        a = last_minutes_of_buckets(buckets, as_of)
        b = op.last_hour_minutes(batch, as_of, arrival="arrival")
        c = kept_rows.last_minutes(as_of)
        assert Counter(map(tuple, c.collect())) == Counter(map(tuple, b.select(*c.columns).collect()))
        assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.select(*a.columns).collect()))


def test_reports_are_published_after_every_batch(spark, root):
    app, seen = RealtimeAds(spark, root), []
    for part in range(2):
        deliver(spark, clicks(spark, [(part, "u", "x")]), root)
        stream = op.parse_ads_log(file_lines(spark, f"{root}/log"))
        for running in app.start_counts(stream, NOW, publish=lambda name, df: seen.append((name, df.count()))):
            running.awaitTermination()
    assert Counter(name for name, _ in seen)["area_ads_top"] >= 2 and {n for n, _ in seen} == {"area_ads_top", "last_hour"}
    assert all(n == 1 for name, n in seen if name == "area_ads_top")


def test_a_last_hour_reads_the_folders_of_two_hours(spark, root):
    buckets = ArrivalBuckets(spark, root)
    log = op.parse_ads_log(clicks(spark, [(3600 * h, "u", "x") for h in range(40)])).withColumn("arrival", F.col("ts"))
    buckets.add(log, 0)
    hours = sorted(int(n.split("=")[1]) for n in buckets.storage.names(buckets.path) if n.startswith("hour="))
    assert len(hours) == 26 and hours[-1] - hours[0] == 25      # older ones went
    at = datetime(2024, 1, 3, 1, 30)
    read = buckets.last_minutes(at)
    text = plan(read)
    assert re.search(r"PartitionFilters: \[.*hour#\d+L? >= \d+.*hour#\d+L? <= \d+", text)
    assert read.count() == 1
    first = int((at - timedelta(hours=1) - datetime(1970, 1, 1)).total_seconds()) // 3600
    assert {int(f.split("hour=")[1].split("/")[0]) for f in buckets.rows(hours[-2]).inputFiles()} == set(hours[-2:])
    assert {int(f.split("hour=")[1].split("/")[0]) for f in read.inputFiles()} == {h for h in hours if h >= first}
    assert read.first().minute_counts == '[{"01:00":1}]'


def test_ranks_read_and_write_the_days_of_a_batch_only(spark, root):
    ranks = AreaRanks(spark, root, k=2)
    schema = "day string, area string, ads_id string, click_count long"

    def take(rows, batch_id):
        ranks.update(spark.createDataFrame(rows, schema), batch_id)

    take([("d1", "n", "a", 5), ("d1", "n", "b", 4), ("d1", "n", "c", 3), ("d1", "s p/a=ce", "a", 1), ("d2", "n", "a", 1)], 0)
    take([("d2", "n", "b", 7)], 1)
    take([("d1", "n", "c", 5), ("d1", "", "z", 1)], 2)
    take([("d1", "n", "c", 5), ("d1", "", "z", 1)], 2)                      # replay
    got = {(r.day, r.area): r.top_ads for r in ranks.lists().collect()}
    assert got == {("d1", "n"): '[{"a":5},{"c":5}]', ("d1", "s p/a=ce"): '[{"a":1}]', ("d1", ""): '[{"z":1}]', ("d2", "n"): '[{"b":7},{"a":1}]'}
    names = {d: sorted(ranks.storage.names(f"{ranks.path}/day={d}")) for d in ("d1", "d2")}
    assert names == {"d1": ["batch_id=0", "batch_id=2"], "d2": ["batch_id=0", "batch_id=1"]}
    before = ranks.before(["d2", "d9"], 3)
    assert {f.split("day=")[1][:2] for f in before.inputFiles()} == {"d2"}
    assert {r.ads_id for r in before.collect()} == {"a", "b"} and ranks.before(["d9"], 3).collect() == []
    for batch_id in range(3, 8):
        take([("d2", "n", "b", 7 + batch_id)], batch_id)
        ranks.tidy(["d2"])
    assert sorted(ranks.storage.names(f"{ranks.path}/day=d2")) == ["batch_id=5", "batch_id=6", "batch_id=7"]
    assert len(ranks.storage.names(f"{ranks.path}/day=d1")) == 2


def test_random_ranks_equal_a_sort_of_all_counts(spark, root):
    rng = random.Random(8)
    ranks, totals = AreaRanks(spark, root), Counter()
    for batch_id in range(6):
        changed = set()
        for _ in range(40):
            key = (rng.choice(["d1", "d2"]), rng.choice("ns"), rng.choice("abcdefgh"))
            totals[key] += 1
            changed.add(key)
        ranks.update(spark.createDataFrame([(*k, totals[k]) for k in changed], "day string, area string, ads_id string, click_count long"), batch_id)
        counts = spark.createDataFrame([(*k, n) for k, n in totals.items()], "day string, area string, ads_id string, click_count long")
        want = {tuple(r) for r in op.area_ads_top(counts).collect()}
        assert {tuple(r) for r in ranks.lists().select("day", "area", "top_ads").collect()} == want


def test_left_out_lines_are_counted_in_the_progress(spark, root):
    lines = spark.createDataFrame([("1704103200123 n c 7 2",), ("oops",), ("",)], "value STRING")
    deliver(spark, lines, root)
    running = RealtimeAds(spark, root).start_guard(file_lines(spark, f"{root}/log"), NOW)
    running.awaitTermination()
    seen = [p.observedMetrics["ads_log"] for p in running.recentProgress if p.observedMetrics]
    assert [tuple(m) for m in seen] == [(3, 2)]


def test_delay_closes_old_days_only(spark, root):
    day = 86400
    app = RealtimeAds(spark, root, delay="1 hour")
    for rows in ([(0, "u", "1")], [(5 * day, "u", "1")], [(5 * day, "u", "1"), (60, "u", "1"), (5 * day + 1, "u", "2")]):
        deliver(spark, clicks(spark, rows), root)
        stream = op.parse_ads_log(file_lines(spark, f"{root}/log"))
        for running in app.start_counts(stream, NOW, only=["area_city_ads_day_count"]):
            running.awaitTermination()
    got = {(r.day, r.ads_id): r.click_count for r in app.area_city_ads_day_count().collect()}
    assert got == {("2024-01-01", "1"): 1, ("2024-01-06", "1"): 2, ("2024-01-06", "2"): 1}


def test_a_long_list_is_joined_as_it_is_under_adaptive_execution(spark, root, monkeypatch):
    """A list of others is as long as it is, not once per part of the clicks, and steps are not
    held to the number of state partitions."""
    deliver(spark, clicks(spark, [(i, f"u{i}", "x") for i in range(20)]), root)
    app = RealtimeAds(spark, root, listed=lambda: spark.createDataFrame([("u1",)], "user_id string"))
    seen, publish = [], app.guard.clean.publish

    def look(df, batch_id):
        seen.append((df._jdf.queryExecution().analyzed().toString(), df.sparkSession.conf.get("spark.sql.adaptive.enabled")))
        publish(df, batch_id)

    monkeypatch.setattr(app.guard.clean, "publish", look)
    app.start_guard(file_lines(spark, f"{root}/log"), NOW).awaitTermination()
    ((text, adaptive),) = seen
    assert "explode" not in text and adaptive == "true"
    assert len(kept(app)) == 19


def test_few_published_rows_are_few_files(spark, root):
    folders = BatchFolders(spark, root, PAIR)
    folders.publish_rows(pairs(spark, a=1, b=2, c=3, d=4).repartition(4), 0)
    assert folders.batch(0).count() == 4
    assert len(list(Path(folders.path(0)).glob("*.parquet"))) == 1


def test_a_restart_opens_the_state_and_does_not_replay_it(spark, root):
    for _ in range(2):
        deliver(spark, clicks(spark, [(i, f"u{i}", "x") for i in range(20)]), root)
        start_guard(spark, root)
    state = list(Path(f"{root}/checkpoints/guard/state").rglob("*"))
    assert any(f.suffix == ".zip" for f in state) and not any(f.suffix == ".changelog" for f in state)


def test_a_line_is_parsed_once_for_the_click_and_the_metrics(spark):
    lines = spark.createDataFrame([("1704103200123 n c 7 2",), ("oops",), (None,)], "value STRING")
    frame = op.ads.parse_observed_ads_log(lines)
    text = frame._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("split(") == 1
    assert [tuple(r) for r in frame.collect()] == [tuple(r) for r in op.parse_ads_log(lines).collect()]
