from collections import Counter, defaultdict
from datetime import datetime
import random

from pyspark.sql import functions as F

from clicktrail import operators as op
from tests.rows import START, clicks


def parsed(spark, rows):
    return op.parse_ads_log(clicks(spark, rows))


def test_bad_lines_are_left_out_and_listed(spark):
    lines = spark.createDataFrame(
        [("1704103200123 north york 7 2",), ("1704103200123 north york 7 2  ",), ("x north york 7 2",),
         ("1704103200123 north york 7",), ("1704103200123 middle east york 7 2",), ("",), (None,)],
        "value STRING",
    )
    got = op.parse_ads_log(lines).collect()
    assert [tuple(r) for r in got] == [(datetime(2024, 1, 1, 10, 0, 0, 123000), "north", "york", "7", "2")] * 2
    assert op.ads_log_rejects(lines).count() == 5


def brute_guard(rows, threshold):
    """Batch by batch, as (bucket, user, ad) with one day: kept clicks and flag buckets."""
    totals, flags, kept = Counter(), {}, []
    batches = defaultdict(list)
    for row in rows:
        batches[row[0]].append(row)
    for bucket in sorted(batches):
        batch = [r for r in batches[bucket] if r[1] not in flags]
        kept += batch
        counts = Counter((user, ad) for _, user, ad in batch)
        for (user, ad), n in counts.items():
            if totals[user, ad] > threshold:
                flags.setdefault(user, bucket)
            totals[user, ad] += n
    return kept, flags


def test_guard_equals_batchwise_rule_with_a_hot_user(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(12), rng.choice("aaaaabcdefgh"), rng.choice("xyz")) for _ in range(400)]
    frame = op.click_buckets(parsed(spark, [(b * 60, u, a) for b, u, a in rows]), 60)
    base = int((START - datetime(1970, 1, 1)).total_seconds()) // 60
    for threshold in (0, 3, 8, 1000):
        kept, flags = brute_guard(rows, threshold)
        got = {r.user_id: r.flag_bucket - base for r in op.flagged_users(frame, threshold).collect()}
        assert got == flags
        left = op.click_guard(frame, threshold).collect()
        assert Counter((r.bucket - base, r.user_id, r.ads_id) for r in left) == Counter(kept)


def test_totals_restart_each_day(spark):
    rows = [(d * 86400 + i * 60, "u", "x") for d in range(3) for i in range(2)]
    assert op.flagged_users(op.click_buckets(parsed(spark, rows), 60), 1).count() == 0
    assert op.flagged_users(op.click_buckets(parsed(spark, rows), 60), 0).count() == 1


def test_listed_users_are_dropped(spark):
    frame = parsed(spark, [(0, "a", "x"), (1, "b", "x")])
    listed = spark.createDataFrame([("a",)], "user_id STRING")
    assert [r.user_id for r in op.drop_users(frame, listed).collect()] == ["b"]


def test_area_top_is_ranked_json(spark):
    rows = [(i, "u", ad, "north", city) for ad, city, n in
            (("1", "york", 2), ("1", "leeds", 3), ("2", "york", 8), ("3", "york", 5), ("4", "york", 1)) for i in range(n)]
    rows += [(86400, "u", "9", "south", "bath")]
    counts = op.area_city_ads_day_count(parsed(spark, rows))
    got = {(r.day, r.area): r.top_ads for r in op.area_ads_top(counts).collect()}
    assert got == {
        ("2024-01-01", "north"): '[{"2":8},{"1":5},{"3":5}]',
        ("2024-01-02", "south"): '[{"9":1}]',
    }


def test_last_hour_is_half_open_and_in_time_order(spark):
    rows = [(0, "u", "x"), (1, "u", "x"), (3599, "u", "x"), (3600, "u", "x"), (3601, "u", "x"), (60, "u", "y")]
    got = op.last_hour_minutes(parsed(spark, rows), datetime(2024, 1, 1, 11, 0, 0)).collect()
    assert {r.ads_id: r.minute_counts for r in got} == {
        "x": '[{"10:00":2},{"10:59":1}]', "y": '[{"10:01":1}]',
    }
    # the window moves every ten seconds, and counts by arrival where that is another time
    later = op.last_hour_minutes(parsed(spark, rows), datetime(2024, 1, 1, 11, 0, 19)).collect()
    assert {r.ads_id: r.minute_counts for r in later}["x"] == '[{"10:59":1},{"11:00":2}]'
    arrived = parsed(spark, rows).withColumn("at", F.lit(datetime(2024, 1, 3)))
    got = op.last_hour_minutes(arrived, datetime(2024, 1, 3, 0, 0, 10), arrival="at").collect()
    assert {r.ads_id: r.minute_counts for r in got}["x"] == '[{"10:00":2},{"10:59":1},{"11:00":2}]'


def test_epochs_out_of_range_are_rejected_and_kill_nothing(spark):
    bad = ["99999999999999999 n c 1 2", "9223372036854775807 n c 1 2", "-1 n c 1 2", "253402300800000 n c 1 2", "1.5 n c 1 2"]
    good = ["0 n c 1 2", "253402300799999 n c 1 2"]
    lines = spark.createDataFrame([(x,) for x in bad + good], "value STRING")
    assert sorted(r.value for r in op.ads_log_rejects(lines).collect()) == sorted(bad)
    days = [r.d for r in op.parse_ads_log(lines).select(F.date_format("ts", "yyyy-MM-dd").alias("d")).collect()]
    assert sorted(days) == ["1970-01-01", "9999-12-31"]


def test_a_hot_user_is_dealt_over_many_tasks(spark):
    rows = [(i, "hot", str(i % 5)) for i in range(3000)] + [(i, f"u{i % 300}", "x") for i in range(900)]
    bucketed = op.click_buckets(parsed(spark, rows), 100)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        listed = spark.createDataFrame([("u1",)], "user_id STRING")
        for kept in (op.click_guard(bucketed, 200), op.drop_users(bucketed, listed)):
            parts = kept.where("user_id = 'hot'").groupBy(F.spark_partition_id()).count().collect()
            assert len(parts) >= 8
        counts = {r.user_id: r.click_count for r in op.guarded_day_counts(bucketed, ["user_id"], 200).collect()}
        plain = {r.user_id: r.n for r in op.click_guard(bucketed, 200).groupBy("user_id").agg(F.count("*").alias("n")).collect()}
        assert counts == plain and counts["hot"] < 3000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
