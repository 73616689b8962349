from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from clicktrail import operators as op
from clicktrail.operators.sessions import hour_quotas
from clicktrail.params import VisitCondition
from tests.rows import visits


def test_thresholds_are_exclusive(spark):
    rows = [{"session_id": "short", "at": t} for t in (0, 10)]            # 10000 ms, 2 steps
    rows += [{"session_id": "long", "at": t} for t in (0, 11)]            # 11000 ms, 2 steps
    rows += [{"session_id": "five", "at": t} for t in range(5)]
    rows += [{"session_id": "six", "at": t} for t in range(6)]
    got = op.session_stats(visits(spark, rows)).first()
    assert tuple(got) == (4, 75.0, 25.0, 75.0, 25.0)


def test_empty_log_gives_one_row_of_zeros(spark):
    assert tuple(op.session_stats(visits(spark, [])).first()) == (0, 0.0, 0.0, 0.0, 0.0)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 30)), min_size=1, max_size=40))
def test_ratio_pairs_add_up(spark, pairs):
    got = op.session_stats(visits(spark, [{"session_id": f"s{s}", "at": t} for s, t in pairs])).first()
    assert got.session_count == len({s for s, _ in pairs})
    assert abs(got.visit_length_le_ratio + got.visit_length_gt_ratio - 100) <= 0.0101
    assert abs(got.step_length_le_ratio + got.step_length_gt_ratio - 100) <= 0.0101


def test_summary_orders_lists_and_takes_first_kind(spark):
    log = visits(spark, [
        {"at": 900, "search_keyword": "late"},
        {"at": 5, "search_keyword": "kw", "click_product_id": 9},   # counts as a search
        {"at": 5, "search_keyword": ""},                            # ties by row, empty item kept
        {"at": 7, "click_product_id": 3, "order_product_ids": "1,2"},
        {"at": 6, "click_product_id": 4},
        {"at": 8, "order_product_ids": "5,6", "pay_product_ids": "7"},
        {"at": 700, "order_product_ids": "8"},
        {"at": 8, "pay_product_ids": "7"},
        {"at": 9, "click_product_id": None},                        # no action
    ])
    for seconds in (1, 300, 10**6):
        got = op.session_summary(log, seconds).first()
        assert tuple(got) == (
            "s", "2024-01-01 10:00:05", 9, 895000, "kw,,late", "4,3", "5,6,8", "7",
        )


def test_summary_without_actions_has_empty_texts(spark):
    got = op.session_summary(visits(spark, [{}])).first()
    assert tuple(got)[2:] == (1, 0, "", "", "", "")


def test_log_without_row_id_is_accepted(spark):
    log = visits(spark, [{"at": i, "page_id": i % 2 + 1} for i in range(4)]).drop("row_id")
    assert op.page_conversion(log, [1, 2]).first().jump_count == 2


def test_sample_follows_quotas_with_a_hot_hour(spark):
    hours = {0: 300, 1: 60, 2: 3, 3: 1}
    rows = [
        {"session_id": f"h{h}-{i}", "at": h * 3600 + j}
        for h, n in hours.items() for i in range(n) for j in range(2)
    ]
    log = visits(spark, rows)
    total, n = sum(hours.values()), 50
    want = {h: min(c, int(c / total * n + 0.5)) for h, c in hours.items()}
    starts = op.session_spans(log)
    quotas = {r.day_hour[-2:]: r.quota for r in hour_quotas(starts, n).collect()}
    assert quotas == {f"{10 + h}": q for h, q in want.items()}

    got = op.session_hourly_sample(log, n, seed=3).collect()
    ids = [r.session_id for r in got]
    assert len(ids) == len(set(ids))
    per_hour = {h: sum(i.startswith(f"h{h}-") for i in ids) for h in hours}
    assert per_hour == want
    assert {r.session_id for r in op.session_hourly_sample(log, n, seed=3).collect()} == set(ids)
    assert {r.session_id for r in op.session_hourly_sample(log, n, seed=4).collect()} != set(ids)


def test_sample_larger_than_the_log_takes_all(spark):
    log = visits(spark, [{"session_id": f"s{i}", "at": i} for i in range(7)] + [{"session_id": None}])
    assert op.session_hourly_sample(log, 1000).count() == 8


def test_filter_bounds_are_inclusive_and_optional(spark):
    log = visits(spark, [{"user_id": u, "at": d * 86400} for u in (1, 2, 3) for d in (0, 1, 2)])
    users = spark.createDataFrame(
        [(1, 20, "a"), (2, 30, "b"), (2, 30, "b"), (3, 40, "c")],
        "user_id BIGINT, age INT, professional STRING",
    )
    kept = lambda **kw: op.filter_visits(log, users, VisitCondition(**kw)).count()
    assert kept() == 12                                     # a user listed twice counts twice
    assert kept(start_date="2024-01-02") == 8
    assert kept(end_date="2024-01-01") == 4
    assert kept(start_age=20, end_age=20) == 3
    assert kept(start_age=30) == 9
    assert kept(professionals=("a", "c")) == 6
    assert op.filter_visits(log, users, VisitCondition()).columns == log.columns


def test_summaries_by_range_are_those_by_time(spark):
    from tests.test_pages import hot_minute

    rows = [{**r, "click_product_id": i} for i, r in enumerate(hot_minute(7))]
    log = visits(spark, rows)
    by_time = sorted(map(str, op.session_summary(log).collect()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(map(str, op.session_summary(log, by_range=True).collect())) == by_time
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
