from clicktrail import operators as op
from tests.rows import visits


def test_counts_take_the_first_kind_and_skip_blank_parts(spark):
    log = visits(spark, [
        {"click_category_id": 1, "order_category_ids": "2"},
        {"order_category_ids": "1,2,,", "pay_category_ids": "9"},
        {"pay_category_ids": "2"},
        {"order_category_ids": ""},
        {"click_category_id": None, "pay_category_ids": "3,3"},
        {},
    ])
    got = {r.category_id: tuple(r)[1:] for r in op.category_counts(log).collect()}
    assert got == {"1": (1, 1, 0), "2": (0, 1, 1), "3": (0, 0, 2)}


def test_top_order_and_ties(spark):
    rows = [{"click_category_id": c} for c in (5, 5, 6, 6, 7, 8)]
    rows += [{"order_category_ids": "6"}, {"pay_category_ids": "8"}]
    got = [r.category_id for r in op.category_top(visits(spark, rows), 4).collect()]
    assert got == ["6", "5", "8", "7"]
    assert [r.category_id for r in op.category_top(visits(spark, rows), 1).collect()] == ["6"]


def test_session_top_with_a_hot_category(spark):
    rows = [{"session_id": f"s{s:02d}", "click_category_id": 1} for s in range(15) for _ in range(s % 4 + 1)]
    rows += [{"session_id": "x", "click_category_id": 2}] * 3 + [{"session_id": "y"}]
    log = visits(spark, rows)
    got = op.category_session_top(log, op.category_top(log), 3).collect()
    assert sorted((r.category_id, r.session_id, r.click_count) for r in got) == [
        ("1", "s03", 4), ("1", "s07", 4), ("1", "s11", 4), ("2", "x", 3),
    ]


def test_only_given_categories_are_ranked(spark):
    log = visits(spark, [{"click_category_id": c} for c in (1, 1, 2)])
    got = op.category_session_top(log, op.category_top(log, 1)).collect()
    assert [r.category_id for r in got] == ["1"]
