import random
from collections import Counter

import pytest

from clicktrail import operators as op
from clicktrail.operators.visits import in_slices, with_order
from tests.rows import visits


def brute(rows, flow):
    """Jumps and ratios by walking every session in order."""
    sessions = {}
    for i, row in enumerate(rows):
        sessions.setdefault(row.get("session_id", "s"), []).append((row["at"], i, row["page_id"]))
    seen, jumps = Counter(r["page_id"] for r in rows), Counter()
    for steps in sessions.values():
        pages = [p for _, _, p in sorted(steps)]
        jumps.update(zip(pages, pages[1:]))
    out = {}
    for a, b in zip(flow, flow[1:]):
        if jumps[a, b]:
            out[f"{a}-{b}"] = (jumps[a, b], seen[a], int(jumps[a, b] / seen[a] * 1000 + 0.5) / 10.0)
    return out


def run(spark, rows, flow, **kw):
    return {r.page_flow: tuple(r)[1:] for r in op.page_conversion(visits(spark, rows), flow, **kw).collect()}


def test_jumps_over_other_pages_do_not_count(spark):
    rows = [{"at": i, "page_id": p} for i, p in enumerate((1, 5, 2, 3, 1, 2))]
    assert run(spark, rows, [1, 2, 3]) == {"1-2": (1, 2, 50.0), "2-3": (1, 2, 50.0)}


@pytest.mark.parametrize("seconds", [1, 7, 300, 10**6])
def test_slices_do_not_change_the_result(spark, seconds):
    rng = random.Random(5)
    rows = [
        # one session holds most of the log; times tie often
        {"session_id": rng.choice(["hot"] * 4 + ["a", "b", "c"]), "at": rng.randrange(900), "page_id": rng.randint(1, 4)}
        for _ in range(1500)
    ]
    flow = [1, 2, 3, 4, 1, 2]
    assert run(spark, rows, flow, slice_seconds=seconds) == brute(rows, flow)


@pytest.fixture
def many_parts(spark):
    """Small partitions are left apart, as large ones would be."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


def hot_minute(seed):
    rng = random.Random(seed)
    return [
        # one session's minute, and in it one second, hold most of the log
        {"session_id": rng.choice(["hot"] * 6 + ["a", "b"]), "at": rng.choice([30] * 4 + [*range(60)]), "page_id": rng.randint(1, 4)}
        for _ in range(3000)
    ]


def test_a_hot_minute_is_many_pieces_by_range(spark, many_parts):
    rows, flow = hot_minute(6), [1, 2, 3, 4, 1, 2]
    pieces = in_slices(with_order(visits(spark, rows)), 60, by_range=True).groupBy("session_id", "slice").count()
    most = max(r["count"] for r in pieces.collect())
    assert most < len(rows) * 0.4 and pieces.where("session_id = 'hot'").count() >= 3
    assert run(spark, rows, flow, by_range=True) == brute(rows, flow)
    every = in_slices(with_order(visits(spark, rows)), 60, by_range=False).groupBy("session_id", "slice").count()
    assert max(r["count"] for r in every.collect()) > len(rows) * 0.7


def test_prefix_visits_are_never_fewer_than_jumps(spark):
    rows = [{"at": i, "page_id": i % 3 + 1} for i in range(20)]
    assert all(visited >= jumped for jumped, visited, _ in run(spark, rows, [1, 2, 3]).values())


def test_short_flow_is_refused(spark):
    with pytest.raises(ValueError):
        op.page_conversion(visits(spark, []), [1])


def test_empty_log(spark):
    assert run(spark, [], [1, 2]) == {}
