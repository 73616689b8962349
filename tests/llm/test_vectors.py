import math

import numpy as np
import pytest

from clicktrail.llm import cover_tree, posting_lists

SCHEMA = "vec_id long, embedding array<float>, label int, node string, path string, v string, list int, n long"
NAN = float("nan")
ODD = [(5000, None, 1), (5001, [0.0] * 6, 1), (5002, [1.0, None, 0, 0, 0, 0.0], 1), (5003, [NAN, 1, 0, 0, 0, 0.0], 1),
       (5004, [math.inf, 1, 0, 0, 0, 0.0], 1), (5005, [], 1), (None, [1.0, 0, 0, 0, 0, 0], 1), (5100, [1.0, 0, 0], 1), (5101, [1.0, 0, 0], 1)]


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "odd", "odd", "odd", 1, 9)
                                  for i, v, label in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out, at = [], 0
    for label in (0, 1, None):
        for _ in range(25):
            center = rng.normal(size=6)
            for _ in range(rng.integers(1, 9)):
                out.append((at, np.float32(center + rng.normal(size=6) * 0.12).tolist(), label))
                at += 1
    tight = rng.normal(size=6)
    out += [(at + i, np.float32(tight + rng.normal(size=6) * 0.02).tolist(), 1) for i in range(120)]   # linked as a whole
    out += [(2000 + i, out[3][1], 0) for i in range(20)] + [(2000, out[3][1], 0)]                      # copies, one row twice
    out += [(3000, (2 * np.array(out[3][1])).tolist(), 0)]                                              # same direction
    return out


def plain_links(rows, threshold=0.93):
    ok = [i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v, label in rows]
    counts, part = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            (_, v, p), (_, w, q) = rows[a], rows[b]
            if ok[a] and ok[b] and p == q and len(v) == len(w):
                v, w = np.array(v), np.array(w)
                if v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= threshold:
                    counts[a] += 1
                    counts[b] += 1
                    part[find(a)] = find(b)
    least = {}
    for i, (vec, _, _) in enumerate(rows):
        if vec is not None:
            least[find(i)] = min(least.get(find(i), vec), vec)
    return sorted(((r[0] if r[0] is not None else -1), n, least.get(find(i), -1)) for i, (r, n) in enumerate(zip(rows, counts)))


@pytest.mark.parametrize("leaf,block", [(1024, 48), (24, 8)])
def test_links_equal_brute_force(spark, rows, monkeypatch, leaf, block):
    monkeypatch.setattr(cover_tree, "LEAF", leaf)
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    every = rows + ODD
    got = cover_tree.near_duplicates(frame(spark, every)).collect()
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1) for r in got) == plain_links(every)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_no_vectors(spark):
    assert cover_tree.near_duplicates(frame(spark, [])).collect() == []
    assert posting_lists.nearest(frame(spark, [])).collect() == []
    assert cover_tree.near_duplicates(frame(spark, ODD[:5])).count() == 5
    assert posting_lists.nearest(frame(spark, ODD[:5]), every=1).collect() == []


def plain_nearest(rows, every, k):
    held = {(i, tuple(v)) for i, v, _ in rows if i is not None and v and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in held:
        if i % every == 0:
            near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in held if j != i)
            out[i] = near[:k]
    return out


def test_recall_exact_scores_and_order(spark, rows, monkeypatch):
    monkeypatch.setattr(posting_lists, "PER_CENTROID", 16)
    monkeypatch.setattr(posting_lists, "PART", 10)
    monkeypatch.setattr(posting_lists, "QUERY_PART", 3)
    want, got, hit = plain_nearest(rows + ODD, 10, 10), {}, 0
    for r in posting_lists.nearest(frame(spark, rows + ODD), every=10, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert [rank for rank, _, _ in found] == list(range(1, 11))
        assert [x[1:] for x in found] == sorted(x[1:] for x in found)
        hit += len({v for _, _, v in found} & {v for _, v in want[q]})
    assert hit / (10 * len(want)) >= 0.9


def test_fewer_candidates_than_asked_for(spark, rows):
    few = rows[:7]
    got = posting_lists.nearest(frame(spark, few), every=5, k=10).collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(q, v) for q in (0, 5) for v in range(7) if q != v}


def test_repeated_rows_take_no_neighbours_place(spark):
    rng = np.random.default_rng(8)
    rows = [(i, np.float32(rng.normal(size=6)).tolist(), 0) for i in range(60)]
    rows += [(61, np.float32(np.array(rows[0][1]) + 0.01).tolist(), 0)] * 10 + [rows[0]] * 10
    want, got = plain_nearest(rows, 20, 10), {}
    for r in posting_lists.nearest(frame(spark, rows), every=20, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got == want


def test_scaled_copies_of_one_direction_end(spark):
    """3,000 vectors of one direction, which no choice of centres parts, with others about."""
    rng = np.random.default_rng(9)
    one, other = rng.normal(size=8), rng.normal(size=8)
    rows = [(i, (one * f).tolist(), 1) for i, f in enumerate(rng.uniform(0.5, 2, 3000))]
    rows += [(3000 + i, (other + 0.01 * rng.normal(size=8)).tolist(), 1) for i in range(5)] + [(4000, one.tolist(), 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {(r.vec_id, r.n_links, r.component_id) for r in cover_tree.near_duplicates(vectors).collect()}
    assert got == {(i, 3000, 0) for i in [*range(3000), 4000]} | {(3000 + i, 4, 3000) for i in range(5)}


def test_centres_are_nested_apart_and_cover():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(400, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    chosen, near = cover_tree._net(x, 400)
    gaps = np.linalg.norm(x[:, None] - x[chosen][None], axis=2)
    level = 1.0     # the next power of two below the furthest row
    assert chosen[0] == 0 and 1 < gaps[:, 0].max() <= 2
    assert gaps.min(axis=1).max() <= level
    between = gaps[chosen] + 9 * np.eye(len(chosen))
    assert between.min() > level
    assert (gaps[np.arange(len(x)), near] <= gaps.min(axis=1) + 1e-12).all()
    search = cover_tree._DualTraversal(x, np.ones(400, np.int64), 0.93, 0.37)
    waiting = [search.tree(np.arange(400))]
    while waiting:
        node = waiting.pop()
        assert np.linalg.norm(search.unit[node["rows"]] - node["center"], axis=1).max() <= node["radius"]
        if node["below"]:
            assert sorted(np.concatenate([c["rows"] for c in node["below"]])) == sorted(node["rows"])
            assert node["below"][0]["rows"][0] == node["rows"][0]
            waiting += node["below"]


def test_vectors_of_several_lengths_split_together(spark, monkeypatch):
    """Two lengths and a large group of near copies, in one label, all split in tables."""
    monkeypatch.setattr(cover_tree, "LEAF", 20)
    rng = np.random.default_rng(11)
    near = rng.normal(size=5)
    rows = [(i, (near + 0.01 * rng.normal(size=5)).tolist(), 1) for i in range(150)]
    rows += [(200 + i, rng.normal(size=5).tolist(), 1) for i in range(60)]
    rows += [(300 + i, rng.normal(size=3).tolist(), 1) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in cover_tree.near_duplicates(vectors).collect())
    assert got == plain_links(rows)
