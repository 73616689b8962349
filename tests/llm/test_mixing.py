import itertools
import random

from pyspark.sql import functions as F

from clicktrail.llm import mixing


def test_targets_share_all_words_and_stop_at_the_limit():
    got = mixing.weighted_targets({"b": 100, "a": 1000, None: 10, "c": 0})
    assert got["c"] == 0 and got[None] == 30 and got["b"] == 300
    assert abs(sum(got.values()) - 1110) < 1e-9
    assert mixing.weighted_targets({}) == {}


def cost(patterns, taken, epochs=3):
    total = 0
    for p, size in patterns.items():
        for e in range(epochs):
            total += max(0, min(taken[p] - e * size, size)) * (e + 1) ** 2
    return total


def test_flow_is_cheapest():
    rng = random.Random(3)
    for _ in range(30):
        sources = "xyz"[:rng.randint(2, 3)]
        patterns = {tuple(sorted(rng.sample(sources, rng.randint(1, len(sources))))): rng.randint(1, 4) for _ in range(3)}
        quotas = {s: rng.randint(0, 6) for s in sources}
        taken = mixing.route(patterns, quotas)
        best = None
        for amounts in itertools.product(*(range(3 * w + 1) for w in patterns.values())):
            chosen = dict(zip(patterns, amounts))
            filled = most_filled(chosen, quotas)
            if filled == sum(amounts):
                rank = (-filled, cost(patterns, chosen))
                best = rank if best is None or rank < best else best
        assert (-sum(taken.values()), cost(patterns, taken)) == best


def most_filled(chosen, quotas):
    """Words of the patterns that find room in their sources' quotas, by Hall's condition."""
    sources = list(quotas)
    return min(sum(quotas[s] for s in part) + sum(a for p, a in chosen.items() if not set(p) <= set(part))
               for n in range(len(sources) + 1) for part in itertools.combinations(sources, n))


def test_mix_of_odd_documents(docs_frame, odd_docs):
    size = mixing.word_count(F.col("text"))
    mixed = mixing.mix_sources(docs_frame, size, F.array("source"))
    rows = mixed.collect()
    assert len(rows) == len(odd_docs)
    plain = {}
    for i, t, s in odd_docs:
        plain[s] = plain.get(s, 0) + len((t or "").replace("\x0b", " ").split())
    want = mixing.weighted_targets(plain)
    for s in plain:
        own = [r for r in rows if r.row.source == s]
        assert {(r.source_size, r.target) for r in own} == {(plain[s], want[s])}
        assert all(r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in own)
        assert want[s] - 1 - max((r["size"] for r in own), default=0) <= sum(r.taken for r in own) <= want[s] + 1
    again = mixing.mix_sources(docs_frame.repartition(7), size, F.array("source")).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_documents_of_several_sources(spark):
    rows = [(i, 10, ["a", "b"] if i % 2 else ["a"]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, n int, s array<string>")
    got = mixing.mix_sources(docs, F.col("n"), F.col("s"), lambda sizes: {"a": 900, "b": 600}).collect()
    assert sum(r.taken for r in got) == 1500
    assert sum(r.taken for r in got if r.row.s == ["a", "b"]) >= 600


def test_no_documents(no_docs):
    assert mixing.mix_sources(no_docs, F.col("size"), F.array("source")).collect() == []


def test_closest_sum():
    assert sum([5, 9, 20, 4][i] for i in mixing._closest([5, 9, 20, 4], 15)) == 14
    assert mixing._closest([], 5) == [] and mixing._closest([3], 2) == []
