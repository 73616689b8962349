"""Mixing of sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong to. Words flow
from patterns to source quotas; the second and third pass over a pattern cost more than the
first, so that repeats are spread evenly. Only patterns and sources pass through the driver.
Which documents make up a pattern's share is drawn by a seeded hash of their keys.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktrail.sources.shared import stash

LEAST = -(1 << 63)     # no hash lies below
MAX_PATTERNS = 4096   # flow network and its broadcast are at most so large; beyond, an error
SLICES = 4096         # slices of the hash range in which a pattern's words are summed
FITTED = 64           # documents of them whose best sum is searched
ZONE = 1000           # documents around a share's end among which the rest is fitted


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def weighted_targets(sizes: dict[str | None, int], weights: Sequence[int] = (1, 2, 3),
                     limit: int = 3) -> dict[str | None, float]:
    """Share of all words per source.

    Sources in code point order (null last) take ``weights`` in turn. A share stops at
    ``limit`` times its source's size; the excess goes to the others by weight.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, free, out = float(sum(sizes.values())), list(names), {}
    while free:
        total = sum(weight[s] for s in free)
        share = {s: rest * weight[s] / total for s in free}
        full = [s for s in free if share[s] > limit * sizes[s]]
        if not full:
            out |= share
            break
        for s in full:
            out[s] = float(limit * sizes[s])
            rest -= out[s]
            free.remove(s)
    return out


def route(patterns: dict[tuple, int], quotas: dict, epochs: int = 3) -> dict[tuple, int]:
    """Words to take of each pattern, by successive cheapest paths.

    An arc from the origin to a pattern exists for every pass over it, with the pattern's
    size as capacity and the square of the pass as cost; arcs to the pattern's sources are
    free and sources drain into their quotas. Costs are convex, so passes fill in order.
    """
    left = {s: max(0, round(q)) for s, q in quotas.items()}
    taken = dict.fromkeys(patterns, 0)
    given: dict[tuple, dict] = {p: {} for p in patterns}
    users: dict = {}
    for p in patterns:
        for s in p:
            users.setdefault(s, []).append(p)

    def step(p):
        done = taken[p] // patterns[p] if patterns[p] else epochs
        return (done + 1) ** 2, (done + 1) * patterns[p] - taken[p], done < epochs

    for wanted in sorted(left, key=lambda s: (s is None, str(s))):
        while left[wanted] > 0:
            # cheapest pattern that can give to the source, possibly by another giving way
            best, heap, seen, back = None, [(0, 0, wanted)], set(), {}
            ticket = 1
            while heap and best is None:
                cost, _, s = heapq.heappop(heap)
                if isinstance(s, tuple) and s and s[0] == "from":
                    best = s
                    break
                if s in seen:
                    continue
                seen.add(s)
                for p in users.get(s, ()):
                    price, _, open_ = step(p)
                    if open_:
                        heapq.heappush(heap, (cost + price, ticket, ("from", p, s)))
                        ticket += 1
                    for other, amount in given[p].items():
                        if amount and other not in seen:
                            if other not in back:
                                back[other] = (p, s)
                            heapq.heappush(heap, (cost, ticket, other))
                            ticket += 1
            if best is None:
                break
            _, p, s = best
            amount, hops, at = min(step(p)[1], left[wanted]), [], s
            while at != wanted:
                q, onto = back[at]
                hops.append((q, at, onto))
                amount, at = min(amount, given[q][at]), onto
            taken[p] += amount
            given[p][s] = given[p].get(s, 0) + amount
            for q, off, onto in hops:
                given[q][off] -= amount
                given[q][onto] = given[q].get(onto, 0) + amount
            left[wanted] -= amount
    return taken


def mix_sources(docs: DataFrame, size: Column, sources: Column,
                targets: Callable[[dict[str | None, int]], dict[str | None, float]] = weighted_targets,
                keys: Sequence[str] = ("doc_id",), epochs: int = 3, seed: int = 42) -> DataFrame:
    """Choose how often each document enters the mix.

    ``size`` gives a document's words, ``sources`` an array of the sources it belongs to (a
    null element is a source of its own; an empty array belongs to none and is not taken).
    ``targets`` maps source sizes to wanted words. Returns (``row`` the document, ``size``,
    ``pattern`` JSON of its sources, ``source_size`` and ``target`` of its first source,
    ``taken``); ``taken`` is 0 to ``epochs`` times the size, whole documents only.

    Null keys hash like any other value. Equal rows are drawn together. Empty documents take
    nothing. An empty table gives an empty result. Extra columns stay inside ``row``.
    """
    spark = docs.sparkSession
    spread = F.xxhash64(F.lit(seed), *[F.col(k) for k in keys], F.lit(0), size)
    rows = docs.select(
        F.struct("*").alias("row"), size.alias("size"),
        F.to_json(F.array_sort(sources)).alias("pattern"), spread.alias("spread"),
    ).withColumn("slice", F.shiftrightunsigned("spread", 64 - (SLICES.bit_length() - 1)))
    slices = stash(rows.groupBy("pattern", "slice").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("size").alias("words")), "slices")

    totals = slices.groupBy("pattern").agg(F.sum("words").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {r.pattern: r.words for r in totals}
    members = {p: tuple(json.loads(p)) for p in patterns}
    sizes: dict[str | None, int] = {}
    for p, words in patterns.items():
        for s in members[p]:
            sizes[s] = sizes.get(s, 0) + words
    wanted = targets(sizes)
    flow = route({members[p]: w for p, w in patterns.items()}, wanted, epochs)
    plan = []
    for p, words in patterns.items():
        whole, rest = divmod(flow[members[p]], words) if words else (0, 0)
        first = members[p][0] if members[p] else None
        plan.append((p, whole, rest, sizes.get(first, 0), float(wanted.get(first, 0.0))))
    plan_df = spark.createDataFrame(plan, "pattern string, whole long, rest long, source_size long, target double")

    zones = stash(slices.join(F.broadcast(plan_df), "pattern").groupBy("pattern").applyInPandas(
        _zone, "pattern string, low int, high int, rest long"), "zones")
    drawn = (
        rows.join(F.broadcast(zones), "pattern").where("slice between low and high")
        .groupBy("pattern", "rest", "spread").agg(F.sum("size").alias("size"))
        .groupBy("pattern").applyInPandas(_fit, "pattern string, below long, chosen array<long>")
    )
    # one row per pattern with at most FITTED documents: bounded by MAX_PATTERNS
    shares = plan_df.drop("rest").join(zones.drop("rest"), "pattern", "left").join(drawn, "pattern", "left")
    shares = spark.createDataFrame(shares.collect(), shares.schema)
    again = F.when(F.col("slice") < F.col("low"), 1).when(
        (F.col("slice") <= F.col("high")) & ((F.col("spread") < F.col("below")) | F.array_contains("chosen", F.col("spread"))), 1).otherwise(0)
    return rows.join(F.broadcast(shares), "pattern", "left").select(
        "row", "size", "pattern", "source_size", "target",
        F.coalesce(F.col("size") * (F.col("whole") + again), F.lit(0)).cast("long").alias("taken"))


def _zone(pdf: pd.DataFrame) -> pd.DataFrame:
    """Slices taken whole lie below ``low``; documents of ``low`` to ``high`` are fitted.

    The range holds the slice in which the share ends, at least half of :data:`FITTED`
    documents before it and :data:`ZONE` from it on, as far as there are so many.
    """
    pdf = pdf.sort_values("slice")
    slices, docs, words = (pdf[c].astype(int).tolist() for c in ("slice", "docs", "words"))
    rest, at = int(pdf["rest"].iloc[0]), 0
    while at < len(slices) and words[at] <= rest:
        rest -= words[at]
        at += 1
    low = high = at
    held = 0
    while low and held < FITTED // 2:
        low -= 1
        held += docs[low]
        rest += words[low]
    held = 0
    while high < len(slices) and held < ZONE:
        held += docs[high]
        high += 1
    return pd.DataFrame({"pattern": [pdf["pattern"].iloc[0]], "low": [slices[low]],
                         "high": [slices[high - 1]], "rest": [rest]})


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Documents in order of their hash up to what is left, the last ones fitted to it.

    Those before are told by the hash that they lie ``below``, only fitted ones are listed.
    """
    pattern, rest = pdf["pattern"].iloc[0], int(pdf["rest"].iloc[0])
    pdf = pdf[pdf["size"] > 0].sort_values("spread")
    sizes = pdf["size"].tolist()
    end = held = 0
    while end < len(sizes) and held + sizes[end] <= rest:
        held += sizes[end]
        end += 1
    begin = max(0, end - FITTED // 2)
    pool = sizes[begin:begin + FITTED]
    picked = _closest(pool, rest - sum(sizes[:begin]))
    spreads = pdf["spread"].tolist()
    below = spreads[begin] if begin < len(spreads) else spreads[-1] + 1 if spreads else LEAST
    return pd.DataFrame({"pattern": [pattern], "below": [below], "chosen": [[spreads[begin + i] for i in picked]]})


def _closest(sizes: list[int], room: int) -> list[int]:
    """Numbers of the sizes whose sum comes closest to ``room`` from below.

    Bit n of a reach says whether sums of n exist. Rooms of more than 2**24 are filled in order.
    """
    if room >= 1 << 24:
        picked = []
        for i, size in enumerate(sizes):
            if size <= room:
                picked.append(i)
                room -= size
        return picked
    reach, every = [1], (1 << (room + 1)) - 1
    for size in sizes:
        reach.append((reach[-1] | reach[-1] << size) & every if size <= room else reach[-1])
    at, picked = reach[-1].bit_length() - 1, []
    for i in range(len(sizes) - 1, -1, -1):
        if not reach[i] >> at & 1:
            picked.append(i)
            at -= sizes[i]
    return picked[::-1]
