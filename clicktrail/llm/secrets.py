r"""Secret scans by DataFrame functions only.

Fixed patterns find assignments, access keys and hex runs. Next to them, candidate strings of
a character class are scanned with a sliding window whose Shannon entropy is kept by
incremental counts: a step adds one character, takes one away and changes the sum of
``n log n`` by the two terms concerned. Allow-listed candidates are suppressed. Everything is
computed within the row, so no text is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktrail.llm.columns import running_starts

# fixed values: base patterns, with what a match must satisfy
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_CHARS = 8


@dataclass(frozen=True)
class EntropyClass:
    """Runs of ``chars`` (ASCII) count as secret where ``window`` characters hold ``bits`` each."""

    kind: str
    chars: str
    window: int
    bits: float


CLASSES = (
    EntropyClass("entropy_hex", "[0-9a-fA-F]", 20, 3.0),
    EntropyClass("entropy_base64", "[A-Za-z0-9+/=_-]", 20, 3.8),
)

# Candidates that are no secrets whatever their entropy. A pattern must not repeat a group: Java's
# matcher recurses once per repetition, and a long candidate would end the process.
ALLOW = (
    r"^[A-Za-z]+$", r"^[0-9]+$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z_/=+-]+$",
    r"(?i)example|placeholder|0123456789|abcdefghij",
)


def scan_secrets(docs: DataFrame, classes: Sequence[EntropyClass] = CLASSES, allow: Sequence[str] = ALLOW) -> DataFrame:
    """Adds ``secrets`` to (``row`` the document): spans sorted by start, then kind as listed.

    A span is a struct of ``start``, ``kind_no``, ``end`` (code points, exclusive) and
    ``kind``. Kinds 1 to 3 are assign, access and hex, leftmost without overlap; the entropy
    classes follow. An entropy span reaches from the first to the last window of a candidate
    over the threshold; candidates matching a pattern of ``allow`` have none. A null text is
    empty and has no spans. Rows are independent of each other: repeats, ties and empty tables
    need no rule. Other columns stay inside ``row``. A very long text is one row's work, in time
    and memory in proportion to its length; no pattern recurses along it.
    """
    text = F.coalesce("text", F.lit(""))
    base = [
        _spans(text, ASSIGN, 1, "assign", lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 1)) >= ASSIGN_CHARS),
        _spans(text, ACCESS, 2, "access"),
        _spans(text, HEX, 3, "hex"),
    ]
    more = [_entropy_spans(text, c, 4 + i, allow) for i, c in enumerate(classes)]
    return docs.select(F.struct("*").alias("row"), F.array_sort(F.concat(*base, *more)).alias("secrets"))


def digest_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _hits(text: Column, pattern: str) -> Column:
    """Matches with their start: what lies between them adds up to where they are.

    Most texts have no match, and one search tells; only others are cut up.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(hits)), hits, lambda gap, hit: F.struct(
        F.length(gap).alias("gap"), hit.alias("hit")))

    def placed(steps: Column) -> Column:
        starts = running_starts(F.transform(steps, lambda s: s["gap"] + F.length(s["hit"])))
        return F.zip_with(steps, starts, lambda s, at: F.struct((at + s["gap"]).alias("start"), s["hit"].alias("hit")))

    # the one-element array names the steps, so that the text is cut up once
    found = F.flatten(F.transform(F.array(steps), placed))
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.array().cast("array<struct<start: bigint, hit: string>>"))


def _span(start: Column, end: Column, kind_no: int, kind: str) -> Column:
    return F.struct(start.cast("long").alias("start"), F.lit(kind_no).alias("kind_no"),
                    end.cast("long").alias("end"), F.lit(kind).alias("kind"))


def _spans(text: Column, pattern: str, kind_no: int, kind: str, valid=None) -> Column:
    hits = _hits(text, pattern)
    if valid is not None:
        hits = F.filter(hits, lambda h: valid(h["hit"]))
    return F.transform(hits, lambda h: _span(h["start"], h["start"] + F.length(h["hit"]), kind_no, kind))


def _entropy_spans(text: Column, cls: EntropyClass, kind_no: int, allow: Sequence[str]) -> Column:
    pattern = f"{cls.chars}{{{cls.window},}}"
    candidates = F.filter(_hits(text, pattern), lambda h: ~_any_match(h["hit"], allow))
    reached = F.transform(candidates, lambda h: F.struct(h["start"].alias("start"), _hot(h["hit"], cls).alias("hot")))
    hot = F.filter(reached, lambda h: h["hot"]["first"] >= 0)
    return F.transform(hot, lambda h: _span(h["start"] + h["hot"]["first"], h["start"] + h["hot"]["last"], kind_no, cls.kind))


def _any_match(text: Column, patterns: Sequence[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | F.rlike(text, F.lit(p))
    return found


def _hot(candidate: Column, cls: EntropyClass) -> Column:
    """First and last bound of the windows over the threshold, -1 if there are none.

    A step moves the window by one character. What it adds to the sum of ``n log n`` depends on
    how often the characters that come and go stand among those that stay.
    """
    w = cls.window
    # by how much n log2 n grows when a count goes from n to n + 1
    growth = F.array(*[F.lit((n + 1) * math.log2(n + 1) - (n * math.log2(n) if n else 0.0)) for n in range(w)])

    def moves(codes: Column) -> Column:
        def move(code: Column, i: Column) -> Column:
            stay = F.slice(codes, F.greatest(i - w + 2, F.lit(1)), F.least(i, F.lit(w - 1)))

            def change(c: Column) -> Column:
                return F.element_at(growth, F.size(F.filter(stay, lambda x: x == c)) + 1)

            gone = F.when(i >= w, change(F.get(codes, i - w))).otherwise(0.0)
            return F.struct(gone.alias("less"), change(code).alias("more"))

        return F.transform(codes, move)

    def step(state: Column, x: Column) -> Column:
        total, seen = state["sum"] - x["less"] + x["more"], state["seen"] + 1
        hot = (seen >= w) & (math.log2(w) - total / w >= cls.bits)
        return F.struct(
            total.alias("sum"), seen.alias("seen"),
            F.when(hot & (state["first"] < 0), seen - w).otherwise(state["first"]).alias("first"),
            F.when(hot, seen).otherwise(state["last"]).alias("last"))

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("seen"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    codes = F.transform(F.split(candidate, ""), F.ascii)
    # the one-element array names the codes, so that they are made once
    scanned = F.transform(F.array(codes), lambda c: F.aggregate(
        moves(c), start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"))))
    return F.element_at(scanned, 1)
