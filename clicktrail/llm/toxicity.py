"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

The fit uses a bounded sample of labelled rows, :data:`SAMPLE` at most, drawn by a hash of the
id. Document counts of the hashed n-grams per class give the log-count ratios; the n-grams that
tell the classes apart best are features, each worth its ratio if it occurs. Logistic
regression learns their weights. Scoring reads whole texts and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clicktrail.llm.arrow import as_bytes, batches
from clicktrail.sources.shared import stash

SAMPLE = 16_000        # labelled rows that the fit reads at most
FEATURES = 1 << 13     # n-grams kept
LEAST_RATIO = 0.5      # log-count ratio, either way, that a kept n-gram has at least
BUCKET_BITS = 22
ORDERS = (3, 4, 5)
LEAST_DOCS = 3         # documents of the sample an n-gram must occur in
SMOOTHING = 1.0
BLOCK = 1 << 20        # feature numbers of sampled rows that the fit unpacks at once
HELD = 8               # such blocks that stay unpacked


def ngrams(text: bytes) -> np.ndarray:
    """Buckets of the character n-grams of a text; case and the kind of white space do not matter."""
    words = " ".join(text.decode("utf-8", "replace").lower().split())
    chars = np.frombuffer(f" {words} ".encode("utf-32-le"), "<u4")
    found, value = [], chars
    for n in range(2, max(ORDERS) + 1):
        if len(chars) < n:
            break
        value = value[:-1] * np.uint32(0x01000193) + chars[n - 1:] * np.uint32(0x9E3779B1)
        if n in ORDERS:
            mixed = (value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            found.append(mixed >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep: Column | None = None,
          sample: int = SAMPLE) -> dict:
    """Fit on documents that have a label.

    ``keep`` limits the labelled rows to learn from. Rows with a null id or label are not
    used; a ``doc_id`` labelled twice counts with its larger label. Returns the model: feature
    buckets, weights, bias. Without rows of both classes the weights are empty and the bias
    holds the share of ones, or a half without any row.
    """
    wanted = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if keep is not None:
        wanted = wanted.where(keep)
    wanted = wanted.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    drawn = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most SAMPLE pairs of numbers, so the broadcast has a bound
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("y") > 0).cast("int").alias("y"), "text")
    rows = stash(texts.repartition(8), "toxicity-sample")
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        share = (n1 + 0.5) / (n0 + n1 + 1)
        return {"grams": np.zeros(0, np.uint32), "weights": np.zeros(0, np.float32), "bias": float(np.log(share / (1 - share)))}

    counts = rows.mapInArrow(_count_ngrams, "gram int, d0 long, d1 long").groupBy("gram").agg(
        F.sum("d0").alias("d0"), F.sum("d1").alias("d1")).where(F.col("d0") + F.col("d1") >= LEAST_DOCS)
    ratio = F.log((F.col("d1") + SMOOTHING) / (n1 + 2 * SMOOTHING)) - F.log((F.col("d0") + SMOOTHING) / (n0 + 2 * SMOOTHING))
    # how far the share of ones among documents with the n-gram is from chance, in deviations
    n = F.col("d0") + F.col("d1")
    prior = n1 / (n0 + n1)
    score = F.abs(F.col("d1") - n * prior) / F.sqrt(n * prior * (1 - prior) + 1)
    rated = counts.select("gram", ratio.alias("ratio"), score.alias("score")).where(F.abs("ratio") >= LEAST_RATIO)
    best = rated.orderBy(F.desc("score"), "gram").limit(FEATURES)
    features = best.select("gram", "ratio").toPandas().sort_values("gram")
    grams, ratios = features["gram"].to_numpy(np.uint32), features["ratio"].to_numpy(np.float64)
    # a kilobyte per row at most
    data = rows.mapInArrow(_feature_numbers(grams), "doc_id long, y int, features binary").collect()
    data.sort(key=lambda r: (r.doc_id, r.features))     # whatever the order in which rows came
    weights, bias = _calibrated([bytes(r.features) for r in data], np.array([r.y for r in data]), ratios)
    return {"grams": grams, "weights": (weights * ratios).astype(np.float32), "bias": float(bias)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Adds ``score`` to (``row`` the document): probability of label 1.

    Null and empty texts get the score of a text without features. Repeated rows are scored
    alike; an empty table gives no rows.
    """
    grams, weights, bias = model["grams"], model["weights"], model["bias"]

    def rate(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BUCKET_BITS, np.float32)
        table[grams] = weights
        for batch in source:
            out = []
            for text in as_bytes(batch.column(0).field("text")):
                found = ngrams(text)
                out.append(bias + float(table[np.unique(found[table[found] != 0])].sum()))
            rated = 1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -500, 500)))
            yield pa.record_batch([batch.column(0), pa.array(rated, pa.float64())], names=["row", "score"])

    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(rate, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def _count_ngrams(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int32)
    for batch in source:
        for y, text in zip(batch.column(1).to_pylist(), as_bytes(batch.column(2))):
            counts[y][np.unique(ngrams(text))] += 1
    grams = np.flatnonzero(counts.any(axis=0))
    for at in range(0, len(grams), 1 << 16):
        part = grams[at:at + (1 << 16)]
        yield pa.record_batch([pa.array(part.astype(np.int32)), pa.array(counts[0][part].astype(np.int64)),
                               pa.array(counts[1][part].astype(np.int64))], names=["gram", "d0", "d1"])


def _feature_numbers(grams: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("features", pa.binary())])

    def rows(source):
        for batch in source:
            for doc, y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                packed = pack(np.isin(grams, ngrams(text)))
                yield (doc, y, packed), len(packed)

    return lambda source: batches(rows(source), schema)


def pack(has: np.ndarray) -> bytes:
    """The features a row has: as 16-bit numbers, or as a bitmap where that is no longer."""
    numbers = np.flatnonzero(has).astype("<u2").tobytes()
    return numbers if len(numbers) < -(-len(has) // 8) else np.packbits(has).tobytes()


def unpack(packed: bytes, features: int) -> np.ndarray:
    """Numbers of a row's features; only a bitmap is an eighth of ``features`` long."""
    if len(packed) < -(-features // 8):
        return np.frombuffer(packed, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8), count=features)).astype("<u2")


def _blocks(rows: list[bytes], features: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows from and to, feature numbers, and each number's row, about :data:`BLOCK` numbers at a time."""
    begin, found, size = 0, [], 0
    for at, row in enumerate(rows):
        found.append(unpack(row, features))
        size += len(found[-1])
        if size >= BLOCK or at == len(rows) - 1:
            owner = np.repeat(np.arange(at + 1 - begin), [len(f) for f in found])
            yield slice(begin, at + 1), np.concatenate(found), owner
            begin, found, size = at + 1, [], 0


def _calibrated(rows: list[bytes], y: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Fit on all rows, with slope and bias set by rows that the fit had not seen.

    On few rows a fit is surer of its own rows than of others. Four fits on three quarters
    rate the quarter left out, and a fit of one feature, that rating, tells how ratings
    translate to probabilities. The rarer class weighs more there, half way to balance.
    """
    order = np.argsort(y, kind="stable")    # so that every quarter has its part of either class
    rows, y = [rows[i] for i in order], y[order]
    quarter, z = np.arange(len(y)) % 4, np.zeros(len(y))
    for q in range(4):
        seen = np.flatnonzero(quarter != q)
        if len(np.unique(y[seen])) == 2:
            w, b = _logistic([rows[i] for i in seen], y[seen], ratios, np.ones(len(seen)))
            for i in np.flatnonzero(quarter == q):
                z[i] = b + (w * ratios)[unpack(rows[i], len(ratios))].sum()
    weights, bias = _logistic(rows, y, ratios, np.ones(len(y)))
    if np.ptp(z) == 0:
        return weights, bias
    balance = np.sqrt(np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)))
    slope, shift = 1.0, 0.0
    for _ in range(200):  # damped Newton steps on two numbers
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        g = np.array([(balance * (p - y) * z).mean() + 1e-3 * (slope - 1), (balance * (p - y)).mean()])
        v = balance * p * (1 - p) + 1e-6
        h = np.array([[(v * z * z).mean() + 1e-3, (v * z).mean()], [(v * z).mean(), v.mean() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, shift = max(slope - step[0], 0.05), shift - step[1]
    return weights * slope, bias * slope + shift


def _logistic(rows: list[bytes], y: np.ndarray, ratios: np.ndarray, importance: np.ndarray,
              rounds: int = 200, ridge: float = 1e-4, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights on ratio-scaled features and bias, by full gradients with adaptive steps.

    Up to :data:`HELD` blocks of rows stay unpacked; further ones are unpacked anew for every gradient.
    """
    held = list(islice(_blocks(rows, len(ratios)), HELD))
    done = held[-1][0].stop if held else 0

    def blocks():
        yield from held
        for part, columns, owner in _blocks(rows[done:], len(ratios)):
            yield slice(part.start + done, part.stop + done), columns, owner

    scale = ratios / max(np.abs(ratios).max(initial=0), 1e-9)
    weights, bias = np.zeros(len(ratios)), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    first, second = np.zeros(len(ratios) + 1), np.zeros(len(ratios) + 1)
    for t in range(1, rounds + 1):
        total, missed = np.zeros(len(ratios)), 0.0
        for part, columns, owner in blocks():
            z = bias + np.bincount(owner, (scale * weights)[columns], part.stop - part.start)
            error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[part]) * importance[part]
            total += np.bincount(columns, error[owner], len(ratios))
            missed += error.sum()
        gradient = np.append(scale * total / len(rows) + ridge * weights, missed / len(rows))
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient ** 2
        move = rate * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.99 ** t)) + 1e-8)
        weights -= move[:-1]
        bias -= move[-1]
    return weights / max(np.abs(ratios).max(initial=0), 1e-9), bias
