import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clicktrail.llm import context_mixing as cm


def plain_tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def check_base(rows, docs, held):
    known = Counter(t for d in docs if not held(d[0]) for t in plain_tokens(d[1]))
    n, v = sum(known.values()), len(known)
    want = sorted((str(d[0]), len(plain_tokens(d[1])), sum(t in known for t in plain_tokens(d[1])), n,
                   round(sum(math.log10((known[t] + 1) / (n + v + 1)) for t in plain_tokens(d[1])), 6)) for d in docs)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want], rtol=1e-9, atol=2e-6)


def test_odd_documents(docs_frame, odd_docs):
    held = F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False))
    rows = cm.score_texts(docs_frame, held).collect()
    check_base(rows, odd_docs, lambda i: i is not None and i % 7 == 2)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert len(by_id[13] | by_id[14] | by_id[15] | by_id[22]) == 1     # none of them has a word


def test_no_documents_and_no_training_documents(no_docs, docs_frame):
    assert cm.score_texts(no_docs, F.lit(False)).collect() == []
    rows = cm.score_texts(docs_frame.where("doc_id in (10, 16)"), F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in rows} == {(0, 0, 0.0)}


def test_held_out_texts_teach_nothing_and_are_predicted_better_than_by_words(spark, medium_dir):
    docs = spark.read.parquet(f"{medium_dir}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    rows = {r.doc_id: r for r in cm.score_texts(docs, held).collect()}
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 7 == 2) for i in rows)
    unseen = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    bits = [r.bits_per_byte for r in unseen if r.n_bytes]
    assert 1 < np.mean(bits) < 8
    for i, text in docs.limit(200).collect():
        size = len((text or "").encode())
        assert rows[i].n_bytes == size
        assert rows[i].bits_per_byte == (pytest.approx(-rows[i].score * math.log2(10) / size) if size else None)
    # other held-out texts leave all as it was
    changed = docs.withColumn("text", F.when(held & (F.col("doc_id") > 20), F.lit("zzz qqq")).otherwise(F.col("text")))
    again = {r.doc_id: r for r in cm.score_texts(changed, held).collect()}
    same = [i for i in rows if not rows[i].held_out]
    assert np.allclose([rows[i].score for i in same], [again[i].score for i in same], rtol=1e-9)
    assert all(rows[i].score == pytest.approx(again[i].score) for i in range(21))
    assert np.allclose([rows[i].base_score for i in same], [again[i].base_score for i in same], rtol=1e-9)


def test_probabilities_of_continuations_add_up():
    """After any start of a word the next bits share one."""
    rng = random.Random(1)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 4))) for _ in range(50)} | {cm.END})
    counts = [rng.randint(1, 30) for _ in words]
    code = cm.binary_code(np.ones(256) + np.bincount(np.frombuffer(b" ".join(words), "u1"), minlength=256))
    assert abs(sum(2.0 ** -code["length"]) - 1) < 1e-12

    class Held:
        value = np.zeros(cm.TABLES << cm.SLOT_BITS, np.uint16)

    import pyarrow as pa
    batch = pa.record_batch([pa.array(words, pa.binary()), pa.array([0] * len(words)), pa.array(counts)], names=["word", "kind", "c"])
    for b in cm._count_contexts(code)(iter([batch])):
        t = cm._sum_chunk(pa.Table.from_batches([b]))
        at = t["chunk"][0].as_py() * cm.CHUNK
        Held.value[at:at + cm.CHUNK] = np.frombuffer(t["counts"][0].as_py(), np.uint16)
    model = {"code": code, "tables": Held, "weights": cm._first_weights(), "refined": np.full((cm.GATES, cm.BUCKETS), 0.5)}
    every = sorted({bytes([a]) for a in range(256) if a not in (9, 10, 11, 12, 13, 32)} | {cm.END})
    # words of one byte, each closed by a blank: their first bytes exclude each other
    batch = pa.record_batch([pa.array(every, pa.binary()), pa.array([0] * len(every)), pa.array([0] * len(every))], names=["word", "kind", "c"])
    total = sum(10 ** x for b in cm._word_scores(model)(iter([batch])) for x in b["logp"].to_pylist())
    assert 0 < total < 1


def test_contents_are_read_back():
    rng = np.random.default_rng(0)
    docs = [rng.choice(1_000_000, n, replace=False) for n in (500, 1, 3, 90_000)]
    doc, ranks = np.repeat(np.arange(4), [len(d) for d in docs]), np.concatenate(docs).astype(np.int32)
    times = np.where(rng.random(len(doc)) < 0.1, 100_000, rng.integers(1, 300, len(doc)))
    starts, own, n = cm._read_content(cm._write_content(doc, ranks, times))
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(own)])):
        assert dict(zip(own[a:b].tolist(), n[a:b].tolist())) == dict(zip(ranks[doc == i].tolist(), times[doc == i].tolist()))


def plain_kinds(points):
    """The kind most pointed to in the groups of tokens before one's own."""
    out = []
    for i in range(len(points)):
        end = i // cm.STRIDE * cm.STRIDE
        votes = Counter(p for p in points[max(0, end - cm.LOOK_BACK * cm.STRIDE):end] if p)
        most = max(votes.values(), default=0)
        out.append(min((k for k in votes if votes[k] == most), default=0))
    return out


def test_kinds_follow_the_markers_before():
    rng = random.Random(7)
    texts = [[0, 0, 3, 3, 0, 0, 0, 0, 5, 5, 5, 0, 0]]
    texts += [[rng.choice([0, 0, 0, 1, 2, 8]) for _ in range(n)] for n in (1, 4, 5, 300, 63, 64, 65, 2)]
    got = cm._kinds_before(np.array(sum(texts, []), np.uint8), np.array([len(t) for t in texts]))
    assert got.tolist() == sum(map(plain_kinds, texts), [])
    assert got[:13].tolist() == [0] * 4 + [3] * 8 + [5]
    groups = cm._groups(np.kron(np.eye(8), np.full((4, 4), 50.0)) + np.diag(np.full(32, 10.0)))
    assert len(set(groups[:4])) == 1 and len(set(groups)) == 8
    assert pd.Series(groups).groupby(np.arange(32) // 4).nunique().eq(1).all()


def test_markers_are_the_most_frequent_words_however_texts_are_dealt(spark):
    """Words that never repeat within a text, lie thinly over tasks, or follow a full counter count too."""
    rng = random.Random(4)
    often = [f"w{i:03}" for i in range(300)]
    texts = [(i, False, often[j]) for j in range(300) for i in range(400 - j)]     # one word a text
    rng.shuffle(texts)
    want = {w.encode() for w in often[:cm.MARKERS]}
    for parts in (1, 7):
        assert set(cm.marker_kinds(spark.createDataFrame(texts, "doc_id long, held_out boolean, text string").repartition(parts))) == want

    import pyarrow as pa
    rare = [f"r{i}" for i in range(3 * cm.COUNTED_WORDS)]
    batch = pa.record_batch([pa.nulls(4, pa.int64()), pa.nulls(4, pa.bool_()), pa.array(["late", " ".join(rare), "late", "late"])], names=["a", "b", "text"])
    counts, parts = Counter(), list(cm._count_words(iter([batch])))
    for part in parts:
        counts.update(dict(zip(part["word"].to_pylist(), part["n"].to_pylist())))
    assert len(parts) > 1 and counts[b"late"] == 3 and len(counts) == len(rare) + 1


def test_starts_that_too_many_words_share_are_counted_whole(spark):
    """Rows cut into small places have the counts that they have in a single batch."""
    rng = random.Random(2)
    words = {b"http" + bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 9))) for _ in range(3000)} | {b"http", b"htt", b"a", cm.END}
    words |= {b"httpsame-long-start-" + bytes([a]) * n for a in b"xyz" for n in (1, 40)} | {b"other%d" % i for i in range(90)}
    rows = sorted((w, kind, rng.randint(0, 5)) for w in words for kind in rng.sample(range(9), 2))
    code, most = cm.binary_code(np.ones(256)), 50
    counted = spark.createDataFrame([(bytearray(w), k, c) for w, k, c in rows], "word binary, kind int, c long").repartition(5)
    placed, starts = cm.place_words(counted, most)
    assert len(starts) > 30
    own = {}
    for r in placed.collect():
        own.setdefault(r.place, []).append((bytes(r.word), r.kind, r.c))
    assert sorted(x for part in own.values() for x in part) == rows
    assert max(sum(c > 0 for *_, c in part) for part in own.values()) <= most      # other rows decide nothing
    assert len(cm.place_words(counted, 10**6)[1]) == 0

    learnt = spark.createDataFrame([(bytearray(w), k, c) for w, k, c in rows if c], "word binary, kind int, c long")
    alone, same_starts = cm.place_words(learnt, most)
    assert (same_starts == starts).all()
    assert {(bytes(r.word), r.kind): r.place for r in alone.collect()} == {(w, k): p for p in own for w, k, c in own[p] if c}

    counts = cm.heavy_counts(placed.repartition(7, "place").sortWithinPartitions("word", "kind").where("c > 0"), code, starts)

    def events_of(part, heavy):
        batch = cm._Batch([w for w, _, _ in part], np.array([k for _, k, _ in part]), np.array([c for _, _, c in part]))
        return cm._Events(batch, code, heavy)

    one, whole = events_of(rows, np.zeros(0, np.uint64)), {}
    for table in (cm.STARTS, cm.STARTS_OF_KIND):      # of a single batch, by keys without shared slots
        deep = np.flatnonzero(one.deep)
        for key, bit, n in zip(one.keys(table, deep).tolist(), one.bit[deep].tolist(), one.count[deep].tolist()):
            whole.setdefault((table, key), [0, 0])[bit] += n
    shared, all_same = 0, []
    for part in own.values():
        events = events_of(sorted(part), starts)
        found = events.deep_counts(counts)
        for table in found:
            deep = np.flatnonzero(events.deep)
            want = np.array([whole[table, key] for key in events.keys(table, deep).tolist()]).reshape(-1, 2).T
            same = (found[table][:, deep] == want).all(axis=0)
            assert same[events.heavy[deep]].all()
            all_same += same.tolist()
        shared += events.heavy.sum()
    assert shared > 10_000 and np.mean(all_same) > 0.99     # a batch's own starts may share slots


def _model_of(words, counts):
    code = cm.binary_code(np.ones(256) + np.bincount(np.frombuffer(b" ".join(words), "u1"), minlength=256))

    class Held:
        value = np.zeros(cm.TABLES << cm.SLOT_BITS, np.uint16)

    return {"code": code, "tables": Held, "weights": cm._first_weights(), "refined": np.full((cm.GATES, cm.BUCKETS), 0.5)}


def test_the_word_before_moves_probability_between_first_bytes_and_adds_none():
    rng = np.random.default_rng(3)
    model = _model_of([b"abc", b"xyz"], [1, 1])
    seen = np.zeros((cm.BEFORE, 256, cm.KINDS + 1))
    for h in range(cm.BEFORE):          # after each hash a few letters come
        for b in rng.choice(np.arange(97, 123), 3):
            seen[h, b, rng.integers(0, 9)] += rng.integers(1, 200)
    gains = cm._first_byte_gains(model, seen.ravel()).reshape(seen.shape)
    nodes = np.unique(model["code"]["node"])
    shares = cm._first_byte_shares(model, nodes)
    plain = np.zeros((256, cm.KINDS + 1))
    at = np.searchsorted(nodes, model["code"]["node"])
    for b in range(256):
        for p in range(model["code"]["begin"][b], model["code"]["begin"][b] + model["code"]["length"][b]):
            plain[b] += np.log10(np.where(model["code"]["bit"][p], shares[:, at[p]], 1 - shares[:, at[p]]))
    mixed = 10 ** (plain[None] + gains)
    assert np.allclose(mixed.sum(axis=1), 1) and np.allclose((10 ** plain).sum(axis=0), 1)
    assert (gains * seen).sum() > 0                         # what was seen is surer
    nothing = cm._first_byte_gains(model, np.zeros(cm.CELLS))
    assert np.allclose(nothing, 0)


def test_words_in_another_order_score_lower(spark):
    rng = random.Random(6)
    verbs = {"sun": "aches", "moon": "binds", "star": "calls", "sky": "dives", "sea": "earns", "tree": "flows"}

    def text(reverse=False):
        words = [w for n in rng.choices(list(verbs), k=20) for w in (n, verbs[n])]
        return " ".join(words[::-1] if reverse else words)

    rows = [(i, text()) for i in range(400)]
    rows += [(1000 + i, t) for i, t in enumerate(text() for _ in range(20))]
    rows += [(2000 + i, " ".join(t.split()[::-1])) for i, (_, t) in enumerate(rows[400:420])]
    got = {r.doc_id: r for r in cm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 1000).collect()}
    forth, back = (np.array([got[first + i].score for i in range(20)]) for first in (1000, 2000))
    assert (forth > back + 5).all()
    assert all(got[1000 + i].base_score == pytest.approx(got[2000 + i].base_score) for i in range(20))


def test_slots_are_hashed_once_for_the_counts_of_a_batch(monkeypatch):
    words = [b"abcdefgh", b"abcdefgi", b"abcdxyz"]
    code = cm.binary_code(np.ones(256))
    events = cm._Events(cm._Batch(words, np.zeros(3, np.int64), np.array([3, 2, 1])), code)
    calls, slots = [], cm._Events.slots
    monkeypatch.setattr(cm._Events, "slots", lambda *args: (calls.append(args[1]), slots(*args))[1])
    found = events.deep_counts()
    assert calls == [cm.STARTS, cm.STARTS_OF_KIND]
    # the fifth byte, after "abcd": what follows is counted by word, with each word's occurrences
    deep = np.flatnonzero(events.deep)
    for table in found:
        own = slots(events, table, deep, cm.BATCH_BITS)
        for bit in (0, 1):
            want = [events.count[deep][(own == s) & (events.bit[deep] == bit)].sum() for s in own]
            assert found[table][bit, deep].tolist() == want


def test_batches_are_cut_where_the_place_changes_once_full(monkeypatch):
    monkeypatch.setattr(cm, "BATCH_WORDS", 5)
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(1, 60))
        places, counts = np.sort(rng.integers(0, 12, n)), rng.integers(0, 2, n)
        words = [b"%03d" % i for i in range(n)]
        want, first, seen = [], 0, 0
        for i in range(n):
            if seen >= 5 and places[i] != places[i - 1]:
                want.append(words[first:i])
                first, seen = i, 0
            seen += counts[i] > 0
        want.append(words[first:])
        table = pa.table({"word": pa.array(words, pa.binary()), "kind": np.zeros(n, np.int64), "c": counts, "place": places})
        assert [b.words for b in cm._word_batches(iter(table.to_batches(max_chunksize=int(rng.integers(1, 20)))))] == want
