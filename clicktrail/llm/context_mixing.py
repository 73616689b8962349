r"""Language-model scores by online logistic context mixing.

A text is its lower-cased words and one end. Bytes of a word are written in a binary code; each
bit is predicted from hashed contexts, the last bytes of the word and all of it so far, some
together with the kind of text that the words before point to. Kinds are groups of frequent
words that occur together, such as the small words of a language. Every context has counts of
both bits over the training tokens. The predictions, as log odds, are
added with weights that a gate picks by how much the contexts have seen; the weights are
learned online, by a gradient step per small batch. A table of what came true for which
prediction refines the sum. Bits of a token add up to its probability, in base 10 logarithms. The bits of a
word's first byte are mixed once more with two contexts that reach into the word before, by
its hash, alone and with the kind.

But for the first byte, a token's probability depends on the token and the kind alone, so it is
computed once per distinct pair of them, whatever the corpus repeats. What the word before adds
is a table over its hash, the first byte and the kind. Pairs of a block of documents are numbered
there; only (block, pair) rows are shuffled, never one row per word of a text.
"""

from __future__ import annotations

import heapq
import operator
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktrail.llm.arrow import as_bytes
from clicktrail.sources.shared import stash

END = b"\n"                # never part of a word
BLOCK_BYTES = 32 << 20     # text whose tokens are numbered together
ORDERS = (1, 2, 4)         # bytes of a hashed context
HEAD = 4                   # shorter word starts are counted for all words, longer ones per batch or if heavy over all
OF_KIND = (1, 2)           # those of them that are counted for each kind of text
TABLES = len(ORDERS) + 2   # two more for short word starts, of all texts and for each kind
STARTS, STARTS_OF_KIND = TABLES - 2, TABLES - 1
MARKERS, KINDS = 256, 8    # frequent words, and groups of them
COUNTED_WORDS = 1 << 17    # distinct words that a task holds before it hands their counts on
BEFORE = 256               # hashes of the word before
CELLS = BEFORE * 256 * (KINDS + 1)
BEFORE_GATES = np.array([0.5, 2, 8, 32, 128, 512])    # bounds of what the word before has seen
BEFORE_ROUNDS = 4
STRIDE, LOOK_BACK = 4, 16  # tokens that share a kind, and how many such groups before tell it
SLOT_BITS = 20             # slots of a table, a fixed size of the model
CHUNK = 1 << 14
SEEN_SOME = 0.05           # added to counts before log odds
GATES = 6 * 4 * 2
BUCKETS = 33               # of a prediction, in the refining table
WORDS_PER_TASK = 65_536
BATCH_WORDS, SLICE_WORDS = 12_288, 4_096
MOST_WORDS = 32_768        # rows of a batch; starts that this many rows less a batch share are heavy
BATCH_BITS = 21            # slots in which longer word starts of a batch are counted
STEP_EVENTS, STEP = 8192, 0.15
INPUTS = TABLES + 1

GROUP_TOKENS = 1 << 18     # tokens of documents that are numbered and written in one go

BLOCK_SCHEMA = ("block long, word binary, kind int, rank int, train long, "
                "docs array<struct<doc_id: long, held_out: boolean, n_tokens: long, n_bytes: long>>, content binary, before binary")


def score_texts(docs: DataFrame, held_out: Column) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``,
    ``n_bytes``, ``bits_per_byte``.

    Learns from all documents that are not ``held_out``; what is held out changes the score of no
    other text. ``base_score`` is an add-one unigram score of the same tokens. ``bits_per_byte``
    is the score in bits by the bytes of the text (``n_bytes``, in UTF-8), null for an empty one. A null text is empty: its only token is the end. Repeated rows
    are scored each, null ids stay null, other columns are ignored. Without training tokens
    every bit is even. An empty table gives no rows. A very long text is taken whole: its task
    holds its words and a few numbers for each.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    kinds = marker_kinds(texts.where("not held_out"))
    blocks = stash(texts.mapInArrow(_number_tokens(kinds), BLOCK_SCHEMA), "blocks")
    places = blocks.where("word is not null").select("block", "word", "kind", "rank", "train")
    counted = stash(places.groupBy("word", "kind").agg(F.sum("train").alias("c")), "words")
    total = counted.where("c > 0").groupBy("word").agg(F.sum("c").alias("c")).agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(total.n or 0), int(total.v or 0)
    # words that begin alike lie together, sorted, so that longer starts can be counted in a
    # batch; starts that too many words share are counted over all batches
    placed, heavy = place_words(counted)
    words = stash(placed.repartition(1 + v // WORDS_PER_TASK, "place").sortWithinPartitions("word", "kind"), "sorted-words")
    model = _fit(words, heavy)
    scored = words.mapInArrow(_word_scores(model), "word binary, kind int, c long, logp double")
    # as many rows as the table has cells, at most
    cells = blocks.where("word is null and content is null").groupBy("rank").agg(F.sum("train").alias("n")).toArrow()
    seen = np.zeros(CELLS)
    seen[cells["rank"].to_numpy()] = cells["n"].to_numpy()
    gain = docs.sparkSession.sparkContext.broadcast(_first_byte_gains(model, seen))

    values = places.select("block", "word", "kind", "rank").join(scored.hint("shuffle_hash"), ["word", "kind"]).select(F.col("block").alias("of_block"), "rank", "c", "logp")
    contents = blocks.where("content is not null").select("block", "docs", "content", "before")
    out = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
           "base_score double, score double, n_bytes long, bits_per_byte double")
    return contents.groupBy("block").cogroup(values.groupBy("of_block")).applyInArrow(_add_up(n, v, gain), out)


# Kinds of text


def marker_kinds(texts: DataFrame) -> dict[bytes, int]:
    """Kind, from 1, of each of the most frequent words of the training texts, counted exactly.

    Words are grouped by which of them they share documents with. What reaches the driver is
    a list of :data:`MARKERS` words and a square table of their numbers.
    """
    frequent = texts.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(
        F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(MARKERS).collect()
    markers = [bytes(r.word) for r in frequent]
    if len(markers) <= KINDS:
        return {w: i + 1 for i, w in enumerate(markers)}
    together = np.zeros((len(markers), len(markers)))
    for row in texts.mapInArrow(_count_together(markers), "i int, row int, n long").groupBy("i", "row").agg(F.sum("n").alias("n")).collect():
        together[row.row, row.i] = row.n
    return dict(zip(markers, _groups(together).tolist()))


def _count_words(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every word of a task with its occurrences, in parts: full counters are handed on, none is cut."""
    counts: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in source:
        for text in as_bytes(batch.column(2)):
            counts.update(text.lower().split())
            if len(counts) > COUNTED_WORDS:
                yield flush()
                counts.clear()
    yield flush()


def _count_together(markers: list[bytes]):
    number = {w: i for i, w in enumerate(markers)}

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(markers), len(markers)), np.int64)
        for batch in source:
            seen = np.zeros((batch.num_rows, len(markers)), np.float32)
            for i, text in enumerate(as_bytes(batch.column(2))):
                seen[i, [number[w] for w in number.keys() & set(text.lower().split())]] = 1
            total += np.rint(seen.T @ seen).astype(np.int64)
        row, i = np.nonzero(total)
        yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(row.astype(np.int32)), pa.array(total[row, i])], names=["i", "row", "n"])

    return count


def _groups(together: np.ndarray) -> np.ndarray:
    """Numbers from 1 of groups of markers with like company, by k-means from frequent starts far apart."""
    own = np.maximum(np.diag(together), 1)
    like = together / np.sqrt(own[:, None] * own[None, :])   # cosine of the documents they are in
    like = like - np.average(like, axis=0, weights=own)
    like /= np.maximum(np.linalg.norm(like, axis=1, keepdims=True), 1e-9)
    centres = like[:1]
    for _ in range(KINDS - 1):
        apart = own * np.maximum(1 - (like @ centres.T).max(axis=1), 0)
        centres = np.vstack([centres, like[np.argmax(apart)]])
    for _ in range(50):
        group = np.argmax(like @ centres.T, axis=1)
        sums = np.stack([(like * own[:, None])[group == k].sum(axis=0) if (group == k).any() else centres[k] for k in range(KINDS)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return group + 1


# Tokens


class _Numbers(dict):
    """Numbers words in order of appearance and keeps the kind that each points to, its hash and first byte."""

    def __init__(self, kinds: dict[bytes, int]):
        super().__init__()
        self.of, self.kinds, self.hashes, self.first = kinds, bytearray(), bytearray(), bytearray()

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.kinds)
        self.kinds.append(self.of.get(word, 0))
        self.hashes.append(zlib.crc32(word) % BEFORE)
        self.first.append(word[0])
        return number


def _kinds_before(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The kind that most markers before a group of tokens point to, 0 if there are none.

    ``points`` are those of texts of the given lengths, one after the other; groups of
    :data:`STRIDE` tokens begin anew with each text.
    """
    groups = -(-lengths // STRIDE)
    first = np.cumsum(groups) - groups
    begin = np.cumsum(lengths) - lengths
    group = np.repeat(first, lengths) + (np.arange(len(points)) - np.repeat(begin, lengths)) // STRIDE
    at = np.flatnonzero(points)
    votes = np.bincount(group[at] * KINDS + points[at] - 1, minlength=int(groups.sum()) * KINDS).reshape(-1, KINDS)
    so_far = np.vstack([np.zeros((1, KINDS), np.int64), np.cumsum(votes, axis=0)])
    every = np.arange(len(votes))
    recent = so_far[every] - so_far[np.maximum(every - LOOK_BACK, np.repeat(first, groups))]
    return np.where(recent.max(axis=1, initial=0) > 0, recent.argmax(axis=1) + 1, 0)[group]


class _Group:
    """Documents of a block: how often each holds each pair of word and kind, and each cell of
    the hash of the word before, first byte and kind. Before the first word stands an end."""

    def __init__(self, docs: list[tuple], tokens: list[np.ndarray], numbers: _Numbers):
        # copies, so that the arrays may grow on
        points, hashes, first = (np.frombuffer(bytes(x), "u1") for x in (numbers.kinds, numbers.hashes, numbers.first))
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.concatenate(tokens).astype(np.int64)
        kind = _kinds_before(points[flat], lengths)
        before = np.roll(hashes[flat], 1).astype(np.int64)
        before[np.cumsum(lengths) - lengths] = zlib.crc32(END) % BEFORE
        cell = (before * 256 + first[flat]) * (KINDS + 1) + kind
        own = np.repeat(np.arange(len(docs)), lengths) << 40
        self.docs = docs
        (self.doc, self.pair, self.times), (self.cell_doc, self.cell, self.cell_times) = (
            self._counted(own | x) for x in (flat * (KINDS + 1) + kind, cell))
        self.held = np.array([held for _, held, *_ in docs])

    @staticmethod
    def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, times = np.unique(keys, return_counts=True)
        return keys >> 40, keys & (1 << 40) - 1, times


def _number_tokens(kinds: dict[bytes, int]):
    """Blocks: a row per distinct token and kind, and one per group of documents with the pairs' numbers."""
    doc = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
    schema = pa.schema([("block", pa.int64()), ("word", pa.binary()), ("kind", pa.int32()), ("rank", pa.int32()),
                        ("train", pa.int64()), ("docs", pa.list_(doc)), ("content", pa.binary()), ("before", pa.binary())])

    def batch_of(n: int, **columns) -> pa.RecordBatch:
        return pa.record_batch([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def finish(block: int, words: list[bytes], groups: list[_Group]) -> Iterator[pa.RecordBatch]:
        pairs = np.unique(np.concatenate([g.pair for g in groups]))
        every, train = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        places = [np.searchsorted(pairs, g.pair) for g in groups]
        for g, own in zip(groups, places):
            learnt = ~g.held[g.doc]
            every += np.bincount(own, g.times, len(pairs)).astype(np.int64)
            train += np.bincount(own[learnt], g.times[learnt], len(pairs)).astype(np.int64)
        order = np.argsort(-every, kind="stable")   # frequent pairs get small numbers
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        spelled = pa.array(words, pa.binary())
        for at in range(0, len(pairs), 1 << 16):
            part = slice(at, at + (1 << 16))
            word, kind = np.divmod(pairs[part], KINDS + 1)
            yield batch_of(len(word), block=pa.array(np.full(len(word), block)), word=spelled.take(pa.array(word)),
                           kind=pa.array(kind.astype(np.int32)), rank=pa.array(rank[part]), train=pa.array(train[part]))
        cells = sum(np.bincount(g.cell, g.cell_times * ~g.held[g.cell_doc], CELLS) for g in groups)
        seen = np.flatnonzero(cells)
        yield batch_of(len(seen), block=pa.array(np.full(len(seen), block)), rank=pa.array(seen.astype(np.int32)),
                       train=pa.array(cells[seen].astype(np.int64)))
        for g, own in zip(groups, places):
            docs = [dict(zip(("doc_id", "held_out", "n_tokens", "n_bytes"), d)) for d in g.docs]
            yield batch_of(1, block=pa.array([block]), docs=pa.array([docs], pa.list_(doc)),
                           content=pa.array([_write_content(g.doc, rank[own], g.times)], pa.binary()),
                           before=pa.array([_write_content(g.cell_doc, g.cell, g.cell_times)], pa.binary()))

    def number(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, blocks = TaskContext.get().partitionId(), 0
        numbers, groups, size = _Numbers(kinds), [], 0
        docs, tokens, held_tokens = [], [], 0

        def close() -> None:
            nonlocal docs, tokens, held_tokens
            if docs:
                groups.append(_Group(docs, tokens, numbers))
                docs, tokens, held_tokens = [], [], 0

        for batch in source:
            for doc_id, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                split = text.lower().split()
                split.append(END)
                tokens.append(np.fromiter(map(numbers.__getitem__, split), np.int32, len(split)))
                docs.append((doc_id, held, len(split), len(text)))
                held_tokens += len(split)
                size += len(text) + 64
                if held_tokens >= GROUP_TOKENS:
                    close()
                if size >= BLOCK_BYTES:
                    close()
                    yield from finish((part << 24) + blocks, list(numbers), groups)
                    numbers, groups, size, blocks = _Numbers(kinds), [], 0, blocks + 1
        close()
        if groups:
            yield from finish((part << 24) + blocks, list(numbers), groups)

    return number


def _write_content(doc: np.ndarray, ranks: np.ndarray, times: np.ndarray) -> bytes:
    """Numbers of documents, one after the other, and how often each occurs.

    Numbers are sorted per document and written as gaps in 16 bits, those too large in 32.
    """
    keys = doc.astype(np.int64) << 32 | ranks       # each occurs once
    if (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys)
        doc, ranks, times = doc[order], ranks[order], times[order]
    ranks = ranks.astype(np.int64)
    n_own = np.bincount(doc)
    gaps = np.diff(ranks, prepend=0)
    starts = np.cumsum(n_own) - n_own
    gaps[starts] = ranks[starts]
    large, many = gaps >= 0xFFFF, times >= 0xFF
    short = np.where(large, 0xFFFF, gaps).astype("<u2")
    few = np.where(many, 0xFF, times).astype("u1")
    head = np.array([len(n_own), len(gaps), large.sum(), many.sum()], "<u4")
    parts = (head, n_own.astype("<u4"), short, gaps[large].astype("<u4"), few, times[many].astype("<u4"))
    return zlib.compress(b"".join(p.tobytes() for p in parts), 1)


def _read_content(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each document starts, the numbers and how often each occurs."""
    data, at = zlib.decompress(content), 16
    n_docs, n, n_large, n_many = np.frombuffer(data, "<u4", 4).tolist()

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        at += np.dtype(kind).itemsize * count
        return np.frombuffer(data, kind, count, at - np.dtype(kind).itemsize * count).astype(np.int64)

    n_own, gaps = take("<u4", n_docs), take("<u2", n)
    gaps[gaps == 0xFFFF] = take("<u4", n_large)
    times = take("u1", n)
    times[times == 0xFF] = take("<u4", n_many)
    starts = np.cumsum(n_own) - n_own
    ranks = np.cumsum(gaps)
    return starts, ranks - np.repeat(ranks[starts] - gaps[starts], n_own), times


def _add_up(n: int, v: int, gain):
    def one_block(texts: pa.Table, values: pa.Table) -> pa.Table:
        size = values.num_rows
        count, logp = np.zeros(size, np.int64), np.zeros(size)
        rank = values["rank"].to_numpy()
        count[rank], logp[rank] = values["c"].to_numpy(), values["logp"].to_numpy()
        base, known = np.log10((count + 1) / (n + 1 * (v + 1))), (count > 0).astype(np.int64)
        sums = [np.zeros((3, 0))]
        for content, before in zip(texts["content"], texts["before"]):
            starts, own, times = _read_content(content.as_py())
            sums.append(np.stack([np.add.reduceat(x[own] * times, starts) for x in (known, base, logp)]))
            starts, own, times = _read_content(before.as_py())
            sums[-1][2] += np.add.reduceat(gain.value[own] * times, starts)
        n_known, base_score, score = np.concatenate(sums, axis=1)
        docs = texts["docs"].combine_chunks().flatten()
        n_bytes = docs.field("n_bytes").to_numpy()
        bits = np.divide(score * -np.log2(10), n_bytes, where=n_bytes > 0, out=np.zeros(len(score)))
        return pa.table({
            "doc_id": docs.field("doc_id"), "held_out": docs.field("held_out"), "n_tokens": docs.field("n_tokens"),
            "n_known": pa.array(n_known.astype(np.int64)), "train_tokens": pa.array(np.full(len(score), n, np.int64)),
            "base_score": pa.array(base_score), "score": pa.array(score),
            "n_bytes": pa.array(n_bytes), "bits_per_byte": pa.array(bits, mask=n_bytes == 0)})

    return one_block


# Starts of words


def place_words(counted: DataFrame, most: int = MOST_WORDS - BATCH_WORDS) -> tuple[DataFrame, np.ndarray]:
    """Rows with their ``place``, and the sorted hashes of heavy starts.

    A start of :data:`HEAD` bytes or more is heavy if over ``most`` rows of training tokens share
    it. Rows of one place share the shortest start that is not heavy, so those of training
    tokens are at most ``most`` if they are longer than :data:`HEAD`, and no other start that is
    not heavy lies in two places. Heavy starts are at most as many as rows by ``most``, times the
    length of a word. Rows of other tokens go where their start belongs and decide nothing.
    """
    head = F.substring("word", 1, HEAD)
    heads = [bytearray(r["head"]) for r in counted.where("c > 0").groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > most).collect()]
    by_head = counted.withColumn("place", F.xxhash64(head))
    if not heads:
        return by_head, np.zeros(0, np.uint64)
    crowded = counted.where(head.isin(heads))
    ranges = crowded.where("c > 0").repartitionByRange("word").sortWithinPartitions("word")
    starts = ranges.mapInArrow(_count_starts(most), "start long, n long").groupBy("start").agg(F.sum("n").alias("n")).where(
        F.col("n") > most).select("start").collect()
    heavy = np.sort(np.array([r.start for r in starts], np.int64).view(np.uint64))
    placed = crowded.select("word", "kind", "c").mapInArrow(_place(heavy), "word binary, kind int, c long, place long")
    return by_head.where(~head.isin(heads)).select("word", "kind", "c", "place").union(placed), heavy


def _symbols_of(batch: pa.RecordBatch) -> _Symbols:
    return _Symbols(_Batch(batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()))


def _count_starts(most: int):
    """Rows by start of :data:`HEAD` bytes or more, of sorted words.

    Starts that end within a task are whole there and handed on only if over ``most`` rows
    share them; those of the first and last word may go on in other tasks.
    """
    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, open_, n_open = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def rows(starts: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(starts.view(np.int64)), pa.array(n.astype(np.int64))], names=["start", "n"])

        for batch in source:
            if not batch.num_rows:
                continue
            symbols = _symbols_of(batch)
            deep = symbols.place >= HEAD
            starts, n = np.unique(symbols.start[deep], return_counts=True)
            every, at = np.unique(np.concatenate([open_, starts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n_open, n]), len(every)).astype(np.int64)
            if first is None:
                first = np.sort(symbols.start[deep & (symbols.word == 0)])
            last = np.sort(symbols.start[deep & (symbols.word == batch.num_rows - 1)])
            going_on = _is_in(every, first) | _is_in(every, last)
            whole = ~going_on & (n > most)
            yield rows(every[whole], n[whole])
            open_, n_open = every[going_on], n[going_on]
        yield rows(open_, n_open)

    return count


def _is_in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _place(heavy: np.ndarray):
    def place(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                symbols = _symbols_of(batch)
                crowded = _is_in(symbols.start, heavy) & (symbols.place >= HEAD)
                length = np.bincount(symbols.word)
                begin = np.cumsum(length) - length
                # the first start that is not heavy, or all of a word whose starts are all heavy
                at = np.minimum(HEAD + np.bincount(symbols.word, crowded, len(length)).astype(np.int64), length - 1)
                yield pa.record_batch([*batch.columns[:3], pa.array(symbols.start[begin + at].view(np.int64))],
                                      names=["word", "kind", "c", "place"])

    return place


class _HeavyCounts:
    """Counts of both bits after heavy starts, of all training tokens."""

    def __init__(self, starts: np.ndarray, rows: list):
        self.starts, self.of = starts, {}
        for table in (STARTS, STARTS_OF_KIND):
            own = sorted((r.key, r.zeros, r.ones) for r in rows if r.table == table)
            self.of[table] = (np.array([r[0] for r in own], np.int64), np.array([r[1:] for r in own], np.float32).reshape(-1, 2))

    def look_up(self, table: int, keys: np.ndarray) -> np.ndarray:
        """Both counts of each key, none for one that no training token has."""
        known, counts = self.of[table]
        found, there = np.zeros((2, len(keys)), np.float32), _is_in(keys, known)
        found[:, there] = counts[np.searchsorted(known, keys[there])].T
        return found


def _count_heavy(code: dict, starts: np.ndarray):
    schema = pa.schema([("table", pa.int32()), ("key", pa.int64()), ("zeros", pa.float64()), ("ones", pa.float64())])

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _word_batches(source):
            events = _Events(batch, code, starts)
            heavy = np.flatnonzero(events.heavy)
            ones = events.count[heavy] * events.bit[heavy]
            for table in (STARTS, STARTS_OF_KIND):
                keys, at = np.unique(events.keys(table, heavy), return_inverse=True)
                yield pa.record_batch([
                    pa.array(np.full(len(keys), table, np.int32)), pa.array(keys),
                    pa.array(np.bincount(at, events.count[heavy] - ones, len(keys))), pa.array(np.bincount(at, ones, len(keys)))], schema=schema)

    return count


def heavy_counts(trained: DataFrame, code: dict, starts: np.ndarray) -> _HeavyCounts:
    rows = trained.mapInArrow(_count_heavy(code, starts), "table int, key long, zeros double, ones double").groupBy(
        "table", "key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).collect() if len(starts) else []
    return _HeavyCounts(starts, rows)


# The model


def _fit(words: DataFrame, heavy: np.ndarray) -> dict:
    """Code, context counts, gated weights and refining table, each from all training tokens.

    What passes through the driver has the size of the model, whatever the size of the corpus.
    """
    spark = words.sparkSession
    trained = words.where("c > 0")
    symbols = trained.mapInArrow(_count_symbols, "symbol int, n double").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    counts = np.ones(256)
    for row in symbols:
        counts[row.symbol] += row.n
    code = binary_code(counts)
    # a task's tables have the model's size, so there are no more tasks than cores
    few = trained.coalesce(max(1, spark.sparkContext.defaultParallelism))
    chunks = few.mapInArrow(_count_contexts(code), "chunk int, slots binary, zeros binary, ones binary").groupBy(
        "chunk").applyInArrow(_sum_chunk, "chunk int, counts binary").collect()
    tables = np.zeros(TABLES << SLOT_BITS, np.uint16)
    for row in chunks:
        tables[row.chunk * CHUNK:(row.chunk + 1) * CHUNK] = np.frombuffer(row.counts, np.uint16)
    model = {"code": code, "tables": spark.sparkContext.broadcast(tables),
             "heavy": spark.sparkContext.broadcast(heavy_counts(trained, code, heavy))}
    learned = np.zeros(_LEARNED)
    for row in trained.mapInArrow(_learn(model), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        learned[row.i] = row.x
    weights, weight_sum, hits, trials = np.split(learned, _PARTS)
    weight_sum = weight_sum[:, None]
    model["weights"] = np.where(weight_sum > 0, weights.reshape(GATES, INPUTS) / np.maximum(weight_sum, 1e-9), _first_weights())
    at = 1 / (1 + np.exp(-_CENTRES))
    model["refined"] = (hits.reshape(GATES, BUCKETS) + 30 * at) / (trials.reshape(GATES, BUCKETS) + 30)
    return model


_PARTS = np.cumsum([GATES * INPUTS, GATES, GATES * BUCKETS])
_LEARNED = GATES * INPUTS + GATES + 2 * GATES * BUCKETS
_CENTRES = np.linspace(-12, 12, BUCKETS)


def _first_weights() -> np.ndarray:
    weights = np.full((GATES, INPUTS), 0.3)
    weights[:, -1] = 0
    return weights


def binary_code(counts: np.ndarray) -> dict:
    """Huffman code of 256 symbols: for each, the inner nodes on its path and the bits taken."""
    heap = [(float(c), i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    children: dict[int, tuple[int, int]] = {}
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        node = 256 + len(children)
        children[node] = (x, y)
        heapq.heappush(heap, (a + b, node, node))
    paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    open_ = [(heap[0][2], [])]
    while open_:
        node, path = open_.pop()
        if node < 256:
            paths[node] = path
        else:
            for bit, child in enumerate(children[node]):
                open_.append((child, path + [(node - 256, bit)]))
    lengths = np.array([len(p) for p in paths])
    nodes = np.array([n for p in paths for n, _ in p], np.uint64)
    return {"length": lengths, "begin": (np.cumsum(lengths) - lengths).astype(np.int32),
            "node": (_avalanche(nodes + np.uint64(1)) >> np.uint64(32)).astype(np.uint32),
            "bit": np.array([b for p in paths for _, b in p], np.int8)}


class _Batch:
    """Sorted pairs of word and kind with their counts, and the counts of the words over all kinds."""

    def __init__(self, words: list[bytes], kinds: np.ndarray, counts: np.ndarray):
        self.words, self.kinds, self.counts = words, kinds, counts.astype(np.float64)
        new = np.fromiter(map(operator.ne, words, [None, *words]), bool, len(words))
        group = np.cumsum(new) - 1
        self.of_word = np.bincount(group, self.counts)[group]

    def rows(self, at: np.ndarray) -> _Batch:
        """Some rows; their counts over all kinds are those of these rows only."""
        return _Batch([self.words[i] for i in at.tolist()], self.kinds[at], self.counts[at])


def _word_batches(source: Iterator[pa.RecordBatch]) -> Iterator[_Batch]:
    """Batches of rows sorted by word, cut where the place changes: the first bytes, if there is none.

    A batch is full once it has :data:`BATCH_WORDS` rows of training tokens; other rows do not count.
    """
    words: list[bytes] = []
    kinds, counts, places = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in source:
        new = batch.column(0).to_pylist()
        words += new
        places = np.concatenate([places, batch.column(3).to_numpy() if batch.num_columns > 3 else np.array([w[:HEAD] for w in new], object)])
        kinds = np.concatenate([kinds, batch.column(1).to_numpy()])
        counts = np.concatenate([counts, batch.column(2).to_numpy()])
        trained = np.concatenate([[0], np.cumsum(counts > 0)])      # rows of training tokens before each row
        begins = np.flatnonzero(places[1:] != places[:-1]) + 1      # of places, after the first
        done = 0
        while True:
            full = np.searchsorted(trained, trained[done] + BATCH_WORDS)
            at = np.searchsorted(begins, max(full, done + 1))
            if at == len(begins):
                break
            end = int(begins[at])
            yield _Batch(words[done:end], kinds[done:end], counts[done:end])
            done = end
        words, places, kinds, counts = words[done:], places[done:], kinds[done:], counts[done:]
    if words:
        yield _Batch(words, kinds, counts)


def _avalanche(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xE7037ED1A0B428DB)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x8EBC6AF09C88C6E3)


def _written(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words in a row, each closed by a blank, and how many each has."""
    parts = [w if w == END else w + b" " for w in words]
    return np.frombuffer(b"".join(parts), "u1"), np.fromiter(map(len, parts), np.int64, len(parts))


class _Symbols:
    """Bytes of a batch of words in one row, with their place and a hash per context."""

    def __init__(self, batch: _Batch):
        self.flat, lengths = _written(batch.words)
        begin = np.cumsum(lengths) - lengths
        self.word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.place = np.arange(len(self.flat)) - begin[self.word]
        value = self.flat.astype(np.uint64) + np.uint64(1)
        powers = np.cumprod(np.full(int(self.place.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
        terms = value * powers[self.place]
        before = np.cumsum(terms) - terms
        start = before - before[begin][self.word]
        kind = (batch.kinds[self.word].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)
        contexts, total = [], np.zeros(len(value), np.uint64)
        for back in range(1, max(ORDERS) + 1):
            earlier = np.zeros(len(value), np.uint64)
            earlier[back:] = value[:-back]
            total = total + np.where(self.place >= back, earlier * np.uint64(pow(0xD6E8FEB86659FD93, back, 1 << 64)), np.uint64(0))
            if back in ORDERS:
                contexts.append((total + np.uint64(back)) ^ kind if back in OF_KIND else total + np.uint64(back))
        contexts += [start, start ^ kind]
        self.start, self.start_of_kind = start, start ^ kind
        self.contexts = [(_avalanche(c + np.uint64(1)) >> np.uint64(32)).astype(np.uint32) for c in contexts]


class _Events:
    """Coded bits of a batch of words: which bit, of which word, in which node and context."""

    def __init__(self, batch: _Batch, code: dict, heavy: np.ndarray = np.zeros(0, np.uint64)):
        symbols = _Symbols(batch)
        length = code["length"][symbols.flat]
        self.symbol = np.repeat(np.arange(len(length), dtype=np.int32), length)
        first = (np.cumsum(length) - length).astype(np.int32)
        path = np.arange(len(self.symbol), dtype=np.int32) + (code["begin"][symbols.flat] - first)[self.symbol]
        self.node, self.bit = code["node"][path], code["bit"][path]
        self.word = symbols.word[self.symbol]
        self.first = (symbols.place == 0)[self.symbol]
        self.deep = (symbols.place >= HEAD)[self.symbol]
        self.heavy = (_is_in(symbols.start, heavy) & (symbols.place >= HEAD))[self.symbol]
        self._starts = {STARTS: symbols.start, STARTS_OF_KIND: symbols.start_of_kind}
        self.count = batch.counts[self.word]
        self._contexts = symbols.contexts

    def slots(self, table: int, part, bits: int = SLOT_BITS) -> np.ndarray:
        key = (self._contexts[table][self.symbol[part]] + self.node[part]) * np.uint32(0x9E3779B1)
        return key >> np.uint32(32 - bits)

    def keys(self, table: int, part: np.ndarray) -> np.ndarray:
        """Start of the word and node of some events, in 64 bits."""
        start = _avalanche(self._starts[table][self.symbol[part]] + np.uint64(1))
        return (start + self.node[part] * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)

    def deep_slots(self) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Events after starts of :data:`HEAD` bytes or more that are not heavy, and their slots."""
        deep = np.flatnonzero(self.deep & ~self.heavy)
        return deep, {table: self.slots(table, deep, BATCH_BITS) for table in (STARTS, STARTS_OF_KIND)}

    def deep_tables(self, deep: np.ndarray, slots: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Both bits' counts by slot, as the parts of a complex number, so that they are looked up at once."""
        count, bit = self.count[deep], self.bit[deep].astype(np.int64)
        return {table: np.bincount((own.astype(np.int64) << 1) | bit, count, 2 << BATCH_BITS).view(np.complex128) for table, own in slots.items()}

    def deep_counts(self, heavy: _HeavyCounts | None = None, tables: dict | None = None) -> dict[int, np.ndarray]:
        """Counts of both bits after the same start of a word, for starts of :data:`HEAD` bytes or more."""
        (deep, slots), found = self.deep_slots(), {}
        crowded = np.flatnonzero(self.heavy)
        for table, counts in (tables or self.deep_tables(deep, slots)).items():
            found[table] = np.zeros((2, len(self.bit)), np.float32)
            both = counts[slots[table]]
            found[table][0, deep], found[table][1, deep] = both.real, both.imag
            if len(crowded):
                found[table][:, crowded] = heavy.look_up(table, self.keys(table, crowded))
        return found


def _count_symbols(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256)
    for batch in _word_batches(source):
        flat, lengths = _written(batch.words)
        total += np.bincount(flat, np.repeat(batch.counts, lengths), 256)
    seen = np.flatnonzero(total)
    yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["symbol", "n"])


def _count_contexts(code: dict):
    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((TABLES, 2, 1 << SLOT_BITS), np.float32)
        for batch in _word_batches(source):
            events = _Events(batch, code)
            short = np.flatnonzero(~events.deep)
            for t in range(TABLES):
                slots, bit, weight = events.slots(t, slice(None)), events.bit, events.count
                if t >= STARTS:
                    slots, bit, weight = slots[short], bit[short], weight[short]
                both = np.bincount(slots | bit.astype(np.uint32) << SLOT_BITS, weight, 2 << SLOT_BITS)
                tables[t] += both.reshape(2, -1).astype(np.float32)
        for t in range(TABLES):
            for at in range(0, 1 << SLOT_BITS, CHUNK):
                zeros, ones = tables[t, :, at:at + CHUNK]
                slots = np.flatnonzero(zeros + ones).astype("<i4")
                if len(slots):
                    yield pa.record_batch([pa.array([(t << SLOT_BITS) // CHUNK + at // CHUNK], pa.int32()), *(
                        pa.array([x.tobytes()], pa.binary()) for x in (slots, zeros[slots], ones[slots]))],
                        names=["chunk", "slots", "zeros", "ones"])

    return count


def _sum_chunk(table: pa.Table) -> pa.Table:
    """Sum of the tasks' counts, as eighths of a binary logarithm, a byte for either bit."""
    total = np.zeros((CHUNK, 2), np.float64)
    for slots, zeros, ones in zip(*(table[c] for c in ("slots", "zeros", "ones"))):
        own = np.frombuffer(slots.as_py(), "<i4")
        total[own, 0] += np.frombuffer(zeros.as_py(), np.float32)
        total[own, 1] += np.frombuffer(ones.as_py(), np.float32)
    return pa.table({"chunk": table["chunk"][:1], "counts": pa.array([_write_counts(total).tobytes()], pa.binary())})


def _write_counts(counts: np.ndarray) -> np.ndarray:
    eighths = np.minimum(np.rint(8 * np.log2(1 + counts)), 255).astype(np.uint16)
    return eighths[:, 0] | (eighths[:, 1] << np.uint16(8))


class _Odds:
    """Log odds and totals of all pairs of counts that a table can hold.

    With ``leave_one`` a pair is looked up by the bit that came and has one occurrence of it
    taken out, as if the token were new.
    """

    def __init__(self, tables: np.ndarray, leave_one: bool):
        self.tables, self.leave_one = tables, leave_one
        pairs = np.arange(1 << 16)
        zeros, ones = (np.exp2((pairs >> shift & 255) / 8) - 1 for shift in (0, 8))
        cases = [(np.maximum(zeros - 1, 0), ones), (zeros, np.maximum(ones - 1, 0))] if leave_one else [(zeros, ones)]
        self.odds = np.concatenate([_log_odds(z, o) for z, o in cases]).astype(np.float32)
        self.total = np.concatenate([z + o for z, o in cases]).astype(np.float32)
        self.sure = np.concatenate([(z < 0.5) | (o < 0.5) for z, o in cases])

    def inputs(self, events: _Events, deep: dict[int, np.ndarray], part: slice) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of every predictor, and the gate, for a run of events."""
        bit, is_deep = events.bit[part], events.deep[part]
        x = np.full((INPUTS, part.stop - part.start), 0.3, np.float32)
        case = bit.astype(np.int32) << 16 if self.leave_one else np.int32(0)
        for t in range(TABLES):
            pair = self.tables[t << SLOT_BITS:(t + 1) << SLOT_BITS][events.slots(t, part)] + case
            x[t] = self.odds[pair]
            if t >= STARTS:
                zeros, ones = deep[t][0, part], deep[t][1, part]
                if self.leave_one:
                    zeros, ones = np.maximum(zeros - (bit == 0), 0), np.maximum(ones - (bit == 1), 0)
                x[t] = np.where(is_deep, _log_odds(zeros, ones), x[t])
                total = np.where(is_deep, zeros + ones, self.total[pair])
                if t == STARTS:
                    of_all = _over(total, (0.5, 8, 100))
        of_kind = _over(total, (0.5, 2.5, 10, 50, 500))
        sure = np.where(is_deep, (zeros < 0.5) | (ones < 0.5), self.sure[pair])
        return x, (of_kind * 4 + of_all) * 2 + sure


def _over(values: np.ndarray, bounds: tuple[float, ...]) -> np.ndarray:
    """How many of a few bounds each value is over."""
    return sum((values > bound).astype(np.int64) for bound in bounds)


def _log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + SEEN_SOME) / (zeros + SEEN_SOME))


def _slices(events: _Events, n_words: int) -> Iterator[slice]:
    bounds = np.searchsorted(events.word, np.arange(0, n_words + SLICE_WORDS, SLICE_WORDS))
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            yield slice(int(a), int(b))


def _learn(model: dict):
    """Weights by online gradient steps over a task's words, and what came true for which sum.

    Tasks start alike and their weights are averaged, each by the tokens it saw.
    """
    def learn(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, weights = _Odds(model["tables"].value, leave_one=True), _first_weights()
        heavy = model["heavy"].value
        power = np.full((GATES, INPUTS), 1e-2)
        weight_sum = np.zeros(GATES)
        hits, trials = np.zeros(GATES * BUCKETS), np.zeros(GATES * BUCKETS)
        for batch in _word_batches(source):
            events = _Events(batch, model["code"], heavy.starts)
            deep = events.deep_counts(heavy)
            for part in _slices(events, len(batch.words)):
                x, gate = odds.inputs(events, deep, part)
                bit, count = events.bit[part], events.count[part]
                for at in range(0, len(bit), STEP_EVENTS):
                    some = slice(at, at + STEP_EVENTS)
                    xs, gs, cs = x[:, some], gate[some], count[some]
                    z = _weighted(xs, weights, gs)
                    error = (bit[some] - _odds_to_share(z)) * cs
                    total = np.bincount(gs, cs, GATES)
                    pull = np.stack([np.bincount(gs, error * row, GATES) for row in xs], axis=1) / np.maximum(total, 1)[:, None]
                    power += pull ** 2
                    weights += STEP * pull / np.sqrt(power)
                    weight_sum += total
                    for place, near in _buckets(z):
                        place, near = gs * BUCKETS + place, near * cs
                        hits += np.bincount(place, near * bit[some], GATES * BUCKETS)
                        trials += np.bincount(place, near, GATES * BUCKETS)
        learned = np.concatenate([(weights * weight_sum[:, None]).ravel(), weight_sum, hits, trials])
        some = np.flatnonzero(learned)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(learned[some])], names=["i", "x"])

    return learn


def _weighted(x: np.ndarray, weights: np.ndarray, gate: np.ndarray) -> np.ndarray:
    return sum(row * own[gate] for row, own in zip(x, np.ascontiguousarray(weights.T)))


def _odds_to_share(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _buckets(z: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two buckets of the refining table next to a sum, and how near each is."""
    at = np.clip((z + 12) * ((BUCKETS - 1) / 24), 0, BUCKETS - 1.001)
    low = at.astype(np.int64)
    return [(low, 1 - (at - low)), (low + 1, at - low)]


def _refined_share(z: np.ndarray, gate: np.ndarray, refined: np.ndarray) -> np.ndarray:
    """Share of ones for a sum: the mean of the sum's own and of what came true for such sums."""
    share = (_odds_to_share(z) + sum(refined[gate, place] * near for place, near in _buckets(z))) / 2
    return np.clip(share, 1e-7, 1 - 1e-7)


def _first_byte_shares(model: dict, nodes: np.ndarray) -> np.ndarray:
    """Share of ones at each node of a word's first byte, by kind, without the word before."""
    words = [bytes([b]) for b in range(256) for _ in range(KINDS + 1)]
    batch = _Batch(words, np.tile(np.arange(KINDS + 1), 256), np.zeros(len(words)))
    events = _Events(batch, model["code"])
    none = {t: np.zeros((2, len(events.bit)), np.float32) for t in (STARTS, STARTS_OF_KIND)}
    x, gate = _Odds(model["tables"].value, leave_one=False).inputs(events, none, slice(0, len(events.bit)))
    share = _refined_share(_weighted(x, model["weights"], gate), gate, model["refined"])
    out = np.full((KINDS + 1, len(nodes)), 0.5)
    first = np.flatnonzero(events.first)
    out[batch.kinds[events.word[first]], np.searchsorted(nodes, events.node[first])] = share[first]
    return out


def _first_byte_gains(model: dict, seen: np.ndarray) -> np.ndarray:
    """What the word before adds to the base 10 logarithm of a token's probability, per cell.

    Two more predictors, the counts of both bits after the same hash, and after the same hash
    and kind, are added to the log odds that the contexts within the word give. A gate picks the
    weights by how much the hash has seen with the kind; they are learned online, by gradient
    steps over the training tokens, each as if it were new.
    """
    code = model["code"]
    nodes = np.unique(code["node"])
    at = np.searchsorted(nodes, code["node"])
    symbol = np.repeat(np.arange(256), code["length"])
    taken = np.zeros((256, len(nodes), 2))
    taken[symbol, at, code["bit"]] = 1
    # counts of both bits by hash, kind and node
    bits = np.einsum("hbk,bnc->hknc", seen.reshape(BEFORE, 256, KINDS + 1), taken, optimize=True)
    share = _first_byte_shares(model, nodes)
    plain = np.broadcast_to(np.log(share / (1 - share)), bits.shape[:3])

    def inputs(lost: int | None, some=slice(None)) -> np.ndarray:
        """Predictors of cells; ``lost`` is a bit of which one occurrence is left out."""
        own, every = bits.reshape(-1, 2)[some], np.broadcast_to(bits.sum(axis=1, keepdims=True), bits.shape).reshape(-1, 2)[some]
        out = [plain.ravel()[some]]
        for counts in (own, every):
            counts = counts.copy()
            if lost is not None:
                counts[:, lost] = np.maximum(counts[:, lost] - 1, 0)
            out.append(np.log((counts[:, 1] + 0.4) / (counts[:, 0] + 0.4)))
        return np.stack(out)

    total = bits.sum(axis=3).ravel()
    gate = np.searchsorted(BEFORE_GATES, total)
    weights = np.tile([1.0, 0.0, 0.0], (len(BEFORE_GATES) + 1, 1))
    power = np.full_like(weights, 1e-2)
    order = np.argsort(_avalanche(np.arange(len(total), dtype=np.uint64) + np.uint64(1)), kind="stable")
    order = order[total[order] > 0]
    flat = bits.reshape(-1, 2)
    for _ in range(BEFORE_ROUNDS):
        for first in range(0, len(order), STEP_EVENTS):
            some = order[first:first + STEP_EVENTS]
            pull, held = np.zeros_like(weights), np.zeros(len(weights))
            for bit in (0, 1):
                x, g, count = inputs(bit, some), gate[some], flat[some, bit]
                error = (bit - _odds_to_share(_weighted(x, weights, g))) * count
                pull += np.stack([np.bincount(g, error * row, len(weights)) for row in x], axis=1)
                held += np.bincount(g, count, len(weights))
            pull /= np.maximum(held, 1)[:, None]
            power += pull ** 2
            weights += STEP * pull / np.sqrt(power)
    mixed = np.clip(_odds_to_share(_weighted(inputs(None), weights, gate)), 1e-7, 1 - 1e-7).reshape(bits.shape[:3])
    gain = np.stack([np.log10((1 - mixed) / (1 - share)), np.log10(mixed / share)], axis=-1)
    return np.einsum("hknc,bnc->hbk", gain, taken, optimize=True).ravel()


def _word_scores(model: dict):
    def rate(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, weights, refined = _Odds(model["tables"].value, leave_one=False), model["weights"], model["refined"]
        heavy = model["heavy"].value if "heavy" in model else _HeavyCounts(np.zeros(0, np.uint64), [])
        for batch in _word_batches(source):
            tables, n = None, len(batch.words)
            if n > MOST_WORDS:          # rows of held-out words, whatever their number, are taken in turn
                learnt = _Events(batch.rows(np.flatnonzero(batch.counts > 0)), model["code"], heavy.starts)
                tables = learnt.deep_tables(*learnt.deep_slots())
            for first in range(0, n, MOST_WORDS):
                rows = np.arange(first, min(n, first + MOST_WORDS))
                some = batch if n <= MOST_WORDS else batch.rows(rows)
                events = _Events(some, model["code"], heavy.starts)
                deep, logp = events.deep_counts(heavy, tables), np.zeros(len(rows))
                for part in _slices(events, len(rows)):
                    x, gate = odds.inputs(events, deep, part)
                    z = _weighted(x, weights, gate)
                    share = _refined_share(z, gate, refined)
                    logp += np.bincount(events.word[part], np.log10(np.where(events.bit[part] == 1, share, 1 - share)), len(rows))
                yield pa.record_batch([
                    pa.array(some.words, pa.binary()), pa.array(some.kinds.astype(np.int32)),
                    pa.array(batch.of_word[rows].astype(np.int64)), pa.array(logp)], names=["word", "kind", "c", "logp"])

    return rate
