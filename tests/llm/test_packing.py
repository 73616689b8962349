import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from clicktrail.llm import packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(VOCABULARY)


def check(rows, docs, whole, capacity):
    sequences, by_doc = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
        assert sum(n for _, n in parts) <= capacity
    want = {}
    for i, text, *_ in docs:
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        n, first = len(ids), (len(ids) - 1) % capacity + 1
        at = 0
        for piece, end in enumerate(range(first, n + 1, capacity)):
            want.setdefault(i, []).append((piece, at, end - at, zlib.crc32(ids[at:end].tobytes())))
            at = end
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    return len(sequences)


def test_odd_documents(docs_frame, odd_docs, whole):
    pieces = packing.token_pieces(docs_frame, packing.byte_bpe(VOCABULARY))
    rows = packing.pack(pieces).collect()
    n = check(rows, odd_docs, whole, packing.CAPACITY)
    assert n <= -(-sum(r.length for r in rows) // packing.CAPACITY) + 1


def test_tree_of_tasks_keeps_every_piece_and_packs_well(spark, whole):
    rng = random.Random(2)
    docs = [(i, "word " * rng.choice([1, 3, 11, 12, 13, 30, 31, 45])) for i in range(900)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    pieces = packing.token_pieces(frame, packing.byte_bpe(VOCABULARY), 32)
    rows = packing.pack(pieces, 32, per_task=20).collect()
    n = check(rows, docs, whole, 32)
    rest = np.array([r.length for r in rows if r.length < 32])
    best = len(packing.best_fit(rest, 32)) + sum(r.length == 32 for r in rows)
    assert n <= best * 1.05 + 2


def test_ids_equal_the_tokenizer_on_odd_text(whole):
    encode = packing.byte_bpe(VOCABULARY)()
    rng = random.Random(4)
    texts = ["", "<|endoftext|>", " a  b\n\n c\t", "it's we'll I'D", "äöü ß é x", "日本語 text", "١٢٣ ²³", "\x00\x7f\x80"]
    alphabet = "abc XYZ09'.,\n\téß ’—́\U0001f600"
    texts += ["".join(rng.choice(alphabet) for _ in range(80)) for _ in range(200)]
    for t in texts:
        assert encode(t) == whole.encode(t, add_special_tokens=False).ids, t


def test_best_fit_takes_the_tightest_bin():
    bins = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert sorted(sorted(b) for b in bins) == [[0, 2], [1, 3, 4]]


def test_no_documents(no_docs):
    assert packing.pack(packing.token_pieces(no_docs, packing.byte_bpe(VOCABULARY))).collect() == []


@pytest.fixture(scope="module")
def encode():
    return packing.byte_bpe(VOCABULARY)()


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\r\n", "\u00a0", " \n"])
def test_long_white_space(whole, encode, blank):
    for text in (blank * 10 ** 6 + "a", "a" + blank * (packing.LONGEST_BLANK - 1) + "a", "a" + blank * packing.LONGEST_BLANK, blank * packing.LONGEST_BLANK):
        assert encode(text) == whole.encode(text, add_special_tokens=False).ids


def test_other_long_runs(whole, encode):
    for text in ("-" * 10 ** 6, "a" * 10 ** 5, "1" * 10 ** 5, "'s" * 10 ** 5, "é" * 10 ** 5, "a " * 10 ** 5, "\x00" * 10 ** 5):
        assert encode(text) == whole.encode(text, add_special_tokens=False).ids
