import hashlib
import random
import zlib

import numpy as np
import pytest

from clicktrail.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, words long, node string, depth int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "odd", 5, "odd", 7) for r in rows], SCHEMA)


def words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return sum(bool(w) for w in text.split(" "))


def brute(rows):
    """Nodes of the trie, by grouping prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for c, turns in own.items():
        turns.sort(key=lambda t: (*t[:3], hashlib.md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()))
        own[c] = [t[2:] for t in turns]
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20)), [])[:h] + own[c][h:])
    members = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    saved = {n: (len(m) - 1) * words(n[-1][1]) if n else 0 for n, m in members.items()}
    leaf = {n: all(len(whole[c]) == len(n) for c in m) for n, m in members.items()}
    out = {}
    for n, m in members.items():
        below = [k for k in members if k[:len(n)] == n]
        ends = ",".join(map(str, sorted(c for c in m if whole[c] == n)))
        out[min(m), len(n)] = (
            min(members[n[:-1]]) if n else None, len(m), sum(len(k) == len(n) + 1 for k in below), sum(leaf[k] for k in below),
            sum(saved[k] for k in below), hashlib.sha256(ends.encode()).hexdigest())
    assert len(out) == len(members)
    return out


def nodes(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def talks(rng, n):
    say = ["", "a b", "x", "one two three", None, " \t\n"]
    for c in range(n):
        kind = rng.random()
        length = 0 if kind < 0.1 else rng.randint(1, 6)
        for t in range(length):
            # a third are copies, two thirds share their first turn
            text = "same words" if kind < 0.4 or t == 0 and kind < 0.75 else rng.choice(say)
            yield c, t, "user" if t % 2 == 0 else "assistant", text


@pytest.mark.parametrize("block_rows, block_turns", [(1, 10), (3, 100), (7, 9), (10_000, 10_000)])
def test_nodes_equal_grouped_prefixes_whatever_the_blocks(spark, block_rows, block_turns):
    rng = random.Random(block_rows)
    rows = list(talks(rng, 150))
    rows += [(-21, 0, "user", "x"), (-20, 0, "user", "same words"), (-20, 1, None, None), (None, 0, "user", "x")]
    rows += [(300, None, "user", "null first"), (300, 1, "user", "tie"), (300, 1, "user", "tie"), (300, 1, "assistant", "tie"),
             (301, 1, "b", "p"), (301, 1, "a", "q"), (301, 1, "a", "o"), (320, 5, "ab", "c"), (340, 5, "a", "bc")]
    rows += [(400, t, "user", f"turn {t % 3}") for t in range(60)] + [(420, 0, "user", "long " * 100_000)]
    rng.shuffle(rows)
    got = nodes(prefix_trie.prefix_trie(prefix_trie.rebuilt(frame(spark, rows)), block_rows, block_turns))
    assert got == brute(rows)


def test_no_conversations(spark):
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(frame(spark, []))).collect() == []


def test_all_turnless(spark):
    # a conversation of fewer turns than it gives up, with none to take over
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 1)
    got = nodes(prefix_trie.prefix_trie(prefix_trie.rebuilt(frame(spark, [(c, 0, "user", "x")]))))
    assert got == {(c, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}


def test_ids_of_equal_conversations_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    rows = [(20 * c, t, "user", "same") for c in range(60) for t in range(4)]
    assert nodes(prefix_trie.prefix_trie(prefix_trie.rebuilt(frame(spark, rows)), 25)) == brute(rows)


def test_extents_over_the_sparse_table():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64):
        shared = rng.integers(0, 4, n - 1)
        table = prefix_trie.sparse_table(shared)
        row, depth = (a.ravel() for a in np.meshgrid(np.arange(n), np.arange(1, 4)))
        left, right = prefix_trie.left_extent(table, row, depth), prefix_trie.right_extent(table, row, depth, n)
        for i, d, a, b in zip(row, depth, left, right):
            assert (shared[a:i] >= d).all() and (a == 0 or shared[a - 1] < d)
            assert b == n - 1 or shared[b] < d
