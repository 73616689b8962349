import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from clicktrail.llm import middle
from clicktrail.llm.middle import Fenwick, Units


def brute(doc, text):
    """By the list of all units."""
    text, name = text or "", "" if doc is None else str(doc)
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"1:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return len(u), "plain", None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return len(u), "spm" if h4 % 100 < 20 else "psm", len(p), len(m), out


def test_rows_equal_the_list_of_units_and_come_back(spark, docs_frame, odd_docs):
    extra = [(2000 + i, t) for i, t in enumerate(
        ["<", "P>", "<P", "a<P>b", "<S>", "<M", "M><S", "<<", "<P<S<M", "x y", "\U0001f600ab\U0001f600", "A" * 5000, "é" * 5000, "a1" * 4097] * 6)]
    docs = docs_frame.select("doc_id", "text", "lang", "slice").unionByName(
        spark.createDataFrame([(i, t, "n", 1) for i, t in extra], "doc_id long, text string, lang string, slice int"))
    got = middle.fill_in_middle(docs).withColumn("back", middle.restore(F.col("output"), F.col("form"))).collect()
    want = [(i, *brute(i, t), t or "") for i, t, *_ in [*odd_docs, *extra]]
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("block", [1, 2, 3, 7, 4096])
def test_places_of_all_cuts(block):
    rng = random.Random(block)
    for n in (0, 1, 2, 5, 40, 200):
        text = "".join(rng.choice("aZ bé\n5\U0001f600[`{@") for _ in range(n))
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        made = Units(text, block)
        assert made.n == len(units)
        assert [made.place(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def test_a_cut_between_blocks_without_units():
    # one word over many blocks: its unit begins in the first, all others hold none
    made = Units("a" * 100 + " b", 8)
    assert (made.n, [made.place(k) for k in range(4)]) == (3, [0, 100, 101, 102])


def test_fenwick_sums():
    import numpy as np
    rng = random.Random(3)
    sums = np.array([(rng.randint(0, 3), 5) for _ in range(37)])
    tree = Fenwick(sums)
    for k in range(int(sums[:, 0].sum()) + 2):
        at = max(i for i in range(38) if sums[:i, 0].sum() <= k)
        assert tree.find(k) == (at, sums[:at, 0].sum(), 5 * at)


def test_no_documents(spark, no_docs):
    assert middle.fill_in_middle(no_docs).collect() == []
