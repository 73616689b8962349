import zlib

import numpy as np

from clicktrail.llm import lines

BLANK = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def plain(docs):
    first = {}
    for i, text, _ in docs:
        for line in (text or "").split("\n"):
            if i is not None and len(key_of(line)) >= 10:
                first[key_of(line)] = min(first.get(key_of(line), i), i)
    return [[i is None or len(key_of(line)) < 10 or first[key_of(line)] == i for line in (text or "").split("\n")]
            for i, text, _ in docs]


def check(docs, frame):
    bitmaps = lines.line_dedup(frame)
    got = sorted((str(r.row.doc_id), str(r.row.text), str(r.kept), r.n_lines, r.n_dropped) for r in lines.kept_text(frame, bitmaps).collect())
    want = []
    for (i, text, _), keep in zip(docs, plain(docs)):
        kept = None if text is None else "\n".join(line for line, k in zip(text.split("\n"), keep) if k)
        want.append((str(i), str(text), str(kept), len(keep), keep.count(False)))
    assert got == sorted(want)
    return bitmaps


def test_odd_documents(docs_frame, odd_docs):
    for r in check(odd_docs, docs_frame).collect():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r.keep), "u1"), count=r.n_lines)
        assert (bits == 0).sum() == r.n_dropped > 0


def test_a_very_common_line_over_many_partitions(spark):
    hot = "a line that is everywhere"
    docs = [(i, f"{hot}\nown line number {i}\n{hot.title()}\nshared by {i % 7} only", None) for i in range(400)]
    check(docs, spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").repartition(5))


def test_no_documents(no_docs):
    assert lines.line_dedup(no_docs).collect() == []
    assert lines.kept_text(no_docs, lines.line_dedup(no_docs)).collect() == []
