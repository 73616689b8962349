import random

import xxhash

from clicktrail.llm import simhash


def plain_fingerprint(text, n=4):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    tokens = [t for t in text.split(" ") if t]
    shingles = [" ".join(tokens[i:i + n]) for i in range(max(1, len(tokens) - n + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints, radius=4):
    """Smallest fingerprint reachable, for fingerprints."""
    prints = sorted(set(prints))
    found = {f: f for f in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= radius and found[a] != found[b]:
                    found[a] = found[b] = min(found[a], found[b])
                    changed = True
    return found


def test_fingerprints_and_groups_of_odd_documents(docs_frame, odd_docs):
    got = simhash.simhash_groups(docs_frame).collect()
    want = [(i, plain_fingerprint(t)) for i, t, _ in odd_docs]
    assert sorted((r.doc_id or -1, r.fp % (1 << 64)) for r in got) == sorted((i or -1, f) for i, f in want)
    group = plain_components([f for _, f in want])
    least = {}
    for i, f in want:
        least[group[f]] = min((x for x in (i, least.get(group[f])) if x is not None), default=None)
    for r in got:
        assert r.component_id == least[group[r.fp % (1 << 64)]], r
    assert {r.component_id for r in got if r.doc_id in (13, 14, 15)} == {13}


def test_rows_of_one_id_are_linked_by_their_texts_alone(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, a), (2, a), (2, b), (3, b), (None, b), (None, "no id at all in here"), (4, None)]
    got = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted(
        [("1", "1"), ("2", "1"), ("2", "2"), ("3", "2"), ("None", "2"), ("None", "None"), ("4", "4")])
    assert len({r.group for r in got}) == 4


def test_links_by_bits_equal_brute_force_also_when_prefixes_split(spark, monkeypatch):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = set(base)
    for b in base:
        for _ in range(12):
            v = rng.choice([b, *prints])
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                v ^= 1 << bit
            prints.add(v)
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(sorted(prints))]
    group = plain_components([v % (1 << 64) for _, v in rows])
    smallest = {}
    for i, v in rows:
        smallest.setdefault(group[v % (1 << 64)], i)
    want = {i: smallest[group[v % (1 << 64)]] for i, v in rows}
    nodes = spark.createDataFrame(rows, "rep long, fp long")
    for most in (1 << 23, 2000):
        monkeypatch.setattr(simhash, "VARIANTS_AT_MOST", most)
        got = {r.node: r.component for r in simhash.components(simhash.ball_links(nodes, 4)).collect()}
        assert {i: got.get(i, i) for i, _ in rows} == want


def test_no_documents(no_docs):
    assert simhash.simhash_groups(no_docs).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.range(200).selectExpr("(id * 37) % 201 as u", "((id + 1) * 37) % 201 as v")
    got = {r.node: r.component for r in simhash.components(links).collect()}
    assert got == dict.fromkeys(range(1, 201), 0)
