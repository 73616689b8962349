import math
import random
import re

from clicktrail.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_spans(text, classes=secrets.CLASSES, allow=secrets.ALLOW):
    text, out = text or "", []
    out += [(m.start(), 1, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 2, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 3, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    for no, c in enumerate(classes, 4):
        for m in re.finditer(f"{c.chars}+", text):
            run = m[0]
            if len(run) < c.window or any(re.search(p, run) for p in allow):
                continue
            hot = []
            for i in range(len(run) - c.window + 1):
                part = run[i:i + c.window]
                h = -sum(part.count(x) / c.window * math.log2(part.count(x) / c.window) for x in set(part))
                if h >= c.bits:
                    hot.append(i)
            if hot:
                out.append((m.start() + hot[0], no, m.start() + hot[-1] + c.window, c.kind))
    return sorted(out)


def compare(frame):
    rows = secrets.scan_secrets(frame).collect()
    for r in rows:
        assert [tuple(s) for s in r.secrets] == plain_spans(r.row.text), (r.row.text or "")[:200]
    return rows


def test_odd_documents(docs_frame, odd_docs):
    assert len(compare(docs_frame)) == len(odd_docs)


def test_random_texts_full_of_secrets(spark):
    rng = random.Random(9)
    parts = ["password=", "Secret: '", "API_KEY = \"", "token:", "AKIA", "AKIAAKIA", "0123456789abcdef", "ABCDEFGHIJKL12", "é", "\U0001f600",
             "\n", " ", "deadbeef", "aB3+/x9Z", "example", "123e4567-e89b-12d3-a456-426614174000", "kQ9_zT", "=", "x" * 30, "thequickbrownfox"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts.append(" ".join(rng.choice(parts) * rng.randint(1, 4) for _ in range(3000)))
    rows = compare(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    kinds = {s.kind for r in rows for s in r.secrets}
    assert kinds == {"assign", "access", "hex", "entropy_hex", "entropy_base64"}


def test_allow_list_suppresses_only_entropy_spans(spark):
    run = "kQ9zTaB3xW7vLp2RmN5sYc8d"
    frame = spark.createDataFrame([(1, f"{run} token={run}")], "doc_id long, text string")
    plain = secrets.scan_secrets(frame).first().secrets
    allowed = secrets.scan_secrets(frame, allow=[*secrets.ALLOW, f"^{run}$"]).first().secrets
    assert [s.kind for s in plain] == ["entropy_base64", "assign", "entropy_base64"]
    assert [s.kind for s in allowed] == ["assign", "entropy_base64"]    # the run with its name is another candidate


def test_no_documents(no_docs):
    assert secrets.scan_secrets(no_docs).collect() == []


def test_very_long_runs(spark):
    rng = random.Random(4)
    base64 = "".join(rng.choice("GHIJKLMNOPghijklmnop0123456789+/") for _ in range(1 << 20))
    n = 10 ** 6
    texts = ["-" * n, "=" * n, "a-" * (n // 2), "_a+" * (n // 3), "token" + " " * n, "password=" + "x" * n, "0" * n, "A" * n + "1",
             "AKIA" * (n // 4), base64]
    rows = secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    kinds = {r.row.doc_id: [s.kind for s in r.secrets] for r in rows}
    assert kinds == {0: [], 1: [], 2: [], 3: [], 4: [], 5: ["assign"], 6: ["hex"], 7: [], 8: ["access"], 9: ["entropy_base64"]}


def test_a_window_that_moves_counts_as_one_counted_afresh(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(chars) for _ in range(400)) for chars in ("0123456789abcdef", "01ab", "aB3+/x9ZkQ_zT=-") for _ in range(20)]
    compare(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
