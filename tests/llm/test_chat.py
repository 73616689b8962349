import random

from pyspark.sql import functions as F

from clicktrail.llm import chat
from clicktrail.llm.columns import running_starts

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, source string"
PARTS = ["[INST]", "[/INST]", "</s>", "[INST~]", "~", "~0", "~1", "[INST", "</s", "[/", "\n", "é", "ok", " ", "user", "<", "]", "\U0001f600"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "odd", "odd") for r in rows], SCHEMA)


def test_round_trip_of_conflicting_texts_and_spans(spark):
    rng = random.Random(6)

    def text():
        return "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))

    rows = [(c, t, rng.choice(["user", "assistant", text()]), text()) for c in range(150) for t in range(rng.randint(1, 6))]
    rows += [(900, 1, None, None), (900, None, "assistant", "x"), (900, 1, "user", "tie"), (900, 1, "user", "tie"), (None, 1, "assistant", "no id")]
    rows += [(901, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(700)] + [(902, 1, "assistant", "long " * 50_000)]
    got = chat.format_chats(frame(spark, rows)).withColumn("turns", chat.parse(F.col("formatted"))).collect()
    want = {}
    for c, t, role, body in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", body or ""))
    assert {r.conv_id for r in got} == set(want)
    for r in got:
        assert [(t.role, t.text) for t in r.turns] == want[r.conv_id]
        parts = [r.formatted[s.start:s.start + s.length] for s in r.loss_spans]
        for part, (_, body) in zip(parts, [x for x in want[r.conv_id] if x[0] == "assistant"], strict=True):
            assert part == body or part == escaped(body)


def test_the_loss_follows_the_mask(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "é</s>~0 b"), (1, 2, "user", "[INST]"), (1, 3, "assistant", ""), (1, 4, "assistant", "c")]
    made = chat.format_chats(frame(spark, rows))
    moved = F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), s["length"], s["escaped"]))
    fewer = F.slice("loss_spans", 1, 2)

    def loss(spans):
        return made.select(F.array_join(chat.loss_texts(F.col("formatted"), spans), "").alias("loss")).first().loss

    assert loss(F.col("loss_spans")) == "é</s>~0 bc"
    assert len({loss(F.col("loss_spans")), loss(moved), loss(fewer)}) == 3


def escaped(text):
    for plain, written in chat.ESCAPES:
        text = text.replace(plain, written)
    return text


def test_plain_texts_stay_as_they_are_and_control_strings_go(spark):
    rows = [(1, 0, "user", "a ~ b"), (1, 1, "assistant", "</s>[INST] ok [/INST]")]
    r = chat.format_chats(frame(spark, rows)).first()
    assert r.formatted == "[INST]user[/INST]a ~ b</s>[INST~]assistant[/INST]~3>~1] ok ~2]</s>"


def test_text_that_is_no_rendering_has_null_turns(spark):
    odd = ["x[/INST]y</s>", "[INST]user</s>", "[INST]a[/INST]b[INST]</s>", ""]
    got = spark.createDataFrame([(t,) for t in odd], "f string").select(chat.parse(F.col("f")).alias("t")).collect()
    assert [[t.text for t in r.t] for r in got] == [[None], [None], [None], []]


def test_running_starts(spark):
    rng = random.Random(1)
    lists = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 255, 256, 257, 1000)]
    got = spark.createDataFrame([(x,) for x in lists], "x array<int>").select(running_starts(F.col("x")).alias("s")).collect()
    assert [r.s for r in got] == [[sum(x[:i]) for i in range(len(x))] for x in lists]


def test_no_conversations(spark):
    assert chat.format_chats(frame(spark, [])).collect() == []
