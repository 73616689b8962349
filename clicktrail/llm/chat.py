r"""Chat formatting with a grammar round trip, by DataFrame functions only.

    conversation := turn*
    turn         := open role '[/INST]' text '</s>'
    open         := '[INST]' | '[INST~]'

A turn is rendered plainly, parsed again and compared with its source. If role or text come
back changed, because they hold control strings, the turn is rendered with its open mark set
to ``[INST~]`` and control strings escaped, and compared again. The escape writes ``~`` as
``~0`` and the brackets that begin a mark as ``~1`` (``[INST``), ``~2`` (``[/INST``) and
``~3`` (``</s``). None of the marks ends as it begins, so text before a mark never
moves it, and a turn can be judged alone, before turns are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktrail.llm.columns import running_starts

# fixed values: the grammar's marks
OPEN, OPEN_ESCAPED, ROLE_END, TURN_END = "[INST]", "[INST~]", "[/INST]", "</s>"
ESCAPES = [("~", "~0"), ("[INST", "~1"), ("[/INST", "~2"), ("</s", "~3")]


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def render_turn(role: Column, text: Column, escaped: bool) -> Column:
    mark = OPEN_ESCAPED if escaped else OPEN
    if escaped:
        role, text = escape(role), escape(text)
    return F.concat(F.lit(mark), role, F.lit(ROLE_END), text, F.lit(TURN_END))


def parse_turn(piece: Column) -> Column:
    """Struct of ``role``, ``text``, ``at`` (where the text begins), ``length`` as written and ``escaped``.

    ``piece`` is a turn without its turn end. A piece that has no open mark, no role end or a
    further mark in its text is no turn: role and text are null.
    """
    escaped = F.startswith(piece, F.lit(OPEN_ESCAPED))
    mark = F.when(escaped, len(OPEN_ESCAPED)).when(F.startswith(piece, F.lit(OPEN)), len(OPEN))
    cut = F.locate(ROLE_END, piece)
    role = F.substring(piece, mark + 1, cut - mark - 1)
    text = F.substring(piece, cut + len(ROLE_END), F.length(piece))
    ok = (cut > 0) & mark.isNotNull() & ~F.contains(text, F.lit("[INST")) & ~F.contains(text, F.lit("[/INST"))

    def read(part: Column) -> Column:
        return F.when(ok, F.when(escaped, unescape(part)).otherwise(part))

    return F.struct(read(role).alias("role"), read(text).alias("text"),
                    (cut - 1 + len(ROLE_END)).cast("long").alias("at"), F.length(text).alias("length"),
                    escaped.alias("escaped"))


def parse(formatted: Column) -> Column:
    """Array of the turns of a conversation, as :func:`parse_turn` reads them."""
    pieces = F.split(formatted, TURN_END)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), parse_turn)


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``loss_spans``.

    ``turns`` has ``conv_id``, ``turn``, ``role``, ``text``. Rows are taken by turn, equal turn
    numbers by role and text, so repeated rows are repeated turns. Null roles and texts are
    empty, a null turn number comes first, and rows with a null ``conv_id`` are one
    conversation. ``loss_spans`` are start and length, in code points of ``formatted``, of each
    assistant text as written, and whether it is escaped. A text that would not come back the same is an error, not a
    row. A conversation is one value, so the longest one has to fit into a row; other columns
    are ignored and an empty table gives no rows.
    """
    rows = turns.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                            F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("source"))
    written = gathered.select("conv_id", "source", F.array_join(F.transform("source", _until_identical), "").alias("formatted"))
    parsed = written.select("conv_id", "source", "formatted", parse(F.col("formatted")).alias("turns"))
    same = F.to_json(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))) == F.to_json(
        F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    checked = parsed.select(
        "conv_id", F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation was not read back"))).alias("formatted"),
        "turns", F.split("formatted", TURN_END).alias("pieces"))
    starts = running_starts(F.transform("pieces", lambda p: F.length(p) + len(TURN_END)))
    spans = F.zip_with("turns", starts, lambda t, at: F.when(
        t["role"] == "assistant", F.struct(
            (at + t["at"]).alias("start"), t["length"].cast("long").alias("length"), t["escaped"].alias("escaped"))))
    return checked.select("conv_id", "formatted", F.array_compact(spans).alias("loss_spans"))


def loss_texts(formatted: Column, loss_spans: Column) -> Column:
    """The texts under the loss mask: cut out of ``formatted`` by the spans, and unescaped."""
    def text(span: Column) -> Column:
        inside = F.substring(formatted, (span["start"] + 1).cast("int"), span["length"].cast("int"))
        return F.when(span["escaped"], unescape(inside)).otherwise(inside)

    return F.transform(loss_spans, text)


def _until_identical(turn: Column) -> Column:
    """The plainest rendering of a turn that is read back as it was."""
    def comes_back(rendered: Column) -> Column:
        back = parse_turn(F.substring(rendered, F.lit(1), F.length(rendered) - len(TURN_END)))
        alone = F.locate(TURN_END, rendered) == F.length(rendered) - len(TURN_END) + 1
        return alone & back["role"].eqNullSafe(turn["role"]) & back["text"].eqNullSafe(turn["text"])

    plain, escaped = (render_turn(turn["role"], turn["text"], e) for e in (False, True))
    return F.when(comes_back(plain), plain).when(comes_back(escaped), escaped).otherwise(
        F.raise_error(F.lit("a turn was not read back")).cast("string"))
