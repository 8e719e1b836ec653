"""Chat formatting: a finite-state machine over roles, segments with loss flags, from a template.

The template is plain data: a header per role, whose text is under the loss, and the role that may
follow each role. ``format_chats`` gives one row per conversation: the segments, the formatted text,
and whether the turn order is one that the machine accepts. Control strings inside texts are escaped
so that ``read_chats`` gets every role and text back from the output. Everything is native Spark.

Escapes: a backslash becomes two, ``#`` becomes ``\\#``, and the ``/`` of ``</`` becomes ``\\/``; so
neither ``###`` nor ``</turn>`` can occur inside an escaped text, and every backslash in it is
followed by the one character that it stands before.

Defined results: turns are ordered by turn, then role and text (null turns first); repeated rows are
turns of their own; a null text or role is empty; a role that the template does not name gets a
header of its own and makes the conversation invalid; rows with a null conversation id form one
conversation; an empty table gives an empty result. A conversation is one row of the output, so its
whole text has to fit one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: role → header; roles under the loss; state → roles that may follow; states in which a chat may end.
TEMPLATE = {
    "headers": {"system": "System", "user": "User", "assistant": "Assistant"},
    "loss": ["assistant"],
    "next": {"": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
    "end": ["assistant"],
}
BEGIN, AFTER_HEADER, END = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("#"), F.lit("\\#")), F.lit("</"), F.lit("<\\/"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _lookup(mapping: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[key] if mapping else F.lit(None)


def format_chats(turns: DataFrame, template: dict = TEMPLATE, *, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, segments (text, loss), formatted, valid, bad_turn (index of the first turn out of order)."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"),
                        F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # the machine: state = the last role, "?" once a role was out of order
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, bs in template["next"].items() for b in bs])
    step = lambda s, t: F.struct(
        F.when(F.array_contains(allowed, F.concat(s["state"], F.lit(">"), t["role"])), t["role"])
        .otherwise(F.lit("?")).alias("state"), (s["n"] + F.lit(1)).alias("n"),
        F.when(s["bad"].isNull() & ~F.array_contains(allowed, F.concat(s["state"], F.lit(">"), t["role"])), s["n"])
        .otherwise(s["bad"]).alias("bad"))
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))
    machine = F.aggregate("turns", start, step)
    # unknown roles: their name in URL escapes, which hold no control character, behind a mark of their own
    header = lambda r: F.coalesce(_lookup(template["headers"], r), F.concat(F.lit("="), F.url_encode(r)))
    loss = F.array(*[F.lit(x) for x in template["loss"]]) if template["loss"] else F.array().cast("array<string>")
    segment = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        segment(F.concat(F.lit(BEGIN), header(t["role"]), F.lit(AFTER_HEADER)), F.lit(False)),
        segment(escape(t["text"]), F.array_contains(loss, t["role"])),
        segment(F.lit(END), F.lit(False)))))
    out = chats.select("conv_id", segments.alias("segments"), machine.alias("machine"))
    ends = F.array(*[F.lit(x) for x in template["end"]])
    return out.select("conv_id", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"),
                      (F.col("machine.bad").isNull() & F.array_contains(ends, F.col("machine.state"))).alias("valid"),
                      F.col("machine.bad").alias("bad_turn"))


def _turns(template: dict) -> Column:
    """The turns (role, text) that the column ``formatted`` holds."""
    back = {h: r for r, h in template["headers"].items()}
    parts = F.split(F.col("formatted"), END, -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)  # what follows the last end is empty

    def turn(part: Column) -> Column:
        head = F.substring_index(part, AFTER_HEADER, 1)
        name = F.substr(head, F.lit(len(BEGIN) + 1))
        text = F.substr(part, F.length(head) + F.lit(len(AFTER_HEADER) + 1))
        role = F.coalesce(_lookup(back, name), F.url_decode(F.substr(name, F.lit(2))))
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def read_chats(formatted: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """``conv_id`` and ``turns`` (role, text), read back from the column ``formatted``."""
    return formatted.select("conv_id", _turns(template).alias("turns"))


def chat_digests(formatted: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """The digests of what is read back from the output of ``format_chats``, and the machine's verdict:
    ``valid``, and ``bad_turn`` (-1 if no turn is out of order)."""
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")
    read = formatted.select("conv_id", "formatted", "valid", "bad_turn", unescape(loss).alias("loss_text"), _turns(template).alias("turns"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
        F.coalesce("bad_turn", F.lit(-1)).cast("long").alias("bad_turn"))
