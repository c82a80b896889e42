"""Chat formatting: conversations rebuilt from event logs, rendered, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of the template. Each holds a bracket or "<", which texts never do once escaped.
OPEN, CLOSE, USER, USER_END, ROLE, ROLE_END = "<s>", "</s>", "[INST]", "[/INST]", "[ROLE:", "]"


def escape(text: Column) -> Column:
    """Replace the characters that control strings need: backslash, square brackets and "<"."""
    for plain, code in (("\\", "\\\\"), ("[", "\\l"), ("]", "\\r"), ("<", "\\g")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """Undo :func:`escape`. Pieces between doubled backslashes hold only the other codes."""

    def piece(x: Column) -> Column:
        for plain, code in (("[", "\\l"), ("]", "\\r"), ("<", "\\g")):
            x = F.replace(x, F.lit(code), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\"), piece), "\\")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages from a log of ``conv_id, turn, part, seq, kind, role, text``.

    Kinds: ``message`` and ``edit`` set the text of a turn, ``regenerate`` empties it (or sets
    it, if it has a text), ``delta`` adds to it. Events apply in order of ``seq``, at equal
    ``seq`` by kind and text. The last role named holds. Null texts are empty; a log whose first
    event is a delta starts from an empty text. ``part`` tells messages of one turn apart. Other
    columns are ignored. A turn's events meet in one task; those of a conversation need not.
    """
    resets = F.col("kind").isin("message", "edit", "regenerate")
    event = F.struct("seq", resets.cast("int").alias("reset"), F.coalesce("text", F.lit("")).alias("text"))
    turn = events.groupBy("conv_id", "turn", "part").agg(
        F.array_sort(F.collect_list(event)).alias("log"),
        F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role")))["role"].alias("role"),
    )
    from_last = F.expr("slice(log, greatest(1, size(log) + 1 - array_position(transform(reverse(log), e -> e.reset), 1)), size(log))")
    log = F.when(F.exists("log", lambda e: e["reset"] == 1), from_last).otherwise(F.col("log"))
    return turn.select("conv_id", "turn", "part", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform(log, lambda e: e["text"]), "").alias("text"))


def event_log(conversations: DataFrame) -> DataFrame:
    """A log of events whose fold gives the rows of ``conv_id, turn, role, text``.

    Rows of every third turn are one message; those of the next are an empty message and three
    deltas; those of the third are a draft, an edit of it, a regeneration, and two deltas of the
    final text. Rows that share a turn are told apart by ``part``, in order of role and text.
    """
    part = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("part", part)
    event = lambda seq, kind, role, text: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    role, text, none = F.col("role"), F.col("text"), F.lit(None).cast("string")
    n = F.char_length(text)
    third, half = F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int")
    cut = lambda start, length: F.substring(text, start + 1, length)
    streamed = F.array(event(0, "message", role, F.lit("")), event(1, "delta", none, cut(F.lit(0), third)), event(2, "delta", none, cut(third, third)), event(3, "delta", none, cut(2 * third, n)))
    again = F.array(
        event(0, "message", role, F.lit("draft")), event(1, "edit", none, F.concat(text, F.lit("?"))), event(2, "regenerate", none, none),
        event(3, "delta", none, cut(F.lit(0), half)), event(4, "delta", none, cut(half, n)),
    )
    whole = F.array(event(0, "message", role, text))
    kind = F.pmod(F.coalesce("turn", F.lit(0)), F.lit(3))
    return rows.select("conv_id", "turn", "part", F.inline(F.when(kind == 1, streamed).when(kind == 2, again).otherwise(whole)))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``n_turns``, ``formatted`` and ``loss_spans``.

    Turns stand in order of ``turn`` and ``part``. A user's text stands between [INST] and
    [/INST], any other role is named before its text. ``loss_spans`` are start (from 0) and
    length in code points of the assistant's texts in ``formatted``. A conversation is one row,
    so its turns meet in one task.
    """
    user = F.col("role") == "user"
    head = F.concat(F.lit(OPEN), F.when(user, F.lit(USER)).otherwise(F.concat(F.lit(ROLE), escape(F.col("role")), F.lit(ROLE_END))))
    body = escape(F.col("text"))
    tail = F.when(user, F.lit(USER_END + CLOSE)).otherwise(F.lit(CLOSE))
    order = Window.partitionBy("conv_id").orderBy("turn", "part")
    pieces = messages.select("conv_id", "turn", "part", F.col("role"), head.alias("head"), body.alias("body"), tail.alias("tail"))
    pieces = pieces.withColumn("piece", F.concat("head", "body", "tail")).withColumn(
        "start", F.sum(F.char_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.char_length("piece") + F.char_length("head")
    )
    turns = F.array_sort(F.collect_list(F.struct("turn", "part", "piece", "start", F.char_length("body").alias("length"), (F.col("role") == "assistant").alias("loss"))))
    return (
        pieces.groupBy("conv_id")
        .agg(turns.alias("turns"))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.array_join("turns.piece", "").alias("formatted"),
            F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss_spans"),
        )
    )


def parse(formatted: DataFrame) -> DataFrame:
    """Read ``formatted`` back: adds ``turns``, an array of role and text, and ``loss_text``, all text
    under ``loss_spans``, unescaped."""

    def turn(piece: Column) -> Column:
        body = F.substring_index(piece, OPEN, -1)
        user = body.startswith(USER)
        text = F.when(user, F.replace(F.replace(body, F.lit(USER), F.lit("")), F.lit(USER_END), F.lit(""))).otherwise(F.substring_index(body, ROLE_END, -1))
        role = F.when(user, F.lit("user")).otherwise(unescape(F.replace(F.substring_index(body, ROLE_END, 1), F.lit(ROLE), F.lit(""))))
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    pieces = F.filter(F.split("formatted", CLOSE), lambda p: p != "")
    read = formatted.withColumn("turns", F.transform(pieces, turn))
    return read.withColumn("loss_text", F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"].cast("int") + 1, s["length"].cast("int")))), ""))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Render a table of ``conv_id, turn, role, text`` and read it back.

    Each row is one message, also where rows repeat; rows of one turn stand in order of role and
    text. A null conversation id is a conversation of its own, null turns come first, null roles
    and texts are empty.
    """
    part = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    events = conversations.select("conv_id", "turn", "role", "text").withColumn("part", part)
    events = events.withColumns({"seq": F.lit(0), "kind": F.lit("message")})
    return parse(render(fold_events(events)))
