"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as
context, its reply as the only trainable text.  Turns that follow the last
reply, and conversations without one, are kept in one more example in which
nothing is trainable, so no turn is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed values of the template: opening and closing mark by role; other roles are named in their turn.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE]", "[/ROLE]")
TRAINED = "assistant"

_ALL = [m for pair in (*MARKS.values(), OTHER) for m in pair]
#: What may follow the first bracket of a mark; the longest first.
_TAILS = "|".join(x.replace("[", r"\[").replace("]", r"\]") for x in sorted((m[1:] for m in _ALL), key=len, reverse=True))
ESCAPE = rf"([<\[])(\\*)({_TAILS})"
UNESCAPE = rf"([<\[])\\(\\*)({_TAILS})"
_quote = lambda m: m.replace("[", r"\[").replace("]", r"\]")
TURN = (
    "(?s)(" + "|".join(_quote(o) for o, _ in (*MARKS.values(), OTHER)) + ") (.*?) ("
    + "|".join(_quote(c) for _, c in (*MARKS.values(), OTHER)) + ")\n"
)


def escape(text: Column) -> Column:
    """A backslash behind the first bracket of every control string, before those that stand there already."""
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def _one_line(role: Column) -> Column:
    """A role without line breaks: these end its line in a turn."""
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _lines(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _by_role(role: Column, which: int) -> Column:
    out = F.lit(OTHER[which])
    for name, pair in MARKS.items():
        out = F.when(role == name, F.lit(pair[which])).otherwise(out)
    return out


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, target_turn, n_turns, text, loss_start, loss_chars), one row per assistant turn.

    ``target_turn`` is the 1-based place of the reply among the turns of the
    conversation; the loss mask is ``loss_chars`` code points from
    ``loss_start`` (0-based) and covers the escaped reply without its marks.
    A row with ``loss_chars`` null closes a conversation that doesn't end with
    a reply.

    Turns are ordered by turn (null last), equal turns by role, then text;
    repeated rows are turns of their own.  Null role and null text are empty,
    rows with a null conv_id form one conversation, further columns are
    ignored, an empty table gives no example.  A conversation is one row of
    the result, so it must fit in a task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    other = ~role.isin(*MARKS)
    piece = F.concat(
        _by_role(role, 0), F.lit(" "), F.when(other, F.concat(escape(_one_line(role)), F.lit("\n"))).otherwise(F.lit("")),
        escape(text), F.lit(" "), _by_role(role, 1), F.lit("\n"),
    )
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"), role.alias("role"), text.alias("raw"), piece.alias("piece")
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    places = F.filter(F.sequence(F.lit(1), n), lambda i: (F.get("turns", i - 1)["role"] == TRAINED) | (i == n))
    rows = whole.select("conv_id", "turns", F.explode(places).alias("target_turn"))
    last = F.get("turns", F.col("target_turn") - 1)
    body = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("target_turn")), lambda t: t["piece"]), "")
    is_reply = last["role"] == TRAINED
    opened, closed = (len(m) + 1 for m in MARKS[TRAINED])
    made = rows.select(
        "conv_id", F.col("target_turn").cast("bigint").alias("target_turn"), n.cast("bigint").alias("n_turns"),
        body.alias("text"), is_reply.alias("_reply"), F.length(last["piece"]).alias("_piece"),
    )
    return made.select(
        "conv_id", "target_turn", "n_turns", "text",
        F.when(F.col("_reply"), (F.length("text") - F.col("_piece") + opened).cast("bigint")).alias("loss_start"),
        F.when(F.col("_reply"), (F.col("_piece") - opened - closed - 1).cast("bigint")).alias("loss_chars"),
    )


def turns_of(text: Column) -> Column:
    """The turns of a formatted text as array<struct<role, text>>, unescaped."""
    def parsed(piece: Column) -> Column:
        mark = F.regexp_extract(piece, TURN, 1)
        inner = F.regexp_extract(piece, TURN, 2)
        role = F.lit(None).cast("string")
        for name, (opened, _) in MARKS.items():
            role = F.when(mark == opened, F.lit(name)).otherwise(role)
        named = F.locate("\n", inner)
        return F.struct(
            F.coalesce(role, _lines(unescape(F.substring(inner, F.lit(1), named - 1)))).alias("role"),
            unescape(F.when(role.isNotNull(), inner).otherwise(F.substring(inner, named + 1, F.length(inner)))).alias("text"),
        )

    return F.transform(F.regexp_extract_all(text, F.lit(TURN), F.lit(0)), parsed)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of every conversation from its examples alone: the last holds all turns, the masks all replies."""
    loss = unescape(F.substring("text", F.col("loss_start").cast("int") + 1, F.col("loss_chars").cast("int")))
    whole = F.max_by("text", "target_turn")
    masked = F.array_join(
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("loss_chars").isNotNull(), F.struct("target_turn", loss.alias("loss"))))),
            lambda x: x["loss"],
        ),
        "",
    )
    grouped = formatted.groupBy("conv_id").agg(
        whole.alias("whole"), masked.alias("masked"), F.sum(F.length("text")).cast("bigint").alias("formatted_chars"),
    )
    # Both helpers are columns of their own, so that the text is parsed once.
    parsed = grouped.select("conv_id", turns_of(F.col("whole")).alias("turns"), "masked", "formatted_chars")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("masked").cast("bigint").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), "formatted_chars",
    )
