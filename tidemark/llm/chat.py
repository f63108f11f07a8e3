"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of the output::

    conversation := turn*
    turn         := "<|im_start|>" role "\\n" body "<|im_end|>" "\\n"

A deterministic parser (:func:`parse`) reads it.  Each turn is rendered as it is, parsed, and compared with
its source; where that isn't identical, its ``<|`` sequences are escaped and it is parsed and compared
again, which must succeed: an escaped field holds no ``<|``, and the escape is one-to-one.  Turns that
render identically are left alone.  Since a rendered turn that parses to one turn ends where the grammar says,
the parse of a conversation is the parse of its turns in order.

Defined results: null role or text is empty; rows of one conversation come by turn (null first), then role,
then text, and repeated rows all stay; a null conversation id is a conversation of its own; an empty table
gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template (fixed values).
START = "<|im_start|>"
END = "<|im_end|>"
_NEWLINE = "<|nl|>"


def escape(text: Column) -> Column:
    """``<|`` becomes ``<\\|``, and one more backslash goes where there are some: no ``<|`` is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(_NEWLINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(_NEWLINE), F.lit("\n")))


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), body, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """Turns of a formatted text as ``array<struct<role, text>>``; a piece that breaks the grammar is null."""
    tail = F.lit(END + "\n")

    def turn(piece: Column) -> Column:
        cut = F.locate("\n", piece)
        body = piece.substr(cut + 1, F.length(piece) - cut - F.length(tail))
        fits = (cut > 0) & piece.endswith(tail) & ~body.contains(END)
        return F.when(fits, F.struct(unescape_role(piece.substr(F.lit(1), cut - 1)).alias("role"), unescape(body).alias("text")))

    pieces = F.split(formatted, START.replace("|", "\\|"), -1)
    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def _same(rendered: Column, role: Column, text: Column) -> Column:
    turns = parse(rendered)
    return F.coalesce((F.size(turns) == 1) & (turns[0]["role"] == role) & (turns[0]["text"] == text), F.lit(False))


def format_conversations(rows: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """``(conv_id, segments)``: one row a conversation; ``segments`` is ``array<struct<text, loss>>`` whose texts
    make up the formatted text and whose flag says which of them the loss counts.

    Escaping works on single rows.  The one shuffle deals out conversations; what a task has of a conversation
    is gathered before it.  A conversation itself is one value and has to fit into one row.
    """
    turns = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"))
    role, text = F.col("_role"), F.col("_text")
    plain = F.when(_same(render(role, text), role, text), True).when(_same(render(escape_role(role), escape(text)), role, text), False)
    turns = turns.withColumn("_plain", plain.otherwise(F.raise_error(F.lit("a turn doesn't survive the round trip"))))
    turn = F.struct("turn", role.alias("role"), text.alias("text"), F.col("_plain").alias("plain"))  # sorted as said, not as escaped
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    segments = F.flatten(
        F.transform(
            "_turns",
            lambda t: F.array(
                F.struct(F.concat(F.lit(START), F.when(t["plain"], t["role"]).otherwise(escape_role(t["role"])), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
                F.struct(F.when(t["plain"], t["text"]).otherwise(escape(t["text"])).alias("text"), (t["role"] == trained_role).alias("loss")),
                F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return gathered.select("conv_id", segments.alias("segments"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest columns, all from the output of :func:`format_conversations`."""
    joined = formatted.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("_text"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("_loss"),
    )
    turns = joined.withColumn("_turns", parse(F.col("_text")))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("_text").cast("long").alias("formatted_chars"),
    )
