"""Conversations as training text: turns between control strings, a loss mask, and a parser that reads them back.

The grammar, which the parser follows without looking ahead::

    conversation := turn*
    turn         := "<|im_start|>" role "\\n" content "<|im_end|>" "\\n"

Neither role nor content may hold a control string ``<|name|>``; a backslash after ``<`` takes a control string its
meaning, and the parser takes one backslash away again. A role's line breaks are written as ``<|nl|>``. Content that
the parser gives back unchanged is written as it is. Content that it doesn't is escaped, first its control strings
only, then everything that looks like the beginning of one, until what is read back is identical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import checked, known, ranked, staged

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
CONTROL = r"<\|[A-Za-z0-9_]+\|>"
#: A longer conversation is written in several pieces.
PIECE_TURNS = 1024


def _unescaped(content: Column) -> Column:
    return F.regexp_replace(content, r"<\\(\\*)\|", r"<$1|")


def _escaped(content: Column) -> Column:
    """Every beginning of a control string with one more backslash; ``_unescaped`` gives the content back, always."""
    return F.regexp_replace(content, r"<(\\*)\|", r"<\\$1|")


def _escaped_controls(content: Column) -> Column:
    return F.regexp_replace(content, r"<(\\*)\|([A-Za-z0-9_]+)\|>", r"<\\$1|$2|>")


def parsed(text: Column) -> Column:
    """Turns of a rendered text: array<struct<role, text, sound>>; ``sound`` is false where the grammar is broken.

    The text before the first turn, which has to be empty, is the first part of the split; if it isn't, it counts as
    one turn that isn't sound.
    """

    def turn(part: Column) -> Column:
        body = F.substring(part, F.lit(1), F.greatest(F.char_length(part) - F.lit(len(END) + 1), F.lit(0)))
        # A role ends at the first line break; without one there is no turn.
        at = F.position(F.lit("\n"), body)
        role, content = F.substring(body, F.lit(1), at - F.lit(1)), F.substring(body, at + F.lit(1), F.char_length(body))
        sound = F.endswith(part, F.lit(END + "\n")) & (at > 0) & ~F.rlike(content, F.lit(CONTROL)) & ~F.rlike(F.replace(role, F.lit(BREAK), F.lit("")), F.lit(CONTROL))
        return F.struct(
            _unescaped(F.replace(role, F.lit(BREAK), F.lit("\n"))).alias("role"), _unescaped(content).alias("text"),
            F.coalesce(sound, F.lit(False)).alias("sound"))

    parts = F.split(text, r"<\|im_start\|>", -1)
    stray = F.struct(F.lit("").alias("role"), F.element_at(parts, 1).alias("text"), F.lit(False).alias("sound"))
    turns = F.transform(F.slice(parts, F.lit(2), F.size(parts)), turn)
    return F.when(F.element_at(parts, 1) == "", turns).otherwise(F.concat(F.array(stray), turns))


def _rendered(role: Column, content: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), content, F.lit(END + "\n"))


def _turn(role: Column, text: Column) -> Column:
    """A turn as the parser gives it back."""
    return F.struct(role.alias("role"), text.alias("text"), F.lit(True).alias("sound"))


def _written(turns: DataFrame) -> DataFrame:
    """Adds ``head`` and ``content``: role and text as the grammar has them, escaped until the parser gives them back."""
    role, text, empty = F.col("role"), F.col("text"), F.lit("")
    # Where nothing looks like the beginning of a control string, nothing has to be parsed to know that it comes back.
    tame = ~F.rlike(role, F.lit(r"[<\n]"))
    head = F.when(tame | (parsed(_rendered(role, empty)) == F.array(_turn(role, empty))), role).otherwise(
        F.replace(_escaped(role), F.lit("\n"), F.lit(BREAK)))
    content = F.when(~F.rlike(text, F.lit(r"<\\*\|")), text)
    for escape in (lambda c: c, _escaped_controls):
        content = content.when(parsed(_rendered(F.col("head"), escape(text))) == F.array(_turn(role, text)), escape(text))
    return turns.withColumn("head", head).withColumn("content", content.otherwise(_escaped(text)))


def format_chats(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    learn: str = "assistant", piece_turns: int = PIECE_TURNS,
) -> DataFrame:
    """Conversations as text in the module's grammar, with the spans on which a model is trained.

    Returns a row per conversation: conv_id, piece (0), whole (true), n_turns, formatted, loss and identical. ``loss``
    lists the contents of the turns whose role is ``learn``: begin and end in code points, begin_byte and end_byte in
    bytes of ``formatted``, end exclusive. ``identical`` says that the parser gives back the source's turns from
    ``formatted``. A conversation of more than ``piece_turns`` turns has ``whole`` false and several pieces, which one
    after the other are its text; as every piece ends between two turns, the pieces are parsed one by one.

    Turns are in the order of ``turn``, null first, ties by role and text; repeated rows stay. Null roles and texts are
    empty ones, empty texts stay as turns. Rows without conv_id are one conversation. Other columns are not read, so
    that their names can't clash. An empty table gives no rows. A text may be as long as a string can be; one piece has
    to fit a string of 2 GB.
    """
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), known(role).alias("role"), known(text).alias("text"))
    large = rows.groupBy("conv_id").count().filter(F.col("count") > piece_turns).select(F.col("conv_id").alias("large_id"))
    large = staged(large, "large-chats")
    if large.isEmpty():
        dealt = rows.withColumn("piece", F.lit(0).cast("long")).withColumn("whole", F.lit(True))
    else:
        side = checked(large, 32)
        met = F.col("conv_id").eqNullSafe(F.col("large_id"))
        small = rows.join(side, met, "left_anti").withColumn("piece", F.lit(0).cast("long")).withColumn("whole", F.lit(True))
        long = ranked(rows.join(side, met, "left_semi"), ["conv_id"], ["turn", "role", "text"], "long-chats")
        long = long.withColumn("piece", F.expr(f"position div {piece_turns}")).withColumn("whole", F.lit(False))
        dealt = small.unionByName(long.drop("position"))
    told = _written(dealt).groupBy("conv_id", "piece", "whole").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "head", "content"))).alias("turns"))
    nothing = "named_struct('chars', 0L, 'bytes', 0L, 'loss', CAST(array() AS array<struct<begin:bigint,end:bigint,begin_byte:bigint,end_byte:bigint>>))"
    fixed = len(START) + 1, len(END) + 1
    spans = F.expr(f"""
      aggregate(turns, {nothing}, (acc, t) -> named_struct(
        'chars', acc.chars + {sum(fixed)} + char_length(t.head) + char_length(t.content),
        'bytes', acc.bytes + {sum(fixed)} + octet_length(t.head) + octet_length(t.content),
        'loss', IF(t.role = '{learn}', concat(acc.loss, array(named_struct(
          'begin', acc.chars + {fixed[0]} + char_length(t.head), 'end', acc.chars + {fixed[0]} + char_length(t.head) + char_length(t.content),
          'begin_byte', acc.bytes + {fixed[0]} + octet_length(t.head), 'end_byte', acc.bytes + {fixed[0]} + octet_length(t.head) + octet_length(t.content)))),
          acc.loss)), acc -> acc.loss)""")
    formatted = F.array_join(F.transform("turns", lambda t: _rendered(t["head"], t["content"])), "")
    source = F.transform("turns", lambda t: _turn(t["role"], t["text"]))
    return told.withColumn("formatted", formatted).select(
        "conv_id", "piece", "whole", F.size("turns").cast("long").alias("n_turns"), "formatted", spans.alias("loss"),
        (parsed(F.col("formatted")) == source).alias("identical"))


def read_chats(pieces: DataFrame) -> DataFrame:
    """What formatted pieces hold, from text and mask alone: adds ``turns`` (role, text, sound) and ``learnt``, the texts under the mask."""
    raw = F.col("formatted").cast("binary")
    learnt = F.transform("loss", lambda s: _unescaped(
        F.substring(raw, (s["begin_byte"] + 1).cast("int"), (s["end_byte"] - s["begin_byte"]).cast("int")).cast("string")))
    return pieces.withColumn("turns", parsed(F.col("formatted"))).withColumn("learnt", learnt)


def digests(pieces: DataFrame) -> DataFrame:
    """Per conversation what its pieces hold: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Conversations of one piece need no shuffle. Pieces of longer ones are joined in order; a digest is that of the
    whole text, so that a conversation has to fit a string here.
    """
    turn = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = read_chats(pieces).select(
        "conv_id", "piece", "whole", F.size("turns").cast("long").alias("n_turns"), F.array_join(turn, "").alias("told"),
        F.array_join("learnt", "").alias("learnt"), F.char_length("formatted").cast("long").alias("chars"))
    joined = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    several = read.filter(~F.col("whole")).groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"), F.sum("chars").alias("chars"), F.array_sort(F.collect_list(F.struct("piece", "told", "learnt"))).alias("parts"),
    ).select("conv_id", "n_turns", joined("told").alias("told"), joined("learnt").alias("learnt"), "chars")
    return read.filter("whole").select("conv_id", "n_turns", "told", "learnt", "chars").unionByName(several).select(
        "conv_id", "n_turns", F.sha2(F.col("told").cast("binary"), 256).alias("turns_sha256"), F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"), F.col("chars").alias("formatted_chars"))
