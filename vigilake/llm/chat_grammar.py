"""Chat formatting by a grammar round trip, in DataFrame functions alone.

    conversation := turn*        turn := START role "\\n" text END "\\n"

The grammar is regular and parsed deterministically: START splits the output into turns, the first "\\n" ends the
role, the first END ends the text, and a turn must be used up by that. While parsing, each run of "<", backslashes
and "|" loses one backslash. A text is first rendered as it is and parsed again; where the recovered turn differs
from its source, each such run in the text gains one backslash, so no START or END is left in it, and the result is
parsed and compared again. Escaping and unescaping are inverse to each other, so the second round always ends; the
whole output is still compared with its source, and a difference stops the job rather than passing on.
In roles "%", line ends and "|" are always percent-coded.

Rows: one for each conversation. Turns are ordered by number; equal numbers by role and text; repeated rows stay
repeated turns. A null text or role counts as empty, a null turn number comes first, rows of a null conversation id
form one conversation. Other columns are not read. An empty table gives no rows. One conversation becomes one
string, so all its turns meet in one task; no other grouping is done.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilake.llm.common import table

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE, WIDE = "assistant", "UTF-32"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def coded(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("|"), F.lit("%7C"))


def uncoded(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%7C"), F.lit("|")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(role: Column, text: Column) -> Column:
    """A turn, from a role that is coded and a text that is escaped where it has to be."""
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """The turns of an output: array<struct<role, text, whole>>; `whole` is false where the grammar doesn't hold."""
    parts = F.split(formatted, r"<\|im_start\|>", -1)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        inner = F.substring_index(F.substring(part, F.length(role) + 2, F.length(part)), END, 1)
        return F.struct(uncoded(role).alias("role"), unescape(inner).alias("text"), (render(role, inner) == F.concat(F.lit(START), part)).alias("whole"))

    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def slices(text: Column, spans: Column) -> Column:
    """The pieces of a text at (start, end), in code points. Four bytes each, so that a piece is cut out without reading what stands before it.

    A letter goes before each piece while it is decoded, as a U+FEFF at its start would be taken for a mark of the byte order.
    """
    first = F.encode(F.lit("x"), WIDE)
    cut = lambda wide, x: F.substring(F.decode(F.concat(first, F.substring(wide, x.start.cast("int") * 4 + 1, (x.end - x.start).cast("int") * 4)), WIDE), 2, 2**31 - 1)
    return F.transform(F.array(F.encode(text, WIDE)), lambda wide: F.transform(spans, lambda x: cut(wide, x)))[0]


def format_chats(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, formatted, turns: array<struct<role, text>> read back, mask: array<struct<start, end>>, loss, n_escaped).

    mask: where the assistant's texts stand in `formatted`, in code points from 0, `end` excluded; each such turn has an entry, an empty text too. loss: what `formatted` has there, unescaped.
    """
    source = df.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    plain = render(coded(F.col("role")), F.col("text"))
    same = F.coalesce(parse(plain) == F.array(F.struct("role", "text", F.lit(True).alias("whole"))), F.lit(False))
    rows = source.withColumn("same", same).withColumn("made", F.when(F.col("same"), plain).otherwise(render(coded(F.col("role")), escape(F.col("text")))))
    before = Window.partitionBy("conv").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("made")).over(before), F.lit(0)) + F.length(F.concat(F.lit(START), coded(F.col("role")))) + 1
    end = start + F.length("made") - F.length(render(coded(F.col("role")), F.lit("")))
    rows = rows.withColumns({"start": start.cast("long"), "end": end.cast("long")})
    chats = rows.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "made", "start", "end"))).alias("source"), F.count_if(~F.col("same")).alias("n_escaped")
    )
    mask = F.transform(F.filter("source", lambda x: x.role == LOSS_ROLE), lambda x: F.struct(x.start.alias("start"), x.end.alias("end")))
    out = chats.select("conv", "n_escaped", "source", mask.alias("mask"), F.array_join(F.col("source.made"), "").alias("formatted")).withColumn("parsed", parse(F.col("formatted")))
    wanted = F.transform("source", lambda x: F.struct(x.role.alias("role"), x.text.alias("text"), F.lit(True).alias("whole")))
    turns = F.when(F.col("parsed") == wanted, F.transform("parsed", lambda x: F.struct(x.role.alias("role"), x.text.alias("text")))).otherwise(
        F.raise_error(F.lit("a conversation doesn't survive its round trip"))
    )
    loss = F.array_join(F.transform(slices(F.col("formatted"), F.col("mask")), unescape), "")
    return out.select(F.col("conv").alias(conv_col), "formatted", turns.alias("turns"), "mask", loss.alias("loss"), "n_escaped")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    chats = format_chats(told.unionByName(more))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "n_escaped",
    )


OP10_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_matches(text, '<\|im_(start|end)\|>|<\\+\|') AS clash FROM c),
l AS (SELECT *, length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '|', '%7C')) + 24
             + length(text) + CASE WHEN clash THEN len(regexp_extract_all(text, '<\\*\|')) ELSE 0 END AS n FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars, count(*) FILTER (clash) AS n_escaped
FROM l GROUP BY conv_id
"""
