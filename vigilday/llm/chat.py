"""Chat formatting with a grammar round trip.

A conversation is rendered as one text in which every turn stands between control strings. Control
strings inside a text, and strings that look like escaped ones, get one backslash more after their first
character, which makes the grammar unambiguous. The rendered text is parsed again, and the turns
recovered are compared with the source: a conversation that differed would be an error, not a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilday.llm.common import table
from vigilday.llm.registry import query

# The control strings around the text of a turn, by role; OTHER is for any other role.
ROLES = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE]", "[SAYS]", "[/ROLE]")
# What follows the first character of a control string.
TAILS = r"s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|ROLE\]|SAYS\]|/ROLE\]"
CONTROL = rf"([<\[])(\\*)({TAILS})"
ESCAPED = rf"([<\[])\\(\\*)({TAILS})"
TURN = r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>|<<SYS>>.*?<</SYS>>|\[ROLE\].*?\[SAYS\].*?\[/ROLE\]"


def escape(text: Column) -> Column:
    """``text`` with one backslash more in every control string and every escaped one."""
    return F.when(text.rlike(CONTROL), F.regexp_replace(text, CONTROL, r"$1\\$2$3")).otherwise(text)


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.when(text.rlike(ESCAPED), F.regexp_replace(text, ESCAPED, "$1$2$3")).otherwise(text)


def head(role: Column) -> Column:
    """What stands before the text of a turn."""
    start = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1]))
    for name, (opening, _) in ROLES.items():
        start = F.when(role == name, opening).otherwise(start)
    return start


def tail(role: Column) -> Column:
    end = F.lit(OTHER[2])
    for name, (_, closing) in ROLES.items():
        end = F.when(role == name, closing).otherwise(end)
    return end


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a rendered conversation, from left to right; null if anything stands outside of turns."""
    found = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))

    def turn(raw: Column) -> Column:
        cut = F.instr(raw, OTHER[1])
        other = F.struct(
            unescape(F.substring(raw, F.lit(len(OTHER[0]) + 1), cut - len(OTHER[0]) - 1)).alias("role"),
            unescape(F.substring(raw, cut + len(OTHER[1]), F.length(raw) - cut - len(OTHER[1]) - len(OTHER[2]) + 1)).alias("text"),
        )
        for name, (opening, closing) in ROLES.items():
            inner = F.substring(raw, F.lit(len(opening) + 1), F.length(raw) - len(opening) - len(closing))
            other = F.when(
                F.startswith(raw, F.lit(opening)), F.struct(F.lit(name).alias("role"), unescape(inner).alias("text"))
            ).otherwise(other)
        return other

    whole = F.length(F.array_join(found, "")) == F.length(formatted)
    return F.when(whole, F.transform(found, turn))


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    trained: str = "assistant",
) -> DataFrame:
    """One row per conversation: its id, ``formatted``, ``turns`` parsed back, ``loss_spans`` (start, length).

    Turns stand in the order of the turn number (null first); rows with equal numbers, repeated ones too, in the order of
    role and text. A null text or role counts as empty; a null id is a conversation. Spans are code points, from 0, of the
    texts of ``trained`` within ``formatted``, as escaped there. An empty table gives an empty result; other
    columns are not read. A conversation is one value of the result, so its turns meet in one task. An error is raised if
    a conversation read back differs from its source.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumns({"head": head(F.col("role")), "tail": tail(F.col("role")), "inner": escape(F.col("text"))})
    rows = rows.withColumn("n", (F.length("head") + F.length("inner") + F.length("tail")).cast("long"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"at": F.coalesce(F.sum("n").over(before), F.lit(0)), "place": F.row_number().over(order)})
    told = rows.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("place", "at", "role", "text", "head", "inner", "tail"))).alias("list")
    )
    span = lambda t: F.struct((t["at"] + F.length(t["head"])).alias("start"), F.length(t["inner"]).alias("length"))
    rendered = told.select(
        "conv",
        F.array_join(F.transform("list", lambda t: F.concat(t["head"], t["inner"], t["tail"])), "").alias("formatted"),
        F.transform("list", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
        F.transform(F.filter("list", lambda t: t["role"] == trained), span).alias("loss_spans"),
    )
    parsed = rendered.withColumn("turns", parse(F.col("formatted")))
    same = F.col("turns").eqNullSafe(F.col("source"))
    checked = F.when(same, F.col("turns")).otherwise(F.raise_error(F.concat(F.lit("round trip failed: "), F.col("formatted"))))
    return parsed.select(F.col("conv").alias(conv_col), "formatted", checked.alias("turns"), "loss_spans")


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, read from the rendered text and unescaped."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"]))), ""
    )


def digest(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Counts and hashes of formatted conversations, from the turns and the loss text read back."""
    read = chats.withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


# Fixed value: the text of both turns of the conversation that the query adds.
ADDED = "</s>[INST] ok [/INST]"

SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{ADDED}'
  UNION ALL SELECT -7, 1, 'assistant', '{ADDED}'
), escaped AS (
  SELECT *, length(regexp_replace(text, '{CONTROL}', '\\1\\\\\\2\\3', 'g')) AS inside,
         length(regexp_replace(role, '{CONTROL}', '\\1\\\\\\2\\3', 'g')) AS named
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(inside + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 19 + named END) AS BIGINT)
    AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@query("op2_chat_format", SQL)
def op2_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(ADDED).alias("text"),
    )
    return digest(format_chats(turns.unionByName(added)))
