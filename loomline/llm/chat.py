"""Chat formatting by grammar round trip, in DataFrame functions only.

A conversation is a sequence of turns ``<turn>role<text>content</turn>`` + newline. Each turn is first
rendered as it stands; the rendered turn is reparsed by a deterministic parser and, where the recovered
role and text differ from the source, its content is escaped (``\\`` becomes ``\\\\``, ``<`` becomes ``\\l``)
and marked ``<turn!>``. Escaped content holds no ``<``, so the second reparse is identical for any text;
a turn for which it were not raises an error. The whole conversation is then parsed back from its
rendered form and compared with the source turns once more.

Turns are ordered by (turn, role, text), nulls first, so ties and repeated rows have a fixed order. Null
texts and roles are empty strings. Rows with a null conversation id form one conversation. Only the three
columns named are read; others play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, RAW, TEXT, CLOSE = "<turn", ">", "<text>", "</turn>\n"
ESCAPED = "!>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    """Left to right: a doubled backslash ends each part, so ``\\l`` inside a part is an escaped ``<``."""
    parts = F.split(c, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\l"), F.lit("<"))), "\\")


def render(role: Column, text: Column, escaped: bool) -> Column:
    if escaped:
        return F.concat(F.lit(OPEN + ESCAPED), escape(role), F.lit(TEXT), escape(text), F.lit(CLOSE))
    return F.concat(F.lit(OPEN + RAW), role, F.lit(TEXT), text, F.lit(CLOSE))


def parse_turn(body: Column) -> Column:
    """(role, text) of a turn without its close mark."""
    raw = F.startswith(body, F.lit(OPEN + RAW))
    rest = F.when(raw, F.substr(body, F.lit(len(OPEN + RAW) + 1))).otherwise(F.substr(body, F.lit(len(OPEN + ESCAPED) + 1)))
    cut = F.instr(rest, TEXT)
    role, text = F.substr(rest, F.lit(1), cut - 1), F.substr(rest, cut + len(TEXT))
    return F.struct(F.when(raw, role).otherwise(unescape(role)).alias("role"), F.when(raw, text).otherwise(unescape(text)).alias("text"))


def parse(formatted: Column) -> Column:
    """The turns of a whole conversation, as an array of (role, text)."""
    bodies = F.split(formatted, CLOSE, -1)
    return F.transform(F.slice(bodies, F.lit(1), F.size(bodies) - 1), parse_turn)


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row for each conversation: id, n_turns, source (array of role, text), formatted, parsed, loss_text.

    loss_text is the text under the loss mask, read back from formatted: each text of the trained role.
    """
    role, text = F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    each = turns.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text"))
    # a raw turn is one turn if it has one close mark, at its end, and its first text mark is the template's
    raw = render(F.col("role"), F.col("text"), False)
    whole = parse_turn(F.substr(raw, F.lit(1), F.length(raw) - len(CLOSE)))
    same = (F.instr(raw, CLOSE) == F.length(raw) - len(CLOSE) + 1) & (whole["role"] == F.col("role")) & (whole["text"] == F.col("text"))
    each = each.withColumn("shown", F.when(same, raw).otherwise(render(F.col("role"), F.col("text"), True)))
    whole_conv = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "shown"))).alias("turns"))
    out = whole_conv.select(
        "id",
        F.size("turns").cast("long").alias("n_turns"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
        F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("formatted"),
    ).withColumn("parsed", parse(F.col("formatted")))
    checked = F.when(F.col("parsed") == F.col("source"), F.col("parsed")).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip")))
    out = out.withColumn("parsed", checked)
    spoken = F.filter("parsed", lambda t: t["role"] == trained_role)
    return out.withColumn("loss_text", F.array_join(F.transform(spoken, lambda t: t["text"]), ""))


EXTRA = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    done = format_conversations(turns.unionByName(extra))
    told = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        F.col("id").alias("conv_id"),
        "n_turns",
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), r AS (
  SELECT *, contains(role || '<text>' || text, '</turn>' || chr(10)) OR contains(role, '<text>') AS clash,
    length(role || text) AS plain,
    2 * length(role || text) - length(replace(replace(role || text, '\', ''), '<', '')) AS escaped
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN clash THEN 21 + escaped ELSE 20 + plain END)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""
