r"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of parts (kind, text, ref, size). The visitor turns each part into text: a text part
becomes its escaped text, an image, audio or document part becomes a placeholder, while its reference is recorded
and its tokens are counted as they will be after expansion.

Escaping: every backslash is doubled, then ``<|`` becomes ``<\|``, also where one text part ends in ``<`` and the next
begins with ``|``. No control string (all begin with ``<|``) can then occur inside a text or a role, and ``\\x`` -> ``x`` restores
it exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchweave.llm.common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PART_TYPE = "struct<kind:string,text:string,ref:string,size:bigint>"


@dataclass(frozen=True)
class Expansion:
    """Tokens that a part stands for: a fixed number, and one for each so many units of its size."""

    chars_per_token: int = 4
    fixed: dict[str, int] = field(default_factory=lambda: {"image": 576, "audio": 2, "document": 4})
    units_per_token: dict[str, int] = field(default_factory=lambda: {"audio": 40, "document": 4})


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _kind(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text"))


def _text(part: Column, expansion: Expansion) -> Column:
    """What a part says itself; empty for parts that a placeholder stands for."""
    return F.when(_kind(part).isin(*expansion.fixed), F.lit("")).otherwise(F.coalesce(part["text"], F.lit("")))


def _visit(part: Column, before: Column, expansion: Expansion) -> Column:
    """(piece, tokens, ref): what a part leaves in the text, its tokens once expanded, and its attachment.

    ``before`` is the part before it, or null. A bar that would meet its ``<`` is escaped as if both were one text.
    """
    kind = _kind(part)
    text = F.coalesce(part["text"], F.lit(""))
    size = F.coalesce(part["size"], F.lit(0))
    meets = F.coalesce(_text(before, expansion).endswith("<"), F.lit(False)) & text.startswith("|")
    piece, tokens = F.concat(F.when(meets, "\\").otherwise(""), escape(text)), F.ceil(F.length(text) / F.lit(expansion.chars_per_token)).cast("long")
    for name, fixed in expansion.fixed.items():
        per = expansion.units_per_token.get(name)
        count = F.lit(fixed) + (F.ceil(size / F.lit(per)).cast("long") if per else F.lit(0))
        piece = F.when(kind == name, F.lit(f"<|{name}|>")).otherwise(piece)
        tokens = F.when(kind == name, count).otherwise(tokens)
    ref = F.when(kind.isin(*expansion.fixed), F.struct(kind.alias("kind"), part["ref"].alias("ref")))
    return F.struct(piece.alias("piece"), tokens.cast("long").alias("tokens"), ref.alias("attachment"))


def format_conversations(messages: DataFrame, expansion: Expansion = Expansion(), loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments, expanded_tokens) for each conversation.

    ``messages`` has conv_id, turn, role and parts (``array<PART_TYPE>``); other columns are ignored. Turns are
    ordered by turn, then role, then content, so ties and repeated rows have a defined order and all stay.
    A null role, text or parts array is empty; a part without kind is text; null conv_ids form one conversation.
    ``loss_spans`` are (start, length) in characters of ``formatted``. A conversation is one value, so it
    must fit a row; conversations are dealt out by conv_id.
    """
    role = escape(F.coalesce(F.col("role"), F.lit("")))
    # empty texts stand between no two parts
    said = F.filter(F.coalesce(F.col("parts"), F.array().cast(f"array<{PART_TYPE}>")), lambda p: _kind(p).isin(*expansion.fixed) | (_text(p, expansion) != ""))
    visited = F.transform("said", lambda p, i: _visit(p, F.get("said", i - 1), expansion))
    messages = messages.select("conv_id", "turn", "role", said.alias("said"))
    turns = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), role.alias("shown"), visited.alias("visited"))
    turns = turns.select("conv_id", "turn", "role", "shown", F.array_join("visited.piece", "").alias("content"),
                         F.aggregate("visited.tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"),
                         F.filter("visited.attachment", lambda x: x.isNotNull()).alias("attached"))
    head = len(TURN) + F.length("shown") + len(TEXT)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    before = F.sum(head + F.length("content") + len(END)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0).cast("long"))
    placed = turns.select("conv_id", F.struct(
        start.alias("at"), F.concat(F.lit(TURN), "shown", F.lit(TEXT), "content", F.lit(END)).alias("rendered"),
        F.struct((start + head).alias("start"), F.length("content").cast("long").alias("length")).alias("span"),
        F.col("role").isin(*loss_roles).alias("learned"), "tokens", "attached", "turn").alias("m"))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    spans = F.transform(F.filter("ms", lambda m: m["learned"]), lambda m: m["span"])
    return whole.select("conv_id", F.array_join("ms.rendered", "").alias("formatted"), spans.alias("loss_spans"),
                        F.flatten(F.transform("ms", lambda m: F.transform(m["attached"], lambda a: F.struct(m["turn"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"))))).alias("attachments"),
                        F.aggregate("ms.tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("expanded_tokens"))


def parse_formatted(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text) as they were before escaping."""
    def back(shown: Column) -> Column:
        halves = F.split(shown.substr(F.lit(len(TURN) + 1), F.length(shown)), r"<\|text\|>", 2)
        return F.struct(unescape(halves[0]).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(F.filter(F.split(formatted, r"<\|end\|>"), lambda x: x != ""), back)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr(s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def text_parts(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("size")))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    out = format_conversations(rows.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts")))
    read = out.select("conv_id", "formatted", "attachments", "expanded_tokens", parse_formatted(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said_by_turn = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said_by_turn, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens")


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS n FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + 8 + 8 + 7) AS BIGINT) AS formatted_chars,
       CAST(0 AS BIGINT) AS n_attachments, CAST(sum((length(text) + 3) // 4) AS BIGINT) AS expanded_tokens
FROM escaped GROUP BY conv_id
"""
