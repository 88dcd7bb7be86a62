r"""Prefix-target expansion of conversations, with DataFrame functions only.

A turn is written ``<s>role[INST]text</s>``. Control strings inside a role or a text get one more backslash after their
first character (``</s>`` becomes ``<\/s>``, ``<\/s>`` becomes ``<\\/s>``), which is taken away when the text is read back; other
text stays as it is. Every assistant turn gives one example: all turns before it and the turn itself, of which only the reply
is trainable (``loss_start``, ``loss_length``: characters of the formatted text). A conversation that doesn't end in an
assistant turn gives one more example without a trainable part, so that the output holds every turn.

The examples of a conversation repeat its earlier turns by definition, so they grow with the square of its turns; they
are made from one row a conversation and never meet in a shuffle.

Rows are ordered by turn, then role and text (nulls first), so ties have one order; a null role or text is empty; rows without
a conv_id form one conversation; repeated rows are repeated turns; extra columns are ignored; no rows give no examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantora.llm.common import table

_CONTROL = r"(/?s>|/?INST\]|/?SYS>|\|[a-z_]+\|>)"
ESCAPE, UNESCAPE = r"([<\[])(\\*)" + _CONTROL, r"([<\[])\\(\\*)" + _CONTROL


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def prefix_target_examples(turns: DataFrame, target: str = "assistant") -> DataFrame:
    """conv_id, example (1, 2, ..), formatted, loss_start (0-based), loss_length (both 0 without a trainable part)."""
    row = F.struct(F.col("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    shown = F.transform("turns", lambda t: F.struct((F.coalesce(t["role"], F.lit("")) == target).alias("reply"), F.concat(F.lit("<s>"), escape(t["role"]), F.lit("[INST]")).alias("head"), escape(t["text"]).alias("body")))
    convs = convs.select("conv_id", shown.alias("shown"))
    ends = F.filter(F.transform("shown", lambda t, i: F.when(t["reply"] | (i == F.size("shown") - 1), i + 1)), lambda i: i.isNotNull())
    examples = convs.select("conv_id", "shown", F.posexplode(ends).alias("nth", "end"))
    last = F.element_at("shown", F.col("end"))
    context = F.array_join(F.transform(F.slice("shown", 1, F.col("end") - 1), lambda t: F.concat(t["head"], t["body"], F.lit("</s>"))), "")
    examples = examples.select("conv_id", (F.col("nth") + 1).alias("example"), context.alias("context"), last.alias("last"))
    return examples.select(
        "conv_id",
        "example",
        F.concat("context", "last.head", "last.body", F.lit("</s>")).alias("formatted"),
        F.when(F.col("last.reply"), F.length("context") + F.length("last.head")).otherwise(0).cast("long").alias("loss_start"),
        F.when(F.col("last.reply"), F.length("last.body")).otherwise(0).cast("long").alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted example."""
    pieces = F.split(formatted, "</s>")

    def turn(piece: Column) -> Column:
        at = F.instr(piece, "[INST]")
        return F.struct(unescape(F.substring(piece, F.lit(4), at - 4)).alias("role"), unescape(F.substring(piece, at + 6, F.length(piece))).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def op1_chat_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("select -1L as conv_id, 0L as turn, 'user' as role, '</s>[INST] ok [/INST]' as text union all select -1L, 1L, 'assistant', '</s>[INST] ok [/INST]'")
    examples = prefix_target_examples(turns.unionByName(extra))
    loss = unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length")))
    back = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", loss.alias("text")))), lambda x: x["text"]), "").alias("loss"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    back = back.select("conv_id", read_turns(F.col("whole")).alias("turns"), "loss", "formatted_chars")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role as r0, text as t0 from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'
), o as (
  select *, row_number() over (partition by conv_id order by turn nulls first, r0 nulls first, t0 nulls first) as i, count(*) over (partition by conv_id) as n,
    length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS>|\|[a-z_]+\|>)', '\1\\\2\3', 'g')) + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS>|\|[a-z_]+\|>)', '\1\\\2\3', 'g')) + 13 as chars
  from c
), p as (select *, sum(chars) over (partition by conv_id order by i) as upto from o)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
  sum(upto) filter (role = 'assistant' or i = n)::bigint as formatted_chars
from p group by conv_id
"""

QUERIES = {"op1_chat_prefix_target": op1_chat_prefix_target}
SQL = {"op1_chat_prefix_target": _SQL}
