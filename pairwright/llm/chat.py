"""Operator 10, chat formatting with typed content parts.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

START, MIDDLE, STOP = "<|im_start|>", "\n", "<|im_end|>\n"
#: What an attachment's placeholder stands for in tokens, by part type: a base and a number for each of its units
#: (image tiles, seconds of sound, document pages).
TOKENS = {"image": (85, 170), "audio": (4, 25), "document": (16, 600)}
PARTS = "array<struct<type:string,text:string,ref:string,units:bigint>>"
#: Template control strings all hold `<` or `[`, so a text with both replaced holds none; `&` keeps this reversible.
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escape(text: Column) -> Column:
    for plain, entity in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for plain, entity in reversed(_ESCAPES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def text_parts(text: Column) -> Column:
    """A plain text as typed text parts, one a line (each keeps its line break)."""
    nothing = F.lit(None)
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=\n)"), lambda x: F.struct(F.lit("text").alias("type"), x.alias("text"), nothing.cast("string").alias("ref"), nothing.cast("long").alias("units"))).cast(PARTS)


def visit(parts: Column) -> Column:
    """Flattens typed parts into struct(body, attachments, tokens).

    A text part gives its escaped text; image, audio and document parts give `<|image:K|>` and so on, K counting the
    attachments of the turn from 0; an unknown or null type with a text is text, without one it is nothing.
    Attachments are struct(slot, type, ref, tokens) in order of their placeholders; tokens is their sum.
    """
    kinds = list(TOKENS)
    every = F.coalesce(parts, F.array().cast(PARTS))
    is_held = lambda p: F.coalesce(p["type"].isin(kinds), F.lit(False))

    def attachment(p: Column, slot: Column) -> Column:
        tokens = F.lit(0).cast("long")
        for kind, (base, unit) in TOKENS.items():
            tokens = F.when(p["type"] == kind, F.lit(base) + F.lit(unit) * F.greatest(F.coalesce(p["units"], F.lit(1)), F.lit(0))).otherwise(tokens)
        return F.struct(slot.alias("slot"), p["type"].alias("type"), p["ref"].alias("ref"), tokens.cast("long").alias("tokens"))

    def piece(p: Column, i: Column) -> Column:
        slot = F.size(F.filter(F.slice(every, F.lit(1), i), is_held))
        return F.when(is_held(p), F.concat(F.lit("<|"), p["type"], F.lit(":"), slot.cast("string"), F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))

    attachments = F.transform(F.filter(every, is_held), attachment)
    return F.struct(F.array_join(F.transform(every, piece), "").alias("body"), attachments.alias("attachments"), F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("tokens"))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: (conv_id, formatted, loss_spans, attachments, n_turns, attachment_tokens).

    `parts` is a column of type PARTS.  Turns are ordered by (turn, role, body before escapes), nulls first, so ties
    and repeated rows have one order and each is a turn; a null role is an empty one; rows with a null conv_id are one
    conversation.  formatted is `<|im_start|>role\\nbody<|im_end|>\\n` for each turn, with `&`, `<` and `[` of role
    and texts as entities.  loss_spans are struct(turn, start, end): code points of the bodies of trained_role,
    counted from the beginning of that turn's chunk.  attachments are struct(turn, slot, type, ref, tokens).
    A conversation is one row of the result, so its turns meet in one task; nothing larger does.
    """
    flat = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), visit(F.col(parts)).alias("v"))
    met = flat.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "v")).alias("t"))
    with_raw = F.transform("t", lambda t: F.struct(t["turn"], t["role"], unescape(t["v"]["body"]).alias("raw"), t["v"]["body"].alias("body"), t["v"]["attachments"].alias("attachments"), t["v"]["tokens"].alias("tokens")))
    grouped = met.select("conv_id", F.sort_array(with_raw).alias("t"))
    head = lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(MIDDLE))
    chunk = lambda t: F.concat(head(t), t["body"], F.lit(STOP))
    spans = F.transform("t", lambda t, i: F.struct(i.alias("turn"), F.length(head(t)).alias("start"), (F.length(head(t)) + F.length(t["body"])).alias("end"), t["role"].alias("role")))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("t", chunk), "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["role"] == trained_role), lambda s: F.struct(s["turn"], s["start"], s["end"])).alias("loss_spans"),
        F.flatten(F.transform("t", lambda t, i: F.transform(t["attachments"], lambda a: F.struct(i.alias("turn"), a["slot"], a["type"], a["ref"], a["tokens"])))).alias("attachments"),
        F.size("t").cast("long").alias("n_turns"),
        F.aggregate("t", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("attachment_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss, formatted): turns as struct(role, text) and the texts under the loss spans, parsed out of the output alone."""
    chunks = formatted.select("conv_id", "formatted", "loss_spans", F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 2**31 - 1).alias("c"))
    return chunks.select(
        "conv_id", "formatted",
        F.transform("c", lambda c: F.struct(unescape(F.substring_index(c, MIDDLE, 1)).alias("role"), unescape(F.regexp_extract(c, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1)).alias("text"))).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substring(F.get("c", s["turn"]), s["start"] - F.lit(len(START)) + 1, s["end"] - s["start"]))).alias("loss"),
    )


def digest(back: DataFrame) -> DataFrame:
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(F.array_join("loss", "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join("loss", "").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


PROBE = "</s>[INST] ok [/INST]"


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and number -7, whose two texts are control strings of another template."""
    probe = conversations.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)


def op10_typed_parts_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and number -7, formatted and read back from the output."""
    turns = with_probe(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return digest(read_back(format_conversations(turns.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts")))))


ORACLE = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{PROBE}' union all select -7, 1, 'assistant', '{PROBE}'),
e as (select *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) as escaped from c),
g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
  coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as loss,
  sum({len(START) + len(MIDDLE) + len(STOP)} + length(role) + escaped) as chars from e group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, cast(chars as bigint) as formatted_chars from g"""
