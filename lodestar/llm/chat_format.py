"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs in pieces of ``PIECE`` turn numbers,
sorted, merged where neighbours have one role (by array aggregation) and joined to text; the
pieces are then joined in order.  A block reads ``<|im_start|>role``, a new line, its texts
with ``<|im_sep|>`` between them, ``<|im_end|>`` and a new line.  Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|`` (a new line in a role ``<\\n|``), so no control
string can come from a text and everything can be read back.  The loss mask is an array of
spans, one for each assistant text.

Defined cases: null roles and texts count as empty; turns with one number are ordered by role
and text, null numbers come first; repeated rows are turns of their own; a conversation
without assistant has no spans; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
PIECE = 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n|"), F.lit("\n")))


def _merge(turns: Column) -> Column:
    """Blocks ``(role, texts)`` of sorted ``(turn, role, text)``, by array aggregation."""
    none = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def step(done: Column, turn: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["role"].alias("role"), F.array_append(last["texts"], turn["text"]).alias("texts"))
        fresh = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        return F.when(last["role"] == turn["role"], F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), longer)).otherwise(F.array_append(done, fresh))

    return F.aggregate(turns, none, step)


def _opening(before: Column, role: Column) -> Column:
    """What stands between a text and the one before, whose role is ``before`` (null: none)."""
    fresh = F.concat(F.lit(START), role, F.lit("\n"))
    return F.when(before.isNull(), fresh).when(before == role, F.lit(SEP)).otherwise(F.concat(F.lit(f"{END}\n"), fresh))


def format_conversations(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans`` (structs ``start, length`` in code points) of every conversation."""
    rows = turns.select("conv_id", "turn", escape_role(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
    pieces = rows.groupBy("conv_id", F.floor(F.col("turn") / PIECE).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    pieces = pieces.select("conv_id", "piece", _merge(F.col("turns")).alias("blocks"))
    # each text of the piece with what stands before it; the first one's opening depends on the piece before
    flat = F.flatten(F.transform("blocks", lambda b, i: F.transform(b["texts"], lambda t, k: F.struct(
        b["role"].alias("role"), t.alias("text"),
        F.when(k > 0, F.lit(SEP)).when(i == 0, F.lit("")).otherwise(F.concat(F.lit(f"{END}\n{START}"), b["role"], F.lit("\n"))).alias("before")))))
    pieces = pieces.select("conv_id", "piece", flat.alias("texts"))

    def add(done: Column, t: Column) -> Column:
        start = done["at"] + F.char_length(t["before"])
        span = F.struct(start.alias("start"), F.char_length(t["text"]).cast("bigint").alias("length"))
        return F.struct((start + F.char_length(t["text"])).alias("at"), F.when(t["role"] == learn, F.array_append(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    nothing = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    pieces = pieces.select(
        "conv_id", "piece", F.col("texts")[0]["role"].alias("first"), F.element_at("texts", -1)["role"].alias("last"),
        F.array_join(F.transform("texts", lambda t: F.concat(t["before"], t["text"])), "").alias("body"),
        F.aggregate("texts", nothing, add)["spans"].alias("spans"),
    )
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("piece", "first", "last", "body", "spans"))).alias("p"))
    parts = F.transform("p", lambda p, i: F.struct(_opening(F.get(F.col("p"), i - 1)["last"], p["first"]).alias("opening"), p["body"].alias("body"), p["spans"].alias("spans")))
    whole = whole.select("conv_id", parts.alias("p"))

    def place(done: Column, p: Column) -> Column:
        body = done["at"] + F.char_length(p["opening"])
        return F.struct((body + F.char_length(p["body"])).alias("at"), F.array_append(done["starts"], body).alias("starts"))

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    whole = whole.withColumn("starts", F.aggregate("p", begin, place)["starts"])
    moved = F.flatten(F.zip_with("p", "starts", lambda p, at: F.transform(p["spans"], lambda s: F.struct((s["start"] + at).alias("start"), s["length"].alias("length")))))
    text = F.concat(F.array_join(F.transform("p", lambda p: F.concat(p["opening"], p["body"])), ""), F.lit(f"{END}\n"))
    return whole.select("conv_id", text.alias("formatted"), moved.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns ``(role, text)`` of a formatted conversation, in order."""
    literal = lambda s: s.replace("|", r"\|")
    blocks = F.slice(F.split(formatted, literal(START)), 2, 1 << 30)

    def block(b: Column) -> Column:
        role = F.substring_index(b, "\n", 1)
        body = F.substring_index(F.substring(b, F.char_length(role) + 2, F.char_length(b)), END, 1)
        return F.transform(F.split(body, literal(SEP)), lambda t: F.struct(unescape_role(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, block))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
