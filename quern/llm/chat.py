"""Chat formatting of typed content parts, in DataFrame expressions.

A visitor over each turn's parts writes text as escaped text and images, audio
and documents as placeholders in their order, and records each attachment's
reference and how many tokens it expands to.  A turn is written as

    <turn:ROLE>
    BODY</turn>

with `<`, `>` and the backslash escaped inside texts and roles, so that control
strings inside them cannot end a turn, and unescaping gives them back exactly.
The loss mask covers the bodies of the assistant's turns, as spans of code points.

Turns of a conversation are brought together by its id, which the result's row
needs whole; equal turn numbers stand in the order of role and text, by their
UTF-8 bytes before any escape.

Edge cases: null texts and roles read as empty; null conversation ids form one
conversation, null turns come first; unknown kinds of part are written as
documents of one page; a turn without parts has an empty body; empty tables give
empty results; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template.
OPEN, HEAD_END, CLOSE = "<turn:", ">\n", "</turn>\n"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A text as the only part of its turn."""
    null = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *null))


def visit(part: Column, place: Column) -> Column:
    """(body, kind, ref, tokens) of one part; place numbers it within its turn."""
    kind = F.coalesce(part["kind"], F.lit("document"))
    kind = F.when(kind.isin("text", "image", "audio"), kind).otherwise("document")
    tiles = F.ceil(F.coalesce(part["width"], F.lit(512)) / 512) * F.ceil(F.coalesce(part["height"], F.lit(512)) / 512)
    tokens = (
        F.when(kind == "text", F.ceil(F.length(F.coalesce(part["text"], F.lit(""))) / 4))
        .when(kind == "image", 85 + 170 * tiles)
        .when(kind == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * 25))
        .otherwise(F.coalesce(part["pages"], F.lit(1)) * 800)
    )
    body = F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), kind, F.lit(":"), place.cast("string"), F.lit("/>")))
    return F.struct(body.alias("body"), kind.alias("kind"), part["ref"].alias("ref"), tokens.cast("long").alias("tokens"))


def format_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans, attachments, n_tokens) from (conv_id, turn, role, parts).

    loss_spans are (start, length) in code points of formatted; attachments are
    (turn, place, kind, ref, tokens) in order.
    """
    role = F.coalesce("role", F.lit(""))
    given = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    plain = F.array_join(F.transform(given, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    turns = turns.select("conv_id", "turn", role.alias("role"), plain.alias("plain"), F.transform(given, visit).alias("parts"))
    body = F.array_join(F.transform("parts", lambda p: p["body"]), "")
    turns = turns.select("conv_id", "turn", "role", "plain", "parts", body.alias("body"), F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(HEAD_END)).alias("head"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "plain", "body")
    whole = F.length("head") + F.length("body") + len(CLOSE)
    placed = turns.withColumn("at", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum(whole).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    gathered = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "before", "turn", "role", "head", "body", "parts"))).alias("t"))
    return gathered.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.transform(F.filter("t", lambda t: t["role"] == "assistant"), lambda t: F.struct((t["before"] + F.length(t["head"])).alias("start"), F.length(t["body"]).cast("long").alias("length"))).alias("loss_spans"),
        F.flatten(
            F.transform("t", lambda t: F.filter(F.transform(t["parts"], lambda p, i: F.struct(t["turn"].alias("turn"), i.alias("place"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))), lambda p: p["kind"] != "text"))
        ).alias("attachments"),
        F.aggregate(F.flatten(F.transform("t", lambda t: F.transform(t["parts"], lambda p: p["tokens"]))), F.lit(0).cast("long"), lambda a, b: a + b).alias("n_tokens"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted): roles and texts parsed from formatted, and the unescaped text under the mask."""
    pieces = F.split("formatted", CLOSE, -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    cut = lambda p: F.instr(p, HEAD_END)
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring(p, F.lit(len(OPEN) + 1), cut(p) - 1 - len(OPEN))).alias("role"),
            unescape(F.substring(p, cut(p) + len(HEAD_END), F.length(p))).alias("text"),
        ),
    )
    under = F.array_join(F.transform("loss_spans", lambda s: F.substring("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))), "")
    return chats.select("conv_id", turns.alias("turns"), unescape(under).alias("loss_text"), "formatted")


def digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the output."""
    back = read_back(format_chat(conversations.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
