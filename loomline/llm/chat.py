"""Chat formatting with DataFrame functions only.

A message has a role and an ordered list of typed content parts: struct(type, text, ref, units). ``flatten_parts`` visits
the parts: text stays (escaped), an image, audio or document part becomes an ordered placeholder ``<image:1>``, and the
visit records each attachment's reference with its number, offset and expanded token count. Turns become

    <s>role[INST]text[/INST]      for any role but the assistant's
    <s>role[INST]text</s>         for the assistant's, whose text is what a model learns (the loss mask)

Control strings inside roles and texts are escaped by one backslash after their bracket; a control string that already
has k backslashes there gets k + 1, so unescaping gives the text back exactly and an escaped text holds no control
string. What follows a text in the output opens with a bracket of its own, so no control string runs over its end. Offsets come from running sums over a conversation's turns, so a conversation costs time linear in its length;
its turns meet in one row because the row is the output.

Defined cases: null texts and roles count as empty; null parts and parts of unknown type are dropped; null units count
as 1; rows of equal (conversation, turn) are ordered by role and text; repeated rows are turns of their own; a null
conversation id is a conversation; an empty table gives no rows; texts of any length are whole; other columns are not
returned, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What the template writes and texts must not contain (fixed values).
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<image:", "<audio:", "<document:")
_CONTROL = r"(/?(?:s>|INST\]|(?:image|audio|document):\d))"
#: Tokens that one unit of a part expands to: image tiles, audio seconds, document pages.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 600}

PART = "struct<type:string,text:string,ref:string,units:long>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)\\" + _CONTROL, "$1$2$3")


def text_part(text: Column) -> Column:
    """The one part of a message that is text only."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))


def _known(parts: Column) -> Column:
    """The parts that are shown, in order."""
    return F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull() & p["type"].isin("text", *TOKENS_PER_UNIT))


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")


def flatten_parts(parts: Column) -> Column:
    """Struct of body (escaped text and placeholders in order) and attachments (kind, number, ref, tokens).

    The text between two attachments is joined before it is escaped, so parts cannot make a control string together.
    Numbers count up through a message's attachments; their positions cut the list of parts, so the visit is linear and
    needs no state.
    """
    known = _known(parts)
    kinds = F.create_map(*[x for k, v in TOKENS_PER_UNIT.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    tokens = lambda p: kinds[p["type"]] * F.coalesce(p["units"], F.lit(1).cast("long"))
    attached = F.filter(known, lambda p: p["type"] != "text")
    attachments = F.transform(attached, lambda p, k: F.struct(p["type"].alias("kind"), (k + 1).alias("number"), p["ref"].alias("ref"), tokens(p).alias("tokens")))
    # positions, from 1, of the attachments, and one past the end
    cuts = F.concat(F.filter(F.transform(known, lambda p, k: F.when(p["type"] != "text", k + 1)), lambda k: k.isNotNull()), F.array(F.size(known) + 1))
    ends = lambda k: F.element_at(cuts, k)
    run = lambda start, end: escape(_joined(F.slice(known, start, end - start)))
    shown = lambda p, k: F.concat(
        F.lit("<"), p["type"], F.lit(":"), (k + 1).cast("string"), F.lit(">"), run(ends(k + 1) + 1, ends(k + 2))
    )
    return F.struct(F.concat(run(F.lit(1), ends(F.lit(1))), F.array_join(F.transform(attached, shown), "")).alias("body"), attachments.alias("attachments"))


def format_chat(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", learn: str = "assistant") -> DataFrame:
    """Per conversation: conv_id, formatted, loss (spans of 1-based start and length), attachments, attachment_tokens.

    Attachments carry kind, number within their message, ref, tokens and turn position.
    """
    rows = messages.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        flatten_parts(F.col(parts_col)).alias("flat"), _joined(_known(F.col(parts_col))).alias("said"),
    )
    learned = F.col("role") == learn
    head = F.concat(F.lit("<s>"), escape(F.col("role")), F.lit("[INST]"))
    rows = rows.withColumn("head", head).withColumn("piece", F.concat("head", "flat.body", F.when(learned, F.lit("</s>")).otherwise(F.lit("[/INST]"))))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "said", "piece")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(
        "conv_id", "piece", F.col("flat.attachments").alias("attachments"),
        F.row_number().over(order).alias("k"),
        F.when(learned, F.struct(
            (F.sum(F.length("piece")).over(so_far) - F.length("piece") + F.length("head") + 1).alias("start"), F.length("flat.body").cast("long").alias("length"),
        )).alias("span"),
    )
    turns = F.sort_array(F.collect_list(F.struct("k", "piece", "span", "attachments")))
    grouped = rows.groupBy("conv_id").agg(turns.alias("turns"))
    attachments = F.flatten(F.transform("turns", lambda t: F.transform(t["attachments"], lambda a: F.struct(t["k"].alias("turn"), a["kind"].alias("kind"), a["number"].alias("number"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"),
        attachments.alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """Array of struct(role, text) read back from a formatted conversation; placeholders stay in the text."""
    pieces = F.split(formatted, "<s>")
    pieces = F.slice(pieces, F.lit(2), F.size(pieces))

    def turn(piece: Column) -> Column:
        body = F.regexp_replace(F.regexp_extract(piece, r"(?s)^.*?\[INST\](.*)$", 1), r"(?s)(?:\[/INST\]|</s>)\z", "")
        return F.struct(unescape(F.substring_index(piece, "[INST]", 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def read_parts(formatted: Column) -> Column:
    """For each turn an array of struct(type, text, number): texts as they were given, joined where no attachment parts
    them, and attachments by kind and number; empty texts are left out."""
    pieces = F.split(formatted, "<s>")
    pieces = F.slice(pieces, F.lit(2), F.size(pieces))
    mark = r"<(?:image|audio|document):\d+>"
    part = lambda kind, text, number: F.struct(kind.alias("type"), text.alias("text"), number.cast("int").alias("number"))

    def turn(piece: Column) -> Column:
        body = F.regexp_replace(F.regexp_extract(piece, r"(?s)^.*?\[INST\](.*)$", 1), r"(?s)(?:\[/INST\]|</s>)\z", "")
        texts, marks = F.split(body, mark), F.regexp_extract_all(body, F.lit(f"({mark})"))
        kinds = F.transform(marks, lambda m: part(F.regexp_extract(m, r"<(\w+):", 1), F.lit(None).cast("string"), F.regexp_extract(m, r":(\d+)", 1)))
        both = F.arrays_zip(F.transform(texts, lambda t: part(F.lit("text"), unescape(t), F.lit(None))).alias("t"), kinds.alias("m"))
        return F.filter(F.flatten(F.transform(both, lambda x: F.array(x["t"], x["m"]))), lambda p: p.isNotNull() & (F.coalesce(p["text"], F.lit("-")) != ""))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, joined."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"].cast("int"), s["length"].cast("int")))), "")
