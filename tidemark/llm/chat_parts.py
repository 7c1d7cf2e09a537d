"""Chat formatting of messages whose content is a list of typed parts, with a loss mask, by DataFrame functions only.

A part has a ``kind`` (text, image, audio or document; null counts as text), a ``text``, a ``ref`` to its attachment and its
size in ``units`` (image tiles, audio seconds, document pages). A visitor turns each part into text: texts are escaped, others
become placeholders in their order, with a record of the attachment and the tokens it expands to. Unknown kinds are attachments too.

Template: ``<turn>role<text>body</turn>`` and a line feed per message. Control strings begin with ``<``; in texts and roles
``\\`` is written ``\\s`` and ``<`` is written ``\\l``, so no text can hold one, and reading is exact. Messages of a conversation
follow turn, then role, then body; null turns come first, null roles and texts are empty, null conversation ids are one conversation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, BODY, CLOSE = "<turn>", "<text>", "</turn>\n"
PART = "struct<kind: string, text: string, ref: string, units: bigint>"
#: Tokens that one unit of an attachment expands to, by kind.
TOKENS = {"image": 256, "audio": 25, "document": 512}


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def kind_of(part: Column) -> Column:
    return F.lower(F.coalesce(part["kind"], F.lit("text")))


def visit(part: Column, text: Callable[[Column], Column], attachment: Callable[[Column, Column], Column]) -> Column:
    """What the visitor makes of a part: ``text`` gets its text, ``attachment`` the part and its kind."""
    return F.when(kind_of(part) == "text", text(part["text"])).otherwise(attachment(part, kind_of(part)))


def body_of(parts: Column) -> Column:
    """The flattened content: escaped texts and placeholders, in order."""
    return F.array_join(F.transform(parts, lambda p: visit(p, escape, lambda _, kind: F.concat(F.lit("<"), escape(kind), F.lit("/>")))), "")


def attachments_of(parts: Column, tokens: dict[str, int] = TOKENS) -> Column:
    """(kind, ref, tokens) of the parts that are not text; kinds without a rate count one token a unit."""
    rate = F.create_map(*[F.lit(x) for pair in tokens.items() for x in pair])
    return F.transform(F.filter(parts, lambda p: kind_of(p) != "text"), lambda p: F.struct(
        kind_of(p).alias("kind"), p["ref"].alias("ref"),
        (F.coalesce(rate[kind_of(p)], F.lit(1)) * F.coalesce(p["units"], F.lit(1))).cast("long").alias("tokens")))


def text_part(text: Column) -> Column:
    """A content list of one text."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts",
                 learn: str = "assistant", tokens: dict[str, int] = TOKENS) -> DataFrame:
    """(conv, formatted, turn_starts, loss, attachments, attachment_tokens) per conversation.

    ``loss`` holds (turn, start, length) of the body of every message by ``learn``, in characters from 0. Messages are rendered
    where they lie; one shuffle by conversation then numbers, measures and joins them. A conversation is one text, so its rows meet
    in one task: its memory is that of the text itself.
    """
    empty = F.from_json(F.lit("[]"), f"array<{PART}>")
    parts = F.coalesce(F.col(parts_col), empty)
    rows = messages.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), F.coalesce(F.col(role_col), F.lit("")).alias("r"),
                           body_of(parts).alias("b"), attachments_of(parts, tokens).alias("a"))
    rows = rows.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("r")), F.lit(BODY)))
    rows = rows.withColumn("size", F.length("head") + F.length("b") + len(CLOSE))
    order = Window.partitionBy("c").orderBy("t", "r", "b")
    rows = rows.withColumns({
        "n": F.row_number().over(order),
        "start": F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")})
    whole = rows.groupBy("c").agg(F.array_sort(F.collect_list(F.struct(
        "n", "start", F.concat("head", "b", F.lit(CLOSE)).alias("text"), "a", (F.col("r") == learn).alias("learn"),
        F.length("head").cast("long").alias("lead"), F.length("b").cast("long").alias("len")))).alias("m"))
    attached = F.flatten(F.transform("m", lambda m: m["a"]))
    return whole.select(
        F.col("c").alias(conv_col), F.array_join(F.transform("m", lambda m: m["text"]), "").alias("formatted"),
        F.transform("m", lambda m: m["start"]).alias("turn_starts"),
        F.transform(F.filter("m", lambda m: m["learn"]), lambda m: F.struct(
            m["n"].alias("turn"), (m["start"] + m["lead"]).alias("start"), m["len"].alias("length"))).alias("loss"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda total, a: total + a["tokens"]).alias("attachment_tokens"))


def read_chats(chats: DataFrame) -> DataFrame:
    """``chats`` with ``turns``, the (role, text) read back from ``formatted``, and ``learnt``, the text under the mask, unescaped.

    Placeholders stay as they are in ``text``.
    """
    pieces = F.filter(F.split("formatted", CLOSE), lambda p: p != "")
    starts = F.col("turn_starts")
    cut = chats.withColumn("__p", pieces)
    return cut.withColumns({
        "turns": F.transform("__p", lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), BODY, 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, BODY) + len(BODY))).alias("text"))),
        "learnt": F.array_join(F.transform("loss", lambda s: unescape(F.substr(
            F.element_at("__p", s["turn"]), (s["start"] - F.element_at(starts, s["turn"]) + 1).cast("int"), s["length"].cast("int")))), ""),
    }).drop("__p")


def digests(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What was read back, as counts and SHA-256 digests, per conversation."""
    read = read_chats(chats)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(conv_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
