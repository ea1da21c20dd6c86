"""Typed content parts flattened into one marked-up conversation, with column expressions only.

A turn holds an array of parts (kind, text, ref, tokens). A visitor over that array writes text parts
as they are and every image, audio or document part as one numbered placeholder; what the placeholder
stands for goes, in order, to a list of attachments with its expanded token count.

Control strings inside texts are escaped reversibly: a "<", any number of "\\" and a "|" get one more
"\\" before the "|". So "<|" never appears inside a text, and unescaping removes exactly one "\\".

Defined results: null texts and roles count as empty; a null part kind counts as text; null
conversation ids form one conversation; turns are ordered by turn, role and text, nulls first, so ties
and repeated rows have one order; an empty table gives no conversations.

A conversation is one output value, so it is gathered by one task; turns are formatted before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The marks of the template.
START, END = "<|im_start|>", "<|im_end|>"
MEDIA = ("image", "audio", "document")
PART = "struct<kind:string,text:string,ref:string,tokens:int>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role also must not contain the line feed that ends it."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # Pairs of backslashes, taken from the left, stand for one; between them "\\n" stands for a line feed.
    pieces = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def text_parts(text: Column) -> Column:
    """A plain text as a one-part content array."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            F.coalesce(text, F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("int").alias("tokens"),
        )
    )


def _is_media(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*MEDIA), F.lit(False))


def flatten_parts(parts: Column) -> Column:
    """The escaped body of a turn: texts and ordered placeholders."""

    def visit(part: Column, i: Column) -> Column:
        mark = F.concat(F.lit("<|"), part["kind"], F.lit(":"), i.cast("string"), F.lit("|>"))
        return F.when(_is_media(part), mark).otherwise(escape(F.coalesce(part["text"], F.lit(""))))

    return F.array_join(F.transform(parts, visit), "")


def attachments(parts: Column) -> Column:
    numbered = F.transform(
        parts,
        lambda p, i: F.struct(
            i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(1)).alias("tokens")
        ),
    )
    return F.filter(numbered, lambda p: F.coalesce(p["kind"].isin(*MEDIA), F.lit(False)))


def format_chats(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """turns(conv_id, turn, role, parts) -> conv_id, formatted, loss_spans, attachments, expanded_tokens.

    loss_spans has one (turn, start, chars) per turn, start counted from the turn's first character
    after its start mark; chars is 0 where the turn is not learned.
    """
    role = F.coalesce("role", F.lit(""))
    formatted = turns.select(
        "conv_id",
        "turn",
        role.alias("role"),
        escape_role(role).alias("_role"),
        flatten_parts(F.col("parts")).alias("_body"),
        attachments(F.col("parts")).alias("_media"),
    ).select(
        "conv_id",
        F.struct(
            "turn",
            "role",
            "_body",
            F.concat(F.lit(START), "_role", F.lit("\n"), "_body", F.lit(END), F.lit("\n")).alias("segment"),
            (F.length("_role") + 1).alias("start"),
            F.when(F.col("role") == learn, F.length("_body")).otherwise(F.lit(0)).alias("chars"),
            F.col("_media").alias("media"),
        ).alias("t"),
    )
    grouped = formatted.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    media = F.flatten(
        F.transform(
            "t",
            lambda x, i: F.transform(
                x["media"],
                lambda m: F.struct(i.alias("turn"), m["part"].alias("part"), m["kind"].alias("kind"), m["ref"].alias("ref"), m["tokens"].alias("tokens")),
            ),
        )
    )
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("formatted"),
        F.transform("t", lambda x, i: F.struct(i.alias("turn"), x["start"].alias("start"), x["chars"].alias("chars"))).alias("loss_spans"),
        media.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, m: a + m["tokens"]))


def parse_chats(chats: DataFrame) -> DataFrame:
    """Read conversations back from their formatted string and loss spans.

    Adds turns array<(role, text)> and loss_text array<string>, the unescaped text under the mask.
    """
    mark, end = START.replace("|", r"\|"), END + "\n"
    # The first piece, before the first start mark, is empty.
    pieces = chats.withColumn("_p", F.transform(F.split("formatted", mark), lambda x: F.substring(x, F.lit(1), F.length(x) - len(end))))
    pieces = pieces.withColumn("_p", F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))))

    def turn(x: Column) -> Column:
        at = F.instr(x, "\n")
        return F.struct(
            unescape_role(F.substring(x, F.lit(1), at - 1)).alias("role"),
            unescape(F.substring(x, at + 1, F.length(x))).alias("text"),
        )

    under = F.zip_with("_p", "loss_spans", lambda x, s: unescape(F.substring(x, s["start"] + 1, s["chars"])))
    return pieces.withColumn("turns", F.transform("_p", turn)).withColumn("loss_text", under).drop("_p")
