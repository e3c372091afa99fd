"""Chat formatting with Spark expressions: collect, sort, merge and join turn structs.

The template, for each run of turns of one role::

    ### role: first text<also>second text</turn>

with a line feed after it. Inside texts and roles control strings are escaped, reversibly: a
backslash becomes ``\\b``, ``###`` ``\\h``, ``</turn>`` ``\\t``, ``<also>`` ``\\a``, and in roles a
colon ``\\c``. So every backslash of a formatted text begins an escape, and no control string
occurs in a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END, ALSO, HEAD = "</turn>\n", "<also>", "### "
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"), ("<also>", "\\a"))


def escape(text: Column, role: bool = False) -> Column:
    for plain, coded in (*ESCAPES, *([(":", "\\c")] if role else [])):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for plain, coded in reversed((*ESCAPES, *([(":", "\\c")] if role else []))):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation: id, ``formatted``, ``loss_spans array<struct<start, end>>``.

    Spans are code points of ``formatted``, end exclusive, one for each (escaped) text of
    ``loss_role``. Turns are sorted by turn, then role, then text, so ties and repeated rows have
    one order and all stay; null turns come first; null texts and roles are empty strings; rows of a
    null conversation id form one conversation; an empty table gives an empty one. Other columns are
    not read. A conversation becomes one text, so it has to fit into one row; conversations are
    spread over partitions by the hash of their id.
    """
    rows = turns.select(
        F.col(id_col).alias("_c_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("_c_t"),
    )
    sorted_ = rows.groupBy("_c_id").agg(F.sort_array(F.collect_list("_c_t")).alias("_c_t"))
    t = F.col("_c_t")
    # places where the role changes; a block reaches to the next of them
    starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))
    placed = sorted_.select("_c_id", "_c_t", starts.alias("_c_s"))
    s = F.col("_c_s")
    blocks = F.transform(
        s,
        lambda at, k: F.struct(
            F.get(t, at)["role"].alias("role"),
            F.transform(F.slice(t, at + 1, F.coalesce(F.get(s, k + 1), F.size(t)) - at), lambda x: escape(x["text"])).alias("texts"),
        ),
    )
    merged = placed.select("_c_id", blocks.alias("_c_b"))
    b = F.col("_c_b")

    def head(block: Column) -> Column:
        return F.concat(F.lit(HEAD), escape(block["role"], role=True), F.lit(": "))

    def spans(acc: Column, block: Column) -> Column:
        within = F.aggregate(
            block["texts"],
            F.struct((acc["at"] + F.length(head(block))).alias("at"), acc["spans"].alias("spans")),
            lambda a, x: F.struct(
                (a["at"] + F.length(x) + len(ALSO)).alias("at"),
                F.when(block["role"] == loss_role, F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(x)).alias("end"))))).otherwise(a["spans"]).alias("spans"),
            ),
        )
        return F.struct((within["at"] - len(ALSO) + len(END)).alias("at"), within["spans"].alias("spans"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    return merged.select(
        F.col("_c_id").alias(id_col),
        F.array_join(F.transform(b, lambda x: F.concat(head(x), F.array_join(x["texts"], ALSO), F.lit(END))), "").alias("formatted"),
        F.aggregate(b, F.struct(F.lit(0).alias("at"), none.alias("spans")), spans, lambda a: a["spans"]).alias("loss_spans"),
    )


def parse_chat(formatted: Column) -> Column:
    """The turns of a formatted text, ``array<struct<role, text>>``, one for each text that went in."""
    parts = F.split(formatted, END, -1)
    blocks = F.slice(parts, 1, F.size(parts) - 1)

    def turns(block: Column) -> Column:
        head = F.substring_index(block, ": ", 1)
        body = F.substr(block, F.length(head) + 3)
        role = unescape(F.substr(head, F.lit(len(HEAD) + 1)), role=True)
        return F.transform(F.split(body, ALSO, -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def chat_digest(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of what can be read back from the output of :func:`format_chats`."""
    read = formatted.select(F.col(id_col), "formatted", parse_chat(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        id_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
