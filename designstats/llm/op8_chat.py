"""Chat formatting with typed content parts, in DataFrame functions only.

A conversation is flattened part by part: text is escaped, an attachment becomes a placeholder, and the
order of the placeholders is the order of the attachment list, which keeps each reference and the
number of tokens that the attachment expands to.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
#: Units of an attachment's size for each token it expands to: pixels, milliseconds, characters.
UNITS_PER_TOKEN = {"image": 784, "audio": 40, "document": 4}
PART = "struct<kind:string,text:string,ref:string,size:bigint>"


def escape(text: Column) -> Column:
    """No ``<`` is left, so no control string can begin inside a text or across two parts."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def is_attachment(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*UNITS_PER_TOKEN), F.lit(False))


def rendered(part: Column) -> Column:
    """The visitor: a placeholder for an attachment, the escaped text for anything else."""
    return F.when(is_attachment(part), F.concat(F.lit("<|"), part["kind"], F.lit("|>"))).otherwise(
        escape(F.coalesce(part["text"], F.lit("")))
    )


def attachment(part: Column) -> Column:
    per = F.lit(None).cast("long")
    for kind, units in UNITS_PER_TOKEN.items():
        per = F.when(part["kind"] == kind, F.lit(units)).otherwise(per)
    size = F.coalesce(part["size"], F.lit(0))
    return F.struct(
        part["kind"].alias("kind"), part["ref"].alias("ref"),
        F.greatest(F.lit(1), F.ceil(size / per)).cast("long").alias("tokens"),
    )


def text_parts(text: Column) -> Column:
    """The one-part content of a turn that is plain text."""
    none = F.lit(None).cast("string")
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), none.alias("ref"),
                            F.lit(None).cast("long").alias("size"))).cast(f"array<{PART}>")


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                parts: str = "parts", learn: str = "assistant") -> DataFrame:
    """One row per conversation: formatted text, loss spans (code points, from 0), attachments, turn count.

    Turns are ordered by (turn, role, text); repeated rows stay as turns of their own. A null or unknown
    kind is text, a null text, role or part list is empty, a null conversation id is one conversation and
    null turns come first. The turns of one conversation are gathered in one row, as its text must be.
    """
    body = F.array_join(F.transform(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), rendered), "")
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        body.alias("body"),
        F.transform(F.filter(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), is_attachment),
                    attachment).alias("attachments"),
    ).withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")))
    rows = rows.withColumn("chars", F.char_length("head") + F.char_length("body") + len(END) + 1)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn(
        "at", F.coalesce(F.sum("chars").over(before), F.lit(0)) + F.char_length("head")
    )
    turn_row = F.struct("place", F.concat("head", "body", F.lit(END), F.lit("\n")).alias("text"), "role", "at",
                        F.char_length("body").cast("long").alias("size"), "attachments")
    out = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn_row)).alias("t"))
    return out.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: x["text"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["role"] == learn),
                    lambda x: F.struct(x["at"].alias("start"), x["size"].alias("length"))).alias("loss_spans"),
        F.flatten(F.transform("t", lambda x: x["attachments"])).alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns back from a formatted text: array of (role, text); placeholders stay as they are."""
    chunk = F.split(formatted, "<\\|im_start\\|>", -1)
    return F.transform(
        F.slice(chunk, F.lit(2), F.greatest(F.size(chunk) - 1, F.lit(0))),
        lambda c: F.struct(
            unescape_role(F.substring_index(c, "\n", 1)).alias("role"),
            unescape(F.substring_index(F.substring(c, F.locate("\n", c) + 1, F.length(c)), END, 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )
