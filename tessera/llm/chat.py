"""Chat formatting as one relational expression.

Turns are collected per conversation, sorted, cut into runs of one role, and each run becomes one
block of the template; only Spark expressions are used. The template:

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT<|im_end|>\\n

A run of adjacent turns of one role shares a block, with <|im_sep|> between its texts. Inside texts
and roles `&` becomes `&amp;` and `<|` becomes `&lt;|` (in roles a line feed also becomes `&#10;`), so
no control string can occur in them and the way back is exact.

Defined cases: a null text is an empty text, a null role an empty role, null turns come first; rows of
one conversation with the same turn are ordered by role, then text; repeated rows are all kept; a null
conv_id is a conversation of its own; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def running(numbers: str) -> Column:
    """For every item of a column of int arrays that aren't empty, the sum of the items before it.

    An aggregation that appends to an array copies it each time, so sums run over stretches of about the
    root of the size, and over the stretches' totals: n ** 1.5 copies for n items, not n ** 2."""
    def sums(xs: Column) -> Column:
        none = F.slice(F.array(F.lit(0)), 1, 0)
        return F.aggregate(xs, F.struct(F.lit(0).alias("at"), none.alias("before")), lambda a, x: F.struct(
            (a["at"] + x).alias("at"), F.concat(a["before"], F.array(a["at"])).alias("before")), lambda a: a["before"])

    step = F.ceil(F.sqrt(F.size(numbers))).cast("int")
    stretches = F.transform(F.sequence(F.lit(0), F.ceil(F.size(numbers) / step).cast("int") - 1), lambda k: F.slice(numbers, k * step + 1, step))
    totals = F.transform(stretches, lambda s: F.aggregate(s, F.lit(0), lambda a, x: a + x))
    return F.flatten(F.zip_with(stretches, sums(totals), lambda s, base: F.transform(sums(s), lambda x: x + base)))


def format_chats(turns: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    loss_spans: array of (start, length) in characters of `formatted`, one for each turn of a trained
    role, in order; it covers the escaped text alone, without markers.
    """
    role = F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("&#10;"))
    rows = turns.select("conv_id", F.struct(
        F.col("turn").alias("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.collect_list("t").alias("ts")).select(
        "conv_id", F.sort_array("ts").alias("ts"))
    # Where a run of one role starts, and one past the end.
    runs = ordered.select("conv_id", "ts", F.filter(
        F.sequence(F.lit(0), F.size("ts") - 1),
        lambda i: (i == 0) | (F.get("ts", i)["role"] != F.get("ts", i - 1)["role"])).alias("at"))
    blocks = runs.select("conv_id", F.transform("at", lambda i, k: F.struct(
        F.get("ts", i)["role"].alias("role"),
        F.transform(
            F.slice("ts", i + 1, F.coalesce(F.get("at", k + 1), F.size("ts")) - i),
            lambda t: escaped(t["text"])).alias("texts"))).alias("blocks"))
    texts = blocks.select("conv_id", "blocks", F.transform("blocks", lambda b: F.concat(
        F.lit(START), b["role"], F.lit("\n"), F.array_join(b["texts"], SEP), F.lit(f"{END}\n"))).alias("parts"))
    pieces = texts.select("conv_id", "parts", F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda x, k: F.struct(
        F.when(k == 0, F.length(b["role"]) + len(START) + 1).otherwise(len(SEP)).alias("before"),
        F.length(x).alias("length"),
        F.when(k == F.size(b["texts"]) - 1, len(END) + 1).otherwise(0).alias("after"),
        b["role"].isin(*trained_roles).alias("trained"))))).alias("pieces"))
    widths = pieces.select("conv_id", "parts", "pieces", F.transform(
        "pieces", lambda p: p["before"] + p["length"] + p["after"]).alias("widths"))
    placed = widths.select("conv_id", "parts", F.arrays_zip("pieces", running("widths").alias("at")).alias("placed"))
    spans = F.transform(F.filter("placed", lambda z: z["pieces"]["trained"]), lambda z: F.struct(
        (z["at"] + z["pieces"]["before"]).alias("start"), z["pieces"]["length"].alias("length")))
    return placed.select("conv_id", F.array_join("parts", "").alias("formatted"), spans.alias("loss_spans"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """The way back: conv_id, turns (array of role, text), loss_texts (unescaped, from loss_spans)."""
    block = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda b: b != "")
    cut = formatted.select("conv_id", "formatted", "loss_spans", block.alias("b"))
    turns = F.flatten(F.transform("b", lambda b: F.transform(
        F.split(F.substring(b, F.instr(b, F.lit("\n")) + 1,
                            F.length(b) - F.instr(b, F.lit("\n")) - len(END) - 1), r"<\|im_sep\|>"),
        lambda x: F.struct(
            unescaped(F.replace(F.substring_index(b, "\n", 1), F.lit("&#10;"), F.lit("\n"))).alias("role"),
            unescaped(x).alias("text")))))
    loss = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return cut.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_texts"))


def digest(parsed: DataFrame) -> DataFrame:
    """The digest columns of a parsed table."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = parsed.select("conv_id", "turns", "formatted", F.array_join("loss_texts", "").alias("loss"))
    return loss.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
