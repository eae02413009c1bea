"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns of a conversation are ordered by turn, then role and text. Prefix sums of
their token counts cut the conversation into turn-aligned spans: turns that lie
inside one multiple of the span budget go together, a turn that crosses a border
is a span of its own. A window holds the system turn (a leading turn of role
`system`), the last turns before the span that fit into the history budget, and
the span. Only the span's assistant texts are under the loss mask, so that each
is a target in exactly one window.

The template marks turns; its control strings, and those of other common
templates, are escaped inside roles and texts. `unescape` reverses that.

Defined results: a null role or text is empty; a null turn comes first; equal
rows are all kept; a null conv_id is a conversation of its own; a turn beyond the
budget fills a window alone (`over_budget`) and is never cut; a conversation of a
system turn only gives one window; extra columns are ignored; an empty table gives
no windows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, BODY, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: Strings that some chat template treats as control strings. Fixed values.
CONTROL = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>",
    "<|end_header_id|>", "<|eot_id|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<s>", "</s>", "<pad>",
    "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>",
)
#: Private-use character that starts an escape: 0 itself, 1 inside a control string, 2 a line feed.
MARK = "\ue000"
TOKEN = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]"
#: Tokens that the template adds to a turn.
OVERHEAD = 5


@dataclass(frozen=True)
class Budget:
    """Tokens of a window, and of them at most so many of repeated history."""

    window: int = 1024
    history: int = 256


def escape(text: Column) -> Column:
    """Reversible: no control string is left, and every MARK is followed by 0 or 1."""
    start = F.replace(text, F.lit(MARK), F.lit(MARK + "0"))
    return reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(f"{c[0]}{MARK}1{c[1:]}")), CONTROL, start)


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(MARK + "1"), F.lit("")), F.lit(MARK + "0"), F.lit(MARK))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(MARK + "2"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(MARK + "2"), F.lit("\n")))


def tokens(text: Column) -> Column:
    """Words, groups of up to three digits and single marks; `Budget` counts these."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def windows(conversations: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """One row per window: conv_id, window (from 0), n_repeated, n_turns, tokens, over_budget, formatted, loss.

    n_repeated: leading turns that an earlier window has as well. loss: code-point
    spans [start, end) of `formatted`, in order.
    """
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy("turn", "role", "text")
    rows = rows.withColumn("tok", tokens(F.col("text")) + OVERHEAD).withColumn("pos", F.row_number().over(order) - 1)
    rows = rows.withColumn("sys", (F.col("pos") == 0) & (F.col("role") == "system"))
    rows = rows.withColumn("sys_tok", F.max(F.when(F.col("sys"), F.col("tok"))).over(whole))
    room = F.greatest(F.lit(budget.window - budget.history) - F.coalesce("sys_tok", F.lit(0)), F.lit(1))
    before = F.sum(F.when(F.col("sys"), 0).otherwise(F.col("tok"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("at", F.when(F.col("sys"), -1).otherwise(before - F.col("tok")))
    key = F.struct(F.floor(F.col("at") / room), F.floor((F.col("at") + F.col("tok") - 1) / room))
    rows = rows.withColumn("key", F.when(~F.col("sys"), key))
    first = ~F.col("sys") & (F.lag("key").over(order).isNull() | (F.lag("key").over(order) != F.col("key")))
    rows = rows.withColumn("first", first)
    rows = rows.withColumn("span", F.sum(F.col("first").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    last = F.greatest(F.max("span").over(whole), F.lit(0))
    rows = rows.withColumn("last", last)
    # Spans that start within the history budget after a turn repeat it.
    ahead = whole.orderBy("at").rangeBetween(1, budget.history)
    rows = rows.withColumn("later", F.collect_list(F.when(F.col("first"), F.col("span"))).over(ahead))
    into = F.when(F.col("sys"), F.sequence(F.lit(0).cast("long"), F.col("last"))).otherwise(F.concat(F.array("span"), "later"))
    placed = rows.withColumn("window", F.explode(into)).withColumn(
        "repeated", F.when(F.col("sys"), F.col("window") > 0).otherwise(F.col("window") > F.col("span"))
    )
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit(BODY))
    placed = placed.select(
        "conv_id", "window", "tok",
        F.struct("pos", "repeated", F.col("role").alias("role"), head.alias("head"), escape(F.col("text")).alias("body")).alias("turn"),
    )
    grouped = placed.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list("turn")).alias("turns"), F.sum("tok").alias("tokens")
    )
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END)).alias("at"),
            F.when(
                (t["role"] == "assistant") & ~t["repeated"],
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(t["head"])).alias("start"),
                            (acc["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end"),
                        )
                    ),
                ),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return grouped.select(
        "conv_id", "window", F.size(F.filter("turns", lambda t: t["repeated"])).alias("n_repeated"),
        F.size("turns").alias("n_turns"), "tokens", (F.col("tokens") > budget.window).alias("over_budget"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        spans.alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>>: the turns of a formatted window."""
    parts = F.split(formatted, r"\Q" + END + r"\E")
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        cut = F.locate(BODY, part)
        return F.struct(
            unescape_role(F.substring(part, F.lit(len(START) + 1), cut - len(START) - 1)).alias("role"),
            unescape(F.substring(part, cut + 1, F.length(part))).alias("text"),
        )

    return F.transform(parts, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """array<string>: the unescaped texts under the loss mask."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))
