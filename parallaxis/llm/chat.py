"""Chat formatting in token-budgeted windows with loss masks, in SQL functions only.

A conversation's turns are laid end to end; running sums of their tokens cut them into turn-aligned spans. Each span
becomes one training window: the system turn if the conversation opens with one, the last turns before the span that
fit the history budget, then the span itself. Only assistant turns of the span are targets; repeated ones are masked,
so every assistant turn is learned once.

The sum's axis is divided into bins of the tokens that are free besides system turn and history. Turns inside one bin
form a span and a turn that crosses a bin's edge is a span by itself, so no span but a single long turn exceeds a bin.
Where the system turn leaves less than two history budgets, history and bin halve what it leaves. So a window keeps
the budget unless a single turn that does not fit beside system turn and history, or the system turn by itself,
exceeds it. At most four spans can begin within one history budget, so a turn is repeated at most four times.

A turn's tokens are estimated from its code points; give ``tokens`` to count them as a tokenizer does.

Windows, running sums and both groupings cluster by conversation: one shuffle carries each text once.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles ``\\`` becomes ``\\b`` and ``<|`` becomes
``<\\p`` (and a role's line feed ``\\n``), so control strings cannot occur in them and reading back is exact.

Edge cases: null texts and roles are empty; turns sort by (turn, role, text) with nulls first; equal rows are all
kept; a null conv_id is one conversation; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens of a window, and of the history repeated in it.
BUDGET, HISTORY = 2048, 512
#: A turn's tokens are its code points divided by this, rounded up, and TURN_OVERHEAD for the template.
CHARS_PER_TOKEN, TURN_OVERHEAD = 4, 4
AHEAD = 4


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    if role:
        text = F.replace(text, F.lit("\\n"), F.lit("\n"))
    return F.replace(F.replace(text, F.lit("<\\p"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def turn_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / CHARS_PER_TOKEN).cast("long") + TURN_OVERHEAD


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Column | None = None) -> DataFrame:
    """Training windows of ``conversations(conv_id, turn, role, text)``; ``tokens`` counts a turn's, of any columns.

    One row for each window: conv_id, window, formatted, n_tokens, n_repeated (turns at its head that an earlier
    window or the retained system turn already gave), loss_spans (code points of ``formatted``, end exclusive).
    """
    conv = Window.partitionBy("conv_id")
    in_order = conv.orderBy(F.asc_nulls_first("turn"), "role", "text")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    turns = (
        conversations.select(
            "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
            (turn_tokens(F.coalesce("text", F.lit(""))) if tokens is None else F.greatest(F.lit(1), F.coalesce(tokens, F.lit(1))).cast("long")).alias("tokens"),
        )
        .withColumn("rn", F.row_number().over(in_order))
        .withColumn("system", (F.col("rn") == 1) & (F.col("role") == "system"))
        .withColumn("stop", F.sum(F.when(F.col("system"), 0).otherwise(F.col("tokens"))).over(so_far))
        .withColumn("room", F.greatest(F.lit(1), budget - F.first(F.when(F.col("system"), F.col("tokens")).otherwise(0)).over(so_far)))
        .withColumn("history", F.least(F.lit(history), F.floor(F.col("room") / 2)))
        .withColumn("bin", F.col("room") - F.col("history"))
        .withColumn("start", F.when(F.col("system"), 0).otherwise(F.col("stop") - F.col("tokens")))
        .withColumn("low", F.floor(F.col("start") / F.col("bin")))
        .withColumn("high", F.floor((F.col("stop") - 1) / F.col("bin")))
    )
    earlier = lambda c: F.lag(F.when(~F.col("system"), F.col(c))).over(in_order)
    joined = (F.col("low") == F.col("high")) & (earlier("low") == earlier("high")) & (earlier("low") == F.col("low"))
    turns = (
        turns.withColumn("opens", F.when(F.col("system") | F.coalesce(joined, F.lit(False)), 0).otherwise(1))
        .withColumn("span", F.greatest(F.lit(0), F.sum("opens").over(so_far) - 1))
        .withColumn("spans", F.max("span").over(conv) + 1)
    )
    by_span = conv.orderBy("span")
    for k in range(1, AHEAD + 1):
        turns = turns.withColumn(f"next{k}", F.min("start").over(by_span.rangeBetween(k, k)))
    own = F.array(F.col("span"))
    again = F.flatten(F.array(*(F.when(F.col("start") >= F.col(f"next{k}") - F.col("history"), F.array(F.col("span") + k)).otherwise(F.array().cast("array<bigint>")) for k in range(1, AHEAD + 1))))
    placed = turns.withColumn("window", F.explode(F.when(F.col("system"), F.sequence(F.lit(0).cast("long"), F.col("spans") - 1)).otherwise(F.concat(own, again))))
    head = F.concat(F.lit(START), escape(F.col("role"), role=True), F.lit("\n"))
    inside = Window.partitionBy("conv_id", "window").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        placed.withColumn("repeated", F.col("window") != F.col("span"))
        .withColumn("shown", F.concat(head, escape(F.col("text")), F.lit(END)))
        .withColumn("until", F.sum(F.length("shown")).over(inside))
        .withColumn("from", F.col("until") - F.length("shown") + F.length(head))
        .withColumn("target", (F.col("role") == "assistant") & ~F.col("repeated"))
    )
    rows = F.sort_array(F.collect_list(F.struct("rn", "shown")))
    losses = F.sort_array(F.collect_list(F.when(F.col("target"), F.struct(F.col("from").alias("start"), (F.col("until") - len(END)).alias("end")))))
    return placed.groupBy("conv_id", "window").agg(
        F.array_join(F.transform(rows, lambda r: r["shown"]), "").alias("formatted"),
        F.sum("tokens").alias("n_tokens"),
        F.sum(F.col("repeated").cast("int")).alias("n_repeated"),
        losses.alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of conversations, from windows alone: turns and learned texts are parsed out of ``formatted``."""
    shown = F.split("formatted", r"<\|im_end\|>\n", -1)
    new = F.slice(shown, F.col("n_repeated").cast("int") + 1, F.greatest(F.lit(0), F.size(shown) - 1 - F.col("n_repeated").cast("int")))

    def turn(part: Column) -> Column:
        body = F.substr(part, F.lit(len(START) + 1))
        cut = F.instr(body, "\n")
        return F.concat(unescape(F.substr(body, F.lit(1), cut - 1), role=True), F.lit("\n"), unescape(F.substr(body, cut + 1)), F.lit("\n"))

    def learned(span: Column) -> Column:
        return unescape(F.substr(F.col("formatted"), (span["start"] + 1).cast("int"), (span["end"] - span["start"]).cast("int")))

    parsed = formatted.select(
        "conv_id", "window", F.size(new).alias("n"), F.array_join(F.transform(new, turn), "").alias("turns"),
        F.array_join(F.transform("loss_spans", learned), "").alias("loss"), F.length("formatted").alias("chars"),
    )
    listed = F.sort_array(F.collect_list(F.struct("window", "turns", "loss")))
    grouped = parsed.groupBy("conv_id").agg(listed.alias("listed"), F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"), F.sum(F.length("loss")).cast("long").alias("loss_chars"), F.count(F.lit(1)).alias("n_windows"))
    joined = lambda name: F.sha2(F.array_join(F.transform("listed", lambda x: x[name]), ""), 256)
    return grouped.select("conv_id", "n_turns", joined("turns").alias("turns_sha256"), "loss_chars", joined("loss").alias("loss_sha256"), "formatted_chars", "n_windows")
