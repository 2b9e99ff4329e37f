"""Chat formatting in budgeted windows (operator 4), with DataFrame functions only.

Turns are written as ``<|role|>\\ntext<|end|>\\n``. Within roles and texts a backslash is doubled and one is put between
``<`` and ``|``, so that no control string can appear there; dropping the first of each backslash pair restores them.

A conversation becomes windows of whole turns. Prefix sums of the turns' tokens give the spans: a turn joins the open
window if the window's system turn, repeated history and new turns stay within the budget, else it opens the next. The
spans of at most ``block`` turns are laid out together, so that a conversation of any length is spread over tasks.
Each window starts with the conversation's system turn and the last turns before it, as far as their own budget goes;
what is repeated is masked, and each assistant text is a target in exactly one window. A turn longer than the budget
has a window of its own; no text is cut or dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


@dataclass(frozen=True)
class Settings:
    budget: int = 2048
    history_turns: int = 2
    history_budget: int = 512
    target_role: str = "assistant"
    system_role: str = "system"
    block: int = 64


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens(text: Column) -> Column:
    """An estimate of tokens: words, and every fourth character of them."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + F.floor(F.length(text) / 4)


def _segment(turn: Column, repeated: Column, s: Settings) -> Column:
    return F.struct(
        turn["turn"].alias("turn"), turn["role"].alias("role"), turn["body"].alias("body"), repeated.alias("repeated"),
        (~repeated & (turn["raw_role"] == s.target_role)).alias("loss"),
    )


def windows(conversations: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row a window: conv_id, window (from 0 in each block of turns), block, text, segments.

    segments: array of (turn, role, start, length, repeated, loss), where start and length give a turn's escaped text in
    ``text`` by code points; ``loss`` marks targets. Order is by turn, null last, then role and text. Null role or text: empty. A null
    conv_id is a conversation. Repeated rows are turns of their own. An empty table gives an empty result; further columns are ignored.
    """
    s = settings
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("raw_role"), F.coalesce("text", F.lit("")).alias("raw"),
    ).withColumns({"role": escape(F.col("raw_role")), "body": escape(F.col("raw"))})
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "raw_role", "raw")
    one = F.struct("turn", "raw_role", "role", "body", (tokens(F.col("body")) + 4).alias("tokens"))
    is_system = F.col("raw_role") == s.system_role
    rows = rows.withColumn("one", one).withColumn("at", F.row_number().over(order) - 1).withColumn(
        "before", F.collect_list("one").over(order.rowsBetween(-s.history_turns, -1))
    ).withColumn(
        "system", F.last(F.when(is_system, F.struct("at", "one")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    )
    # The latest turns before this one that fit the history's budget, other than the system turn that is kept anyway.
    history = F.filter(F.col("before"), lambda t: t["raw_role"] != s.system_role)
    sums = lambda i: F.aggregate(F.slice(F.col("history"), i + 1, F.greatest(F.size("history"), F.lit(1))), F.lit(0).cast("long"), lambda a, t: a + t["tokens"])
    rows = rows.withColumn("history", history).withColumn("history", F.filter("history", lambda t, i: sums(i) <= s.history_budget))
    lead = F.coalesce(F.col("system.one.tokens"), F.lit(0)) + F.aggregate("history", F.lit(0).cast("long"), lambda a, t: a + t["tokens"])
    rows = rows.withColumn("lead", lead.cast("long")).withColumn("block", F.floor(F.col("at") / s.block).cast("long"))
    # Spans: running sums over the block's turns, as (tokens in the open window, number of the window).
    turn = F.struct("at", "one", "lead", "system", "history")
    blocks = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    sizes = F.transform("turns", lambda x: F.struct(x["lead"].alias("lead"), x["one"]["tokens"].cast("long").alias("tokens")))

    def step(state, x):
        fits = (state["used"] > 0) & (state["used"] + x["tokens"] <= s.budget)
        number = F.when(fits, state["number"]).otherwise(state["number"] + 1)
        return F.struct(
            F.when(fits, state["used"] + x["tokens"]).otherwise(x["lead"] + x["tokens"]).alias("used"), number.alias("number"),
            F.concat(state["numbers"], F.array(number)).alias("numbers"),
        )

    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(-1).alias("number"), F.array().cast("array<int>").alias("numbers"))
    blocks = blocks.withColumn("numbers", F.aggregate(sizes, start, step, lambda x: x["numbers"]))
    spans = blocks.withColumn("window", F.explode(F.sequence(F.lit(0), F.array_max("numbers"))))
    spans = spans.withColumn("new", F.filter("turns", lambda t, i: F.element_at("numbers", i + 1) == F.col("window"))).drop("turns", "numbers")
    spans = spans.withColumn("first", F.element_at("new", 1))
    again = lambda turns: F.transform(turns, lambda t: _segment(t, F.lit(True), s))
    lead_in = F.concat(
        F.when(F.col("first.system").isNotNull(), again(F.array(F.col("first.system.one")))).otherwise(again(F.slice("first.history", 1, 0))),
        again(F.col("first.history")),
    )
    fresh = F.transform("new", lambda x: _segment(x["one"], F.lit(False), s))
    parts = spans.select("conv_id", "block", "window", F.concat(lead_in, fresh).alias("parts"))
    head = lambda p: F.concat(F.lit(OPEN), p["role"], F.lit(CLOSE))
    written = lambda p: F.concat(head(p), p["body"], F.lit(END))

    def place(state, p):
        return F.struct(
            (state["end"] + F.length(written(p))).alias("end"),
            F.concat(state["segments"], F.array(F.struct(
                p["turn"].alias("turn"), p["role"].alias("role"), (state["end"] + F.length(head(p))).alias("start"),
                F.length(p["body"]).alias("length"), p["repeated"].alias("repeated"), p["loss"].alias("loss"),
            ))).alias("segments"),
        )

    kind = "array<struct<turn:bigint,role:string,start:int,length:int,repeated:boolean,loss:boolean>>"
    empty = F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("segments"))
    return parts.select(
        "conv_id", "block", "window", F.concat_ws("", F.transform("parts", written)).alias("text"),
        F.aggregate("parts", empty, place, lambda x: x["segments"]).alias("segments"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns of each conversation from its windows: conv_id, at (block, window, place), turn, role, text, loss, chars of its window on the first."""
    exploded = formatted.select("conv_id", "block", "window", "text", F.posexplode("segments").alias("place", "seg")).filter("not seg.repeated")
    return exploded.select(
        "conv_id", F.struct("block", "window", "place").alias("at"), F.col("seg.turn").alias("turn"),
        unescape(F.col("seg.role")).alias("role"), unescape(F.expr("substring(text, seg.start + 1, seg.length)")).alias("text"), F.col("seg.loss").alias("loss"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the windows alone."""
    sizes = formatted.groupBy("conv_id").agg(F.sum(F.length("text")).alias("formatted_chars"))
    turns = F.array_sort(F.collect_list(F.struct("at", "role", "text", "loss")))
    back = read_back(formatted).groupBy("conv_id").agg(turns.alias("turns"))
    joined = lambda parts: F.concat_ws("", parts)
    targets = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"])
    back = back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length(joined(targets)).cast("long").alias("loss_chars"), F.sha2(joined(targets), 256).alias("loss_sha256"),
    )
    return back.join(sizes.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold another template's control strings."""
    text = F.lit("</s>[INST] ok [/INST]")
    turns = F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))))
    return spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(turns).alias("t")).select("conv_id", "t.turn", "t.role", text.alias("text"))
