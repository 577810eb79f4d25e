"""Preference formatting of paired conversations; DataFrame functions only.

The longest common prefix of turns of a chosen and a rejected conversation is rendered once as the prompt. What follows it
on either side is a completion, with the spans of assistant text that a trainer counts (all else is masked).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, END = "<|", "|>\n", "<|end|>\n"


def format_preferences(turns: DataFrame, pair: Column, is_chosen: Column, turn_col: str = "turn", role_col: str = "role",
                       text_col: str = "text") -> DataFrame:
    """One row per pair: pair_id, n_prompt_turns, n_chosen, n_rejected, prompt, chosen, rejected, chosen_spans, rejected_spans.

    Spans are structs (start, end) of assistant text in the completion, in code points, end exclusive. Turns are ordered by
    turn number, then role and text, so ties and repeated rows have one order. A null role is `user`, a null text is empty, a
    null turn number comes first. Rows without a pair (null) belong to no conversation and have no row. A pair with one side
    only has no common prefix and an empty completion on the other side. Other columns are ignored.

    One shuffle by pair; a conversation is a row of the result, so it is the unit that has to fit into a task.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("user")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sides = turns.select(pair.alias("pair_id"), is_chosen.alias("chosen"), turn.alias("t")).filter("pair_id IS NOT NULL")
    both = sides.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("chosen"), F.col("t")))).alias("a"),
        F.array_sort(F.collect_list(F.when(~F.col("chosen"), F.col("t")))).alias("b"))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    both = both.withColumn("same", same)
    prefix = F.coalesce(F.nullif(F.array_position("same", False), F.lit(0)) - 1, F.size("same").cast("long"))
    both = both.withColumn("n_prompt_turns", prefix)
    n = F.col("n_prompt_turns").cast("int")
    both = both.select("pair_id", "n_prompt_turns", F.size("a").cast("long").alias("n_chosen"), F.size("b").cast("long").alias("n_rejected"),
                       F.slice("a", F.lit(1), n).alias("p"), F.slice("a", n + 1, F.size("a")).alias("a"), F.slice("b", n + 1, F.size("b")).alias("b"))
    return both.select("pair_id", "n_prompt_turns", "n_chosen", "n_rejected", render("p").alias("prompt"), render("a").alias("chosen"),
                       render("b").alias("rejected"), spans("a").alias("chosen_spans"), spans("b").alias("rejected_spans"))


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE))


def render(turns: str) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def spans(turns: str) -> Column:
    """Where the text of assistant turns lies in the rendered turns."""
    none = F.from_json(F.lit("[]"), "array<struct<start:bigint,end:bigint>>")

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(_head(t))
        end = start + F.length(t["text"])
        own = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def span_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
