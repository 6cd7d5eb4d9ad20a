"""Preference formatting of paired conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shelf, numbered

OPEN, AFTER_ROLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(AFTER_ROLE), turn["text"], F.lit(CLOSE))


def _rows_of(conversations: DataFrame, key: str, side: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit("unknown"))
    return conversations.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("pair_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("turn"), role.alias("role"), text.alias("text")))).alias(f"t{side}"))


def format_preferences(chosen: DataFrame, rejected: DataFrame, key: str = "conv_id") -> DataFrame:
    """(conv_id, prompt, n_prompt_turns, chosen, rejected, chosen_mask, rejected_mask) for each key of both sides.

    Both tables have (key, turn, role, text). The longest common prefix of turns, equal in role and text, is rendered once as
    the prompt; the turns after it are each side's completion. A mask names the characters of its completion that are
    trained on, "start-end" for each assistant turn's text and closing sign, joined by commas: other roles' turns and the
    headers are masked out. One exchange a side on the key, the rest are array expressions.

    Defined cases: conversations equal throughout, or one a prefix of the other, leave an empty completion with an empty
    mask; nothing in common - an empty prompt; a null text is the empty text, a null role is "unknown", a null turn number comes
    first; turns with equal numbers are ordered by role and text; rows with a null key and keys of one side only give no row; other columns are ignored.
    """
    a = _rows_of(chosen, f"`{key}`", 0)
    b = _rows_of(rejected, f"`{key}`", 1)
    both = a.join(b, "pair_id")
    t0, t1 = F.col("t0"), F.col("t1")
    same = F.zip_with(t0, t1, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    # the first turn that differs; zip_with pads the shorter side with nulls, so its end differs too
    common = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same).cast("bigint")).cast("int")
    out = both.withColumn("n", common)
    tail = lambda t: F.slice(t, F.col("n") + 1, F.greatest(F.size(t) - F.col("n"), F.lit(0)))

    def joined(turns: Column) -> Column:
        return F.array_join(F.transform(turns, rendered), "")

    def mask(turns: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

        def step(acc, t):
            begin = acc["at"] + F.length(t["role"]) + len(OPEN) + len(AFTER_ROLE)
            end = begin + F.length(t["text"]) + len(CLOSE)
            span = F.when(t["role"] == "assistant", F.array(F.concat_ws("-", begin.cast("string"), (end - 1).cast("string")))).otherwise(F.array().cast("array<string>"))
            return F.struct(end.alias("at"), F.concat(acc["spans"], span).alias("spans"))

        return F.array_join(F.aggregate(turns, start, step)["spans"], ",")

    return out.select(
        F.col("pair_id").alias("conv_id"),
        joined(F.slice(t0, F.lit(1), F.col("n"))).alias("prompt"),
        F.col("n").alias("n_prompt_turns"),
        joined(tail(t0)).alias("chosen"),
        joined(tail(t1)).alias("rejected"),
        mask(tail(t0)).alias("chosen_mask"),
        mask(tail(t1)).alias("rejected_mask"),
    )


def swapped_answers(conversations: DataFrame, key: str = "conv_id", part_rows: int = 1_000_000) -> DataFrame:
    """A rejected side for conversations that come without one: the last assistant turn says what the next conversation's last one says.

    The next conversation is the one with the next larger identifier, of whatever type that can be sorted. Where it never answers, and in the last one, the last
    assistant turn is left out. Turns after the last assistant turn are left out on this side. A conversation without
    an assistant turn is as it was. Conversations are numbered by a range sort, so no task sees all of them.

    Defined cases: rows with a null identifier are left out; a null role is no assistant's; of several last assistant turns with one number
    the largest text is the answer, and each of them says the next one's; a null turn number comes first; other columns are left out; no rows - no rows.
    """
    shelf = Shelf(conversations.sparkSession, "chat")
    c = conversations.select(F.col(f"`{key}`").alias("conv_id"), "turn", "role", "text").where("conv_id is not null")
    # a null turn number is less than all others, as in the order of turns
    said = F.when(F.col("role") == "assistant", F.struct(F.col("turn").isNotNull().alias("has"), "turn", "text"))
    last = shelf.put(c.groupBy("conv_id").agg(F.max(said).alias("last")))
    last = shelf.put(numbered(last, ["conv_id"], 1 + last.count() // part_rows, "n", shelf))
    other = last.where("last is not null").select((F.col("n") - 1).alias("n"), F.lit(True).alias("there"), F.col("last.text").alias("other"))
    own = last.select("conv_id", "n", F.col("last").isNotNull().alias("speaks"), F.col("last.turn").alias("last_turn")).join(other, "n", "left")
    marked = c.join(own, "conv_id")
    at = F.coalesce(F.col("turn") <= F.col("last_turn"), F.col("turn").isNull())
    is_last = F.col("speaks") & (F.col("role") == "assistant") & F.col("turn").eqNullSafe(F.col("last_turn"))
    is_last = F.coalesce(is_last, F.lit(False))
    kept = marked.where(~F.col("speaks") | at).where(~is_last | F.col("there"))
    return kept.select(F.col("conv_id").alias(key), "turn", "role", F.when(is_last, F.col("other")).otherwise(F.col("text")).alias("text"))
