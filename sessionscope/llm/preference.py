"""Preference formatting, in built-in functions only.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns is rendered once, as the
prompt; the turns that follow on either side become its completion, in segments that say which text is trained on
(assistant turns) and which is masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"


def render(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"), F.coalesce(turn["text"], F.lit("")), F.lit("<|end|>\n"))


def _turns(df: DataFrame, side: int, pair: str, turn: str, role: str, text: str) -> DataFrame:
    return df.select(df[pair].alias("pair"), F.lit(side).alias("side"), F.struct(df[turn].alias("turn"), df[role].alias("role"), df[text].alias("text")).alias("t"))


def format_pairs(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, rejected (rendered completions), chosen_segments and rejected_segments (text, trained),
    chosen_trained_chars, rejected_trained_chars, usable (both completions have a trained segment).

    Turns are ordered by number, role and text (null first); those that agree in role and text, nulls included, are common.
    Nulls and edges: a null role or text renders as empty; a side without turns has an empty completion and an empty
    prompt; a conversation that is the other's prefix leaves an empty completion; turns without a pair id belong
    to no pair and are left out; a repeated turn is a turn; other columns are ignored. One pair is one row, however long.
    """
    rows = _turns(chosen, 0, pair, turn, role, text).union(_turns(rejected, 1, pair, turn, role, text)).where("pair is not null")
    side = lambda k: F.array_sort(F.collect_list(F.when(F.col("side") == k, F.col("t"))))
    both = rows.groupBy("pair").agg(side(0).alias("c"), side(1).alias("r"))
    same = F.zip_with("c", "r", lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, F.lit(False))
    both = both.withColumn("n", F.when(first > 0, first - 1).otherwise(F.size(same).cast("bigint")).cast("int"))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    segments = lambda side: F.transform(rest(side), lambda t: F.struct(render(t).alias("text"), F.coalesce(t["role"] == TRAINED_ROLE, F.lit(False)).alias("trained")))
    cut = both.select("pair", "n", F.array_join(F.transform(F.slice("c", 1, F.col("n")), render), "").alias("prompt"), segments("c").alias("cs"), segments("r").alias("rs"))
    joined = lambda s: F.array_join(F.transform(s, lambda x: x["text"]), "")
    trained = lambda s: F.aggregate(s, F.lit(0).cast("bigint"), lambda total, x: total + F.when(x["trained"], F.length(x["text"])).otherwise(0))
    any_trained = lambda s: F.exists(s, lambda x: x["trained"])
    return cut.select(
        F.col("pair").alias("pair_id"), F.col("n").alias("n_prompt_turns"), "prompt", joined("cs").alias("chosen"), joined("rs").alias("rejected"),
        F.col("cs").alias("chosen_segments"), F.col("rs").alias("rejected_segments"), trained("cs").alias("chosen_trained_chars"), trained("rs").alias("rejected_trained_chars"),
        (any_trained("cs") & any_trained("rs")).alias("usable"))


def mask(segments: Column) -> Column:
    """Canonical text of a completion's segments: their lengths in code points in order, each behind ``t`` (trained) or ``m`` (masked)."""
    return F.array_join(F.transform(segments, lambda s: F.concat(F.when(s["trained"], F.lit("t")).otherwise(F.lit("m")), F.length(s["text"]).cast("string"))), ",")


def pairs_from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) turns that follow from a table of conversations, a pair a conversation. Chosen is the whole conversation.

    Rejected repeats the text of the first turn (a reply that does not answer) in one of the assistant turns, early or late, drawn from a
    digest of the id; every second such conversation ends there, the others go on with all later turns. A conversation
    without an assistant turn is rejected as it is chosen, so its completions are empty. Turns without a conversation are left out."""
    order = ["turn", "role", "text"]
    pair, before = Window.partitionBy("pair_id"), Window.partitionBy("pair_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answers = F.coalesce((F.col("role") == TRAINED_ROLE).cast("bigint"), F.lit(0))
    number = F.conv(F.substring(F.md5(F.col("pair_id").cast("string")), 1, 7), 16, 10).cast("bigint")
    turns = conversations.select(F.col("conv_id").alias("pair_id"), *order).where("pair_id is not null").withColumns({
        "number": number, "place": F.row_number().over(before), "nth": F.sum(answers).over(before), "answers": F.sum(answers).over(pair),
        "opening": F.min(F.struct(*order)).over(pair)["text"]})
    picked = (F.col("role") == TRAINED_ROLE) & (F.col("nth") == F.col("number") % F.greatest("answers", F.lit(1)) + 1)
    turns = turns.withColumn("at", F.min(F.when(picked, F.col("place"))).over(pair))
    ends = F.expr("(number div 16) % 2 = 1")
    wrong = F.when(F.col("place") == F.col("at"), F.col("opening")).otherwise(F.col("text"))
    rejected = turns.where(F.col("at").isNull() | (F.col("place") <= F.col("at")) | ~ends)
    return turns.select("pair_id", *order), rejected.select("pair_id", "turn", "role", wrong.alias("text"))
