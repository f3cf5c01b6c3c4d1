"""Conversations: listing, history, feedback, and what an anonymous reader is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of documents whose heading trail may be shown to an anonymous reader (fixed values).
DISCLOSABLE = ("page", "article", "manual")


def listed(messages: DataFrame) -> DataFrame:
    """One row per conversation: its messages, its turns (a user's message is one), its first turn."""
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.count_if(F.col("role") == "user").alias("n_turns"), F.min("turn").alias("first_turn"))


def history(messages: DataFrame, most: int) -> DataFrame:
    """The last ``most`` messages of each conversation, oldest first by ``place``."""
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = messages.withColumn("__n", F.row_number().over(last)).where(F.col("__n") <= most)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).drop("__n")


def with_feedback(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """Assistant messages with the last feedback given on each: ``conv_id, turn, feedback``."""
    last = feedback.groupBy("conv_id", "turn").agg(F.max_by("feedback", "at").alias("feedback"))
    return messages.where("role = 'assistant'").select("conv_id", "turn").join(last, ["conv_id", "turn"], "left")


def shareable(shares: DataFrame, now: Column) -> DataFrame:
    """Shares that may still be opened: ``token_hash, conv_id`` of those neither revoked nor past their time."""
    return shares.where(~F.col("revoked") & (F.col("expires_at").isNull() | (F.col("expires_at") > now))).select("token_hash", "conv_id")


def anonymous(citations: DataFrame, disclosable: tuple[str, ...] = DISCLOSABLE) -> DataFrame:
    """Citations as an anonymous reader sees them: the page number, and the heading trail of disclosable
    kinds; no title, address, text or id of a document leaves."""
    trail = F.when(F.col("kind").isin(*disclosable), F.col("heading_text"))
    return citations.select("answer_id", "slot", F.col("page"), trail.alias("trail"))


def prompts(questions: DataFrame, passages: DataFrame, messages: DataFrame, system: str, budget: int) -> DataFrame:
    """``query_id, prompt``: the system's words, numbered passages, the conversation so far, and the question.

    ``questions`` has ``query_id, conv_id, text``; ``passages`` ``query_id, rank, text``; ``messages`` ``conv_id, turn,
    role, text, tokens``, of which the latest that fit ``budget`` are told, oldest first. Parts that are empty are left out.
    """
    from folioforge.operators.corpus import history_cut

    shown = passages.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("p"))
    numbered = F.array_join(F.transform("p", lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["text"])), "\n")
    told = history_cut(messages, budget).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    lines = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")
    joined = questions.join(shown, "query_id", "left").join(told, "conv_id", "left")
    part = lambda title, body: F.when(body.isNotNull() & (body != ""), F.concat(F.lit(f"{title}\n"), body))
    return joined.select("query_id", F.concat_ws("\n\n", F.lit(system), part("Passages:", numbered), part("Conversation:", lines), F.concat(F.lit("Question: "), "text")).alias("prompt"))
