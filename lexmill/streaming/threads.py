"""Conversation state as a stream: which threads wait for a reply, and what became of them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "asked long, waiting boolean, last_id long"
OUT = "session_id string, thread_id string, n_messages long, waiting boolean, last_chat_id long"


def _fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Count the thread's messages; the one with the largest id tells whether it waits."""
    asked, waiting, last = state.get if state.exists else (0, False, -1)
    for batch in batches:
        asked += len(batch)
        newest = batch["chat_id"].idxmax()
        if int(batch.at[newest, "chat_id"]) >= last:
            last, waiting = int(batch.at[newest, "chat_id"]), batch.at[newest, "status"] == "need_clarify"
    state.update((int(asked), bool(waiting), int(last)))
    yield pd.DataFrame([(*key, int(asked), bool(waiting), int(last))], columns=["session_id", "thread_id", "n_messages", "waiting", "last_chat_id"])


def thread_states(messages: DataFrame) -> DataFrame:
    """Updates ``session_id, thread_id, n_messages, waiting, last_chat_id`` of a stream of chat rows.

    State is one small row per thread, kept by the state store; late rows count but don't change who waits.
    Missing session or thread ids are the empty one.
    """
    known = messages.select(F.coalesce("session_id", F.lit("")).alias("session_id"), F.coalesce("thread_id", F.lit("")).alias("thread_id"), "chat_id", "status").where("chat_id is not null")
    return known.groupBy("session_id", "thread_id").applyInPandasWithState(_fold, OUT, STATE, "update", "NoTimeout")


def thread_states_batch(messages: DataFrame) -> DataFrame:
    """The same states of a finished table."""
    known = messages.select(F.coalesce("session_id", F.lit("")).alias("session_id"), F.coalesce("thread_id", F.lit("")).alias("thread_id"), "chat_id", "status").where("chat_id is not null")
    return known.groupBy("session_id", "thread_id").agg(F.count(F.lit(1)).alias("n_messages"), F.max_by(F.coalesce(F.col("status") == "need_clarify", F.lit(False)), "chat_id").alias("waiting"), F.max("chat_id").alias("last_chat_id"))


def latest_states(updates: DataFrame) -> DataFrame:
    """Final state of each thread out of the updates that a stream wrote."""
    return updates.groupBy("session_id", "thread_id").agg(F.max_by(F.struct("n_messages", "waiting", "last_chat_id"), "n_messages").alias("s")).select("session_id", "thread_id", "s.*")
