"""Chunk records and saved conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import text

# The fields of a record, and of a saved state.
FIELDS = ["de_muc", "file_id", "article_code", "article_name", "mapc", "law_id", "topic_id", "title", "article", "issuer", "effective_date", "source_note"]
RECORD = "content string, metadata struct<" + ", ".join(f"{c}: string" for c in FIELDS) + ", related_articles: array<string>>"
STATE = "checkpoint_id string, session_id string, thread_id string, updated_at string, state struct<status: string, question: string, final_answer: string>"


def chunk_records(spark: SparkSession, path: str) -> DataFrame:
    """Normalised records of a JSON array (``.json``) or of JSON lines: flat, missing strings empty, content trimmed, blank labels left out.

    Lines that are no record are skipped.
    """
    if not path.endswith((".json", ".jsonl")):
        raise ValueError("chunk records are .json or .jsonl")
    raw = spark.read.schema(RECORD + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("multiLine", path.endswith(".json")).json(path)
    good = raw.where("_bad is null and (content is not null or metadata is not null)")
    labels = F.filter(F.coalesce("metadata.related_articles", F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    return good.select(F.trim(text("content")).alias("content"), *[text(F.col(f"metadata.{c}")).alias(c) for c in FIELDS], labels.alias("related_articles"))


def conversations(spark: SparkSession, folder: str, most: int) -> DataFrame:
    """The last ``most`` saved conversations below a folder, the latest first; unreadable files are skipped."""
    raw = spark.read.schema(STATE + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    good = raw.where("_bad is null and thread_id is not null")
    return good.select("session_id", "thread_id", "updated_at", "state.status", "state.question", "state.final_answer").orderBy(F.desc("updated_at"), F.desc("thread_id")).limit(most)


def saved(states: DataFrame, updates: DataFrame) -> DataFrame:
    """Saved states with those of the same session and thread replaced by later ones."""
    both = states.unionByName(updates)
    columns = [c for c in both.columns if c not in ("session_id", "thread_id")]
    newest = F.max_by(F.struct(*columns), "updated_at").alias("s")
    return both.groupBy("session_id", "thread_id").agg(newest).select("session_id", "thread_id", *[F.col("s")[c].alias(c) for c in columns])


def forgotten(states: DataFrame, ended: DataFrame) -> DataFrame:
    """Saved states without those of the ended sessions and threads; threads that were never saved make no difference."""
    return states.join(ended.select("session_id", "thread_id").distinct(), ["session_id", "thread_id"], "left_anti")
