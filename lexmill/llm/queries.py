"""Queries of the problems on training text, over the statute, chat and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.mixing import mixture
from lexmill.llm.pairs import defective_pairs
from lexmill.llm.sentences import sentence_units
from lexmill.llm.splitting import oversized_pieces
from lexmill.llm.tokenizer import encoded, with_token_count
from lexmill.llm.truncation import hidden_limits, text_facts, truncated, truncation_rates
from lexmill.llm.visual import consistent_texts, inconsistent_fields
from lexmill.sources.tables import blank, table, trimmed

TEXT_FIELDS = ["article_name", "title", "raw_content"]


def _articles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "parsed_article").where(~blank("mapc")).withColumn("mapc", trimmed("mapc"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of articles that are not in the consistent form."""
    return inconsistent_fields(_articles(spark, folder), ["snapshot_no", "mapc"], TEXT_FIELDS)


def p5_consistent(spark: SparkSession, folder: str) -> DataFrame:
    """Every article's fields in the consistent form."""
    return consistent_texts(_articles(spark, folder), ["snapshot_no", "mapc"], TEXT_FIELDS).select("snapshot_no", "mapc", "field", "consistent")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of index_document that lost their end."""
    return truncated(table(spark, folder, "index_document"), _articles(spark, folder))


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How often each loader truncates."""
    return truncation_rates(table(spark, folder, "index_document"), p3_found(spark, folder))


def p3_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Hidden limits of each loader, with the measure they are counted in."""
    return hidden_limits(text_facts(table(spark, folder, "index_document")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Defective pairs of question and answer, with the type of the defect."""
    return defective_pairs(table(spark, folder, "chat_log"))


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Defective pairs by type and route."""
    chats = table(spark, folder, "chat_log").select("chat_id", "route").where("chat_id is not null").groupBy("chat_id").agg(F.max("route").alias("route"))
    return p4_found(spark, folder).join(chats, "chat_id").groupBy("route", "defect_type").agg(F.count(F.lit(1)).alias("n_pairs"))


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of the articles of all snapshots that exceed a config's chunk_size."""
    configs = [tuple(r) for r in table(spark, folder, "chunk_config").select("config_id", "chunk_size", "chunk_overlap").collect()]
    return oversized_pieces(_articles(spark, folder), ["snapshot_no", "mapc"], "raw_content", configs)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Articles of snapshot 5 that had to be cut, by config: those of which the splitter made pieces."""
    return p6_pieces(spark, folder).where("snapshot_no = 5 and piece_no = 2").select("config_id", "mapc").distinct()


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of each document."""
    return encoded(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each document's ids decode to its text."""
    return encoded(table(spark, folder, "documents").select("doc_id", "text"), check="same").select("doc_id", F.size("ids").alias("n_ids"), "same")


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, folder, "mix_target")
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixture(with_token_count(docs), targets, key="doc_id", size="n_tokens")


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of each document in the mixture."""
    return _mixture(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mixture(spark, folder)[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Ends of the sentence units of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return sentence_units(docs, "doc_id").select("doc_id", "sent_end").distinct()


QUERIES = {
    "p3_found": p3_found,
    "p3_rates": p3_rates,
    "p3_limits": p3_limits,
    "p4_found": p4_found,
    "p4_rates": p4_rates,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p7_ids": p7_ids,
    "p7_round_trip": p7_round_trip,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p5_found": p5_found,
    "p5_consistent": p5_consistent,
}
SQL: dict[str, str] = {
    "p6_found": """select distinct config_id, trim(mapc) as mapc from parsed_article, chunk_config where snapshot_no = 5 and trim(coalesce(mapc,'')) <> '' and length(raw_content) > chunk_size""",
}
