"""Relational work on the corpus: back-fill, grouping, manifest, statistics, incremental merge, point tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.session import kept
from lexmill.functions.text import clipped, iso_date, point_id, present, retrieval_text, text

from lexmill.operators.skew import split_join

MISSING = "(missing)"


def latest_rows(rows: DataFrame, key: list[str], loaded: str) -> DataFrame:
    """One row per key, the latest loaded; the fold is partial, so repeated keys are not gathered in one task."""
    columns = [c for c in rows.columns if c not in key]
    best = F.max_by(F.struct(*columns), F.struct(F.col(loaded), F.xxhash64(*columns))).alias("_r")
    return rows.groupBy(*key).agg(best).select(*key, *[F.col("_r")[c].alias(c) for c in columns])


def clean_issuer(col: Column) -> Column:
    """Whether an issuer is a name: no date in it, and at most 80 characters."""
    return ~F.lower(col).contains("ngày") & (F.length(col) <= 80)


def backfilled(articles: DataFrame, scope: list[str], position: str, fields: list[str], issuer: str = "issuer") -> DataFrame:
    """Articles with missing fields filled from others of the same scope (file and law).

    The longest value fills in, the first by ``position`` on a tie; for the issuer the first clean one,
    else the first. One aggregation and one join on the scope, heavy scopes split off; nothing is collected per scope.
    Rows with a blank scope value keep what they have.
    """

    def known(c: str, x: Column) -> Column:
        return F.when(present(c).isNotNull(), x)

    longest = [F.max_by(F.col(c), known(c, F.struct(F.length(c).alias("n"), (-F.col(position)).alias("p")))).alias(f"_{c}") for c in fields]
    first = F.max_by(F.col(issuer), known(issuer, F.struct(clean_issuer(F.col(issuer)).alias("c"), (-F.col(position)).alias("p")))).alias(f"_{issuer}")
    usable = articles
    for c in scope:
        usable = usable.where(present(c).isNotNull())
    best = usable.groupBy(*scope).agg(*longest, first)
    # One law may hold much of all rows: heavy scopes are filled in by a broadcast.
    joined = split_join(articles, best, scope)
    return joined.select(*[F.coalesce(present(c), F.col(f"_{c}"), F.lit("")).alias(c) if c in [*fields, issuer] else F.col(c) for c in articles.columns])


def source_laws(articles: DataFrame, file: str | list[str] = "file_id") -> DataFrame:
    """``file, law_id, title, issuer, effective_date``: the distinct laws of each file, by law_id else title."""
    named = articles.withColumn("_key", F.coalesce(present("law_id"), present("title"))).where("_key is not null")

    def longest(c: str) -> Column:
        return F.coalesce(F.max_by(text(c), F.struct(F.length(text(c)), text(c))), F.lit("")).alias(c)

    clean = F.when(present("issuer").isNotNull(), F.struct(clean_issuer(F.col("issuer")), F.col("issuer").alias("i")))
    return named.groupBy(*([file] if isinstance(file, str) else file), "_key").agg(longest("law_id"), longest("title"), F.coalesce(F.max(clean)["i"], F.lit("")).alias("issuer"), longest("effective_date")).drop("_key")


def manifest(articles: DataFrame, chunks: DataFrame, file: str | list[str] = "file_id") -> DataFrame:
    """``file, article_count, chunk_count, law_count, content_sha``: one row per file with its counts and content digest.

    The digest is made of digests of digests: the articles' ordered ones of each of 4,096 classes, then the classes'.
    So neither texts nor digests of a file that holds much of all articles come together in one task.
    """
    file = [file] if isinstance(file, str) else file
    told = articles.select(*file, present("law_id").alias("_law"), F.sha2(F.concat_ws("|", text("mapc"), text("raw_content")), 256).alias("_d"))
    ordered = lambda c: F.sha2(F.concat_ws("", F.array_sort(F.collect_list(c))), 256)
    classes = told.groupBy(*file, F.left("_d", F.lit(3)).alias("_c")).agg(F.count(F.lit(1)).alias("_n"), ordered("_d").alias("_s"))
    counts = classes.groupBy(*file).agg(F.sum("_n").alias("article_count"), F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("_c", "_s"))), lambda x: x["_s"])), 256).alias("content_sha"))
    laws = told.groupBy(*file).agg(F.count_distinct("_law").alias("law_count"))
    sections = chunks.groupBy(*file).agg(F.count(F.lit(1)).alias("chunk_count"))
    return counts.join(laws, file).join(sections, file, "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def corpus_stats(rows: DataFrame, content: str, fields: list[str], by: list[str] | None = None) -> DataFrame:
    """Counts of all rows, or of each group: rows, empty texts, mean and largest length, missing values of each field."""
    n = F.length(F.trim(text(content)))
    return rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(n == 0).alias("n_empty"),
        F.round(F.avg(n.cast("double")), 2).alias("avg_length"),
        F.max(n).cast("long").alias("max_length"),
        *[F.count_if(present(f).isNull()).alias(f"missing_{f}") for f in fields],
    )


def histogram(rows: DataFrame, field: str) -> DataFrame:
    """``value, n`` of a field, missing values under one name."""
    return rows.groupBy(F.coalesce(present(field), F.lit(MISSING)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def replaced(existing: DataFrame, updated: DataFrame, changed: DataFrame, key: str | list[str]) -> DataFrame:
    """Existing rows whose key is not among the changed ones, and the updated rows."""
    return existing.join(changed.select(key).distinct(), key, "left_anti").unionByName(updated)


def group_key(file: str = "file_id") -> Column:
    """Key of an article's group: file, law, code (else number) and name."""
    return F.concat_ws("|", text(file), text("law_id"), F.coalesce(present("article_code"), text("article")), text("article_name"))


def article_documents(chunks: DataFrame, position: str, key: Column, most_text: int = 12_000, most_payload: int = 50_000) -> DataFrame:
    """One index document per group of chunks: first metadata, distinct contents and related labels in order, clipped texts with flags.

    Repeated contents of a key are folded before the shuffle; only its distinct contents, which the document has, are put together.
    """
    meta = ["law_id", "article_code", "article_name", "title", "issuer", "effective_date", "mapc"]
    first = F.min(F.struct(F.col(position).alias("p"), F.struct(*[text(c).alias(c) for c in meta]).alias("m"))).alias("first")
    distinct = chunks.withColumn("_key", key).withColumn("_c", F.trim(text("content"))).groupBy("_key", "_c").agg(first, F.count(F.lit(1)).alias("n"))
    grouped = distinct.groupBy("_key").agg(
        F.min("first")["m"].alias("m"),
        F.sum("n").alias("chunk_count"),
        F.array_sort(F.collect_list(F.when(F.col("_c") != "", F.struct(F.col("first.p").alias("p"), F.col("_c").alias("c"))))).alias("parts"),
    )
    content = F.array_join(F.transform("parts", lambda x: x["c"]), "\n\n")
    # Labels are folded to one per key before they are put together in the order in which they are first seen.
    related = F.col("related_articles") if "related_articles" in chunks.columns else F.array().cast("array<string>")
    labels = chunks.select(key.alias("_key"), F.col(position).alias("p"), F.posexplode(related).alias("i", "label")).where(F.trim(text("label")) != "")
    seen = labels.groupBy("_key", "label").agg(F.min(F.struct("p", "i")).alias("at")).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("at", "label"))).alias("labels"))
    grouped = grouped.join(seen, "_key", "left").withColumn("related_articles", F.coalesce(F.transform("labels", lambda x: x["label"]), F.array().cast("array<string>")))
    docs = grouped.select(point_id("article", F.col("_key")).alias("point_id"), "m.*", "chunk_count", "related_articles", content.alias("content"))
    full = retrieval_text("title", "law_id", "article_code", "article_name", "content")
    shown, cut = clipped("content", most_payload)
    searched, cut_text = clipped(full, most_text)
    return docs.select("point_id", *meta, iso_date("effective_date").alias("effective_date_iso"), "chunk_count", "related_articles", shown.alias("content"), cut.alias("content_truncated"), searched.alias("retrieval_text"), cut_text.alias("retrieval_text_truncated"))


def chunk_documents(chunks: DataFrame, most_text: int = 12_000, most_payload: int = 50_000) -> DataFrame:
    """One index document per chunk: a stable id of its file, law, article and content, clipped texts with flags; repeated chunks come out once."""
    meta = ["file_id", "law_id", "article_code", "article_name", "article", "title", "issuer", "effective_date", "mapc", "de_muc"]
    key = F.concat_ws("|", text("file_id"), text("law_id"), text("article_code"), text("mapc"), F.sha1(text("content")))
    shown, cut = clipped(F.trim(text("content")), most_payload)
    searched, cut_text = clipped(retrieval_text("title", "law_id", "article", "article_code", "article_name", "de_muc", "content"), most_text)
    return chunks.select(point_id("chunk", key).alias("point_id"), *[text(c).alias(c) for c in meta], iso_date("effective_date").alias("effective_date_iso"), shown.alias("content"), cut.alias("content_truncated"), searched.alias("retrieval_text"), cut_text.alias("retrieval_text_truncated")).dropDuplicates(["point_id"])


def index_documents(level: str, chunks: DataFrame, position: str, key: Column) -> dict[str, DataFrame]:
    """Index documents by level: those of ``chunk``, ``article``, or ``both``; any other level is an error."""
    if level not in ("chunk", "article", "both"):
        raise ValueError(f"unknown level: {level}")
    made = {"chunk": lambda: chunk_documents(chunks), "article": lambda: article_documents(chunks, position, key)}
    return {name: make() for name, make in made.items() if level in (name, "both")}


def total_order(rows: DataFrame, by: list[Column]) -> DataFrame:
    """Rows with their place in a total order: a range-partitioned sort, then ordinals from the partitions' sizes.

    The sorted rows are kept, so that sizes and rows come from one evaluation and the same partitions. The
    only thing on the driver is one count per partition.
    """
    with_id = kept(rows.orderBy(*by).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    counts = with_id.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = counts.select("_p", "_first", (F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    return with_id.join(F.broadcast(before), "_p").withColumn("position", F.col("_before") + F.col("_i") - F.col("_first")).drop("_p", "_i", "_first", "_before")
