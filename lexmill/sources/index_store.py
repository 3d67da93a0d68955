"""Versioned point tables: upsert by key, stale points, alias, retention; records and sinks of the corpus."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.text import collapse, text


def collection_name(prefix: str, version: str | None, day: str, explicit: str | None = None, level: str = "chunk") -> str:
    """Name of a version of a collection: an explicit one wins, else prefix and version (the day by default).

    One explicit name cannot stand for both levels.
    """
    if explicit and level == "both":
        raise ValueError("an explicit name stands for one level only")
    return explicit or f"{prefix}_v{version or day}"


def upserted(existing: DataFrame, points: DataFrame, key: str = "point_id") -> DataFrame:
    """Existing rows with the points of the same key replaced: running it twice changes nothing."""
    return existing.join(points.select(key).distinct(), key, "left_anti").unionByName(points.dropDuplicates([key]))


def without_values(existing: DataFrame, field: str, values: DataFrame) -> DataFrame:
    """Points whose field is none of the values."""
    return existing.join(values.select(F.col(values.columns[0]).alias(field)).distinct(), field, "left_anti")


def retained(names: DataFrame, prefix: str, keep: int, protected: list[str]) -> DataFrame:
    """``name, keep``: of the names with a prefix the last ``keep`` in order, and the protected ones, stay."""
    own = names.where(F.col("name").startswith(prefix))
    place = F.row_number().over(Window.orderBy(F.desc("name")))
    return own.withColumn("place", place).select("name", ((F.col("place") <= keep) | F.col("name").isin(protected or [""])).alias("keep"))


class Collections:
    """Point tables below a shared folder, with aliases that name the active version."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def write(self, name: str, points: DataFrame) -> None:
        points.write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.target(name) or name}")

    def target(self, alias: str) -> str | None:
        """Collection an alias names, None if there is no such alias."""
        path = f"{self.folder}/_aliases/{alias}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return None
        return self.spark.read.text(path).first()[0]

    def switch(self, alias: str, name: str) -> str | None:
        """Point an alias to another collection; the one it named before, unchanged if it is the same."""
        before = self.target(alias)
        if before != name:
            self.spark.createDataFrame([(name,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/_aliases/{alias}")
        return before


def preview(rows: DataFrame, content: str, columns: list[str], related: str, most: int = 240) -> DataFrame:
    """The columns, the content's length, its first characters in one line, and the number of related labels."""
    x = F.trim(text(content))
    return rows.select(*columns, F.length(x).alias("content_length"), F.substring(F.replace(x, F.lit("\n"), F.lit(" ")), 1, most).alias("content_preview"), F.coalesce(F.size(related), F.lit(0)).alias("n_related"))


def json_array(rows: DataFrame, folder: str) -> None:
    """Rows as JSON arrays, one per part file, so that no row passes through one task; ``[]`` for a part without rows is not written."""

    def arrays(batches):
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"value": ["[" + ",\n".join(batch["value"]) + "]"]})

    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).mapInPandas(arrays, "value string").write.mode("overwrite").text(folder)


def export_corpus(chunks: DataFrame, manifest: DataFrame, stats: DataFrame, folder: str, preview_columns: list[str]) -> None:
    """Corpus as Parquet and JSON lines, manifest and statistics as JSON lines, the preview as CSV; no file is forced to be one."""
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks.parquet")
    chunks.write.mode("overwrite").json(f"{folder}/chunks.jsonl")
    json_array(chunks, f"{folder}/chunks.json")
    preview(chunks, "content", preview_columns, "related_articles").write.mode("overwrite").csv(f"{folder}/preview.csv", header=True)
    manifest.write.mode("overwrite").json(f"{folder}/manifest.jsonl")
    stats.write.mode("overwrite").json(f"{folder}/stats.jsonl")


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases ``query, ground_truth_mapc`` of JSON lines or CSV; a list may be JSON text or separated by commas; blank queries are left out."""
    raw = spark.read.csv(path, header=True) if path.endswith(".csv") else spark.read.schema("query string, ground_truth_mapc string").json(path)
    x = F.trim(text("ground_truth_mapc"))
    listed = F.when(x.startswith("["), F.from_json(x, "array<string>")).otherwise(F.transform(F.split(x, ","), lambda v: F.trim(v)))
    return raw.select(collapse("query").alias("query"), F.filter(listed, lambda v: v != "").alias("ground_truth_mapc")).where("query <> ''")
