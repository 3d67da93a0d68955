"""Queries of the general problems over the statute tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.lookalike import SUSPECT
from lexmill.functions.reading import as_read
from lexmill.functions.visual_udf import consistent_udf
from lexmill.operators.orphans import orphan_references, orphan_report
from lexmill.operators.snapshot_diff import snapshot_changes
from lexmill.plans.oracle import expanded
from lexmill.sources.tables import blank, table, trimmed

ARTICLE_CODE = r"([0-9]+\.[0-9]+\.[A-ZĐ]+\.[0-9]+\.[0-9]+)"


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Articles (by mapc, on how raw_content reads) and files (by lower-case path, on the digest) that changed."""
    articles = snapshot_changes(
        table(spark, folder, "parsed_article").where(~blank("mapc")),
        snapshot=F.col("snapshot_no"),
        key=trimmed("mapc"),
        content=as_read("raw_content"),
        loaded=F.col("loaded_at"),
    )
    files = snapshot_changes(
        table(spark, folder, "manifest_entry").where(~blank("source_path")),
        snapshot=F.col("snapshot_no"),
        key=F.lower(trimmed("source_path")),
        content=F.lower(trimmed(F.coalesce("content_sha256", F.lit("")))),
        loaded=F.col("synced_at"),
    )
    named = [x.select("snapshot_no", F.lit(name).alias("record_table"), "record_key", "change_type") for x, name in ((articles, "parsed_article"), (files, "manifest_entry"))]
    return named[0].unionByName(named[1])


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Records added, removed and changed per table and snapshot."""
    return p1_found(spark, folder).groupBy("snapshot_no", "record_table", "change_type").agg(F.count(F.lit(1)).alias("n_records"))


def article_code(label: F.Column) -> F.Column:
    """The code a label names, without ``Điều ``: letter case, look-alikes and spacing don't matter; "" if it names none."""
    odd = label.rlike(SUSPECT)
    plain = F.coalesce(consistent_udf(F.when(odd, label)), label)
    return F.regexp_extract(F.upper(F.regexp_replace(plain, r"\s*\.\s*", ".")), ARTICLE_CODE, 1)


def _references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    articles = table(spark, folder, "parsed_article").select(F.col("snapshot_no").alias("period"), trimmed("mapc").alias("mapc"), "article_code", "related_articles")
    labels = articles.where(~blank("mapc")).select("period", F.col("mapc").alias("row_key"), F.explode("related_articles").alias("label")).where(~blank("label"))
    by_code = labels.select(F.lit("parsed_article").alias("ref_table"), "period", "row_key", article_code(F.col("label")).alias("ref_key"))
    points = table(spark, folder, "index_document").select(F.lit("index_document").alias("ref_table"), F.col("snapshot_no").alias("period"), F.col("point_id").alias("row_key"), trimmed("mapc").alias("ref_key"))
    codes = articles.select(F.lit("parsed_article").alias("ref_table"), "period", article_code(F.col("article_code")).alias("ref_key"))
    keys = articles.select(F.lit("index_document").alias("ref_table"), "period", F.col("mapc").alias("ref_key"))
    return by_code.unionByName(points), codes.unionByName(keys)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """References of related_articles (to codes) and of index_document (to mapc) without a target in their snapshot."""
    found = orphan_references(*_references(spark, folder))
    return found.select("ref_table", F.col("period").alias("snapshot_no"), "row_key", "ref_key", "reason")


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per table, snapshot and reason."""
    return orphan_report(*_references(spark, folder)).withColumnRenamed("period", "snapshot_no")


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p2_found": p2_found, "p2_report": p2_report}

# The labels' look-alikes that occur in codes, and invisible characters and odd spaces, are few enough for SQL.
_CODE = r"regexp_extract(upper(regexp_replace(regexp_replace(translate({0}, 'ÐðƉɖ', 'ĐđĐđ'), '[\x{ad}\x{200b}-\x{200d}\x{2060}\x{feff}]', '', 'g'), '\s*\.\s*', '.', 'g')), '([0-9]+\.[0-9]+\.[A-ZĐ]+\.[0-9]+\.[0-9]+)', 1)"
_P2 = f"""
with a as (select snapshot_no, @trim(mapc) as mapc, article_code, related_articles from parsed_article),
l as (select snapshot_no, mapc, unnest(related_articles) as label from a where coalesce(mapc,'')<>''),
r as (select distinct 'parsed_article' as ref_table, snapshot_no, mapc as row_key, {_CODE.replace('{0}', 'label')} as ref_key from l where @trim(coalesce(label,''))<>''
 union select distinct 'index_document', snapshot_no, point_id, @trim(mapc) from index_document where snapshot_no is not null),
t as (select distinct 'parsed_article' as ref_table, snapshot_no, {_CODE.replace('{0}', 'article_code')} as ref_key from a union select distinct 'index_document', snapshot_no, mapc from a where coalesce(mapc,'')<>''),
k as (select ref_table, ref_key, list(distinct snapshot_no) as held from t where coalesce(ref_key,'')<>'' group by 1, 2),
f as (select r.*, case when list_contains(coalesce(held,[]), r.snapshot_no) then null when len(list_filter(coalesce(held,[]), lambda x: x < r.snapshot_no)) > 0 then 'deleted' when len(list_filter(coalesce(held,[]), lambda x: x > r.snapshot_no)) > 0 then 'late' else 'missing' end as reason
 from r left join k using (ref_table, ref_key) where coalesce(r.ref_key,'')<>'')"""
SQL = {name: expanded(sql) for name, sql in {
    "p2_found": f"{_P2} select ref_table, snapshot_no, row_key, ref_key, reason from f where reason is not null",
    "p2_report": f"{_P2} select ref_table, snapshot_no, reason, count(*)::bigint as n_references, count(distinct ref_key)::bigint as n_keys from f where reason is not null group by all",
}.items()}
