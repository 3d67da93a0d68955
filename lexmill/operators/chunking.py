"""Sections and chunks of articles along clauses and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import clean_text, text

# What starts a clause and a point.
CLAUSE = r"^[0-9]+\.\s+"
POINT = r"(?iu)^[a-zđ]\)\s+"


def numbered_lines(articles: DataFrame, key: list[str], body: str) -> DataFrame:
    """``*key, line_no, line, clause_no, point_no``: non-empty lines with the clause and point they stand in.

    Running counts of the starts carry clause and point forward; 0 is the preamble of the article or clause.
    The window is over one article's lines.
    """
    lines = articles.select(*key, F.posexplode(F.split(clean_text(body), "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    by_article = Window.partitionBy(*key).orderBy("line_no")
    started = lines.withColumn("clause_no", F.sum(F.col("line").rlike(CLAUSE).cast("int")).over(by_article))
    by_clause = Window.partitionBy(*key, "clause_no").orderBy("line_no")
    point = F.col("line").rlike(POINT) & (F.col("clause_no") > 0)
    return started.withColumn("point_no", F.sum(point.cast("int")).over(by_clause))


def article_sections(articles: DataFrame, key: list[str], body: str) -> DataFrame:
    """``*key, section_no, section``: an article without clauses is one section, as is a clause without points; else one per point.

    A section repeats the preamble of its article and, for a point, the header and preamble of its clause.
    Articles without text have one empty section. Keys must tell articles apart.
    """
    lines = numbered_lines(articles, key, body)
    parts = lines.groupBy(*key, "clause_no", "point_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("part"))
    clauses = parts.groupBy(*key, "clause_no").agg(F.array_sort(F.collect_list(F.struct("point_no", "part"))).alias("points"))
    whole = clauses.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("clause_no", "points"))).alias("clauses"))

    def part(points, n):
        return F.filter(points, lambda p: (p["point_no"] > 0) == n)

    def joined(*texts):
        return F.concat_ws("\n", *texts)

    preamble = F.try_element_at(F.filter("clauses", lambda c: c["clause_no"] == 0), F.lit(1))["points"]
    lead = F.when(preamble.isNotNull(), F.array_join(F.transform(preamble, lambda p: p["part"]), "\n"))
    real = F.filter("clauses", lambda c: c["clause_no"] > 0)
    of_clause = F.transform(
        real,
        lambda c: F.when(F.size(part(c["points"], True)) == 0, F.array(joined(F.col("lead"), c["points"][0]["part"]))).otherwise(F.transform(part(c["points"], True), lambda p: joined(F.col("lead"), F.array_join(F.transform(part(c["points"], False), lambda q: q["part"]), "\n"), p["part"]))),
    )
    sections = F.when(F.size(real) == 0, F.array(F.col("lead"))).otherwise(F.flatten(of_clause))
    cut = whole.withColumn("lead", lead).select(*key, F.posexplode(sections).alias("section_no", "section"))
    return articles.select(*key).distinct().join(cut, key, "left").select(*key, F.coalesce("section_no", F.lit(0)).alias("section_no"), F.coalesce("section", F.lit("")).alias("section"))


def with_heading(sections: DataFrame, heading: list[str], section: str = "section") -> DataFrame:
    """Sections with the article's heading in a line of its own above the text."""
    head = F.concat_ws(" ", *[F.nullif(F.trim(text(c)), F.lit("")) for c in heading])
    return sections.withColumn("content", F.when(F.col(section) == "", F.lit("")).otherwise(F.concat_ws("\n", F.nullif(head, F.lit("")), F.col(section))))
