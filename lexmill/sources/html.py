"""Articles out of HTML snapshots of a codified collection."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.extract import source_note, title_parts
from lexmill.functions.text import clean_text

# Classes of the paragraphs, and the form of a chapter's code.
CLASSES = {"pChuong": "chapter", "pDieu": "article", "pGhiChu": "note", "pNoiDung": "body", "pChiDan": "related"}
CHAPTER = r"(?iu)^Chương\s+[IVXLCDM0-9]+\z"
NODE = "node_no int, kind string, text string, anchor string, links array<string>"


class _Nodes(HTMLParser):
    """Paragraphs directly below the content element (below the body where there is none), in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.headings = [], []
        self.kind = None
        self.depth = self.root = 0
        self.inner = self.skip = 0
        self.in_heading = self.in_link = False

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        names = (attrs.get("class") or "").split()
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "div":
            self.depth += 1
            if "_content" in names and not self.root:
                self.root, self.nodes, self.kind = self.depth, [], None
        elif tag == "h3" and not self.headings:
            self.in_heading = True
        elif tag == "p":
            kind = next((CLASSES[c] for c in names if c in CLASSES), None)
            if kind:
                self.kind = kind if not self.root or self.depth >= self.root else None
                self.inner = 0
                if self.kind:
                    self.nodes.append({"kind": kind, "text": [], "anchor": "", "links": []})
            elif self.kind:
                self.inner += 1
                self.nodes[-1]["text"].append("\n")
        elif tag == "a" and self.kind:
            self.in_link = True
            node = self.nodes[-1]
            node["anchor"] = node["anchor"] or attrs.get("name") or ""
            node["links"].append("")
        elif tag == "br" and self.kind:
            self.nodes[-1]["text"].append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "div":
            if self.root and self.depth == self.root:
                self.kind, self.root = None, self.root
            self.depth -= 1
        elif tag == "h3":
            self.in_heading = False
        elif tag == "a":
            self.in_link = False
        elif tag == "p" and self.kind:
            if self.inner:
                self.inner -= 1
                self.nodes[-1]["text"].append("\n")
            else:
                self.kind = None

    def handle_data(self, data):
        if self.skip:
            return
        if self.in_heading:
            self.headings.append(data)
        if self.kind:
            self.nodes[-1]["text"].append(data)
            if self.in_link and self.nodes[-1]["links"]:
                self.nodes[-1]["links"][-1] += data


def html_nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key, node_no, kind, text, anchor, links``: classified paragraphs of each page in order, and its heading, a line per text, as node 0.

    Unclosed and nested paragraphs, scripts and styles are dealt with; a page without such paragraphs has its heading only.
    Null pages have no rows.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, page in zip(batch["k"], batch["h"]):
                if page is None:
                    continue
                found = _Nodes()
                found.feed(page)
                found.close()
                rows.append((k, 0, "heading", "\n".join(x.strip() for x in found.headings if x.strip()), "", []))
                rows += [(k, i, n["kind"], "".join(n["text"]), n["anchor"], n["links"]) for i, n in enumerate(found.nodes, 1)]
            yield pd.DataFrame(rows, columns=["k", "node_no", "kind", "text", "anchor", "links"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(parse, f"k {kind}, {NODE}").withColumnRenamed("k", key)


def articles(nodes: DataFrame, key: str) -> DataFrame:
    """Articles of pages: each takes the first note, the first non-empty body and all links up to the next article or chapter.

    Chapters carry forward: a code starts one, any other chapter paragraph is its title. Running
    windows per page make the islands, one aggregation their rows.
    """
    page = Window.partitionBy(key).orderBy("node_no").rowsBetween(Window.unboundedPreceding, 0)
    plain = nodes.where("kind <> 'heading'").withColumn("text", clean_text("text"))
    chapter = (F.col("kind") == "chapter") & (F.col("text") != "")
    code = chapter & F.col("text").rlike(CHAPTER)
    plain = plain.withColumn("chapter_code", F.last(F.when(code, F.col("text")), ignorenulls=True).over(page))
    # A new code clears the title until the next title.
    plain = plain.withColumn("chapter_title", F.last(F.when(code, F.lit("")).when(chapter, F.col("text")), ignorenulls=True).over(page))
    starts = F.col("kind").isin("article", "chapter")
    plain = plain.withColumn("island", F.sum(starts.cast("int")).over(page))

    def first(kind: str, column: str = "text"):
        return F.coalesce(F.min_by(column, F.when((F.col("kind") == kind) & (F.col("text") != ""), F.col("node_no"))), F.lit(""))

    links = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "related", F.struct("node_no", "links")))), lambda x: x["links"]))
    labels = F.array_distinct(F.filter(F.transform(links, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""))
    grouped = plain.groupBy(key, "island").agg(
        F.bool_or(F.col("kind") == "article").alias("is_article"),
        first("article").alias("heading"), F.coalesce(F.max(F.when(F.col("kind") == "article", F.col("anchor"))), F.lit("")).alias("mapc"),
        first("note").alias("source_note"), first("body").alias("raw_content"), labels.alias("related_articles"),
        F.coalesce(F.max("chapter_code"), F.lit("")).alias("chapter_code"), F.coalesce(F.max("chapter_title"), F.lit("")).alias("chapter_title"),
    ).where("is_article")
    article_code, article_name = title_parts("heading")
    note = source_note("source_note")
    return grouped.select(key, F.col("island").alias("article_no"), article_code.alias("article_code"), article_name.alias("article_name"), "mapc", *[c.alias(n) for n, c in note.items()], "source_note", "related_articles", "raw_content", "chapter_code", "chapter_title")


def section_labels(nodes: DataFrame, key: str, lookup: DataFrame | None = None) -> DataFrame:
    """``key, de_muc``: what a page's section is called: the first two lines of its heading, else the lookup's name of its key, else the key.

    ``lookup``: value, name, a few rows; they are looked up by the page's key.
    """
    lines = F.filter(F.split(clean_text("text"), "\n"), lambda x: x != "")
    label = F.nullif(F.array_join(F.slice(lines, 1, 2), " - "), F.lit(""))
    heads = nodes.where("kind = 'heading'").select(key, label.alias("_label"))
    if lookup is None:
        return heads.select(key, F.coalesce("_label", F.col(key).cast("string")).alias("de_muc"))
    names = F.broadcast(lookup.select(F.col("value").alias(key), F.col("name").alias("_name")))
    return heads.join(names, key, "left").select(key, F.coalesce("_label", F.nullif(F.trim("_name"), F.lit("")), F.col(key).cast("string")).alias("de_muc"))


def snapshot_root(spark: SparkSession, path: str) -> str | None:
    """The folder of a snapshot, the one that holds ``jsonData.js``: a folder or its parent, or a file's folder or the one above; None if neither."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    first = hadoop if files.exists(hadoop) and files.getFileStatus(hadoop).isDirectory() else hadoop.getParent()
    for folder in (first, first.getParent() if first is not None else None):
        if folder is not None and files.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "jsonData.js")):
            return folder.toString()
    return None


def html_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, file_id, html, sha256, file_size, modified``: the HTML files below a folder, libraries and the index page left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(folder)
    own = files.where(~F.lower("path").rlike(r"/lib/") & ~F.lower("path").rlike(r"/bophapdien\.html\z"))
    name = F.regexp_extract("path", r"([^/]+)\.html\z", 1)
    return own.select("path", name.alias("file_id"), F.decode("content", "UTF-8").alias("html"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))


def js_array(script: str, name: str) -> list:
    """The JSON array that a script assigns to a variable; [] if there is none. Brackets within strings don't count."""
    start = re.search(rf"\b{re.escape(name)}\s*=\s*\[", script)
    if not start:
        return []
    found, _ = json.JSONDecoder().raw_decode(script[start.end() - 1 :])
    return found


def lookups(spark: SparkSession, script: str) -> tuple[DataFrame, DataFrame]:
    """Topics and sections of a snapshot's lookup script; rows without a value are left out. The script is one small file."""
    schema = "value string, name string, stt string, topic string"
    made = [[(str(x["Value"]), x.get("Text") or "", str(x.get("STT") or ""), str(x.get("ChuDe") or "")) for x in js_array(script, name) if x.get("Value")] for name in ("jdChuDe", "jdDeMuc")]
    return spark.createDataFrame(made[0], schema).drop("topic"), spark.createDataFrame(made[1], schema)
