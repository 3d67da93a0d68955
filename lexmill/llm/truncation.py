"""Text cut off by field limits or mid-transfer.

Hidden storage limits show where the lengths of many values of one source pile up at their
maximum, once the right way of counting is found: characters, bytes, escaped or with converted
line ends. The endings of the values then tell which of them lost their end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.session import written
from lexmill.operators.skew import split_join
from lexmill.sources.tables import trimmed

#: Values of one source and period at the same length (or up to SLACK below it, as cut values lose
#: trailing space or a broken character) that make it a limit.
AT_LIMIT = 3
SLACK = 3
#: A pile below longer values is a limit too if it has so many values, and so many times those of its surroundings.
PILE, STANDS_OUT, SURROUNDINGS = 10, 8, 100
#: Measures, the simplest first: it is named where several fit equally well.
MEASURES = ["characters", "utf8_bytes", "utf16_units", "crlf_characters", "crlf_bytes", "json_characters", "json_ascii", "entity_characters"]
#: Characters of the tails that are compared with the article's end.
TAIL = 40
#: Characters before an end that its signs can reach back to.
REACH = 160

# How sections of statutes end without a full stop.
LINE_ENDS = r"(?U)(?:^[-–+•*] ?.*[A-ZĐ]{2,}\.?|^\p{L}[^.!?]*: [\d.,]+ \p{L}+/\p{L}+|^(?:Phụ lục|Mẫu|Bảng|Biểu)\b.{0,20}\d+[a-z]?|^\|.*\||\bv\.v\.?)\z"
SENTENCE_END = r"[.!?…。！？؟।។]['\"”’»›)\]）】」』]*\z|[)\]）】」』”’»]\z"
#: A full stop within a number: an amount without its unit.
NUMBER_CUT = r"(?U)\b(?:từ|đến|là|phí|mức) \d{1,3}(?:\.\d{3})*\.\z"
MARK = r"\s*(?:…|\.{3,}|\[…\]|\[\.{3}\])\z"


def _count(text: Column, *found: str) -> Column:
    """Occurrences of single characters; plain replacement is far cheaper than a pattern."""
    return sum(F.length(text) - F.length(F.replace(text, F.lit(x), F.lit(""))) for x in found)


def lengths(text: Column) -> Column:
    """Array of the text's length as different stores would count it, in the order of ``MEASURES``."""
    chars = F.length(text)
    breaks = _count(text, "\n") - (chars - F.length(F.replace(text, F.lit("\r\n"), F.lit("\r"))))
    escaped = _count(text, "\n", "\r", "\t", '"', "\\")
    wide = F.octet_length(F.encode(text, "UTF-16BE")) / 2 - chars
    other = F.length(F.regexp_replace(text, r"[\x00-\x7f]+", ""))
    ways = {
        "characters": chars,
        "utf16_units": chars + wide,
        "utf8_bytes": F.octet_length(text),
        "crlf_characters": chars + breaks,
        "crlf_bytes": F.octet_length(text) + breaks,
        "json_characters": chars + escaped,
        "json_ascii": chars + escaped + 5 * other + 6 * wide,
        "entity_characters": chars + 4 * _count(text, "&") + 3 * _count(text, "<", ">") + 5 * _count(text, '"', "'"),
    }
    return F.array(*[ways[m].cast("int") for m in MEASURES])


def _stripped(text: Column) -> Column:
    return F.rtrim(text, F.lit(" \t\r\n\x0b\x0c\u00a0\u200b\ufeff"))


def _squeezed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def _tail(text: Column) -> Column:
    return F.right(_squeezed(F.right(text, F.lit(4 * TAIL))), F.lit(TAIL))


def _facts(field: str, t: Column, twin: Column, sizes: Column) -> Column:
    """What is known of a text by its length, its end and its twin: no text of any length is in it."""
    end, line = F.right(t, F.lit(REACH)), F.substring_index(t, "\n", -1)
    marked, broken = end.rlike(MARK), end.endswith("�")
    lost = F.length(F.regexp_extract(end, MARK, 0)) + F.length(F.regexp_extract(end, "�+\\z", 0))
    base = F.left(t, F.length(t) - lost)
    goes_on = F.coalesce((F.length(twin) > F.length(t)) & twin.startswith(base), F.lit(False))
    then = F.substring(twin, F.length(base) + 1, F.lit(1))
    ends = end.rlike(SENTENCE_END)
    inside = goes_on & (marked | broken | ~ends | then.rlike(r"(?U)\w"))
    whole = F.coalesce((F.length(twin) == F.length(t)) & ~twin.endswith("�"), F.lit(False))
    return F.struct(
        F.lit(field).alias("field"), (t != "").alias("there"), sizes.alias("sizes"), (inside | (broken & ~whole)).alias("sure"), goes_on.alias("goes_on"), marked.alias("marked"),
        (ends & ~end.rlike(NUMBER_CUT)).alias("final"), line.rlike(LINE_ENDS).alias("line"), end.rlike(r"\S{60}\z").alias("breakless"),
        _squeezed(F.right(t, F.lit(4 * TAIL))).alias("ending"), F.right(_squeezed(F.right(line, F.lit(REACH))), F.lit(TAIL)).alias("last"),
    )


def text_facts(points: DataFrame) -> DataFrame:
    """``point_id, snapshot_no, source, mapc, valid`` and the facts of each point's two texts, one row each.

    Each text is read once, by the JVM, and none is shuffled: lengths under all ways of counting, signs at the
    end, and whether the twin goes on. ``valid``: whether the payload is whole JSON. Repeated rows stay.
    """
    opened = F.from_json("payload", "content string, broken string", {"columnNameOfCorruptRecord": "broken", "allowSingleQuotes": "false"})
    rows = points.select("point_id", "snapshot_no", "source", trimmed("mapc").alias("mapc"), "content", "payload").where("point_id is not null").withColumn("p", opened)
    valid = F.col("payload").isNull() | F.col("p.broken").isNull() | F.rtrim("payload", F.lit(" \t\r\n")).endswith("}")
    rows = rows.select("point_id", "snapshot_no", "source", "mapc", valid.alias("valid"), _stripped(F.col("content")).alias("a"), _stripped(F.when(F.col("p.broken").isNull(), F.col("p.content"))).alias("b"))
    sized = rows.withColumn("a_sizes", lengths(F.col("a")))
    sized = sized.withColumn("b_sizes", F.when(F.col("a") == F.col("b"), F.col("a_sizes")).otherwise(lengths(F.col("b"))))
    both = F.array(_facts("content", F.col("a"), F.col("b"), F.col("a_sizes")), _facts("payload", F.col("b"), F.col("a"), F.col("b_sizes")))
    return sized.select("point_id", "snapshot_no", "source", "mapc", "valid", F.explode(both).alias("x")).select("point_id", "snapshot_no", "source", "mapc", "valid", "x.*")


def hidden_limits(facts: DataFrame) -> DataFrame:
    """``source, snapshot_no, field, measure, limit, n_at_limit``: lengths at which many of a source's values end.

    Every length is tested, in each measure: the values within ``SLACK`` of it are its pile. It is a limit if the
    pile has ``AT_LIMIT`` values, more than any other stretch of that width and no fewer than there are longer
    values; or, wherever it lies, ``PILE`` values and ``STANDS_OUT`` times what its surroundings have. The
    measure with the largest pile is that of the source, and all limits found in it count.
    """
    # A point counts once, however often its row was delivered.
    sized = facts.where("there").select("point_id", "source", "snapshot_no", "field", "sizes").distinct()
    group = ["source", "snapshot_no", "field", "measure"]
    counted = sized.select("source", "snapshot_no", "field", F.posexplode("sizes").alias("measure", "n")).groupBy(*group, "n").agg(F.count(F.lit(1)).alias("k"))
    # Windows over the different lengths of a group, of which there are as many as the longest text allows.
    by_length = Window.partitionBy(*group).orderBy("n")
    piled = counted.withColumns({
        "pile": F.sum("k").over(by_length.rangeBetween(-SLACK, 0)),
        "longer": F.coalesce(F.sum("k").over(by_length.rangeBetween(1, Window.unboundedFollowing)), F.lit(0)),
        "around": F.sum("k").over(by_length.rangeBetween(-SURROUNDINGS, SURROUNDINGS)),
        "next": F.coalesce(F.max("k").over(by_length.rangeBetween(1, SLACK)), F.lit(0)),
    })
    # Of a pile only its highest length is the limit.
    tops = piled.where("next = 0").withColumn("best", F.max("pile").over(Window.partitionBy(*group)))
    by_pile = Window.partitionBy(*group).orderBy(F.desc("pile"), F.desc("n"))
    tops = tops.withColumns({"place": F.row_number().over(by_pile), "second": F.coalesce(F.lead("pile").over(by_pile), F.lit(0))})
    highest = (F.col("place") == 1) & (F.col("pile") >= AT_LIMIT) & (F.col("pile") > F.col("second")) & (F.col("longer") <= F.col("pile"))
    elsewhere = (F.col("around") - F.col("pile")) * (SLACK + 1) / (2 * SURROUNDINGS - SLACK)
    stands_out = (F.col("pile") >= PILE) & (F.col("pile") >= STANDS_OUT * (elsewhere + 1))
    found = tops.where(highest | stands_out).select(*group, F.col("n").alias("limit"), F.col("pile").alias("n_at_limit"))
    named = F.element_at(F.array(*[F.lit(m) for m in MEASURES]), F.col("measure") + 1)
    best = Window.partitionBy("source", "snapshot_no", "field")
    ranked = found.withColumn("of_measure", F.max("n_at_limit").over(Window.partitionBy(*group))).withColumn("rank", F.dense_rank().over(best.orderBy(F.desc("of_measure"), "measure")))
    return ranked.where("rank = 1").select("source", "snapshot_no", "field", named.alias("measure"), "limit", "n_at_limit")


def truncated(points: DataFrame, articles: DataFrame) -> DataFrame:
    """Distinct ``point_id, field`` (content or payload) of the texts that stop inside a word or sentence as their end was lost.

    ``points``: point_id, snapshot_no, source, mapc, content, payload; ``articles``: mapc, raw_content.

    A text is cut if its payload or content twin goes on after it inside a word or sentence; if it ends in a
    broken character; or if it has no ending of a sentence, of a list, table or annex line, or of its
    article. An end mark (``…``) counts as a cut at a hidden limit, or where the twin goes on. A payload is cut
    too if its JSON text breaks off.

    - Null, empty and blank texts are no case; nor are broken characters inside a text or wrong flags in the payload.
    - Repeated rows come out once. Points without an article are judged by their endings alone.
    - Empty tables give no rows; columns other than those named are ignored.
    - Loaders and articles that hold much of all rows meet their limits and ends by a broadcast (``split_join``).
    """
    # Read for the limits and for the verdicts; the texts themselves are read once. Written tables keep the plans small.
    facts = written(text_facts(points), "facts")
    broken_json = facts.where("not valid").select("point_id", F.lit("payload").alias("field"))
    rows = facts.where("there")
    proven = rows.where("sure").select("point_id", "field")
    open_ends = rows.where("not sure and not goes_on and (marked or not final)")
    limits = written(hidden_limits(facts).groupBy("source", "snapshot_no", "field").agg(F.first("measure").alias("measure"), F.collect_set("limit").alias("limits")), "limits")
    near = split_join(open_ends, limits, ["source", "snapshot_no", "field"])
    own = F.try_element_at("sizes", F.array_position(F.array(*[F.lit(m) for m in MEASURES]), F.col("measure")).cast("int"))
    at_limit = F.coalesce(F.exists("limits", lambda x: own.between(x - SLACK, x)), F.lit(False))
    near = written(near.select("point_id", "field", F.when(F.col("mapc") != "", F.col("mapc")).alias("mapc"), "marked", "line", "breakless", "ending", "last", at_limit.alias("at_limit")), "near")
    # The article's ends in any snapshot: a point may name one that its own snapshot lacks.
    ends = articles.select(trimmed("mapc").alias("mapc"), _tail(F.col("raw_content")).alias("tail")).where("mapc <> '' and tail <> ''").groupBy("mapc").agg(F.collect_set("tail").alias("tails"))
    ends = written(ends, "ends")
    met = split_join(near, ends, ["mapc"])
    # The text ends as the article does, or its last line, where it is shorter than the tail, is the article's.
    short = (F.length("last") >= 4) & (F.length("last") < TAIL)
    at_end = F.coalesce(F.exists("tails", lambda x: F.endswith(F.col("ending"), x) | (short & F.endswith(x, F.col("last")))), F.lit(False))
    # A line's ending, or text without breaks, is no proof of a cut by itself.
    unproven = F.col("line") | (F.col("breakless") & F.col("tails").isNull())
    cut = F.when(F.col("marked"), F.col("at_limit") & ~at_end).otherwise(~at_end & (~unproven | F.col("at_limit")))
    return broken_json.unionByName(proven).unionByName(met.where(cut).select("point_id", "field")).distinct()


def truncation_rates(points: DataFrame, found: DataFrame) -> DataFrame:
    """``source, field, n_texts, n_truncated, share`` of each source."""
    once = points.select("point_id", "source", F.explode(F.array(F.lit("content"), F.lit("payload"))).alias("field")).where("point_id is not null").distinct()
    flagged = once.join(found.withColumn("cut", F.lit(1)), ["point_id", "field"], "left")
    return flagged.groupBy("source", "field").agg(F.count(F.lit(1)).alias("n_texts"), F.count("cut").alias("n_truncated")).withColumn("share", F.round(F.col("n_truncated") / F.col("n_texts"), 6))
