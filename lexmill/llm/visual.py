"""Visually identical text with different characters, brought to one consistent form.

Only chunks (runs without plain white space) that hold a character outside the safe class
are worked on, each distinct one once: it is exploded to positioned code points, these meet
the decomposition and look-alike mappings in a broadcast join, marks are ordered by their
class, words settled to one script, and the chunk is rebuilt and recomposed. Values are then
put together again from their chunks. The number of distinct chunks, not of values, sets the
cost of the explosion.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from lexmill.functions.lookalike import FOREIGN, STROKES, SUSPECT, TO_CYRILLIC, around, expand, is_invisible, is_wide_mark, pieces, script, suspect_chunks, sure
from lexmill.functions.session import kept

ID = ["h1", "h2", "near"]
_PART = "ch string, ccc int, letter boolean, sure string, script string, latin string, cyrillic string"
#: Code points that are simply themselves by the thousand: Hangul syllables, surrogates, private use, plain ideographs.
_PLAIN = [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xD800, 0xF8FF), (0x20000, 0x2F7FF), (0x2FA20, 0xDFFFF), (0xE1000, 0x10FFFF)]


def _part(ch: str) -> tuple:
    of = script(ch)
    return ch, unicodedata.combining(ch), of in ("L", "C", "G", "A"), of if of and sure(ch, of) else None, of or None, FOREIGN.get(ch, ch), TO_CYRILLIC.get(ch, ch)


@lru_cache(maxsize=1)
def _characters() -> list[tuple]:
    rows, n = [], 0
    while n <= 0x10FFFF:
        skip = next((b for a, b in _PLAIN if a <= n <= b), None)
        if skip:
            n = skip + 1
            continue
        ch = chr(n)
        to = unicodedata.normalize("NFD", expand(ch))
        if to != ch or unicodedata.combining(ch) or script(ch) in ("L", "C", "G", "A") or is_invisible(ch) or around(ch):
            rows.append((ch, is_wide_mark(ch), is_invisible(ch), around(ch), [_part(x) for x in to]))
        n += 1
    return rows


def character_table(spark: SparkSession) -> DataFrame:
    """``at, wide, unseen, around, parts``: full decomposition and look-alikes of each character that is not simply itself.

    Built by rule over all code points of all planes; as many rows however large the input, so it may be broadcast.
    """
    part = _PART.replace(" string", ":string").replace(" int", ":int").replace(" boolean", ":boolean")
    return spark.createDataFrame(_characters(), f"at string, wide boolean, unseen boolean, around string, parts array<struct<{part}>>")


@F.pandas_udf(StringType())
def _recompose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


_PIECES = ArrayType(StructType([StructField("token", StringType()), StructField("near", StringType()), StructField("odd", BooleanType())]))


@F.pandas_udf(_PIECES)
def suspect_pieces(texts: pd.Series) -> pd.Series:
    """The distinct pieces of each text that hold a character outside the safe class."""
    return texts.map(suspect_chunks, na_action="ignore")


@F.pandas_udf(_PIECES)
def pieces_of(texts: pd.Series) -> pd.Series:
    """A text's pieces and the white space between them, in order."""
    return texts.map(pieces, na_action="ignore")


def identified(rows: DataFrame) -> DataFrame:
    """Rows with columns token and near, and a 128-bit id of the token, so that no long text travels with each code point."""
    return rows.withColumn("h1", F.xxhash64("token")).withColumn("h2", F.xxhash64(F.lit(7), "token"))


def chunk_forms(pieces: DataFrame) -> DataFrame:
    """``h1, h2, near, n, token, form`` of each distinct chunk of ``pieces (token, near, h1, h2)``."""
    table = F.broadcast(character_table(pieces.sparkSession))
    distinct = pieces.groupBy(*ID).agg(F.count(F.lit(1)).alias("n"), F.first("token").alias("token"))
    han = F.col("token").rlike(r"[、-〿ぁ-ゟァ-ヿ㐀-䶿一-鿿豈-\x{faff}]") | F.col("near").contains("H")
    points = distinct.select(*ID, "n", han.alias("han"), F.posexplode(F.regexp_extract_all("token", F.lit("(?s)."), F.lit(0))).alias("pos", "at"))
    same = F.array(F.struct(F.col("at").alias("ch"), F.lit(0).alias("ccc"), F.lit(False).alias("letter"), F.lit(None).cast("string").alias("sure"), F.lit(None).cast("string").alias("script"), F.col("at").alias("latin"), F.col("at").alias("cyrillic")))
    beside = Window.partitionBy(*ID).orderBy("pos")
    met = points.join(table, "at", "left").withColumns({
        "kind": F.coalesce("around", F.lit("")), "before": F.coalesce(F.lag("around").over(beside), F.lit("")), "after": F.coalesce(F.lead("around").over(beside), F.lit("")), "next": F.lead("at").over(beside),
    })
    # Invisible characters that change how their neighbours look stay.
    joined = (F.col("before") == "J") & (F.col("after") == "J") | (F.col("at") == "\u200d") & F.col("before").isin("S", "V", "T") & F.col("after").isin("S", "T")
    stays = F.col("unseen") & (
        F.col("at").between("\ufe00", "\ufe0f") & ((F.col("before") == "S") | F.coalesce(F.col("next") == "\u20e3", F.lit(False)))
        | F.col("at").isin("\u200c", "\u200d") & joined
        | F.col("at").between("\u180b", "\u180f") & (F.col("before") == "M")
        | F.col("at").between("\U000e0020", "\U000e007f") & (F.col("before") == "T")
    )
    parts = F.when(F.col("wide") & F.col("han") | stays, same).otherwise(F.coalesce("parts", same))
    # An invisible character has no parts but keeps its row, so that the chunk as delivered can be told.
    split = met.select(*ID, "n", "pos", "at", F.posexplode_outer(parts).alias("sub", "p")).select(*ID, "n", "pos", "at", F.coalesce("sub", F.lit(0)).alias("sub"), "p.*").withColumns({"ch": F.coalesce("ch", F.lit("")), "ccc": F.coalesce("ccc", F.lit(-1)), "letter": F.coalesce("letter", F.lit(False))})

    order = Window.partitionBy(*ID).orderBy("pos", "sub")
    whole = Window.partitionBy(*ID)
    word = Window.partitionBy(*ID, "word")
    placed = split.withColumn("starter", F.sum(F.when(F.col("ccc") == 0, 1).otherwise(0)).over(order)).withColumn("word", F.sum(F.when((F.col("ccc") == 0) & ~F.col("letter"), 1).otherwise(0)).over(order))

    def held(of: str, w) -> Column:
        return F.coalesce(F.max(F.col("sure") == of).over(w), F.lit(False))

    placed = placed.withColumns({f"all_{of}": held(of, whole) | F.col("near").contains(of) for of in "CGA"} | {f"in_{of}": held(of, word) for of in "LCGA"})
    kinds = sum(F.col(f"in_{of}").cast("int") for of in "LCGA")
    twin = F.col("ch").isin(list(FOREIGN))
    leave = F.coalesce(F.max(twin & F.coalesce(F.when(F.col("script") == "C", F.col("all_C")).when(F.col("script") == "G", F.col("all_G")).when(F.col("script") == "A", F.col("all_A")), F.lit(False))).over(word), F.lit(False))
    latin = F.coalesce(F.max(F.col("script") == "L").over(word), F.lit(False))
    settled = placed.withColumn(
        "out",
        F.when(kinds > 1, F.col("ch"))
        .when(F.col("in_L") | ((kinds == 0) & (latin | ~leave)), F.col("latin"))
        .when(F.col("in_C"), F.col("cyrillic"))
        .otherwise(F.col("ch")),
    ).withColumn("out", F.coalesce("out", F.lit("")))
    form = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("starter", "ccc", "pos", "sub", "out"))), lambda x: x["out"]), "")
    delivered = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("sub") == 0, F.struct("pos", "at")))), lambda x: x["at"]), "")
    rebuilt = settled.groupBy(*ID).agg(F.first("n").alias("n"), delivered.alias("token"), form.alias("form"))
    for mark in STROKES:
        rebuilt = rebuilt.withColumn("form", F.replace(F.replace("form", F.lit("d" + mark), F.lit("đ")), F.lit("D" + mark), F.lit("Đ")))
    return rebuilt.withColumn("form", _recompose("form"))


def long_form(rows: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """``*key, field, value``: one row per text field."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    return rows.select(*key, pairs.alias("p")).select(*key, "p.field", "p.value")


def inconsistent_fields(rows: DataFrame, key: list[str], fields: list[str], hot_share: int = 2_000) -> DataFrame:
    """Distinct ``*key, field`` of the values that are not in the consistent form.

    - Null and empty values are consistent. Keys may be null or repeated; equal (key, field) pairs come out once.
    - Text without white space is worked on in pieces of at most 256 characters, so no text is one group.
    - Chunks that hold at least one ``hot_share``-th of all suspect pieces (so at most that many chunks)
      are joined by broadcast, all others by a shuffle on the chunk's id.
    - Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    values = long_form(rows, key, fields).where(F.col("value").rlike(SUSPECT))
    # Read twice, for the distinct chunks and for the fields they occur in, but taken from the texts once.
    found = kept(identified(values.select(*key, "field", F.explode(suspect_pieces("value")).alias("c")).select(*key, "field", "c.token", "c.near")))
    forms = kept(chunk_forms(found).select(*ID, "n", (F.col("form") != F.col("token")).alias("changed")))
    total = forms.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * hot_share >= total
    hot = F.broadcast(forms.where(F.col("changed") & is_hot).select(*ID))
    # Hot chunks, changed or not, leave before the others are shuffled.
    any_hot = F.broadcast(forms.where(is_hot).select(*ID))
    rare = forms.where(F.col("changed") & ~is_hot).select(*ID)
    slim = found.drop("token")
    # A field that a hot chunk already shows needs no second proof; the rest go by shuffle.
    shown = slim.join(hot, ID, "left_semi").unionByName(slim.join(any_hot, ID, "left_anti").join(rare, ID, "left_semi"))
    return shown.select(*key, "field").distinct()


def consistent_texts(rows: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """``*key, field, value, consistent`` of every row and field: the value as delivered and in the one consistent form.

    - A null value stays null, an empty one empty. Repeated rows come out as often as they came in.
    - White space of the ASCII range is kept as it is; any other space becomes a plain space.
    - Suspect values are taken apart at plain white space, their distinct chunks brought to the
      consistent form and the pieces put together by position; other values pass unchanged.
    """
    values = long_form(rows, key, fields).withColumn("odd", F.coalesce(F.col("value").rlike(SUSPECT), F.lit(False)))
    clean = values.where("not odd").select(*key, "field", "value", F.col("value").alias("consistent"))
    odd = values.where("odd").withColumns({"v1": F.xxhash64("value"), "v2": F.xxhash64(F.lit(3), "value")})
    once = odd.groupBy("v1", "v2").agg(F.first("value").alias("value"))
    # Read three times, but taken from the texts once; neighbouring clean pieces could be joined, their number is that of the words.
    placed = kept(identified(once.select("v1", "v2", F.posexplode(pieces_of("value")).alias("pos", "c")).select("v1", "v2", "pos", "c.token", "c.near", "c.odd")))
    forms = chunk_forms(placed.where("odd")).select(*ID, "form")
    plain = placed.where("not odd").select("v1", "v2", "pos", F.col("token").alias("out"))
    mended = placed.where("odd").join(forms, ID).select("v1", "v2", "pos", F.col("form").alias("out"))
    pieces = F.array_sort(F.collect_list(F.struct("pos", "out")))
    whole = plain.unionByName(mended).groupBy("v1", "v2").agg(F.array_join(F.transform(pieces, lambda x: x["out"]), "").alias("consistent"))
    return clean.unionByName(odd.join(whole, ["v1", "v2"]).select(*key, "field", "value", "consistent"))
