"""Reranking by a pluggable pair model, and the variants of a question that are searched besides it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexmill.functions.text import collapse, text, token_set

#: Scores of (question, text) pairs, one number per pair, made where the pairs lie.
PairModel = Callable[[Sequence[tuple[str, str]]], Sequence[float]]


def overlap_model(pairs: Sequence[tuple[str, str]]) -> list[float]:
    """Offline model: the share of a question's words that a text has."""
    out = []
    for question, found in pairs:
        asked, said = set(question.lower().split()), set(found.lower().split())
        out.append(len(asked & said) / len(asked) if asked else 0.0)
    return out


def reranked(hits: DataFrame, request: str, question: str, content: str, keep: int, model: PairModel | None = None, scored: int | None = None) -> DataFrame:
    """The best ``keep`` hits of each request, with ``rerank_score`` and ``rerank``.

    The first ``scored`` hits (default ``keep + 1``) are scored by the model; a hit without a score has its
    combined one, as have all where there is no model. Ties go to the combined score, then the key.
    """
    first = hits.where(F.col("rank") <= (scored or keep + 1))
    if model is None:
        told = first.withColumn("rerank_score", F.col("combined"))
    else:

        @F.pandas_udf(DoubleType())
        def score(questions: pd.Series, texts: pd.Series) -> pd.Series:
            return pd.Series([float(x) for x in model(list(zip(questions, texts)))])

        told = first.withColumn("rerank_score", F.round(score(text(question), text(content)), 6))
    best = Window.partitionBy(request).orderBy(F.desc("rerank_score"), F.desc("combined"), "key")
    return told.withColumn("rerank", F.row_number().over(best)).where(F.col("rerank") <= keep)


def variants(question: Column, filters: dict[str, Column], terms: Sequence[str], most: int = 4) -> Column:
    """Distinct searches for a question, at most ``most``: itself, what it names, and itself with the terms it touches.

    What it names comes from the article and law filters; a term counts as touched if the question has all its words.
    """
    asked = collapse(question)
    named = F.concat_ws(" ", *[F.nullif(filters[c], F.lit("")) for c in ("article_code", "article", "law_id") if c in filters])
    words = token_set(question, 1)
    touched = [F.when(F.size(F.array_except(F.array(*[F.lit(w) for w in t.split()]), words)) == 0, F.concat_ws(" ", F.lit(t), named)) for t in terms]
    every = F.filter(F.array(asked, named, *touched), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.slice(F.array_distinct(F.transform(every, F.trim)), 1, most)
