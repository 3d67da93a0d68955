"""Quality of retrieval and routing, latencies, claims and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.extract import GENERIC, citation_tokens, citations
from lexmill.functions.text import collapse, compared, folded, informative_tokens, present, text, token_set

CUTOFFS = (1, 3, 5, 10)
# Least token overlap of a supported claim, and of a short one.
SUPPORT, SUPPORT_SHORT, SHORT_CLAIM, CLAIM_LENGTH = 0.42, 0.28, 8, 18
# Words by which a claim states its own limits; what bad citations cost; when a text is the reference's.
DISCLAIMER = "chưa đủ căn cứ|cần làm rõ thêm|không đủ dữ liệu|chỉ có thể xác định|tham khảo"
CITATION_PENALTY = 0.15
CONTAINED, SHARED, SHARED_PART = 48, 12, 0.55
STOP_WORDS = ["các", "cho", "có", "của", "đã", "đang", "để", "được", "hoặc", "khi", "không", "là", "một", "như", "này", "theo", "thì", "từ", "và", "về", "vì", "với"]


def same_context(a: Column, a_words: Column, b: Column, b_words: Column) -> Column:
    """Whether two texts in their compared forms are of one context: the shorter, if long enough, within the other, or enough informative words in common."""
    shorter, longer = F.when(F.length(b) < F.length(a), b).otherwise(a), F.when(F.length(b) < F.length(a), a).otherwise(b)
    both, least = F.size(F.array_intersect(a_words, b_words)), F.least(F.size(a_words), F.size(b_words))
    within = (F.length(shorter) >= CONTAINED) & F.contains(longer, shorter)
    return (a != "") & (b != "") & (within | (least > 0) & ((both >= SHARED) | (both / least >= SHARED_PART)))


#: Fields of a hit, and what a case lists for them, by which a hit is relevant.
TRUTH = {"point_id": "ids", "mapc": "mapcs", "article_code": "article_codes", "law_id": "law_ids", "title": "titles"}


def with_forms(rows: DataFrame, texts: list[str]) -> DataFrame:
    """Rows with ``_t`` and ``_tw``, the compared form and the informative words of their joined texts, made evenly over the cores."""
    spread = rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism, *rows.columns[:1])
    formed = spread.withColumn("_t", compared(F.concat_ws(" ", *[present(c) for c in texts])))
    return formed.withColumn("_tw", informative_tokens("_t", STOP_WORDS))


def truth_matches(hits: DataFrame, cases: DataFrame, query: str, texts: list[str]) -> DataFrame:
    """Hits of the cases with ``matched`` and ``by``, the fields by which they match (``context`` for a text that is near a reference).

    ``cases``: query, and any of the arrays ids, mapcs, article_codes, law_ids, titles, contexts; blank values match
    nothing. ``texts``: columns of a hit whose joined text is compared with the reference contexts; hits that have
    its forms already (``with_forms``) bring them. A case is joined to its own hits, a few per query.
    """
    lists = [x for x in [*TRUTH.values(), "contexts"] if x in cases.columns]
    # The forms of a reference are made once per case, not once per hit.
    forms = lambda c: F.struct(compared(c).alias("t"), informative_tokens(c, STOP_WORDS).alias("w"))
    met = hits.join(cases.select(query, *[(F.transform(x, forms) if x == "contexts" else F.col(x)).alias(f"_{x}") for x in lists]), query)
    if "_t" not in hits.columns:
        met = met.withColumn("_t", compared(F.concat_ws(" ", *[present(c) for c in texts])))
        met = met.withColumn("_tw", informative_tokens("_t", STOP_WORDS))
    by = [F.when((text(f) != "") & F.array_contains(F.col(f"_{x}"), F.col(f)), F.lit(f)) for f, x in TRUTH.items() if x in lists and f in hits.columns]
    if "contexts" in lists:
        by.append(F.when(F.exists("_contexts", lambda c: same_context(F.col("_t"), F.col("_tw"), c["t"], c["w"])), F.lit("context")))
    found = F.filter(F.array(*by), lambda x: x.isNotNull())
    return met.withColumn("by", found).withColumn("matched", F.size("by") > 0).select(*[c for c in hits.columns if c not in ("_t", "_tw")], "by", "matched")


def relevant_ranks(matches: DataFrame, cases: DataFrame, query: str) -> DataFrame:
    """``query, first_rank``: best rank of a matching hit of each case that states any truth; null if none was found."""
    lists = [x for x in [*TRUTH.values(), "contexts"] if x in cases.columns]
    stated = F.lit(False)
    for x in lists:
        stated = stated | F.exists(F.coalesce(x, F.array().cast("array<string>")), lambda v: text(v) != "")
    found = matches.where("matched").groupBy(query).agg(F.min("rank").alias("first_rank"))
    return cases.where(stated).select(query).distinct().join(found, query, "left")


def filter_hit_rates(hits: DataFrame, asked: DataFrame, query: str, passes: Column, filtered: Column) -> DataFrame:
    """``query, n_hits, hit_rate``: share of a query's hits that pass its filters; null for a query without filters, 0 without hits.

    ``passes``: over the columns of hits and asked; ``filtered``: whether a query of ``asked`` has any filter.
    """
    seen = hits.join(asked, query).groupBy(query).agg(F.count(F.lit(1)).alias("n_hits"), F.avg(passes.cast("double")).alias("rate"))
    told = asked.select(query, filtered.alias("filtered")).join(seen, query, "left")
    return told.select(query, F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.when(F.col("filtered"), F.round(F.coalesce("rate", F.lit(0.0)), 4)).alias("hit_rate"))


def first_relevant_rank(hits: DataFrame, truth: DataFrame, query: str, doc: str) -> DataFrame:
    """``query, first_rank``: the best rank of a relevant document of each query that has any truth; null if none was found."""
    wanted = truth.select(query).distinct()
    found = hits.join(truth.select(query, doc).distinct(), [query, doc]).groupBy(query).agg(F.min("rank").alias("first_rank"))
    return wanted.join(found, query, "left")


def retrieval_quality(ranks: DataFrame, k: int) -> DataFrame:
    """One row: hit rates at the cutoffs up to ``k``, and the mean reciprocal rank over hits and over all queries."""
    at = [F.round(F.avg(F.when(F.col("first_rank") <= c, 1.0).otherwise(0.0)), 4).alias(f"hit_{c}") if c <= k else F.lit(None).cast("double").alias(f"hit_{c}") for c in CUTOFFS]
    inverse = 1.0 / F.col("first_rank")
    return ranks.agg(F.count(F.lit(1)).alias("n_queries"), *at, F.round(F.avg(inverse), 4).alias("mrr_hits"), F.round(F.avg(F.coalesce(inverse, F.lit(0.0))), 4).alias("mrr_all"))


def latencies(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by, n, mean, median, p95`` of a measure, percentiles interpolated; nulls don't count."""
    x = F.col(value).cast("double")
    return rows.groupBy(*by).agg(F.count(x).alias("n"), F.round(F.avg(x), 3).alias("mean"), F.round(F.median(x), 3).alias("median"), F.round(F.percentile(x, 0.95), 3).alias("p95"))


def accuracy(rows: DataFrame, by: list[str], predicted: Column, gold: Column) -> DataFrame:
    """``by, n, accuracy``: share of rows whose values agree, missing ones being one value."""
    same = (text(predicted) == text(gold)).cast("double")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(same), 4).alias("accuracy"))


def claims(rows: DataFrame, key: str, answer: str) -> DataFrame:
    """``key, claim_no, claim``: sentences and clauses of an answer of at least 18 characters."""
    parts = F.split(F.regexp_replace(text(answer), r"([.!?;:])\s+", "$1\x01"), "\x01")
    trimmed = F.filter(F.transform(parts, lambda x: F.trim(F.btrim(collapse(x), F.lit("- ")))), lambda x: F.length(x) >= CLAIM_LENGTH)
    return rows.select(key, F.posexplode(trimmed).alias("claim_no", "claim"))


def claim_support(found: DataFrame, evidence: DataFrame, key: str, hints: DataFrame | None = None) -> DataFrame:
    """``key, claim_no, n_tokens, best_overlap, supported`` of claims against the texts of the same key.

    ``evidence``: key, evidence. The overlap is the share of the claim's tokens that a text has. A claim is
    supported if it has no tokens, states its own limits, overlaps a text enough, or names one of ``hints``
    (key, hints: the citations expected or given). Evidence of a key is that of one answer, a few texts.
    """
    sets = evidence.select(key, token_set("evidence").alias("e"))
    none = F.array().cast("array<string>")
    asked = found.select(key, "claim_no", "claim", token_set("claim").alias("c"))
    asked = asked.join(hints.select(key, "hints"), key, "left") if hints is not None else asked.withColumn("hints", none)
    named = F.exists(F.coalesce("hints", none), lambda h: (text(h) != "") & F.contains(F.lower("claim"), F.lower(h)))
    asked = asked.select(key, "claim_no", "c", (F.col("claim").rlike(f"(?iu){DISCLAIMER}") | named).alias("told"))
    met = asked.join(sets, key, "left").withColumn("overlap", F.when(F.size("c") > 0, F.coalesce(F.size(F.array_intersect("c", "e")), F.lit(0)) / F.size("c")).otherwise(1.0))
    best = met.groupBy(key, "claim_no").agg(F.first(F.size("c")).cast("long").alias("n_tokens"), F.round(F.max("overlap"), 6).alias("best_overlap"), F.bool_or("told").alias("told"))
    enough = (F.col("best_overlap") >= SUPPORT) | ((F.col("best_overlap") >= SUPPORT_SHORT) & (F.col("n_tokens") <= SHORT_CLAIM)) | (F.col("n_tokens") == 0) | F.col("told")
    return best.withColumn("supported", enough).drop("told")


def citation_report(answers: DataFrame, key: str, answer: str, sources: str, expected: str) -> DataFrame:
    """``key, citations, pool, weak, missing, citation_ok`` of each answer.

    The pool is what may be cited: the answer's sources and the ``expected`` citations of its documents, each once. A
    citation is weak if it is no part of one of the pool, none of the pool is part of it, and they name no article
    or law in common. ``missing``: the answer cites nothing although it could, or refers to the law in general only.
    """
    none = F.array().cast("array<string>")
    clean = lambda c: F.filter(F.transform(F.coalesce(c, none), collapse), lambda x: x != "")
    rows = answers.select(key, collapse(answer).alias("_a"), citations(answer).alias("citations"), F.array_distinct(F.concat(clean(F.col(sources)), clean(F.col(expected)))).alias("pool"))

    def meets(c: Column, e: Column) -> Column:
        a, b = F.lower(c), F.lower(e)
        return F.contains(a, b) | F.contains(b, a) | F.arrays_overlap(citation_tokens(c), citation_tokens(e))

    weak = F.filter("citations", lambda c: (F.size("pool") > 0) & ~F.exists("pool", lambda e: meets(c, e)))
    cites = F.size("citations") > 0
    missing = ~cites & ((F.size("pool") > 0) | F.col("_a").rlike(f"(?iu){GENERIC}"))
    told = rows.select(key, "citations", "pool", weak.alias("weak"), missing.alias("missing"))
    return told.withColumn("citation_ok", (F.size("weak") == 0) & ~F.col("missing"))


def grounding(supported: DataFrame, key: str, report: DataFrame | None = None) -> DataFrame:
    """``key, n_claims, n_unsupported, score``: the share of supported claims, less the penalty of bad citations, between 0 and 1.

    With a ``report`` (key, citation_ok) every answer of it comes out, one without claims as if it had a supported one.
    """
    counted = supported.groupBy(key).agg(F.count(F.lit(1)).alias("n_claims"), F.count_if(~F.col("supported")).alias("n_unsupported"))
    penalty = F.lit(0.0)
    if report is not None:
        counted = report.select(key, "citation_ok").join(counted, key, "left").fillna(0, ["n_claims", "n_unsupported"])
        penalty = F.when(F.col("citation_ok"), 0.0).otherwise(CITATION_PENALTY)
    score = 1 - F.col("n_unsupported") / F.greatest("n_claims", F.lit(1)) - penalty
    return counted.withColumn("score", F.round(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)), 4))


# A source that is only an article, or only a law.
BARE_ARTICLE = r"^Điều\s+[0-9A-Za-z./-]+\.?$"
BARE_LAW = r"^(?:Luật|Bộ luật|Nghị định|Thông tư|Pháp lệnh|Quyết định)\s+số(?:[^\p{L}\p{N}_]|$)"


def displayed_sources(sources: Column, most: int) -> Column:
    """Sources to show, at most ``most``, those first: distinct ones without what fuller ones say already.

    Where full citations are there, bare articles are left out, as are bare laws that one of them names; so are sources
    of up to four words that are part of another. If nothing is left, the first two stay.
    """
    known = F.array_distinct(F.filter(F.transform(F.coalesce(sources, F.array().cast("array<string>")), collapse), lambda x: x != ""))
    rich = F.filter(known, lambda x: F.contains(x, F.lit(" - ")) | (F.contains(x, F.lit(",")) & (F.length(x) > 24)))

    def spare(x: Column) -> Column:
        within = lambda of: F.exists(of, lambda y: F.contains(F.lower(y), F.lower(x)))
        part = F.exists(known, lambda y: (F.lower(x) != F.lower(y)) & F.contains(F.lower(y), F.lower(x)))
        return (x.rlike(f"(?iu){BARE_ARTICLE}") & (F.size(rich) > 0)) | (x.rlike(f"(?iu){BARE_LAW}") & within(rich)) | (part & (F.size(F.split(x, " ")) <= 4))

    kept = F.filter(known, lambda x: ~spare(x))
    shown = F.when((F.size(known) <= 1) | (F.size(kept) > 0), F.when(F.size(known) <= 1, known).otherwise(kept)).otherwise(F.slice(known, 1, 2))
    return F.slice(shown, 1, most)


def label_scores(question: Column, keywords: dict[str, list[str]]) -> Column:
    """Struct (label, score): the label most of whose keywords a question has, the first on a tie, and its share of all hits.

    The score lies between 0.35 and 0.99; a question with none of the keywords has no label and score 0.
    """
    x = folded(question)
    hits = [sum((F.contains(x, F.lit(w)).cast("int") for w in words), F.lit(0)) for words in keywords.values()]
    total = sum(hits, F.lit(0))
    best = F.greatest(*hits) if len(hits) > 1 else hits[0]
    label = F.coalesce(*[F.when((h == best) & (best > 0), F.lit(name)) for name, h in zip(keywords, hits)])
    score = F.when(total > 0, F.least(F.greatest(best / total, F.lit(0.35)), F.lit(0.99))).otherwise(0.0)
    return F.struct(label.alias("label"), F.round(score, 4).alias("score"))


def messages(rows: DataFrame, thread: list[str], at: str, asked: str, answered: str) -> DataFrame:
    """``thread, message_no, role, text``: a thread's questions and answers in order, blank ones left out."""
    pair = F.array(F.struct(F.lit(0).alias("o"), F.lit("user").alias("role"), present(asked).alias("text")), F.struct(F.lit(1).alias("o"), F.lit("assistant").alias("role"), present(answered).alias("text")))
    said = rows.select(*thread, at, F.explode(pair).alias("m")).where(F.col("m.text").isNotNull())
    order = Window.partitionBy(*thread).orderBy(at, "m.o", "m.text")
    return said.select(*thread, F.row_number().over(order).alias("message_no"), "m.role", "m.text")


def folded_events(events: DataFrame, key: str, at: list[str], kind: str, value: str) -> DataFrame:
    """``key, kind, n, last_value``: the latest value of each kind of event of a key."""
    return events.groupBy(key, kind).agg(F.count(F.lit(1)).alias("n"), F.max_by(value, F.struct(*at)).alias("last_value"))


def step_times(events: DataFrame, key: str, at: str, order: str, kind: str) -> DataFrame:
    """``kind, n, total_s``: seconds from each event of a key to its next one, summed by the kind of the first."""
    following = F.lead(at).over(Window.partitionBy(key).orderBy(at, order))
    spent = (F.unix_micros(following.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 1e6
    return events.withColumn("_s", spent).where("_s is not null").groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("_s"), 3).alias("total_s"))
