"""Queries of search, ranking, verification, evaluation and conversation operators, with their SQL.

Searches are against all rows. `hybrid_search`, `context_blocks`, `evidence`, `strong_exact_hits` and
`section_search` ask with every row that has an id; the others take those whose id is divisible by 50 as queries.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.extract import CITED_ARTICLE, CITED_LAW, GENERIC, query_filters
from lexmill.functions.session import kept, shared_folder
from lexmill.functions.text import collapse, iso_date, present, text
from lexmill.operators.corpus import chunk_documents, latest_rows
from lexmill.operators.evaluation import (
    BARE_ARTICLE, BARE_LAW, CONTAINED, DISCLAIMER, SHARED, SHARED_PART, accuracy, citation_report, claim_support, claims, displayed_sources, filter_hit_rates, folded_events, grounding, label_scores, latencies,
    messages, relevant_ranks, retrieval_quality, step_times, truth_matches, with_forms,
)
from lexmill.operators.search import FILTER_FIELDS, Postings, bm25_topk, clipped, is_strong_hit, context_block, date_passes, dedup_key, evidence_status, exact_bonus, exact_match, has_filters, hybrid_merge, passes_filters, vector_topk, with_fallback
from lexmill.models import embedded
from lexmill.operators.rerank import overlap_model, reranked, variants
from lexmill.plans.corpus_queries import _COLLAPSE, _COMPARED, _LAW, _TOKENS, _WORDS, CITES, _PART, _WS, _of, articles, latest_snapshot
from lexmill.plans.oracle import expanded
from lexmill.sources.tables import table, trimmed
from lexmill.streaming.threads import latest_states, thread_states, thread_states_batch

TOP = 8
#: Intents by words of the question: a parameter of the label scorer.
INTENTS = {
    "xu_phat": ["mức phạt", "xử phạt", "hành vi"],
    "thu_tuc": ["thủ tục", "hồ sơ", "các bước", "bước nào"],
    "tra_cuu": ["điều", "thời hạn", "là bao lâu", "quy định"],
    "khac": ["phí", "ai có", "phải làm gì"],
}

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = expanded(sql)
        return f

    return add


def _sections(spark, folder) -> DataFrame:
    """Indexed sections, one row per point: the one indexed last."""
    one = F.max_by(F.struct(text("content").alias("content"), text(trimmed("mapc")).alias("mapc")), F.struct("indexed_at", text("content"), text("mapc"))).alias("r")
    return table(spark, folder, "index_document").groupBy("point_id").agg(one).select("point_id", "r.*").withColumn("kind", _kind(F.col("content")))


def _described(spark, folder, sections: DataFrame | None = None) -> DataFrame:
    """Indexed sections, or those given, with the metadata of their article in the latest snapshot."""
    fields = ["mapc", *FILTER_FIELDS, "source_note"]
    current = latest_rows(latest_snapshot(articles(spark, folder)).select(*fields, "loaded_at"), ["mapc"], "loaded_at").drop("loaded_at")
    return (_sections(spark, folder) if sections is None else sections).join(current, "mapc", "left")


def _described_hits(spark, folder, asked: DataFrame, k: int) -> DataFrame:
    """Best sections for the questions by BM25 with the metadata of their articles; the index is read once, the sections' keys stay with their counts."""
    docs = _sections(spark, folder)
    postings = Postings(docs, asked, doc="point_id", carried=("mapc",))
    hits = bm25_topk(docs, asked, k, doc="point_id", query="chat_id", postings=postings)
    return _described(spark, folder, hits.join(postings.rows.select(F.col("d").alias("point_id"), "mapc"), "point_id"))


def _kind(x):
    return F.lower(F.regexp_extract(F.coalesce(x, F.lit("")), r"Điều \d+\.\d+\.([A-ZĐ]+)\.", 1))


def _asking(every: bool, key: str) -> str:
    return f"{key} is not null" if every else f"{key} % 50 = 0"


def _questions(spark, folder, every: bool = False) -> DataFrame:
    """The question of each chat that has an id, or of each 50th."""
    asked = table(spark, folder, "chat_log").where(_asking(every, "chat_id")).groupBy("chat_id").agg(F.max("question").alias("question"))
    return kept(asked.withColumn("kind", _kind(F.col("question"))))


def _once(asked: DataFrame, query: str, found) -> DataFrame:
    """What ``found`` makes of the distinct questions, each under the smallest id that asks it, for all ids that ask it."""
    ones = asked.groupBy("question").agg(F.min(query).alias(query)).select(query, "question")
    same = asked.join(ones.withColumnRenamed(query, "_first"), "question").select(query, "_first")
    return found(ones).withColumnRenamed(query, "_first").join(same, "_first").drop("_first")


_BM25 = """
d0 as (select point_id, max_by(struct_pack(content := coalesce(content,''), mapc := coalesce(@trim(mapc),'')), struct_pack(at := indexed_at, c := coalesce(content,''), m := coalesce(mapc,''))) as r from index_document group by 1),
docs as (select point_id, r.content as content, r.mapc as mapc, lower(regexp_extract(r.content, 'Điều \\d+\\.\\d+\\.([A-ZĐ]+)\\.', 1)) as kind from d0),
art as (select distinct on (mapc) mapc, article_code, article_name, article, law_id, title, issuer, effective_date, topic_id, de_muc, source_note, raw_content from parsed_article where snapshot_no = (select max(snapshot_no) from parsed_article) and @trim(coalesce(mapc,''))<>'' order by mapc, loaded_at desc),
meta as (select docs.*, art.* exclude (mapc) from docs left join art using (mapc)),
asked as (select chat_id, max(question) as question, lower(regexp_extract(coalesce(max(question),''), 'Điều \\d+\\.\\d+\\.([A-ZĐ]+)\\.', 1)) as kind from chat_log where chat_id % 50 = 0 group by 1),
t as (select point_id, unnest(""" + _of(_TOKENS, "content") + """) as term from docs),
l as (select point_id, len(""" + _of(_TOKENS, "content") + """) as n from docs), a as (select avg(n) as avgdl, count(*) as n from l),
tf as (select point_id, term, count(*) as tf from t group by all), df as (select term, count(*) as df from tf group by 1),
qt as (select chat_id, term, count(*) as qtf from (select chat_id, unnest(""" + _of(_TOKENS, "question") + """) as term from asked) group by all),
s as (select chat_id, tf.point_id, round(sum(qtf * ln(1 + (a.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l.n / avgdl))), 6) as score
 from qt join tf using (term) join df using (term) join l using (point_id) cross join a group by all)"""  # fmt: skip


#: The same with the question of every chat.
_BM25_OF_ALL = _BM25.replace("from chat_log where chat_id % 50 = 0 group", "from chat_log where chat_id is not null group")


@query(f"""with {_BM25} select chat_id, point_id, score, rank::int as rank from (select *, row_number() over (partition by chat_id order by score desc, point_id) as rank from s where score > 0) where rank <= {TOP}""")
def bm25_sections(spark, folder):
    """Best sections for the questions by BM25."""
    return bm25_topk(_sections(spark, folder), _questions(spark, folder), TOP, doc="point_id", query="chat_id")


_FILTERED = f"""{_BM25}, f as (select s.* from s join docs using (point_id) join asked using (chat_id) where asked.kind = '' or asked.kind = docs.kind),
hits as (select chat_id, point_id, score, rank::int as rank from (select *, row_number() over (partition by chat_id order by score desc, point_id) as rank from f where score > 0) where rank <= {TOP})"""


@query(f"with {_FILTERED} select * from hits")
def bm25_filtered(spark, folder):
    """Best sections among those of the type of law that a question names; statistics stay those of all sections."""
    return bm25_topk(_sections(spark, folder), _questions(spark, folder), TOP, doc="point_id", query="chat_id", filters={"kind": "kind"})


_STRICT = f"""{_BM25}, f as (select s.* from s join docs using (point_id) join asked using (chat_id) where asked.kind = docs.kind and docs.kind <> ''),
strict as (select chat_id, point_id, score, rank::int as rank from (select *, row_number() over (partition by chat_id order by score desc, point_id) as rank from f where score > 0) where rank <= {TOP}),
loose as (select chat_id, point_id, score, rank::int as rank from (select *, row_number() over (partition by chat_id order by score desc, point_id) as rank from s where score > 0) where rank <= {TOP})"""


@query(f"with {_STRICT} select *, false as fell_back from strict union all select *, true from loose where chat_id not in (select chat_id from strict)")
def filter_fallback(spark, folder):
    """Hits under a strict filter, and unfiltered ones for the questions that it leaves none."""
    docs, asked = _sections(spark, folder), _questions(spark, folder)
    postings = Postings(docs, asked, doc="point_id", filters=("kind",))
    strict = bm25_topk(docs, asked.where("kind <> ''"), TOP, doc="point_id", query="chat_id", filters={"kind": "kind"}, postings=postings)
    return with_fallback(kept(strict), bm25_topk(docs, asked, TOP, doc="point_id", query="chat_id", postings=postings), "chat_id")


_COS = """
n as (select vec_id, label, list_transform(embedding, lambda x: x::double / nullif(sqrt(list_aggregate(list_transform(embedding, lambda y: y::double * y::double), 'sum')), 0)) as v from embeddings where embedding is not null),
c as (select q.vec_id as query_id, d.vec_id, q.label as ql, d.label as dl, round(list_aggregate(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2]), 'sum'), 6) as semantic from n q cross join n d where q.vec_id % 50 = 0)"""


@query(f"""with {_COS} select query_id, vec_id, semantic, semantic as score, rank::int as rank from (select *, row_number() over (partition by query_id order by semantic desc, vec_id) as rank from c) where rank <= {TOP}""")
def vector_neighbours(spark, folder):
    """Nearest vectors by cosine, exactly."""
    rows = table(spark, folder, "embeddings")
    return vector_topk(rows, rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), TOP)


@query(f"""with {_COS}, f as (select * from (select *, row_number() over (partition by query_id order by semantic desc, vec_id) as near from c) where near <= {4 * TOP}),
b as (select *, (coalesce(ql = dl, false))::int as exact, round(semantic + 0.35 * (coalesce(ql = dl, false))::int, 6) as score from f)
select query_id, vec_id, semantic, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, exact desc, semantic desc, vec_id) as rank from b) where rank <= {TOP}""")
def vector_label_boost(spark, folder):
    """Nearest vectors re-scored for an equal label within an over-fetch."""
    rows = table(spark, folder, "embeddings")
    return vector_topk(rows, rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), TOP, label=("label", "label"), bonus=0.35)


@query(f"""with {_COS} select query_id, vec_id, semantic, semantic as score, rank::int as rank from (select *, row_number() over (partition by query_id order by semantic desc, vec_id) as rank from c where ql is null or ql = dl) where rank <= {TOP}""")
def vector_filtered(spark, folder):
    """Nearest vectors among those of the query's own label, filtered before the search."""
    rows = table(spark, folder, "embeddings")
    return vector_topk(rows, rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), TOP, filters={"label": "label"})


def _hybrid(spark, folder, every: bool = True) -> tuple[DataFrame, DataFrame]:
    """Hybrid hits, and the documents: all are searched, by BM25 and those that have a vector by their vector too, and all that have an id ask, or each 50th."""
    asking = _asking(every, "doc_id")
    docs = table(spark, folder, "documents").select("doc_id", text("text").alias("content"), "law_id")
    vectors = table(spark, folder, "embeddings").withColumnRenamed("vec_id", "doc_id").join(docs.select("doc_id"), "doc_id", "left_semi")
    asked = kept(docs.where(asking).select(F.col("doc_id").alias("request_id"), F.regexp_extract("content", r"^[^\r\n]*", 0).alias("question")))
    lexical = _once(asked, "request_id", lambda ones: bm25_topk(docs, ones, 12, query="request_id")).select("request_id", F.lit("bm25").alias("channel"), "doc_id", "score")
    near = vector_topk(vectors, vectors.where(asking).withColumnRenamed("doc_id", "request_id"), 12, row="doc_id", query="request_id").select("request_id", F.lit("vector").alias("channel"), "doc_id", "score")
    law = docs.where(asking).select(F.col("doc_id").alias("request_id"), F.col("law_id").alias("asked_law"))
    # Hits of a request stay together over the cores from here: for its law, the merge and the ranks.
    told = lexical.unionByName(near).join(docs.select("doc_id", "law_id"), "doc_id")
    hits = told.repartition(2 * spark.sparkContext.defaultParallelism, "request_id").join(law, "request_id")
    bonus, exact = exact_bonus({"law_id": (F.col("law_id"), F.col("asked_law"))})
    merged = hybrid_merge(hits.select("request_id", F.lit(0).alias("query_no"), "channel", F.col("doc_id").alias("key"), "score", bonus.alias("bonus"), F.size(exact).alias("n_exact")))
    return merged.select("request_id", "key", "bm25", "vector", "n_queries", "n_channels", "bonus", "combined", "rank"), docs


_HYBRID = """
b as (select d.doc_id, coalesce(d.text,'') as content, d.law_id, list_transform(e.embedding, lambda x: x::double / nullif(sqrt(list_aggregate(list_transform(e.embedding, lambda y: y::double * y::double), 'sum')), 0)) as v from documents d left join embeddings e on d.doc_id = e.vec_id),
asked as (select doc_id as request_id, regexp_extract(content, '^[^\\r\\n]*', 0) as question, v, law_id from b where doc_id is not null),
t as (select doc_id, unnest(""" + _of(_TOKENS, "content") + """) as term from b), l as (select doc_id, len(""" + _of(_TOKENS, "content") + """) as n from b), a as (select avg(n) as avgdl, count(*) as n from l),
tf as (select doc_id, term, count(*) as tf from t group by all), df as (select term, count(*) as df from tf group by 1),
qt as (select request_id, term, count(*) as qtf from (select request_id, unnest(""" + _of(_TOKENS, "question") + """) as term from asked) group by all),
s as (select request_id, tf.doc_id, round(sum(qtf * ln(1 + (a.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l.n / avgdl))), 6) as score from qt join tf using (term) join df using (term) join l using (doc_id) cross join a group by all),
c as (select request_id, b.doc_id, round(list_aggregate(list_transform(list_zip(asked.v, b.v), lambda z: z[1] * z[2]), 'sum'), 6) as score from asked cross join b where asked.v is not null and b.v is not null),
h as (select request_id, doc_id, 'bm25' as channel, score from (select *, row_number() over (partition by request_id order by score desc, doc_id) as r from s where score > 0) where r <= 12
 union all select request_id, doc_id, 'vector', score from (select *, row_number() over (partition by request_id order by score desc, doc_id) as r from c) where r <= 12),
m as (select h.request_id, h.doc_id as key, greatest(coalesce(max(score) filter (where channel='bm25'),0),0) as bm25, greatest(coalesce(max(score) filter (where channel='vector'),0),0) as vector, count(distinct channel)::bigint as n_channels, 1::bigint as n_queries,
 max(case when trim(coalesce(b.law_id,''))<>'' and lower(trim(b.law_id)) = lower(trim(asked.law_id)) then 0.45 else 0 end)::double as bonus from h join b on b.doc_id = h.doc_id join asked using (request_id) group by 1, 2),
r as (select *, round(0.4 * case when max(bm25) over w > 0 then bm25 / max(bm25) over w else 0 end + 0.6 * case when max(vector) over w > 0 then vector / max(vector) over w else 0 end + 0.1 + bonus, 6) as combined from m window w as (partition by request_id)),
k as (select *, row_number() over (partition by request_id order by combined desc, bonus desc, vector desc, bm25 desc, key)::int as rank from r)"""  # fmt: skip


#: The same with each 50th document as a request.
_HYBRID_50 = _HYBRID.replace("from b where doc_id is not null)", "from b where doc_id % 50 = 0)")


def _hits_sql(hybrid: str) -> str:
    return f"with {hybrid} select request_id, key, bm25, vector, n_queries, n_channels, bonus, combined, rank from k where rank <= 12"


@query(_hits_sql(_HYBRID))
def hybrid_search(spark, folder, every: bool = True):
    """BM25 and vectors merged with the exact-match bonus: the flagship."""
    return _hybrid(spark, folder, every)[0].where("rank <= 12")


def _contexts_sql(hybrid: str) -> str:
    return f"""with {hybrid} select request_id, md5(string_agg('[' || rank || '] ' || trim(substr(trim(content), 1, 1400)), chr(10)||chr(10) order by rank)) as context_md5 from k join b on b.doc_id = k.key where rank <= 4 group by 1"""


@query(_contexts_sql(_HYBRID))
def context_blocks(spark, folder, every: bool = True):
    """Context of the best four documents of each request."""
    hits, docs = _hybrid(spark, folder, every)
    shown = hits.where("rank <= 4").join(docs.select(F.col("doc_id").alias("key"), clipped("content").alias("content")), "key")
    return context_block(shown, "request_id", "content").select("request_id", F.md5("context").alias("context_md5"))


def _evidence_sql(hybrid: str) -> str:
    return f"""with {hybrid}, g as (select request_id, count(*)::bigint as n_hits, count(distinct key)::bigint as n_sources, count_if(trim(coalesce(b.law_id,''))<>'')::bigint as n_structured, max(combined) as top_score from k join b on b.doc_id = k.key where rank <= 4 group by 1)
select request_id, coalesce(n_hits, 0)::bigint as n_hits, coalesce(n_sources, 0)::bigint as n_sources, coalesce(n_structured, 0)::bigint as n_structured, top_score,
 case when n_hits is null then 'no_results' when n_hits < 2 then 'insufficient_results' when n_sources < 1 then 'low_source_diversity' when top_score < 0.15 then 'weak_evidence' else 'ok' end as status from asked left join g using (request_id)"""


@query(_evidence_sql(_HYBRID))
def evidence(spark, folder, every: bool = True):
    """Whether the hits of each request suffice, requests without a hit included."""
    hits, docs = _hybrid(spark, folder, every)
    best = hits.where("rank <= 4").join(docs.select(F.col("doc_id").alias("key"), "law_id"), "key")
    return evidence_status(best, docs.where(_asking(every, "doc_id")).select(F.col("doc_id").alias("request_id")), "request_id", least_hits=2)


# The queries under the names they had when the others searched documents with a vector only; each 50th document asks.
for _some, _sql in ((hybrid_search, _hits_sql), (context_blocks, _contexts_sql), (evidence, _evidence_sql)):
    QUERIES[f"{_some.__name__}_all"], SQL[f"{_some.__name__}_all"] = partial(_some, every=False), expanded(_sql(_HYBRID_50))


_CODE = "Điều [0-9A-ZĐ.]+[0-9A-ZĐ]"
# What a logged answer states as truth: the articles and laws of its sources, and its own text as reference context.
_TRUTH = f"""
logged as (select distinct on (chat_id) chat_id, coalesce(sources, []) as sources, coalesce(final_answer, '') as answer from chat_log where chat_id % 50 = 0 order by chat_id, asked_at desc),
cases as (select chat_id, list_filter(list_transform(sources, lambda x: regexp_extract(coalesce(x,''), '{_CODE}', 0)), lambda x: x <> '') as codes, list_filter(list_transform(sources, lambda x: trim(split_part(coalesce(x,''), ' - ', 3))), lambda x: x <> '') as laws, answer,
 {_of(_COMPARED, 'answer')} as ct, {_of(_WORDS, 'answer')} as cw from logged),
hits as (select chat_id, point_id, score, rank::int as rank from (select *, row_number() over (partition by chat_id order by score desc, point_id) as rank from s where score > 0) where rank <= 10),
ht as (select hits.chat_id, hits.point_id, rank, meta.article_code, meta.law_id, concat_ws(' ', nullif(trim(content),''), nullif(trim(coalesce(article_name,'')),''), nullif(trim(coalesce(title,'')),''), nullif(trim(coalesce(law_id,'')),''), nullif(trim(coalesce(source_note,'')),'')) as t from hits join meta using (point_id)),
hw as (select *, {_of(_COMPARED, 't')} as tt, {_of(_WORDS, 't')} as tw from ht),
mt as (select hw.chat_id, point_id, rank, coalesce(trim(coalesce(article_code,''))<>'' and list_contains(codes, article_code), false) as by_code, coalesce(trim(coalesce(law_id,''))<>'' and list_contains(laws, law_id), false) as by_law,
 tt <> '' and ct <> '' and ((least(length(tt), length(ct)) >= {CONTAINED} and (case when length(ct) < length(tt) then contains(tt, ct) else contains(ct, tt) end)) or (least(len(tw), len(cw)) > 0 and (len(list_intersect(tw, cw)) >= {SHARED} or len(list_intersect(tw, cw)) / least(len(tw), len(cw)) >= {SHARED_PART}))) as by_context from hw join cases using (chat_id)),
fr as (select w.chat_id, min(rank) as f from (select chat_id from cases where len(codes) > 0 or len(laws) > 0 or trim(answer) <> '') w left join (select * from mt where by_code or by_law or by_context) using (chat_id) group by 1)"""


def _cases(spark, folder) -> DataFrame:
    rows = latest_rows(table(spark, folder, "chat_log").where("chat_id % 50 = 0").select("chat_id", "sources", "final_answer", "asked_at"), ["chat_id"], "asked_at")
    listed = lambda f: F.filter(F.transform(F.coalesce("sources", F.array().cast("array<string>")), f), lambda x: x != "")
    laws = lambda x: F.trim(F.coalesce(F.try_element_at(F.split(x, " - "), F.lit(3)), F.lit("")))
    return rows.select("chat_id", listed(lambda x: F.regexp_extract(text(x), _CODE, 0)).alias("article_codes"), listed(laws).alias("law_ids"), F.array(text("final_answer")).alias("contexts"))


def _matches(spark, folder, hits: DataFrame, cases: DataFrame) -> DataFrame:
    hits, texts = kept(hits), ["content", "article_name", "title", "law_id", "source_note"]
    # The forms of a section are made once, however many questions find it.
    found = _described(spark, folder).join(hits.select("point_id").distinct(), "point_id", "left_semi").select("point_id", "article_code", *texts)
    formed = with_forms(found, texts).select("point_id", "article_code", "law_id", "title", "_t", "_tw")
    return truth_matches(hits.join(formed, "point_id"), cases, "chat_id", texts)


@query(f"""with {_BM25}, {_TRUTH} select chat_id, point_id, rank, array_to_string(list_filter([case when by_code then 'article_code' end, case when by_law then 'law_id' end, case when by_context then 'context' end], lambda x: x is not null), ',') as by from mt""")
def ground_truth_matches(spark, folder):
    """By which fields each of the best ten sections agrees with what the logged answers state as truth."""
    hits = bm25_topk(_sections(spark, folder), _questions(spark, folder), 10, doc="point_id", query="chat_id")
    return _matches(spark, folder, hits, _cases(spark, folder)).select("chat_id", "point_id", "rank", F.array_join("by", ",").alias("by"))


_QUALITY = "count(*)::bigint as n_queries, " + ", ".join(f"round(avg(case when f <= {c} then 1.0 else 0.0 end),4) as hit_{c}" for c in (1, 3, 5, 10)) + ", round(avg(1.0::double/f),4) as mrr_hits, round(avg(coalesce(1.0::double/f,0.0)),4) as mrr_all"


@query(f"with {_BM25}, {_TRUTH} select {_QUALITY} from fr")
def retrieval_evaluation(spark, folder):
    """Hit rates and reciprocal ranks of BM25 against what the answers state as truth."""
    cases = _cases(spark, folder)
    hits = bm25_topk(_sections(spark, folder), _questions(spark, folder), 10, doc="point_id", query="chat_id")
    return retrieval_quality(relevant_ranks(_matches(spark, folder, hits, cases), cases, "chat_id"), 10)


def _grid_sql() -> str:
    truth = _TRUTH.replace("from s where score > 0) where rank <= 10)", "from (select s.*, false as filtered from s union all select s.*, true from s join docs using (point_id) join asked using (chat_id) where asked.kind = '' or asked.kind = docs.kind) where score > 0) where rank <= 10)")
    truth = truth.replace("hits as (select chat_id, point_id, score,", "hits as (select chat_id, filtered, point_id, score,").replace("row_number() over (partition by chat_id order", "row_number() over (partition by chat_id, filtered order")
    truth = truth.replace("ht as (select hits.chat_id,", "ht as (select hits.chat_id, hits.filtered,").replace("mt as (select hw.chat_id,", "mt as (select hw.chat_id, hw.filtered,")
    truth = truth[: truth.index("fr as (")] + """g as (select * from (select false as filtered union all select true) cross join (select 5 as k union all select 10)),
fr as (select g.filtered, g.k, w.chat_id, min(mm.rank) as f from (select chat_id from cases where len(codes) > 0 or len(laws) > 0 or trim(answer) <> '') w cross join g left join (select * from mt where by_code or by_law or by_context) mm on mm.chat_id = w.chat_id and mm.filtered = g.filtered and mm.rank <= g.k group by 1, 2, 3)"""
    return f"with {_BM25}, {truth} select filtered, k, {_QUALITY.replace('as hit_10', 'as h10')} from fr group by 1, 2".replace("select filtered, k, count(*)", "select * exclude (h10), case when k >= 10 then h10 end as hit_10 from (select filtered, k, count(*)") + ")"


@query(_grid_sql())
def scenario_grid(spark, folder):
    """The evaluation over a grid of scenarios: with and without the filter, five and ten hits; hit rates beyond the depth are null."""
    docs, asked, cases = _sections(spark, folder), _questions(spark, folder), _cases(spark, folder)
    postings = Postings(docs, asked, doc="point_id", filters=("kind",))
    # The corpus is read once for both searches, and each hit compared with the truth once for all scenarios.
    hits = [bm25_topk(docs, asked, 10, doc="point_id", query="chat_id", filters={"kind": "kind"} if x else None, postings=postings).withColumn("filtered", F.lit(x)) for x in (False, True)]
    told = kept(_matches(spark, folder, hits[0].unionByName(hits[1]), cases).select("chat_id", "filtered", "rank", "matched"))
    out = None
    for filtered in (False, True):
        for k in (5, 10):
            found = told.where((F.col("filtered") == filtered) & (F.col("rank") <= k))
            row = retrieval_quality(relevant_ranks(found, cases, "chat_id"), k).select(F.lit(filtered).alias("filtered"), F.lit(k).alias("k"), "*")
            out = row if out is None else out.unionByName(row)
    return out


_ASKED_FILTERS = f"""
qf as (select chat_id, {_of(_COLLAPSE, 'question')} as x from asked),
wf as (select chat_id, regexp_extract(x, '(?i){_LAW}', 0) as w_law, case when regexp_extract(x, '(?i)Điều (\\d+\\.\\d+\\.[A-ZĐ]+\\.\\d+\\.\\d+)', 1) <> '' then 'Điều ' || upper(regexp_extract(x, '(?i)Điều (\\d+\\.\\d+\\.[A-ZĐ]+\\.\\d+\\.\\d+)', 1)) else '' end as w_code,
 case when regexp_matches(lower(x), 'từ ngày \\d') then regexp_extract(lower(x), 'từ ngày (\\d{{1,2}}/\\d{{1,2}}/\\d{{4}})', 1) else '' end as w_from from qf)"""


@query(f"""with {_BM25}, {_ASKED_FILTERS},
hits as (select chat_id, point_id from (select *, row_number() over (partition by chat_id order by score desc, point_id) as rank from s where score > 0) where rank <= {TOP}),
ps as (select wf.chat_id, (w_law = '' or (lower({_of(_COLLAPSE, 'meta.law_id')}) <> '' and lower({_of(_COLLAPSE, 'meta.law_id')}) = lower(w_law))) and (w_code = '' or (lower({_of(_COLLAPSE, 'meta.article_code')}) <> '' and lower({_of(_COLLAPSE, 'meta.article_code')}) = lower(w_code))) as ok from hits join wf using (chat_id) join meta using (point_id)),
r as (select chat_id, count(*)::bigint as n_hits, avg(ok::int::double) as rate from ps group by 1)
select chat_id, coalesce(n_hits, 0)::bigint as n_hits, case when w_law <> '' or w_code <> '' then round(coalesce(rate, 0.0), 4) end as hit_rate from wf left join r using (chat_id)""")
def filter_hit_rate(spark, folder):
    """Share of the unfiltered hits that pass the filters which a question states."""
    asked = _questions(spark, folder)
    wanted = query_filters("question")
    asked_for = asked.select("chat_id", *[wanted[f].alias(f"w_{f}") for f in ("law_id", "article_code")])
    filters = {f: F.col(f"w_{f}") for f in ("law_id", "article_code")}
    hits = _described_hits(spark, folder, asked, TOP)
    return filter_hit_rates(hits, asked_for, "chat_id", passes_filters({f: F.col(f) for f in FILTER_FIELDS}, filters), has_filters(filters))


_SAME = lambda a, b: f"(lower({_of(_COLLAPSE, a)}) <> '' and lower({_of(_COLLAPSE, a)}) = lower({_of(_COLLAPSE, b)}))"


@query(f"""with {_BM25_OF_ALL}, {_ASKED_FILTERS},
hits as (select chat_id, point_id from (select *, row_number() over (partition by chat_id order by score desc, point_id) as rank from s where score > 0) where rank <= {TOP})
select hits.chat_id, count_if({_SAME('meta.article_code', 'w_code')})::bigint as n_strong, count(*)::bigint as n_hits from hits join wf using (chat_id) join meta using (point_id) group by 1""")
def strong_exact_hits(spark, folder):
    """How many of a question's hits are the very article that it names."""

    def strong(asked: DataFrame) -> DataFrame:
        wanted = query_filters("question")
        asked_for = asked.select("chat_id", *[wanted[f].alias(f"w_{f}") for f in ("law_id", "article_code")])
        hits = _described_hits(spark, folder, asked, TOP).join(asked_for, "chat_id")
        _, names = exact_bonus({f: (F.col(f), F.col(f"w_{f}")) for f in ("law_id", "article_code")})
        return hits.groupBy("chat_id").agg(F.count_if(is_strong_hit(names)).alias("n_strong"), F.count(F.lit(1)).alias("n_hits"))

    return _once(_questions(spark, folder, every=True), "chat_id", strong).select("chat_id", "n_strong", "n_hits")


_CHUNK_PARTS = "list_filter([" + ", ".join(_of(_PART, _of(_COLLAPSE, c)) for c in ("title", "law_id", "article", "article_code", "article_name", "de_muc", "content")) + "], lambda x: x <> '')"
_CHUNK_META = ("law_id", "article_code", "article_name", "article", "title", "issuer", "effective_date", "mapc", "de_muc")


@query(f"""with {_BM25.split("asked as (")[0].rstrip().rstrip(",").replace("d0 as (", "d0 as (")},
m as (select coalesce(law_id,'') as law_id, coalesce(article_code,'') as article_code, coalesce(article_name,'') as article_name, coalesce(article,'') as article, coalesce(title,'') as title, coalesce(issuer,'') as issuer, coalesce(effective_date,'') as effective_date, docs.mapc as mapc, coalesce(de_muc,'') as de_muc, content from docs left join art on art.mapc = docs.mapc),
h as (select *, {_CHUNK_PARTS} as parts, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('chunk:' || concat_ws('|', '', law_id, article_code, mapc, sha1(content)))) as h from m),
f as (select distinct on (h) *, array_to_string(list_filter(parts, lambda v, i: not list_contains(list_transform(parts[1:i-1], lambda y: lower(y)), lower(v))), '. ') as words from h)
select substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || lpad(lower(to_hex(((('0x' || substr(h,17,2))::int) & 63) | 128)), 2, '0') || substr(h,19,2) || '-' || substr(h,21,12) as point_id, {", ".join(_CHUNK_META)},
 md5(trim(content)) as content_md5, md5(case when length(words) > 12000 then regexp_replace(substr(words, 1, 12000), '{_WS}+\\z', '') else words end) as retrieval_md5, length(words) > 12000 as retrieval_text_truncated from f""")
def chunk_index(spark, folder):
    """Index documents of the sections: stable ids, metadata of their articles, clipped search texts."""
    made = chunk_documents(_described(spark, folder).withColumn("file_id", F.lit("")))
    return made.select("point_id", *_CHUNK_META, F.md5("content").alias("content_md5"), F.md5("retrieval_text").alias("retrieval_md5"), "retrieval_text_truncated")


@query(f"""with {_BM25},
hits as (select chat_id, point_id, score from (select *, row_number() over (partition by chat_id order by score desc, point_id) as rank from s where score > 0) where rank <= 4),
g as (select chat_id, count(*)::bigint as n_hits, count(distinct point_id)::bigint as n_sources, count_if(trim(coalesce(law_id,''))<>'' or trim(coalesce(article_code,''))<>'')::bigint as n_structured, count_if(trim(coalesce(law_id,''))<>'' and trim(coalesce(article_code,''))<>'') as n_citable, max(score) as top_score from hits join meta using (point_id) group by 1)
select chat_id, coalesce(n_hits,0)::bigint as n_hits, coalesce(n_sources,0)::bigint as n_sources, coalesce(n_structured,0)::bigint as n_structured, top_score, case when n_hits is null then 'no_results' when n_hits < 2 then 'insufficient_results' when n_sources < 2 then 'low_source_diversity' when n_structured = 0 then 'missing_structured_sources'
 when n_citable = 0 then 'missing_structured_citations' when top_score < 12 then 'weak_evidence' else 'ok' end as status from asked left join g using (chat_id)""")
def section_evidence(spark, folder):
    """Whether the best four sections of each question are evidence that can be cited."""
    asked = _questions(spark, folder)
    hits = _described_hits(spark, folder, asked, 4)
    told = hits.select("chat_id", F.col("point_id").alias("key"), "law_id", "article_code", F.col("score").alias("combined"))
    return evidence_status(told, asked.select("chat_id"), "chat_id", least_score=12.0, least_hits=2, least_sources=2, structured=True)


@query("""with c as (select distinct on (chat_id) chat_id, route, status, total_elapsed_ms from chat_log order by chat_id, asked_at desc)
select route, status, count(total_elapsed_ms)::bigint as n, round(avg(total_elapsed_ms::double),3) as mean, round(median(total_elapsed_ms::double),3) as median, round(quantile_cont(total_elapsed_ms::double,0.95),3) as p95 from c group by 1,2""")
def latency_summary(spark, folder):
    """Latencies of the chats by route and status."""
    rows = latest_rows(table(spark, folder, "chat_log").select("chat_id", "route", "status", "total_elapsed_ms", "asked_at"), ["chat_id"], "asked_at")
    return latencies(rows, ["route", "status"], "total_elapsed_ms")


def _intent_sql() -> str:
    x = f"lower({_of(_COLLAPSE, 'question')})"
    hits = ["(" + " + ".join(f"(contains({x}, '{w}'))::int" for w in words) + ")" for words in INTENTS.values()]
    best = f"greatest({', '.join(hits)})"
    label = "coalesce(" + ", ".join(f"case when {h} = {best} and {best} > 0 then '{n}' end" for n, h in zip(INTENTS, hits)) + ")"
    return f"""with c as (select distinct on (chat_id) chat_id, question, intent from chat_log order by chat_id, asked_at desc), p as (select *, {label} as label from c)
select intent, count(*)::bigint as n, round(avg((coalesce(label,'') = coalesce(intent,''))::int::double),4) as accuracy from p group by 1"""


@query(_intent_sql())
def intent_accuracy(spark, folder):
    """How often the keyword labels of the questions agree with the logged intents."""
    rows = latest_rows(table(spark, folder, "chat_log").select("chat_id", "question", "intent", "asked_at"), ["chat_id"], "asked_at")
    labelled = rows.withColumn("label", label_scores(F.col("question"), INTENTS)["label"])
    return accuracy(labelled, ["intent"], F.col("label"), F.col("intent"))


_TOK = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[0-9A-Za-zÀ-ỹ]+'), lambda x: length(x) >= 2))"
_CITED_TOK = "list_concat(regexp_extract_all({0}, '(?i)" + CITED_ARTICLE + "'), regexp_extract_all({0}, '(?i)" + CITED_LAW + "'))"
_CLAIMS = """
c as (select distinct on (chat_id) chat_id, coalesce(final_answer,'') as a, sources from chat_log order by chat_id, asked_at desc),
p as (select chat_id, list_filter(list_transform(string_split(regexp_replace(a, '([.!?;:])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(trim(""" + _of(_COLLAPSE, "x") + """, '- '))), lambda x: length(x) >= 18) as l from c),
cl0 as (select chat_id, generate_subscripts(l, 1) - 1 as claim_no, unnest(l) as claim from p),
src as (select distinct chat_id, regexp_extract(s, '""" + _CODE + """', 0) as code from (select chat_id, unnest(sources) as s from c)),
art as (select distinct on (mapc) mapc, article_code, article_name, law_id, title, raw_content from parsed_article where snapshot_no = (select max(snapshot_no) from parsed_article) and @trim(coalesce(mapc,''))<>'' order by mapc, loaded_at desc),
found as (select chat_id, coalesce(raw_content,'') as body, concat_ws(' ', nullif(trim(coalesce(article_code,'')),''), nullif(trim(coalesce(article_name,'')),''), coalesce(nullif(trim(coalesce(law_id,'')),''), nullif(trim(coalesce(title,'')),''))) as hint,
 concat_ws(' - ', nullif(""" + _of(_COLLAPSE, "article_code") + """,''), nullif(""" + _of(_COLLAPSE, "article_name") + """,''), coalesce(nullif(""" + _of(_COLLAPSE, "law_id") + """,''), nullif(""" + _of(_COLLAPSE, "title") + """,''))) as expected from src join art on code = trim(article_code)),
ev as (select chat_id, """ + _of(_TOK, "body || chr(10) || hint") + """ as e from found),
ex as (select chat_id, list(distinct expected) as expected from found group by 1),
a0 as (select chat_id, """ + _of(_COLLAPSE, "a") + """ as x, list_distinct(list_concat(list_filter(list_transform(coalesce(sources, []), lambda s: """ + _of(_COLLAPSE, "s") + """), lambda s: s <> ''), list_filter(coalesce(expected, []), lambda s: s <> ''))) as pool from c left join ex using (chat_id)),
""" + CITES.replace("@from", "a0") + """,
rep as (select chat_id, citations, pool, x, list_filter(citations, lambda q: len(pool) > 0 and len(list_filter(pool, lambda e: contains(lower(e), lower(q)) or contains(lower(q), lower(e)) or list_has_any(""" + _of(_CITED_TOK, "lower(q)") + ", " + _of(_CITED_TOK, "lower(e)") + """))) = 0) as weak,
 len(citations) = 0 and (len(pool) > 0 or regexp_matches(x, '(?i)""" + GENERIC + """')) as missing from cites),
ct0 as (select chat_id, claim_no, claim, """ + _of(_TOK, "claim") + """ as t from cl0),
o as (select ct0.chat_id, claim_no, claim, len(t)::bigint as n_tokens, round(max(case when len(t) > 0 then coalesce(len(list_intersect(t, e)),0)::double / len(t) else 1.0 end),6) as best_overlap from ct0 left join ev using (chat_id) group by all),
sup as (select o.chat_id, claim_no, n_tokens, best_overlap, best_overlap >= 0.42 or (best_overlap >= 0.28 and n_tokens <= 8) or n_tokens = 0 or regexp_matches(claim, '(?i)""" + DISCLAIMER + """') or len(list_filter(list_concat(pool, citations), lambda h: h <> '' and contains(lower(claim), lower(h)))) > 0 as supported from o join rep using (chat_id))"""  # fmt: skip


def _cited(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The latest row of each answer, the articles that its sources name, and the report on its citations."""
    rows = latest_rows(table(spark, folder, "chat_log").select("chat_id", "final_answer", "sources", "asked_at"), ["chat_id"], "asked_at")
    codes = rows.select("chat_id", F.explode("sources").alias("s")).select("chat_id", F.regexp_extract("s", _CODE, 0).alias("code")).distinct()
    current = latest_rows(latest_snapshot(articles(spark, folder)).select("mapc", "article_code", "article_name", "law_id", "title", "raw_content", "loaded_at"), ["mapc"], "loaded_at")
    named = [present("article_code"), present("article_name"), F.coalesce(present("law_id"), present("title"))]
    expected = F.concat_ws(" - ", *[F.nullif(collapse(c), F.lit("")) for c in named])
    met = codes.join(current.withColumn("code", F.trim("article_code")), "code").select("chat_id", F.concat(text("raw_content"), F.lit("\n"), F.concat_ws(" ", *named)).alias("evidence"), expected.alias("expected"))
    report = citation_report(rows.join(met.groupBy("chat_id").agg(F.collect_set("expected").alias("expected")), "chat_id", "left"), "chat_id", "final_answer", "sources", "expected")
    return rows, met, report


def _supported(spark, folder) -> tuple[DataFrame, DataFrame]:
    rows, met, report = _cited(spark, folder)
    hints = report.select("chat_id", F.concat("pool", "citations").alias("hints"))
    return claim_support(claims(rows, "chat_id", "final_answer"), met, "chat_id", hints), report


@query(f"with {_CLAIMS} select chat_id, claim_no::int as claim_no, n_tokens, best_overlap, supported from sup")
def claims_supported(spark, folder):
    """Claims of the answers against the articles they cite."""
    return _supported(spark, folder)[0]


@query(f"""with {_CLAIMS}, g as (select chat_id, count(*)::bigint as n_claims, count_if(not supported)::bigint as n_unsupported from sup group by 1)
select chat_id, len(weak) = 0 and not missing as citation_ok, coalesce(n_claims,0)::bigint as n_claims, coalesce(n_unsupported,0)::bigint as n_unsupported, round(greatest(least(1 - coalesce(n_unsupported,0) / greatest(coalesce(n_claims,0), 1) - case when len(weak) = 0 and not missing then 0 else 0.15 end, 1), 0), 4) as score from rep left join g using (chat_id)""")
def grounding_scores(spark, folder):
    """Share of supported claims of each answer, less the penalty of bad citations."""
    supported, report = _supported(spark, folder)
    return grounding(supported, "chat_id", report)


@query(f"with {_CLAIMS} select chat_id, len(citations)::int as n_citations, len(pool)::int as n_pool, array_to_string(weak, ' | ') as weak, missing, len(weak) = 0 and not missing as citation_ok from rep")
def citation_reports(spark, folder):
    """Citations of each answer against what it may cite: weak ones, and whether they are missing."""
    report = _cited(spark, folder)[2]
    return report.select("chat_id", F.size("citations").alias("n_citations"), F.size("pool").alias("n_pool"), F.array_join("weak", " | ").alias("weak"), "missing", "citation_ok")


@query("""
with c as (select distinct chat_id, list_distinct_ordered as k from (select chat_id, list_filter(list_transform(coalesce(sources, []), lambda x: """ + _of(_COLLAPSE, "x") + """), lambda x: x <> '') as list_distinct_ordered from chat_log)),
u as (select chat_id, list_filter(k, lambda x, i: not list_contains(k[1:i-1], x)) as k from c),
r as (select chat_id, k, list_filter(k, lambda x: contains(x, ' - ') or (contains(x, ',') and length(x) > 24)) as rich from u),
f as (select chat_id, k, list_filter(k, lambda x: not ((regexp_matches(x, '(?i)""" + BARE_ARTICLE + """') and len(rich) > 0) or (regexp_matches(x, '(?i)""" + BARE_LAW + """') and len(list_filter(rich, lambda y: contains(lower(y), lower(x)))) > 0) or (len(list_filter(k, lambda y: lower(x) <> lower(y) and contains(lower(y), lower(x)))) > 0 and len(string_split(x, ' ')) <= 4))) as kept from r)
select distinct chat_id, array_to_string((case when len(k) <= 1 then k when len(kept) > 0 then kept else k[1:2] end)[1:2], ' | ') as shown from f""")  # fmt: skip
def shown_sources(spark, folder):
    """Sources shown with the answers: distinct, none part of another, two at most."""
    return table(spark, folder, "chat_log").select("chat_id", F.array_join(displayed_sources(F.col("sources"), 2), " | ").alias("shown")).distinct()


@query("""
with c as (select distinct chat_id, asked_at, coalesce(session_id,'') as session_id, coalesce(thread_id,'') as thread_id, question, final_answer from chat_log),
m as (select *, 0 as o, 'user' as role, nullif(trim(coalesce(question,'')),'') as text from c union all select *, 1, 'assistant', nullif(trim(coalesce(final_answer,'')),'') from c)
select session_id, thread_id, row_number() over (partition by session_id, thread_id order by asked_at, chat_id, o)::int as message_no, role, md5(text) as text_md5 from m where text is not null""")
def thread_messages(spark, folder):
    """Messages of each thread in order."""
    rows = table(spark, folder, "chat_log").select("chat_id", "asked_at", F.coalesce("session_id", F.lit("")).alias("session_id"), F.coalesce("thread_id", F.lit("")).alias("thread_id"), "question", "final_answer").distinct()
    said = messages(rows.withColumn("at", F.struct("asked_at", "chat_id")), ["session_id", "thread_id"], "at", "question", "final_answer")
    return said.select("session_id", "thread_id", "message_no", "role", F.md5("text").alias("text_md5"))


_THREADS = """select coalesce(session_id,'') as session_id, coalesce(thread_id,'') as thread_id, count(*)::bigint as n_messages, coalesce(max_by(coalesce(status = 'need_clarify', false), chat_id), false) as waiting, max(chat_id)::bigint as last_chat_id from chat_log where chat_id is not null group by 1, 2"""


@query(_THREADS)
def waiting_threads(spark, folder):
    """State of each thread: whether it waits for the user's reply."""
    return thread_states_batch(table(spark, folder, "chat_log"))


@query(_THREADS)
def thread_stream(spark, folder):
    """The same states kept by a stream over the chat table, with state per thread."""
    out = shared_folder(spark, "threads")
    rows = spark.readStream.schema(table(spark, folder, "chat_log").schema)
    stream = (rows.option("pathGlobFilter", "*.parquet").parquet(f"{folder}/chat_log.parquet")) if _is_folder(spark, f"{folder}/chat_log.parquet") else rows.option("pathGlobFilter", "chat_log.parquet").parquet(folder)

    def keep(updates: DataFrame, batch: int) -> None:
        updates.write.mode("overwrite").parquet(f"{out}/states/batch={batch}")

    running = thread_states(stream).writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    running.awaitTermination()
    return latest_states(spark.read.parquet(f"{out}/states"))


@query()
def section_search(spark, folder):
    """Hybrid search of the indexed sections for the questions and their variants: BM25 and hashed-word vectors, reranked by word overlap."""
    docs = kept(_sections(spark, folder))

    def best(asked: DataFrame) -> DataFrame:
        # What a question finds depends on nothing but its text, so equal ones are searched, merged and reranked once.
        searched = asked.select("chat_id", F.posexplode(variants(F.col("question"), query_filters("question"), ["mức phạt", "thủ tục", "thời hạn", "hồ sơ"])).alias("query_no", "question"))
        one = kept(searched.withColumn("query_id", F.col("chat_id") * 8 + F.col("query_no")))
        lexical = bm25_topk(docs, one, 12, doc="point_id", query="query_id").select("query_id", F.lit("bm25").alias("channel"), "point_id", "score")
        near = vector_topk(docs.withColumn("embedding", embedded("content")), one.withColumn("embedding", embedded("question")), 12, row="point_id", query="query_id").select("query_id", F.lit("vector").alias("channel"), "point_id", "score")
        hits = lexical.unionByName(near).select(F.floor(F.col("query_id") / 8).alias("request_id"), (F.col("query_id") % 8).alias("query_no"), "channel", F.col("point_id").alias("key"), "score", F.lit(0.0).alias("bonus"))
        merged = hybrid_merge(hits).where("rank <= 5")
        told = merged.join(docs.select(F.col("point_id").alias("key"), "content"), "key").join(asked.select(F.col("chat_id").alias("request_id"), "question"), "request_id")
        return reranked(told, "request_id", "question", "content", 4, overlap_model).select(F.col("request_id").alias("chat_id"), "key", "combined", "rerank_score", "rerank")

    return _once(_questions(spark, folder, every=True), "chat_id", best).select(F.col("chat_id").alias("request_id"), "key", "combined", "rerank_score", "rerank")


def _is_folder(spark, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


@query("select user_id, event_type, count(*)::bigint as n, max_by(value, struct_pack(t := ts, e := event_id)) as last_value from events group by 1, 2")
def event_fold(spark, folder):
    """Latest value of each kind of event of a user."""
    return folded_events(table(spark, folder, "events"), "user_id", ["ts", "event_id"], "event_type", "value")


@query("""with n as (select event_type, (epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts)) / 1e6 as s from events)
select event_type, count(*)::bigint as n, round(sum(s), 3) as total_s from n where s is not null group by 1""")
def step_timing(spark, folder):
    """Time from each event of a user to the next, by kind."""
    return step_times(table(spark, folder, "events"), "user_id", "ts", "event_id", "event_type")


_G = "lower(" + _of(_COLLAPSE, "{0}") + ")"


@query(f"""
with a as (select *, case when regexp_matches(trim(coalesce(effective_date,'')),'^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') then try_strptime(trim(effective_date),'%d/%m/%Y') when regexp_matches(trim(coalesce(effective_date,'')),'^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') then try_strptime(trim(effective_date),'%Y-%m-%d') end as d from parsed_article)
select law_id, count(*)::bigint as n_rows, count_if({_of(_G, 'issuer')} <> '' and {_of(_G, 'issuer')} = 'chính phủ')::bigint as n_folded, count_if(issuer = 'Chính phủ')::bigint as n_exact,
 count_if(d is null or (d >= '2005-01-01' and d <= '2015-12-31'))::bigint as n_in_range_or_undated, count_if(d is not null and d >= '2005-01-01' and d <= '2015-12-31')::bigint as n_in_range from a group by 1""")
def filter_modes(spark, folder):
    """Articles of each law that pass the folded and the exact filter, and the date range with undated rows passing or dropped."""
    rows = table(spark, folder, "parsed_article").withColumn("iso", iso_date("effective_date"))
    start, end = F.lit("2005-01-01T00:00:00Z"), F.lit("2015-12-31T00:00:00Z")
    return rows.groupBy("law_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(exact_match(F.col("issuer"), F.lit("Chính phủ"))).alias("n_folded"), F.count_if(F.col("issuer") == "Chính phủ").alias("n_exact"),
        F.count_if(date_passes(F.col("iso"), start, end)).alias("n_in_range_or_undated"), F.count_if(date_passes(F.col("iso"), start, end, "drop")).alias("n_in_range"),
    )


@query("""
select case when coalesce(law_id,'')<>'' or coalesce(article_code,'')<>'' then coalesce(law_id,'')||'|'||coalesce(article_code,'')||'|'||coalesce(article_name,'') else coalesce(nullif(trim(coalesce(mapc,'')),''), sha1(coalesce(raw_content,''))) end as key, count(*)::bigint as n_rows, min(snapshot_no) as first_snapshot from parsed_article group by 1""")
def retrieval_keys(spark, folder):
    """Rows per key under which hits are the same."""
    return table(spark, folder, "parsed_article").groupBy(dedup_key(content="raw_content").alias("key")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("snapshot_no").alias("first_snapshot"))

