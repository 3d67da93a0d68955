"""Queries of text, extraction, chunking and corpus operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.extract import ASKED_ISSUERS, BEHIND, CITED_ARTICLE, CITED_CLAUSE, CITED_LAW, CITED_POINT, ISSUER_NAMES, ISSUERS, LAW_STARTS, NOTE_DATE, NOTE_STARTS, SECTION, TITLE, article_no, citations, effective_date, issuer_of_note, law_id, query_features, query_filters, title_of_law, title_parts
from lexmill.functions.text import WS, clipped, collapse, folded, format_source, informative_tokens, iso_date, legal_reference, point_id, present, retrieval_text, text, tidy, token_set, tokens, without_prefixes
from lexmill.operators.chunking import article_sections, numbered_lines, with_heading
from lexmill.operators.evaluation import STOP_WORDS
from lexmill.operators.corpus import article_documents, backfilled, corpus_stats, group_key, histogram, latest_rows, manifest, replaced, source_laws, total_order
from lexmill.operators.snapshot_diff import snapshot_changes
from lexmill.operators.splitter import chunks
from lexmill.sources.html import articles as html_articles
from lexmill.sources.html import html_nodes
from lexmill.sources.index_store import preview, retained, upserted
from lexmill.plans.oracle import expanded
from lexmill.sources.tables import blank, table, trimmed

QUERIES: dict = {}
SQL: dict[str, str] = {}

def _of(template: str, column: str) -> str:
    """SQL of an expression over a column."""
    return template.replace("{0}", column)


# SQL of shared expressions; white space as the columns' WS.
_WS = WS
_TIDY = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(coalesce({0},''), chr(160), ' '), '\r\n?', chr(10), 'g'), '[ \t\f\x0b]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10)||chr(10), 'g'), '^[ \n]+|[ \n]+\z', '', 'g')"
_COLLAPSE = "trim(regexp_replace(coalesce({0},''), '" + _WS + "+', ' ', 'g'))"
_TOKENS = "regexp_extract_all(lower(coalesce({0},'')), '[0-9A-Za-zÀ-ỹ]+')"
_COMPARED = "trim(regexp_replace(regexp_replace(lower(" + _COLLAPSE + "), '[^\\p{L}\\p{N}_ ]', ' ', 'g'), ' +', ' ', 'g'))"
_WORDS = "list_filter(list_distinct(string_split(" + _COMPARED + f", ' ')), lambda x: length(x) > 2 and not regexp_full_match(x, '\\p{{Nd}}+') and not list_contains({STOP_WORDS}, x))"
_LAW = "(?:Bộ luật|Luật|Pháp lệnh|Nghị quyết liên tịch|Nghị quyết|Nghị định|Thông tư liên tịch|Thông tư|Quyết định|Chỉ thị|Lệnh) số\\s+[^\\s,()]+"
# Citations of the texts x of a table: each article with what the 80 characters behind it name, then laws, each once in order.
_CITED, _CITED_LAW = "(?i)" + CITED_ARTICLE, "(?i)" + CITED_LAW
CITES = f"""
cm as (select *, regexp_extract_all(x, '{_CITED}') as m, regexp_split_to_array(x, '{_CITED}') as p from @from),
ct as (select *, list_transform(generate_series(1, len(m)), lambda i: substr(p[i+1] || coalesce(array_to_string(list_transform(generate_series(i+1, len(m)), lambda j: m[j] || p[j+1]), ''), ''), 1, {BEHIND})) as t from cm),
cl as (select *, list_concat(list_transform(generate_series(1, len(m)), lambda i: concat_ws(', ', m[i], nullif(regexp_extract(t[i], '(?i){CITED_CLAUSE}'), ''), nullif(regexp_extract(t[i], '(?i){CITED_POINT}'), ''), nullif(regexp_extract(t[i], '{_CITED_LAW}'), ''))), regexp_extract_all(x, '{_CITED_LAW}')) as l from ct),
cites as (select * exclude (m, p, t, l), list_filter(l, lambda e, i: list_position(l, e) = i) as citations from cl)"""
_ARTICLES = "(select * from parsed_article where @trim(coalesce(mapc,''))<>'')"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = expanded(sql)
        return f

    return add


def articles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "parsed_article").where(~blank("mapc"))


def latest_snapshot(rows: DataFrame) -> DataFrame:
    """Rows of the latest snapshot."""
    return rows.join(F.broadcast(rows.agg(F.max("snapshot_no").alias("snapshot_no"))), "snapshot_no", "left_semi")


@query("""
select r_name, n_name, count(*)::bigint as n_customers, round(sum(c_acctbal), 2) as balance
from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey group by 1, 2""")
def dim_lookup_join(spark, folder):
    """Small lookups joined to a fact table, missing keys kept."""
    c, n, r = (table(spark, folder, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return joined.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n_customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query(f"select doc_id, md5({_of(_TIDY, 'text')}) as clean_md5, length({_of(_TIDY, 'text')})::bigint as n_clean from documents")
def tidy_documents(spark, folder):
    """Documents with blanks and empty lines collapsed."""
    clean = tidy("text")
    return table(spark, folder, "documents").select("doc_id", F.md5(clean).alias("clean_md5"), F.length(clean).cast("long").alias("n_clean"))


@query(f"select distinct chat_id, lower({_of(_COLLAPSE, 'question')}) as folded from chat_log")
def folded_questions(spark, folder):
    """Questions in the form in which they are matched."""
    return table(spark, folder, "chat_log").select("chat_id", folded("question").alias("folded")).distinct()


@query(f"""
with t as (select doc_id, {_of(_TOKENS, 'text')} as t, {_of(_WORDS, 'text')} as w from documents)
select doc_id, len(t)::bigint as n_tokens, len(list_distinct(list_filter(t, lambda x: length(x) >= 2)))::bigint as n_distinct, len(w)::bigint as n_informative from t""")
def document_tokens(spark, folder):
    """Tokens of each document: all, distinct, informative."""
    return table(spark, folder, "documents").select("doc_id", F.size(tokens("text")).cast("long").alias("n_tokens"), F.size(token_set("text")).cast("long").alias("n_distinct"), F.size(informative_tokens("text", STOP_WORDS)).cast("long").alias("n_informative"))


@query(f"""
with t as (select doc_id, unnest({_of(_TOKENS, 'text')}) as term from documents)
select term, count(*)::bigint as tf, count(distinct doc_id)::bigint as df from t group by term""")
def corpus_terms(spark, folder):
    """Term and document frequencies of the documents: terms are counted per document first, so a hot term is folded early."""
    per_doc = table(spark, folder, "documents").select("doc_id", F.explode(tokens("text")).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))


_PART = "regexp_replace({0}, '^[ .]+|[ .]+\\z', '', 'g')"
_PARTS = "list_filter([" + ", ".join(_of(_PART, _of(_COLLAPSE, c)) for c in ("title", "law_id", "article", "article_code", "article_name", "de_muc", "raw_content")) + "], lambda x: x <> '')"


@query(f"""
with p as (select distinct snapshot_no, mapc, {_PARTS} as parts from {_ARTICLES}),
f as (select snapshot_no, mapc, array_to_string(list_filter(parts, lambda x, i: not list_contains(list_transform(parts[1:i-1], lambda y: lower(y)), lower(x))), '. ') as t from p)
select snapshot_no, mapc, md5(t) as text_md5, length(t)::bigint as n_chars, length(t) > 12000 as clipped from f""")
def article_retrieval_text(spark, folder):
    """Search text of each article: its distinct fields in one line, and whether it exceeds the index's limit."""
    made = articles(spark, folder).select("snapshot_no", "mapc", retrieval_text("title", "law_id", "article", "article_code", "article_name", "de_muc", "raw_content").alias("t"))
    # Digest and length first: no text is shuffled.
    return made.select("snapshot_no", "mapc", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n_chars"), clipped("t", 12_000)[1].alias("clipped")).distinct()


@query(r"""
with d as (select effective_date, trim(coalesce(effective_date,'')) as x, count(*)::bigint as n_rows from parsed_article group by 1)
select effective_date, coalesce(strftime(coalesce(case when regexp_matches(x,'^\d{1,2}/\d{1,2}/\d{4}$') then try_strptime(x,'%d/%m/%Y') end,
 case when regexp_matches(x,'^\d{4}-\d{1,2}-\d{1,2}$') then try_strptime(x,'%Y-%m-%d') end), '%Y-%m-%dT00:00:00Z'), '') as iso, n_rows from d""")
def effective_dates(spark, folder):
    """Dates of any delivered form in ISO form."""
    return table(spark, folder, "parsed_article").groupBy("effective_date").agg(F.count(F.lit(1)).alias("n_rows")).select("effective_date", iso_date("effective_date").alias("iso"), "n_rows")


@query("""
with k as (select distinct coalesce(mapc,'') || '|' || sha1(coalesce(content,'')) as key from index_document),
x as (select key, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('chunk:' || key)) as x from k)
select key, substr(x,1,8) || '-' || substr(x,9,4) || '-5' || substr(x,14,3) || '-' || lpad(lower(to_hex(((('0x' || substr(x,17,2))::int) & 63) | 128)), 2, '0') || substr(x,19,2) || '-' || substr(x,21,12) as point_id from x""")
def stable_point_ids(spark, folder):
    """Version 5 ids of the sections, equal in every run."""
    key = F.concat_ws("|", text("mapc"), F.sha1(text("content")))
    return table(spark, folder, "index_document").select(key.alias("key")).distinct().select("key", point_id("chunk", F.col("key")).alias("point_id"))


@query("""
select distinct snapshot_no, mapc,
 concat_ws(' - ', nullif(trim(coalesce(article_code,'')),''), nullif(trim(coalesce(article_name,'')),''), coalesce(nullif(trim(coalesce(law_id,'')),''), nullif(trim(coalesce(title,'')),'')),
  nullif(concat_ws(', ', nullif(trim(coalesce(issuer,'')),''), nullif(trim(coalesce(effective_date,'')),'')), '')) as source,
 concat_ws(' ', nullif(trim(coalesce(article,'')),''), 'của ' || nullif(trim(coalesce(title,'')),''), '(' || nullif(trim(coalesce(law_id,'')),'') || ')') as reference
from parsed_article where @trim(coalesce(mapc,''))<>''""")
def source_lines(spark, folder):
    """Citation line and legal reference of each article."""
    return articles(spark, folder).select("snapshot_no", "mapc", format_source().alias("source"), legal_reference().alias("reference")).distinct()


@query(r"""
select distinct mapc, case when regexp_matches(t, '^(?i)(Điều\s+[0-9A-Za-zÀ-ỹ.\-]+\.)') then regexp_extract(t, '^(?i)(Điều\s+[0-9A-Za-zÀ-ỹ.\-]+\.)\s*(.*)$', 1) else t end as code,
 regexp_extract(t, '^(?i)(Điều\s+[0-9A-Za-zÀ-ỹ.\-]+\.)\s*(.*)$', 2) as name
from (select mapc, """ + _of(_TIDY, "coalesce(article_code,'') || '. ' || coalesce(article_name,'')") + """ as t from parsed_article where @trim(coalesce(mapc,''))<>'')""")  # fmt: skip
def article_titles(spark, folder):
    """Headings split into code and name."""
    code, name = title_parts(F.concat(text("article_code"), F.lit(". "), text("article_name")))
    return articles(spark, folder).select("mapc", code.alias("code"), name.alias("name")).distinct()


_NOTE = "regexp_replace(" + _of(_TIDY, "source_note") + ", '^[() ]+|[() ]+$', '', 'g')"


@query(rf"""
with n as (select distinct mapc, {_NOTE} as note from {_ARTICLES}),
d as (select *, regexp_extract(note, '(?i){_LAW}', 0) as law_id, regexp_extract(note, '(?i)Điều\s+\d+[A-Za-zÀ-ỹ\-]*', 0) as article,
 regexp_replace(regexp_replace(regexp_extract(note, '(?i){_LAW}(.*)', 1), '(?i)(ngày\s+(\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{1,2}}\s+tháng\s+\d{{1,2}}\s+năm\s+\d{{4}})|,\s*(có|hết) hiệu lực).*', ''), '^[ ,;:\-]+|[ ,;:\-]+$', '', 'g') as title from n)
select mapc, law_id, article, title, coalesce(nullif(regexp_extract(note, '(?i)có hiệu lực thi hành kể từ ngày\s+(\d{{1,2}}/\d{{1,2}}/\d{{4}})', 1),''),
 nullif(regexp_extract(note, '(?i)có hiệu lực kể từ ngày\s+(\d{{1,2}}/\d{{1,2}}/\d{{4}})', 1),''), nullif(regexp_extract(note, '(?i)có hiệu lực từ ngày\s+(\d{{1,2}}/\d{{1,2}}/\d{{4}})', 1),''), '') as effective_date from d""")
def source_note_fields(spark, folder):
    """Law, title, article and date out of the source notes."""
    note = F.regexp_replace(tidy("source_note"), r"^[() ]+|[() ]+$", "")
    return articles(spark, folder).select("mapc", law_id(note).alias("law_id"), article_no(note).alias("article"), title_of_law(note).alias("title"), effective_date(note).alias("effective_date")).distinct()


def _issuer_sql() -> str:
    names = "case " + " ".join(f"when contains(note, '{x}') then '{x}'" for x in ISSUER_NAMES) + " end"
    codes = "case when starts_with(p, 'UBTVQH') then '" + ISSUERS["UBTVQH"] + "' when regexp_full_match(p, 'QH[0-9]*') then '" + ISSUERS["QH"] + "' " + " ".join(f"when p = '{k}' then '{v}'" for k, v in ISSUERS.items()) + " end"
    coded = lambda x: f"list_filter(list_transform(regexp_split_to_array(upper({_of(_COLLAPSE, x)}), '[^0-9A-ZÀ-ỸĐ]+'), lambda p: {codes}), lambda v: v is not null)"
    once = lambda c: f"nullif(array_to_string(list_filter({c}, lambda e, i: list_position({c}, e) = i), '; '), '')"
    starts = lambda x, whole, table: "case " + " ".join(f"when starts_with({x}, '{a}') and contains({whole}, '{b}') then '{n}'" for a, b, n in table) + " end"
    return rf"""
with n as (select distinct mapc, {_NOTE} as note from {_ARTICLES}),
l as (select *, regexp_extract(note, '(?i){_LAW}', 0) as law,
 regexp_replace(regexp_replace(regexp_extract(note, '(?i){_LAW}(.*)', 1), '(?i)({NOTE_DATE}|,\s*(có|hết) hiệu lực).*', ''), '^[ ,;:\-]+|[ ,;:\-]+$', '', 'g') as title,
 trim(regexp_extract(regexp_replace(note, '(?is),\s*(?:có hiệu lực|hết hiệu lực).*', ''), '(?is)^.*{NOTE_DATE}(.*)$', 1)) as tail from n),
i as (select mapc, coalesce(case when starts_with(lower(tail), 'của ') then nullif({_of(_TIDY, "substr(tail, 5)")}, '') end, {names}, {once(coded('law'))}, {once(coded('title'))},
 {starts("trim(regexp_replace(lower(note), '^điều[[:space:]]+[0-9a-zà-ỹ.-]+[[:space:]]+', ''))", "lower(note)", NOTE_STARTS)}, {starts(f"upper({_of(_COLLAPSE, 'law')})", f"upper({_of(_COLLAPSE, 'law')})", LAW_STARTS)}, '') as issuer from l)
select issuer, count(distinct mapc)::bigint as n_articles from i group by 1"""


@query(_issuer_sql())
def source_note_issuers(spark, folder):
    """Issuers that the notes state, name or imply, with the number of articles of each."""
    note = F.regexp_replace(tidy("source_note"), r"^[() ]+|[() ]+$", "")
    issuer = issuer_of_note(note, law_id(note), title_of_law(note))
    return articles(spark, folder).select(issuer.alias("issuer"), "mapc").distinct().groupBy("issuer").agg(F.count(F.lit(1)).alias("n_articles"))


_ASKED_ISSUER = "case " + " ".join(f"when contains(lower(x), '{name.lower()}') then '{name}'" for name in ASKED_ISSUERS) + " else '' end"


@query(rf"""
with q as (select distinct chat_id, {_of(_COLLAPSE, 'question')} as x from chat_log),
f as (select chat_id, x, regexp_extract(x, '(?i){_LAW}', 0) as law_id, upper(regexp_extract(x, '(?i)Điều (\d+\.\d+\.[A-ZĐ]+\.\d+\.\d+)', 1)) as code, regexp_extract(x, '(?i)Điều (\d+)(?:[^.\dA-Za-z]|\.?$)', 1) as plain, trim(regexp_extract(x, '(?i){TITLE}', 1), ' ,.;:') as titled, trim(regexp_extract(x, '(?i){SECTION}', 0)) as de_muc from q),
g as (select chat_id, x, law_id, case when code<>'' then 'Điều ' || code else '' end as article_code, case when code='' and plain<>'' then 'Điều ' || plain else '' end as article,
 case when titled<>'' then titled when law_id='' and starts_with(lower(x), 'luật ') then trim(x, ' ,.;:') else '' end as title, de_muc, {_ASKED_ISSUER} as issuer from f)
select chat_id, law_id, article_code, article, title, de_muc, issuer, article<>'' as has_article_ref, article_code<>'' as has_article_code, title<>'' as has_law_title, law_id<>'' as has_law_id, de_muc<>'' as has_de_muc,
 article<>'' or article_code<>'' or title<>'' or law_id<>'' as is_structured, contains(lower(x), 'quy định') as mentions_quy_dinh, contains(lower(x), 'là gì') as mentions_la_gi from g""")
def question_filters(spark, folder):
    """Metadata that questions name, and what they refer to."""
    found = query_filters("question")
    flags = query_features(found, F.col("question"))
    return table(spark, folder, "chat_log").select("chat_id", *[found[c].alias(c) for c in found if c != "effective_date"], *[c.alias(n) for n, c in flags.items()]).distinct()


@query(rf"""
with a as (select distinct chat_id, {_of(_COLLAPSE, 'final_answer')} as x from chat_log), {CITES.replace('@from', 'a')},
c as (select chat_id, unnest(citations) as citation from cites)
select citation, count(*)::bigint as n_answers from c group by 1""")
def answer_citations(spark, folder):
    """Citations of the answers and how many answers have each."""
    cited = table(spark, folder, "chat_log").select("chat_id", citations("final_answer").alias("c")).distinct()
    return cited.select(F.explode("c").alias("citation")).groupBy("citation").agg(F.count(F.lit(1)).alias("n_answers"))


@query(rf"""
with a as (select distinct mapc, article_name, {_of(_COLLAPSE, 'raw_content')} as x from {_ARTICLES} where snapshot_no = 5)
select mapc, md5(case when trim(coalesce(article_name,''))<>'' and lower(left(trim(x), length(trim(article_name)))) = lower(trim(article_name))
 then regexp_replace(substr(trim(x), length(trim(article_name))+1), '^[\s.:\-]+', '') else trim(x) end) as body_md5 from a""")
def bodies_without_prefix(spark, folder):
    """Bodies of the latest snapshot without their article's name at the start."""
    return _bodies(latest_snapshot(articles(spark, folder))).drop("snapshot_no")


@query(rf"""
with a as (select distinct snapshot_no, mapc, article_name, {_of(_COLLAPSE, 'raw_content')} as x from {_ARTICLES})
select distinct snapshot_no, mapc, md5(case when trim(coalesce(article_name,''))<>'' and lower(left(trim(x), length(trim(article_name)))) = lower(trim(article_name))
 then regexp_replace(substr(trim(x), length(trim(article_name))+1), '^[\s.:\-]+', '') else trim(x) end) as body_md5 from a""")
def bodies_without_prefix_all(spark, folder):
    """The same of every snapshot."""
    return _bodies(articles(spark, folder))


def _bodies(rows: DataFrame) -> DataFrame:
    return rows.select("snapshot_no", "mapc", F.md5(without_prefixes(collapse("raw_content"), F.col("article_name"))).alias("body_md5")).distinct()


def _current(spark, folder, every: bool = False):
    """Articles of the latest or of every snapshot, one row each."""
    rows = articles(spark, folder)
    return latest_rows((rows if every else latest_snapshot(rows)).select("snapshot_no", "mapc", "file_id", "law_id", "article_code", "article", "article_name", "title", "issuer", "effective_date", "raw_content", "related_articles", "de_muc", "chapter_code", "chapter_title", "source_note", "loaded_at"), ["snapshot_no", "mapc"], "loaded_at")


# The entities that occur, which is what SQL can undo, then lines with the clause and point they stand in.
_PLAIN = "replace(replace(replace(replace(raw_content, '&#273;', 'đ'), '&ldquo;', '“'), '&rdquo;', '”'), '&ge;', '≥')"
_LINES = f"""
cur as (select distinct on (snapshot_no, mapc) snapshot_no, mapc, article_code, article_name, raw_content from parsed_article where @trim(coalesce(mapc,''))<>'' order by snapshot_no, mapc, loaded_at desc),
sp as (select snapshot_no, mapc, string_split({_of(_TIDY, _PLAIN)}, chr(10)) as l from cur),
ln as (select snapshot_no, mapc, generate_subscripts(l, 1) as line_no, unnest(l) as line from sp),
cn as (select *, sum(regexp_matches(line, '^[0-9]+\\.\\s+')::int) over (partition by snapshot_no, mapc order by line_no) as clause_no from ln where trim(line) <> ''),
pn as (select *, sum((regexp_matches(line, '(?i)^[a-zđ]\\)\\s+') and clause_no > 0)::int) over (partition by snapshot_no, mapc, clause_no order by line_no) as point_no from cn)"""


@query(f"""with {_LINES} select snapshot_no, mapc, count(*)::bigint as n_lines, max(clause_no)::bigint as n_clauses, count(distinct case when point_no > 0 then clause_no || '.' || point_no end)::bigint as n_points from pn group by 1, 2""")
def article_clauses(spark, folder):
    """Lines, clauses and points of each article of every snapshot."""
    lines = numbered_lines(_current(spark, folder, every=True), ["snapshot_no", "mapc"], "raw_content")
    return lines.groupBy("snapshot_no", "mapc").agg(F.count(F.lit(1)).alias("n_lines"), F.max("clause_no").cast("long").alias("n_clauses"), F.count_distinct(F.when(F.col("point_no") > 0, F.struct("clause_no", "point_no"))).alias("n_points"))


@query(f"""with {_LINES},
pt as (select snapshot_no, mapc, clause_no, point_no, string_agg(line, chr(10) order by line_no) as part from pn group by all),
ld as (select snapshot_no, mapc, part as lead from pt where clause_no = 0),
hd as (select snapshot_no, mapc, clause_no, part as head from pt where clause_no > 0 and point_no = 0),
ps as (select *, max(point_no) over (partition by snapshot_no, mapc, clause_no) as points, max(clause_no) over (partition by snapshot_no, mapc) as clauses from pt),
sc as (select snapshot_no, mapc, clause_no, point_no, concat_ws(chr(10), lead, case when point_no > 0 then head end, part) as section from ps left join ld using (snapshot_no, mapc) left join hd using (snapshot_no, mapc, clause_no) where clause_no > 0 and (point_no > 0 or points = 0)
 union all select snapshot_no, mapc, 0, 0, part from ps where clauses = 0),
nm as (select snapshot_no, mapc, (row_number() over (partition by snapshot_no, mapc order by clause_no, point_no) - 1)::int as section_no, section from sc),
fl as (select cur.snapshot_no, cur.mapc, coalesce(section_no, 0)::int as section_no, coalesce(section, '') as section, nullif(concat_ws(' ', nullif(trim(coalesce(article_code,'')),''), nullif(trim(coalesce(article_name,'')),'')), '') as head from cur left join nm using (snapshot_no, mapc))
select snapshot_no, mapc, section_no, case when section = '' then '' else concat_ws(chr(10), head, section) end as content from fl""")
def sections(spark, folder):
    """Sections of the articles of every snapshot along clauses and points, with their headings."""
    current = _current(spark, folder, every=True)
    cut = article_sections(current, ["snapshot_no", "mapc"], "raw_content").join(current.select("snapshot_no", "mapc", "article_code", "article_name"), ["snapshot_no", "mapc"])
    return with_heading(cut, ["article_code", "article_name"]).select("snapshot_no", "mapc", "section_no", "content")


@query()
def section_chunks(spark, folder):
    """Chunks of at most 800 characters of the sections of every snapshot, each below its heading."""
    current = _current(spark, folder, every=True)
    cut = article_sections(current, ["snapshot_no", "mapc"], "raw_content").join(current.select("snapshot_no", "mapc", F.concat_ws(" ", present("article_code"), present("article_name")).alias("heading")), ["snapshot_no", "mapc"])
    return chunks(cut, ["snapshot_no", "mapc", "section_no"], "section", "heading")


_BLANK = "nullif(trim(coalesce({0},'')),'')"


@query("""
with a as (select *, cast(substr(mapc,1,15) as bigint) as pos from parsed_article where @trim(coalesce(mapc,''))<>''),
b as (select snapshot_no, file_id, law_id,
 max_by(title, struct_pack(n := length(title), p := -pos)) filter (where trim(coalesce(title,''))<>'') as t,
 max_by(effective_date, struct_pack(n := length(effective_date), p := -pos)) filter (where trim(coalesce(effective_date,''))<>'') as d,
 max_by(issuer, struct_pack(c := position('ngày' in lower(issuer))=0 and length(issuer)<=80, p := -pos)) filter (where trim(coalesce(issuer,''))<>'') as i
 from a where trim(coalesce(law_id,''))<>'' and trim(coalesce(file_id,''))<>'' group by all)
select distinct a.snapshot_no, a.mapc, coalesce(nullif(trim(coalesce(a.title,'')),''), b.t, '') as title, coalesce(nullif(trim(coalesce(a.issuer,'')),''), b.i, '') as issuer, coalesce(nullif(trim(coalesce(a.effective_date,'')),''), b.d, '') as effective_date
from a left join b on a.snapshot_no=b.snapshot_no and a.file_id=b.file_id and a.law_id=b.law_id""")
def metadata_backfill(spark, folder):
    """Missing titles, issuers and dates from other articles of the same file and law."""
    rows = articles(spark, folder).withColumn("pos", F.substring("mapc", 1, 15).cast("long"))
    return backfilled(rows, ["snapshot_no", "file_id", "law_id"], "pos", ["title", "effective_date"]).select("snapshot_no", "mapc", "title", "issuer", "effective_date").distinct()


@query("""
with a as (select *, coalesce(nullif(trim(coalesce(law_id,'')),''), nullif(trim(coalesce(title,'')),'')) as k from parsed_article where snapshot_no = 5)
select file_id, max_by(coalesce(law_id,''), struct_pack(n := length(coalesce(law_id,'')), v := coalesce(law_id,''))) as law_id, max_by(coalesce(title,''), struct_pack(n := length(coalesce(title,'')), v := coalesce(title,''))) as title,
 coalesce(max_by(issuer, struct_pack(c := position('ngày' in lower(issuer))=0 and length(issuer)<=80, v := issuer)) filter (where trim(coalesce(issuer,''))<>''),'') as issuer,
 max_by(coalesce(effective_date,''), struct_pack(n := length(coalesce(effective_date,'')), v := coalesce(effective_date,''))) as effective_date
from a where k is not null group by file_id, k""")
def laws_of_files(spark, folder):
    """Distinct laws of each file of the latest snapshot."""
    return source_laws(latest_snapshot(table(spark, folder, "parsed_article")))


@query(SQL["laws_of_files"].replace(" where snapshot_no = 5", "").replace("select file_id,", "select snapshot_no, file_id,").replace("group by file_id,", "group by snapshot_no, file_id,"))
def laws_of_files_all(spark, folder):
    """Distinct laws of each file of every snapshot."""
    return source_laws(table(spark, folder, "parsed_article"), ["snapshot_no", "file_id"])


@query("""
with a as (select distinct on (mapc) mapc, file_id, law_id, raw_content from parsed_article where snapshot_no=5 and @trim(coalesce(mapc,''))<>'' order by mapc, loaded_at desc),
c as (select a.file_id, count(distinct i.point_id)::bigint as chunk_count from index_document i join a on @trim(i.mapc)=a.mapc where i.snapshot_no=5 group by 1),
f as (select file_id, count(*)::bigint as article_count, count(distinct nullif(trim(coalesce(law_id,'')),''))::bigint as law_count from a group by 1),
d as (select file_id, sha256(coalesce(mapc,'')||'|'||coalesce(raw_content,'')) as d from a),
k as (select file_id, left(d, 3) as c, sha256(string_agg(d, '' order by d)) as s from d group by all),
g as (select file_id, sha256(string_agg(s, '' order by c)) as content_sha from k group by all)
select f.file_id, article_count, law_count, content_sha, coalesce(chunk_count,0)::bigint as chunk_count from f join g on f.file_id is not distinct from g.file_id left join c on f.file_id = c.file_id""")
def file_manifest(spark, folder):
    """Manifest of the latest snapshot's files: articles, laws, indexed sections and the digest of the contents."""
    return _manifest(spark, folder, False).drop("snapshot_no")


@query("""
with a as (select distinct on (snapshot_no, mapc) snapshot_no, mapc, file_id, law_id, raw_content from parsed_article where @trim(coalesce(mapc,''))<>'' order by snapshot_no, mapc, loaded_at desc),
c as (select a.snapshot_no, a.file_id, count(distinct i.point_id)::bigint as chunk_count from index_document i join a on @trim(i.mapc)=a.mapc and i.snapshot_no=a.snapshot_no group by 1, 2),
f as (select snapshot_no, file_id, count(*)::bigint as article_count, count(distinct nullif(trim(coalesce(law_id,'')),''))::bigint as law_count from a group by 1, 2),
d as (select snapshot_no, file_id, sha256(coalesce(mapc,'')||'|'||coalesce(raw_content,'')) as d from a),
k as (select snapshot_no, file_id, left(d, 3) as c, sha256(string_agg(d, '' order by d)) as s from d group by all),
g as (select snapshot_no, file_id, sha256(string_agg(s, '' order by c)) as content_sha from k group by all)
select f.snapshot_no, f.file_id, article_count, law_count, content_sha, coalesce(chunk_count,0)::bigint as chunk_count from f join g using (snapshot_no, file_id) left join c using (snapshot_no, file_id)""")
def file_manifest_all(spark, folder):
    """Manifest of every snapshot's files."""
    return _manifest(spark, folder, True)


def _manifest(spark, folder, every: bool) -> DataFrame:
    rows = _current(spark, folder, every)
    points = table(spark, folder, "index_document").select("snapshot_no", "point_id", trimmed("mapc").alias("mapc")).distinct()
    return manifest(rows, points.join(rows.select("snapshot_no", "mapc", "file_id"), ["snapshot_no", "mapc"]), ["snapshot_no", "file_id"])


@query("""
with a as (select distinct on (snapshot_no, mapc) snapshot_no, mapc, file_id, law_id from parsed_article where @trim(coalesce(mapc,''))<>'' order by snapshot_no, mapc, loaded_at desc),
c as (select a.snapshot_no, a.file_id, count(distinct i.point_id)::bigint as chunk_count from index_document i join a on @trim(i.mapc)=a.mapc and i.snapshot_no=a.snapshot_no group by 1, 2),
f as (select snapshot_no, file_id, count(*)::bigint as article_count, string_agg(distinct nullif(trim(coalesce(law_id,'')),''), ';' order by nullif(trim(coalesce(law_id,'')),'')) as law_ids from a group by 1, 2),
m as (select snapshot_no, file_id, max_by(struct_pack(p := lower(coalesce(relative_path,'')), h := lower(coalesce(content_sha256,'')), s := file_size, t := mtime_ns, v := snapshot_version), synced_at) as m from manifest_entry where file_id is not null group by 1, 2)
select snapshot_no, file_id, article_count, coalesce(chunk_count,0)::bigint as chunk_count, coalesce(law_ids,'') as law_ids, m.p as relative_path, m.h as content_sha256, m.s as file_size, m.t as mtime_ns, m.v as snapshot_version
from f left join c using (snapshot_no, file_id) left join m using (snapshot_no, file_id)""")
def manifest_entries(spark, folder):
    """Manifest entries: what each file of a snapshot holds, with the signature it was delivered with."""
    rows = _current(spark, folder, True)
    points = table(spark, folder, "index_document").select("snapshot_no", "point_id", trimmed("mapc").alias("mapc")).distinct()
    held = manifest(rows, points.join(rows.select("snapshot_no", "mapc", "file_id"), ["snapshot_no", "mapc"]), ["snapshot_no", "file_id"])
    laws = source_laws(rows, ["snapshot_no", "file_id"]).where(present("law_id").isNotNull()).groupBy("snapshot_no", "file_id").agg(F.array_join(F.array_sort(F.collect_set(F.trim("law_id"))), ";").alias("law_ids"))
    signed = F.struct(F.lower(text("relative_path")).alias("relative_path"), F.lower(text("content_sha256")).alias("content_sha256"), "file_size", "mtime_ns", "snapshot_version")
    signature = table(spark, folder, "manifest_entry").where("file_id is not null").groupBy("snapshot_no", "file_id").agg(F.max_by(signed, "synced_at").alias("s")).select("snapshot_no", "file_id", "s.*")
    key = ["snapshot_no", "file_id"]
    return held.drop("law_count", "content_sha").join(laws, key, "left").join(signature, key, "left").withColumn("law_ids", F.coalesce("law_ids", F.lit("")))


@query("""
select count(*)::bigint as n_rows, count_if(length(trim(coalesce(raw_content,'')))=0)::bigint as n_empty, round(avg(length(trim(coalesce(raw_content,'')))::double),2) as avg_length,
 max(length(trim(coalesce(raw_content,''))))::bigint as max_length, count_if(trim(coalesce(issuer,''))='')::bigint as missing_issuer, count_if(trim(coalesce(law_id,''))='')::bigint as missing_law_id, count_if(trim(coalesce(effective_date,''))='')::bigint as missing_effective_date, snapshot_no
from parsed_article group by snapshot_no""")
def snapshot_stats(spark, folder):
    """Counts, lengths and missing fields of each snapshot."""
    return corpus_stats(table(spark, folder, "parsed_article"), "raw_content", ["issuer", "law_id", "effective_date"], ["snapshot_no"])


@query("""select coalesce(nullif(trim(coalesce(issuer,'')),''),'(missing)') as value, count(*)::bigint as n from parsed_article group by 1""")
def issuer_histogram(spark, folder):
    """Articles by issuer, missing ones under one name."""
    return histogram(table(spark, folder, "parsed_article"), "issuer")


@query("""
with m as (select distinct on (snapshot_no, p) snapshot_no, lower(trim(source_path)) as p, lower(trim(coalesce(content_sha256,''))) as h from manifest_entry where trim(coalesce(source_path,''))<>'' order by snapshot_no, p, synced_at desc),
s as (select distinct snapshot_no as n, lag(snapshot_no) over (order by snapshot_no) as prev from (select distinct snapshot_no from m))
select s.n as snapshot_no, coalesce(b.p, a.p) as source_path, case when a.p is null then 'added' when b.p is null then 'removed' else 'changed' end as change_type
from s join (select * from m) b on b.snapshot_no = s.n full join (select m.*, n from m join s on m.snapshot_no = s.prev) a on a.n = s.n and a.p = b.p
where s.prev is not null and (a.p is null or a.h <> b.h)
union all
select a.n, a.p, 'removed' from (select m.*, n from m join s on m.snapshot_no = s.prev) a left join m b on b.snapshot_no = a.n and b.p = a.p where b.p is null""")
def changed_files(spark, folder):
    """Files added, removed or changed between consecutive snapshots."""
    found = snapshot_changes(table(spark, folder, "manifest_entry").where(~blank("source_path")), snapshot=F.col("snapshot_no"), key=F.lower(trimmed("source_path")), content=F.lower(F.trim(F.coalesce("content_sha256", F.lit("")))), loaded=F.col("synced_at"))
    return found.select("snapshot_no", F.col("record_key").alias("source_path"), "change_type")


@query("""
with a as (select distinct on (snapshot_no, mapc) snapshot_no, mapc, file_id, raw_content from parsed_article where snapshot_no in (4,5) and @trim(coalesce(mapc,''))<>'' order by snapshot_no, mapc, loaded_at desc),
ch as (select distinct coalesce(x.file_id, y.file_id) as file_id from (select * from a where snapshot_no=4) x full join (select * from a where snapshot_no=5) y on x.mapc=y.mapc and x.file_id=y.file_id where x.mapc is null or y.mapc is null or coalesce(x.raw_content,'')<>coalesce(y.raw_content,''))
select * from (select file_id, mapc, md5(coalesce(raw_content,'')) as body_md5, snapshot_no from a where snapshot_no=4 and file_id not in (select file_id from ch)
union all select file_id, mapc, md5(coalesce(raw_content,'')), snapshot_no from a where snapshot_no=5 and file_id in (select file_id from ch))""")
def incremental_merge(spark, folder):
    """Corpus of the snapshot before the latest with the articles of changed files replaced by the latest ones."""
    return _merges(spark, folder, False).drop("merged_no")


@query("""
with a as (select distinct on (snapshot_no, mapc) snapshot_no, mapc, file_id, raw_content from parsed_article where @trim(coalesce(mapc,''))<>'' order by snapshot_no, mapc, loaded_at desc),
s as (select * from (select n as merged_no, lag(n) over (order by n) as base_no from (select distinct snapshot_no as n from a)) where base_no is not null),
o as (select s.merged_no, a.* from a join s on a.snapshot_no = s.base_no), w as (select s.merged_no, a.* from a join s on a.snapshot_no = s.merged_no),
ch as (select distinct coalesce(x.merged_no, y.merged_no) as merged_no, coalesce(x.file_id, y.file_id) as file_id from o x full join w y on x.merged_no=y.merged_no and x.mapc=y.mapc and x.file_id=y.file_id where x.mapc is null or y.mapc is null or coalesce(x.raw_content,'')<>coalesce(y.raw_content,''))
select merged_no, file_id, mapc, md5(coalesce(raw_content,'')) as body_md5, snapshot_no from o anti join ch using (merged_no, file_id)
union all select merged_no, file_id, mapc, md5(coalesce(raw_content,'')), snapshot_no from w semi join ch using (merged_no, file_id)""")
def incremental_merge_all(spark, folder):
    """The merge of every snapshot into the one before it."""
    return _merges(spark, folder, True)


def _merges(spark, folder, every: bool) -> DataFrame:
    rows = latest_rows(articles(spark, folder).select("snapshot_no", "mapc", "file_id", "raw_content", "loaded_at"), ["snapshot_no", "mapc"], "loaded_at").select("file_id", "mapc", F.md5(text("raw_content")).alias("body_md5"), "snapshot_no")
    # A row per snapshot: few.
    steps = articles(spark, folder).select(F.col("snapshot_no").alias("merged_no")).distinct().withColumn("base_no", F.lag("merged_no").over(Window.orderBy("merged_no"))).where("base_no is not null")
    if not every:
        steps = steps.orderBy(F.desc("merged_no")).limit(1)
    both = rows.join(F.broadcast(steps), (F.col("snapshot_no") == F.col("merged_no")) | (F.col("snapshot_no") == F.col("base_no"))).withColumn("is_base", F.col("snapshot_no") == F.col("base_no")).drop("base_no")
    sides = both.groupBy("merged_no", "file_id", "mapc").agg(F.max(F.when(F.col("is_base"), F.col("body_md5"))).alias("a"), F.max(F.when(~F.col("is_base"), F.col("body_md5"))).alias("b"))
    key = ["merged_no", "file_id"]
    changed = sides.where(~F.col("a").eqNullSafe(F.col("b"))).select(*key).distinct()
    return replaced(both.where("is_base"), both.where("not is_base").join(changed, key, "left_semi"), changed, key).drop("is_base")


@query("""
with c as (select coalesce(file_id,'')||'|'||coalesce(law_id,'')||'|'||coalesce(nullif(trim(coalesce(article_code,'')),''),coalesce(article,''))||'|'||coalesce(article_name,'') as k, snapshot_no, trim(coalesce(raw_content,'')) as content from parsed_article where @trim(coalesce(mapc,''))<>''),
o as (select k, content, min(snapshot_no) as p from c where content<>'' group by 1,2),
g as (select k, count(*)::bigint as chunk_count from c group by 1)
select g.k as group_key, g.chunk_count, md5(coalesce(string_agg(o.content, chr(10)||chr(10) order by o.p, o.content),'')) as content_md5 from g left join o on g.k=o.k group by 1,2""")
def article_groups(spark, folder):
    """Articles grouped over the snapshots: distinct contents in order, all rows counted."""
    rows = articles(spark, folder).select(group_key().alias("k"), F.col("snapshot_no").alias("p"), F.trim(text("raw_content")).alias("c"))
    parts = F.transform(F.array_sort(F.collect_set(F.when(F.col("c") != "", F.struct("p", "c")))), lambda x: x["c"])
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("chunk_count"), F.md5(F.array_join(F.array_distinct(parts), "\n\n")).alias("content_md5")).withColumnRenamed("k", "group_key")


_INDEXED = "list_filter([" + ", ".join(_of(_PART, _of(_COLLAPSE, c)) for c in ("m.title", "m.law_id", "m.article_code", "m.article_name", "content")) + "], lambda x: x <> '')"
_META = ("law_id", "article_code", "article_name", "title", "issuer", "effective_date", "mapc")


@query(f"""
with c as (select coalesce(file_id,'')||'|'||coalesce(law_id,'')||'|'||coalesce(nullif(trim(coalesce(article_code,'')),''),coalesce(article,''))||'|'||coalesce(article_name,'') as k, struct_pack(s := snapshot_no, l := loaded_at, d := md5(coalesce(raw_content,''))) as p,
 struct_pack({", ".join(f"{c} := coalesce({c},'')" for c in _META)}) as m, trim(coalesce(raw_content,'')) as body, related_articles from parsed_article where @trim(coalesce(mapc,''))<>''),
g as (select k, count(*)::bigint as chunk_count, min(struct_pack(p := p, m := m)).m as m from c group by 1),
o as (select k, body, min(struct_pack(p := p, m := m)).p as p from c where body <> '' group by 1, 2), t as (select k, string_agg(body, chr(10)||chr(10) order by p, body) as content from o group by 1),
lb as (select k, p, generate_subscripts(related_articles, 1) as i, unnest(related_articles) as label from c), lf as (select k, label, min(struct_pack(p := p, i := i)) as fst from lb where trim(coalesce(label,'')) <> '' group by 1, 2),
ll as (select k, list(label order by fst, label) as related from lf group by 1),
d as (select g.k, m, chunk_count, coalesce(related, []) as related, coalesce(content, '') as content from g left join t using (k) left join ll using (k)),
r as (select *, {_INDEXED} as parts, trim(m.effective_date) as x, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('article:' || k)) as h from d),
s as (select *, array_to_string(list_filter(parts, lambda v, i: not list_contains(list_transform(parts[1:i-1], lambda y: lower(y)), lower(v))), '. ') as fulltext from r)
select substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || lpad(lower(to_hex(((('0x' || substr(h,17,2))::int) & 63) | 128)), 2, '0') || substr(h,19,2) || '-' || substr(h,21,12) as point_id, {", ".join(f"m.{c} as {c}" for c in _META)},
 coalesce(strftime(coalesce(case when regexp_matches(x,'^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') then try_strptime(x,'%d/%m/%Y') end, case when regexp_matches(x,'^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') then try_strptime(x,'%Y-%m-%d') end), '%Y-%m-%dT00:00:00Z'), '') as effective_date_iso, chunk_count, array_to_string(related, ' | ') as related_articles,
 case when length(content) > 50000 then regexp_replace(substr(content, 1, 50000), '{_WS}+\\z', '') else content end as content, length(content) > 50000 as content_truncated,
 case when length(fulltext) > 12000 then regexp_replace(substr(fulltext, 1, 12000), '{_WS}+\\z', '') else fulltext end as retrieval_text, length(fulltext) > 12000 as retrieval_text_truncated from s""")
def article_index(spark, folder):
    """Index documents of the articles: ids, clipped texts, flags, ISO dates, related labels."""
    rows = articles(spark, folder).withColumn("content", F.col("raw_content")).withColumn("pos", F.struct("snapshot_no", "loaded_at", F.md5(text("raw_content"))))
    return article_documents(rows, "pos", group_key()).withColumn("related_articles", F.array_join("related_articles", " | "))


@query("""
select distinct point_id, length(coalesce(content,''))::bigint as content_length, length(coalesce(content,''))>1000 as content_truncated,
 md5(case when length(coalesce(content,''))>1000 then regexp_replace(substr(content,1,1000), '""" + _WS + """+\\z', '') else coalesce(content,'') end) as payload_md5 from index_document""")  # fmt: skip
def clipped_points(spark, folder):
    """Sections clipped to 1,000 characters, with flags."""
    shown, cut = clipped("content", 1_000)
    return table(spark, folder, "index_document").select("point_id", F.length(text("content")).cast("long").alias("content_length"), cut.alias("content_truncated"), F.md5(shown).alias("payload_md5")).distinct()


@query("""
select distinct snapshot_no, mapc, length(trim(coalesce(raw_content,'')))::bigint as content_length, substr(replace(trim(coalesce(raw_content,'')), chr(10), ' '), 1, 240) as content_preview, coalesce(len(related_articles),0)::bigint as n_related
from parsed_article where @trim(coalesce(mapc,''))<>''""")
def article_preview(spark, folder):
    """Preview rows of the articles."""
    shown = preview(articles(spark, folder), "raw_content", ["snapshot_no", "mapc"], "related_articles")
    return shown.select("snapshot_no", "mapc", F.col("content_length").cast("long").alias("content_length"), "content_preview", F.col("n_related").cast("long").alias("n_related")).distinct()


@query("""
with n as (select distinct 'articles_v' || lpad(snapshot_no::varchar, 3, '0') || '_' || coalesce(de_muc,'') as name from parsed_article),
r as (select name, row_number() over (order by name desc) as place from n where starts_with(name, 'articles_v'))
select name, place <= 2 or name = (select min(name) from n) as keep from r""")
def version_retention(spark, folder):
    """Which versions of the section collections stay: the last two and a protected one."""
    names = table(spark, folder, "parsed_article").select(F.concat(F.lit("articles_v"), F.lpad(F.col("snapshot_no").cast("string"), 3, "0"), F.lit("_"), text("de_muc")).alias("name")).distinct()
    first = names.agg(F.min("name")).first()[0]
    return retained(names, "articles_v", 2, [first] if first else [])


@query("""
with p as (select distinct on (point_id) point_id, snapshot_no, md5(coalesce(content,'')) as body_md5 from index_document where snapshot_no <= 4 order by point_id, indexed_at desc, body_md5 desc),
n as (select distinct on (point_id) point_id, snapshot_no, md5(coalesce(content,'')) as body_md5 from index_document where snapshot_no = 5 order by point_id, indexed_at desc, body_md5 desc)
select * from p where point_id not in (select point_id from n) union all select * from n""")
def upserted_points(spark, folder):
    """Points of earlier snapshots with those of snapshot 5 put in by id."""
    points = table(spark, folder, "index_document").select("point_id", "snapshot_no", F.md5(text("content")).alias("body_md5"), "indexed_at")
    newest = lambda rows: rows.groupBy("point_id").agg(F.max_by(F.struct("snapshot_no", "body_md5"), F.struct("indexed_at", "body_md5")).alias("r")).select("point_id", "r.*")
    return upserted(newest(points.where("snapshot_no <= 4")), newest(points.where("snapshot_no = 5")))


@query("""
with a as (select distinct file_id, article_code, law_id, mapc from parsed_article where snapshot_no=5 and @trim(coalesce(mapc,''))<>'')
select mapc, (row_number() over (order by coalesce(file_id,''), coalesce(article_code,''), coalesce(law_id,''), mapc) - 1)::bigint as position from a""")
def corpus_order(spark, folder):
    """Place of each current article in the corpus's total order."""
    return _ordered(latest_snapshot(articles(spark, folder))).drop("snapshot_no")


@query("""
with a as (select distinct snapshot_no, file_id, article_code, law_id, mapc from parsed_article where @trim(coalesce(mapc,''))<>'')
select snapshot_no, mapc, (row_number() over (partition by snapshot_no order by coalesce(file_id,''), coalesce(article_code,''), coalesce(law_id,''), mapc) - 1)::bigint as position from a""")
def corpus_order_all(spark, folder):
    """Place of each article in the total order of its snapshot."""
    return _ordered(articles(spark, folder))


def _ordered(rows: DataFrame) -> DataFrame:
    placed = total_order(rows.select("snapshot_no", "file_id", "article_code", "law_id", "mapc").distinct(), [F.col("snapshot_no"), text("file_id"), text("article_code"), text("law_id"), F.col("mapc")])
    # Places from the snapshots' sizes: those before it are taken off.
    sizes = rows.select("snapshot_no", "file_id", "article_code", "law_id", "mapc").distinct().groupBy("snapshot_no").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("snapshot_no", F.coalesce(F.sum("n").over(Window.orderBy("snapshot_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before), "snapshot_no").select("snapshot_no", "mapc", (F.col("position") - F.col("before")).cast("long").alias("position"))


@query("""
select file_id, mapc, trim(article_code) || '.' as article_code, coalesce(nullif(trim(coalesce(chapter_code,'')),''),'') as chapter_code
from (select distinct on (mapc) * from parsed_article where snapshot_no=5 and @trim(coalesce(mapc,''))<>'' order by mapc, loaded_at desc)""")
def html_articles_round_trip(spark, folder):
    """Articles rendered as HTML pages of their files by Spark and parsed again: codes and chapters come back."""
    return _round_trip(_current(spark, folder)).drop("snapshot_no")


@query("""
select snapshot_no, file_id, mapc, trim(article_code) || '.' as article_code, coalesce(nullif(trim(coalesce(chapter_code,'')),''),'') as chapter_code
from (select distinct on (snapshot_no, mapc) * from parsed_article where @trim(coalesce(mapc,''))<>'' order by snapshot_no, mapc, loaded_at desc)""")
def html_articles_round_trip_all(spark, folder):
    """The same of every snapshot."""
    return _round_trip(_current(spark, folder, every=True))


def _round_trip(rows: DataFrame) -> DataFrame:
    escape = lambda c: F.replace(F.replace(F.replace(text(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    paragraph = lambda kind, x: F.concat(F.lit(f'<p class="{kind}">'), x, F.lit("</p>\n"))
    links = F.array_join(F.transform(F.coalesce("related_articles", F.array().cast("array<string>")), lambda x: F.concat(F.lit("<a href='#'>"), F.replace(F.coalesce(x, F.lit("")), F.lit("<"), F.lit("&lt;")), F.lit("</a>"))), "; ")
    body = F.regexp_replace(escape("raw_content"), "\r\n?|\n", "</p><p>")
    rendered = F.concat(
        paragraph("pChuong", F.coalesce(present("chapter_code"), F.lit("Chương 0"))), paragraph("pChuong", escape("chapter_title")),
        paragraph("pDieu", F.concat(F.lit('<a name="'), F.col("mapc"), F.lit('"></a>'), F.trim("article_code"), F.lit(". "), escape("article_name"))),
        paragraph("pGhiChu", escape("source_note")), paragraph("pNoiDung", F.concat(F.lit("<p>"), body, F.lit("</p>"))), paragraph("pChiDan", links),
    )
    # A page per file and the first 13 digits of mapc, each article below its own chapter: the carry-forward of chapters over a whole file's page is not run.
    pages = rows.withColumn("h", rendered).groupBy("snapshot_no", "file_id", F.substring("mapc", 1, 13).alias("part")).agg(F.concat(F.lit('<html><body><h3>x</h3><div class="_content">'), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mapc", "h"))), lambda x: x["h"]), ""), F.lit("</div></body></html>")).alias("html"))
    keyed = pages.withColumn("page", F.concat_ws("|", F.col("snapshot_no").cast("string"), "part", "file_id"))
    found = html_articles(html_nodes(keyed, "page", "html"), "page")
    return found.select(F.substring_index("page", "|", 1).cast("int").alias("snapshot_no"), F.regexp_extract("page", r"(?s)^[^|]*\|[^|]*\|(.*)", 1).alias("file_id"), "mapc", "article_code", F.when(F.col("chapter_code") == "Chương 0", "").otherwise(F.col("chapter_code")).alias("chapter_code"))

