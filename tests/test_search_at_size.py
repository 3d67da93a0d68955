"""Searches make no row per pair of query and row, and find what brute force finds whatever the slices, blocks and tasks are."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexmill.operators import search
from lexmill.plans import catalogue


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def words(value: str) -> list[str]:
    return re.findall(r"[0-9A-Za-zÀ-ỹ]+", (value or "").lower())


def brute(docs, question, kind, k):
    toks, times = {d: Counter(words(t)) for d, t, _ in docs}, Counter(words(question))
    average, df, out = sum(sum(c.values()) for c in toks.values()) / len(toks), Counter(t for c in toks.values() for t in c), []
    for d, _, of in docs:
        n = sum(toks[d].values())
        score = sum(m * math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * toks[d][t] * 2.5 / (toks[d][t] + 1.5 * (0.25 + 0.75 * n / average)) for t, m in sorted(times.items()) if toks[d][t])
        if round(score, 6) > 0 and kind in ("", (of or "").strip().lower()):
            out.append((-round(score, 6), d))
    return [(d, -s) for s, d in sorted(out)[:k]]


def corpus(n: int):
    rng = random.Random(7)
    lexicon = [f"từ{i}" for i in range(40)]
    text = lambda most: " ".join(rng.choices(lexicon, [1 / (i + 1) for i in range(40)], k=rng.randint(0, most)))
    docs = [(f"d{i:04}", text(12) if i % 9 else "từ1 từ2 TỪ1", rng.choice(["A", " b ", "", None])) for i in range(n)]
    asked = [(i, text(5) if i % 4 else "từ2 từ1", rng.choice(["", "a", "B"])) for i in range(30)]
    return docs, [*asked, (30, "", ""), (31, None, "a"), (32, "nowhere", "")]


@pytest.mark.parametrize("block", [4, 1_000])
def test_lexical_search_over_slices_blocks_and_tasks(spark, monkeypatch, block):
    monkeypatch.setattr(search, "QUESTIONS", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    docs, asked = corpus(600)
    d, q = spark.createDataFrame(docs, "doc_id string, content string, kind string"), spark.createDataFrame(asked, "query_id int, question string, kind string")
    try:
        for filters in (None, {"kind": "kind"}):
            found = defaultdict(list)
            for r in search.bm25_topk(d.repartition(5), q, 6, filters=filters).orderBy("query_id", "rank").collect():
                found[r.query_id].append((r.doc_id, r.score))
            want = {i: brute(docs, text, kind.lower() if filters else "", 6) for i, text, kind in asked}
            assert dict(found) == {i: x for i, x in want.items() if x}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lexical_search_makes_no_row_per_pair(spark):
    docs, asked = corpus(50)
    d, q = spark.createDataFrame(docs, "doc_id string, content string, kind string"), spark.createDataFrame(asked, "query_id int, question string, kind string")
    assert "Join" not in plan(search.bm25_topk(d, q, 3))


@pytest.mark.parametrize("name", ["bm25_sections", "bm25_filtered", "context_blocks_all", "evidence", "filter_hit_rate", "section_evidence", "evidence_all", "ground_truth_matches", "hybrid_search", "context_blocks", "hybrid_search_all", "strong_exact_hits"])
def test_queries_join_no_terms(spark, name):
    joins = [x for x in plan(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")).splitlines() if "Join" in x]
    assert not [x for x in joins if "term#" in x]


def test_grid_compares_each_hit_once(spark):
    from lexmill.functions import session

    session.release()
    catalogue.QUERIES["scenario_grid"](spark, "/root/testdata/sf0.001")
    told = [x for x in session._kept if "matched" in x.columns]
    assert len(told) == 1 and told[0].columns == ["chat_id", "filtered", "rank", "matched"]


def test_fallback_reads_the_corpus_once(spark):
    from lexmill.functions import session

    session.release()
    catalogue.QUERIES["filter_fallback"](spark, "/root/testdata/sf0.001")
    assert len([x for x in session._kept if "terms" in x.columns]) == 1


def test_forms_of_a_reference_are_made_once_per_case(spark):
    from lexmill.operators.evaluation import truth_matches

    hits = spark.createDataFrame([(1, 1, "một hai ba bốn")], "q int, rank int, content string")
    cases = spark.createDataFrame([(1, ["Một, hai ba bốn", "x"])], "q int, contexts array<string>")
    found = truth_matches(hits, cases, "q", ["content"])
    assert found.first().by == ["context"]
    above = plan(found).split("Join")[0]
    assert "lower" not in above.split("AS by")[0].rpartition("exists(")[2]


def test_vectors_are_normalized_once_per_row(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [4.0, -3.0]), (4, [6.0, 8.0])], "vec_id long, embedding array<float>")
    found = search.vector_topk(rows, rows.where("vec_id in (1, 4)").withColumnRenamed("vec_id", "query_id"), 3)
    assert [tuple(r) for r in found.select("query_id", "vec_id", "score").orderBy("query_id", "rank").collect()] == [(q, v, s) for q in (1, 4) for v, s in ((1, 1.0), (4, 1.0), (2, 0.0))]
    assert "transform(" not in plan(found) and "aggregate(" not in plan(found)


def test_bytes_are_split_as_the_engine_splits(spark):
    import pyarrow as pa

    from lexmill.functions.text import split_tokens, tokens

    rng = random.Random(3)
    odd = ["Σ", "σ", "Α", "a", "İ", "ỹ", "Ỻ", "’", ".", "-", "́", "Đ", "1", "𐐀", "\n", "ẞ", "K", "Ⱥ", "²", "῿", "中", "Ɤ", "Ƛ", "é"]
    texts = ["", *("".join(rng.choices(odd, k=rng.randint(0, 12))) for _ in range(2_000)), "", *(f"a{chr(c)}b {chr(c)}" for c in range(1, 0x2100)), "x", ""]
    want = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", tokens("s").alias("t")).orderBy("i").collect()]
    said, lengths = split_tokens(pa.array(["of no text", *texts], pa.string()).slice(1))
    ends = [0, *lengths.cumsum().tolist()]
    assert len(said) == ends[-1]
    said = said.to_pylist()
    assert [said[a:b] for a, b in zip(ends, ends[1:])] == want
    assert not len(split_tokens(pa.array([], pa.string()))[1]) and split_tokens(pa.array(["", "-"]))[1].tolist() == [0, 0]


@pytest.mark.parametrize("hot, most, size", [(-1.0, 1_000, 40_000), (2.0, 1_000, 40_000), (0.004, 3, 7), (0.02, 1_000, 200)])
def test_frequent_and_rare_terms_add_up_to_one_score(spark, monkeypatch, hot, most, size):
    for name, value in (("HOT", hot), ("MOST_HOT", most), ("SLICE", size), ("PRODUCT", 5), ("SOME", 3)):
        monkeypatch.setattr(search, name, value)
    docs, asked = corpus(900)
    d, q = spark.createDataFrame(docs, "doc_id string, content string, kind string"), spark.createDataFrame(asked, "query_id int, question string, kind string")
    found = defaultdict(list)
    for r in search.bm25_topk(d.repartition(3), q, 6, filters={"kind": "kind"}).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.doc_id, r.score))
    want = {i: brute(docs, text, kind.lower(), 6) for i, text, kind in asked}
    assert dict(found) == {i: x for i, x in want.items() if x}


@pytest.mark.parametrize("name", ["bm25_filtered", "context_blocks_all", "evidence", "filter_hit_rate", "section_evidence", "evidence_all", "ground_truth_matches", "hybrid_search", "context_blocks", "hybrid_search_all", "strong_exact_hits"])
def test_corpus_is_split_and_counted_outside_the_plan(spark, name):
    from lexmill.functions import session

    session.release()
    catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    counts = [x for x in session._kept if "terms" in x.columns]
    assert len(counts) == 1 and "regexp_extract_all" not in plan(counts[0]) and dict(counts[0].dtypes)["terms"] == "binary"


def test_a_product_has_like_questions():
    rng = np.random.default_rng(5)
    # Questions of two patterns in turns, each with a word of its own.
    asked = [np.array([[*range(50 * (i % 2), 50 * (i % 2) + 12), int(rng.integers(100, 200))], [1] * 13]) for i in range(search.PRODUCT * 2)]
    share = np.bincount(np.concatenate([t for t, _ in asked]))
    products = list(search._alike(asked, share))
    assert sorted(np.concatenate(products).tolist()) == list(range(len(asked))) and all(len(x) <= search.PRODUCT for x in products)
    assert [len({int(q) % 2 for q in x}) for x in products] == [1, 1]


def test_only_odd_letters_are_lowered_in_python():
    import pyarrow as pa

    from lexmill.functions.text import _lower

    texts = ["ĐIỀU 1", "ΟΔΟΣ Σ", "", "İ", *(chr(c) for c in range(1, 0x3000))]
    assert _lower(pa.array(["of no text", *texts]).slice(1)).to_pylist() == [x.replace("Ᲊ", "ᲊ").lower() for x in texts]


def test_forms_are_made_once_per_section(spark):
    from lexmill.operators.evaluation import truth_matches, with_forms

    hits = spark.createDataFrame([(q, r, "s1") for q in (1, 2) for r in (1, 2)], "q int, rank int, p string")
    formed = with_forms(spark.createDataFrame([("s1", "một hai ba bốn", None)], "p string, content string, title string"), ["content", "title"])
    cases = spark.createDataFrame([(1, ["Một, hai ba bốn"]), (2, ["khác"])], "q int, contexts array<string>")
    found = truth_matches(hits.join(formed.select("p", "_t", "_tw"), "p"), cases, "q", ["content", "title"])
    assert found.columns == ["p", "q", "rank", "by", "matched"] and {(r.q, *r.by) for r in found.collect()} == {(1, "context"), (2,)}


@pytest.mark.parametrize("name", ["hybrid_search", "context_blocks_all", "evidence", "filter_hit_rate", "section_evidence", "evidence_all", "ground_truth_matches", "context_blocks", "hybrid_search_all", "strong_exact_hits"])
def test_questions_are_read_once_and_scored_with_their_like(spark, monkeypatch, name):
    from lexmill.functions import session

    of, scored = search._alike, []
    monkeypatch.setattr(search, "_alike", lambda asked, share: scored.append(len(asked)) or of(asked, share))
    session.release()
    catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(scored) == 1 and scored[0] > 0
    assert len([x for x in session._kept if "question" in x.columns]) == 1


@pytest.mark.parametrize("exact", [1, 7, 10_000])
def test_a_product_is_looked_through_at_once(spark, monkeypatch, exact):
    monkeypatch.setattr(search, "EXACT", exact)
    # Many equal documents: all of them can be among the best, and the smaller ids are.
    docs = [(f"d{i:04}", "từ1 từ2" if i % 3 else f"từ1 số{i % 5}") for i in range(700)]
    d, q = spark.createDataFrame(docs, "doc_id string, content string"), spark.createDataFrame([(1, "từ1 từ2"), (2, "số3 số3"), (3, "từ2")], "query_id int, question string")
    found = defaultdict(list)
    for r in search.bm25_topk(d, q, 4).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.doc_id, r.score))
    assert dict(found) == {i: brute([(d, t, "") for d, t in docs], x, "", 4) for i, x in ((1, "từ1 từ2"), (2, "số3 số3"), (3, "từ2"))}


def test_rows_of_several_queries_are_told_at_once():
    rng = np.random.default_rng(4)
    best, one, asked, margins = search._Best(9, 3, 0.0), search._Best(9, 3, 0.0), np.array([4, 1, 7]), np.array([0.0, 0.5, 0.1])
    for size in (40, 320):
        scores = rng.integers(-2, 30, (3, size)).astype(np.float32)
        of, rows = best.possible_all(asked, scores, scores.reshape(3, search.SOME, -1).max(axis=1) if size > 40 else scores, margins)
        assert [rows[of == i].tolist() == sorted(rows[of == i].tolist()) for i in range(3)] == [True] * 3
        for x in (best, one):
            x.slice(["d"] * size)
        best.add_all(asked, of, rows, scores[of, rows].astype(float))
        for i, q in enumerate(asked):
            one.add(q, np.arange(size), scores[i].astype(float))
    assert (best.scores == one.scores).all() and (best.rows == one.rows).all()


@pytest.mark.parametrize("name", ["filter_hit_rate", "section_evidence", "strong_exact_hits"])
def test_the_index_is_read_once(spark, name):
    # Keys of the sections found come from their counts; the cache of the counts has the only scan of the index, and its texts.
    found = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert not re.search(r"(?<!Memory)Relation \[.*indexed_at", plan(found)) and "InMemoryRelation" in plan(found)


@pytest.mark.parametrize("name", ["hybrid_search", "context_blocks_all", "evidence", "evidence_all", "context_blocks", "hybrid_search_all"])
def test_hits_are_not_multiplied_by_the_merge(spark, name):
    assert "Expand" not in plan(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_no_text_is_looked_through_for_odd_letters_that_none_has(monkeypatch):
    import pyarrow as pa

    from lexmill.functions import text

    monkeypatch.setattr(text.pc, "match_substring", None)
    said, lengths = text.split_tokens(pa.array(["", "Một hai-BA", "ba", "", "- é-"]))
    assert said.to_pylist() == ["một", "hai", "ba", "ba", "é"] and lengths.tolist() == [0, 3, 1, 0, 1]
