"""Settings, records, conversations, HTML folders and exports."""

import json

from lexmill import config
from lexmill.operators.corpus import corpus_stats
from lexmill.sources.html import html_files
from lexmill.sources.index_store import export_corpus
from lexmill.sources.records import chunk_records, conversations, saved


def test_settings():
    got = config.read("top_k: ${TOP:5}\nbm25_b: 0\nother: 1\nvector_weight: ${W}\n", {"TOP": "7"})
    assert (got.top_k, got.bm25_b, got.vector_weight, got.bm25_top_k) == (7, 0.0, 0.6, 12)
    assert config.read("") == config.Retrieval()


def test_records_and_export(spark, tmp_path):
    rows = [{"content": " x ", "metadata": {"mapc": "m1", "law_id": None, "related_articles": ["a", " "]}}, {"content": "y"}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n[broken\n")
    (tmp_path / "a.json").write_text(json.dumps(rows))
    for name in ("a.jsonl", "a.json"):
        found = {r.content: r for r in chunk_records(spark, str(tmp_path / name)).collect()}
        assert set(found) == {"x", "y"} and found["x"].related_articles == ["a"] and found["x"].law_id == "" and found["y"].mapc == ""
    chunks = chunk_records(spark, str(tmp_path / "a.json"))
    export_corpus(chunks, chunks.select("mapc"), corpus_stats(chunks, "content", ["mapc"]), str(tmp_path / "out"), ["mapc"])
    assert spark.read.csv(str(tmp_path / "out/preview.csv"), header=True).columns == ["mapc", "content_length", "content_preview", "n_related"]
    assert spark.read.json(str(tmp_path / "out/stats.jsonl")).first().n_rows == 2


def test_conversations(spark, tmp_path):
    for name, thread, at in (("s1", "t1", "2024-01-01"), ("s1", "t2", "2024-01-03"), ("s2", "t3", "2024-01-02")):
        folder = tmp_path / name
        folder.mkdir(exist_ok=True)
        (folder / f"{thread}.json").write_text(json.dumps({"session_id": name, "thread_id": thread, "updated_at": at, "state": {"status": "ok"}}))
    (tmp_path / "s2" / "bad.json").write_text("{")
    assert [r.thread_id for r in conversations(spark, str(tmp_path), 2).collect()] == ["t2", "t3"]
    states = spark.createDataFrame([("s", "t", "1", "a"), ("s", "u", "1", "b")], "session_id string, thread_id string, updated_at string, status string")
    newer = spark.createDataFrame([("s", "t", "2", "c")], states.schema)
    assert {(r.thread_id, r.status) for r in saved(states, newer).collect()} == {("t", "c"), ("u", "b")}


def test_html_folder(spark, tmp_path):
    (tmp_path / "demuc" / "lib").mkdir(parents=True)
    for name in ("demuc/a.html", "demuc/lib/x.html", "demuc/b.htm", "BoPhapDien.html"):
        (tmp_path / name).write_text("<p>đò</p>")
    found = html_files(spark, str(tmp_path)).collect()
    assert [(r.file_id, r.html, r.file_size) for r in found] == [("a", "<p>đò</p>", 11)]
