"""Sources, sinks, streaming, settings, the ingest plan, and the driver's entry."""

import datetime

import pytest

import __spark_entry__
from vellum.__main__ import main
from vellum.config import Settings
from vellum.plans.answering import model_answers, prompts
from vellum.plans.ingest import clean_documents, ingest
from vellum.sources.catalog import catalog, first_folders, pick_subject, scan_catalog
from vellum.sources.documents import TextPages, read_documents
from vellum.sources.stages import append_feedback, read_stage, write_stage
from vellum.streaming.feedback import feedback_stream, index_stream, windowed_outcomes


def test_settings():
    s = Settings.from_env({"CHUNK_SIZE": "100", "USE_LLM": "true", "NPROBE": "8"})
    assert (s.chunk_size, s.use_llm, s.nprobe, s.chunk_overlap) == (100, True, 8, 50)
    assert Settings(languages="a, b").language_list == ["a", "b"]


def test_read_documents(spark, tmp_path):
    (tmp_path / "jesc105.pdf").write_text("First page\n12\fSecond page\n13")
    (tmp_path / "bad.pdf").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "other.txt").write_text("no")
    rows = {r["filename"]: r for r in read_documents(spark, str(tmp_path), TextPages()).collect()}
    good = rows["jesc105"]
    assert (good["chapter"], good["total_pages"], good["full_text"]) == ("5", 2, "First page\n12\n\nSecond page\n13")
    assert [p["pdf_page_number"] for p in good["pages"]] == ["12", "13"] and good["error"] is None
    assert rows["bad"]["error"] and rows["bad"]["total_pages"] == 0 and len(rows) == 2


def test_what_is_no_text_is_refused():
    for content in (b"%PDF-1.7 ...", b"a\0b"):
        with pytest.raises(ValueError, match="reader"):
            TextPages().pages(content)


def test_first_folders_and_picked_subject(spark):
    names = ("r/CLASS-IX/Science-English/a.pdf", "r/class-ix/Science-Hindi/b.pdf", "r/class-x/Science-Hindi/c.pdf", "r/class-x/Science-English/d.txt", "r/other/Science-English/e.pdf")
    found = catalog(first_folders(spark.createDataFrame([(p,) for p in names], "path string")))
    assert {(r["class"], r["language"], r["pdf_count"]) for r in found.collect()} == {(9, "English", 1), (10, "Hindi", 1)}
    assert pick_subject(found, 9, "science", "EN").count() == 1 and pick_subject(found, 10, "Science", "en").count() == 0


def test_catalog(spark, tmp_path):
    paths = ["CLASS-X/Science-English/a.pdf", "CLASS-X/Science-English/b.pdf", "CLASS-VI/Maths-Hindi/c.pdf", "CLASS V/Art-Urdu/d.pdf", "CLASS-X/nohyphen/e.pdf", "CLASS-IX/Art-Urdu/f.txt"]
    got = {(r["class"], r["subject"], r["lang_code"]): r["pdf_count"] for r in catalog(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {(10, "Science", "en"): 2, (5, "Maths", "hi"): 1}
    for p in paths:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    assert scan_catalog(spark, str(tmp_path)).count() == 2


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_stages(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    write_stage(df, str(tmp_path / fmt), fmt)
    assert read_stage(spark, str(tmp_path / fmt), fmt, "k int, v string").count() == 2
    with pytest.raises(ValueError):
        write_stage(df, str(tmp_path / "x"), "xml")


def feedback(spark, day=1, score=0.0):
    row = (datetime.datetime(2024, 1, day), "q", None, True, None, ("5", "s", "en", "success", "", score, "t"))
    return spark.createDataFrame([row], "asked_at timestamp, question string, answer string, helpful boolean, remark string, metadata struct<class: string, subject: string, lang: string, status: string, rejection_type: string, grounding_score: double, sent_at: string>")


def test_feedback_log_and_stream(spark, tmp_path):
    log = str(tmp_path / "log")
    assert append_feedback(feedback(spark), log) and append_feedback(feedback(spark, 2, 0.5), log)
    rows = sorted(spark.read.json(log).collect(), key=lambda r: r["asked_at"])
    assert rows[0]["answer"] == "REJECTED" and rows[0]["remark"] == ""
    q = windowed_outcomes(feedback_stream(spark, log)).writeStream.format("memory").queryName("outcomes").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) n from outcomes").first()["n"] == 2 == windowed_outcomes(spark.read.schema(feedback(spark).schema).json(log)).count()
    assert not append_feedback(feedback(spark), "/proc/none/log")


def test_index_stream(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    df = spark.createDataFrame([(1, "5", "Science", "en")], "chunk_id long, class string, subject string, lang string")
    df.write.parquet(src)
    for _ in range(2):
        index_stream(spark.readStream.schema(df.schema).parquet(src), out, str(tmp_path / "cp")).awaitTermination()
        df.write.mode("append").parquet(src)
    assert spark.read.parquet(out).count() == 2


def test_ingest(spark):
    pages = [(1, "12", "x", 1, None), (2, "Unknown", "y", 1, None)]
    rows = [(1, "note: " + "a word. " * 30, "jesc101.pdf", None, pages, "en"), (2, "नदी १० " * 400, "jhsc1.pdf", "4", pages, "hi"), (3, None, None, None, None, None), (4, "", "f", "", [], "en")]
    scans = spark.createDataFrame(rows, "doc_id long, full_text string, filename string, chapter string, pages array<struct<page_number: int, pdf_page_number: string, text: string, char_count: int, error: string>>, lang string")
    cleaned = {r["doc_id"]: r for r in clean_documents(scans).collect()}
    assert cleaned[1]["metadata"]["chapter"] == "101" and cleaned[2]["metadata"]["chapter"] == "4" and cleaned[2]["structures"] is None and cleaned[3]["cleaned_text"] == ""
    chunks = ingest(scans, Settings(embedding_dimension=16)).collect()
    assert {r["doc_id"] for r in chunks} == {1, 2} and all(len(r["embedding"]) == 16 for r in chunks)
    a = next(r for r in chunks if r["doc_id"] == 1)
    assert a["structure_type"] == "note" or a["structure_type"] is None
    assert a["keywords"] is None and a["page_numbers"] == [1, 2] and a["primary_page"] == 1
    b = next(r for r in chunks if r["doc_id"] == 2)
    assert b["content_type"] == "explanation" and b["subject"] == "Science"


def test_entry_names():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 40


def test_model_answers(spark):
    class Echo:
        def complete(self, system, user, temperature, max_tokens):
            return [ValueError("no") if "fail" in u else "Told [Source 1]." for u in user]

    class Down:
        def complete(self, system, user, temperature, max_tokens):
            raise OSError("unreachable")

    answered = spark.createDataFrame([(1, "success", "x", 0.9, "retrieval_only"), (2, "success", "y", 0.9, "retrieval_only"), (3, "rejected", None, None, None)], "q_id long, status string, answer string, grounding_score double, mode string")
    hits = spark.createDataFrame([(q, r, "3", "7", f"Sentence {r} of a text that is long enough.") for q in (1, 2, 3) for r in (2, 1)], "q_id long, rank int, chapter string, page string, text string")
    questions = spark.createDataFrame([(1, "what?", "en"), (2, "fail?", "hi"), (3, "z", "en")], "q_id long, question string, lang string")
    asked = prompts(questions, hits)
    first = asked.where("q_id = 1").first()
    assert first["user"].index("[Source 1] Chapter: 3, Page: 7\nSentence 1") < first["user"].index("[Source 2]") and "what?" in first["user"]
    out = {r["q_id"]: r for r in model_answers(answered, asked, Echo(), Settings(use_llm=True)).collect()}
    assert out[1]["mode"] == "llm" and out[1]["answer"].startswith("Told [Source 1].\n\n====") and "[1] Sentence 1" in out[1]["answer"]
    assert (out[2]["mode"], out[2]["answer"]) == ("extractive_fallback", "y") and out[3]["mode"] is None
    assert {r["mode"] for r in model_answers(answered, asked, Down(), Settings(use_llm=True)).collect()} == {"extractive_fallback", None}
    assert model_answers(answered, asked, Echo(), Settings()) is answered


def test_command_line(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "jesc101.pdf").write_text("Chapter 1 A lesson that is long enough to be kept as a chunk of text.")
    assert main(["ingest", str(docs), str(tmp_path / "ix"), "--subject", "Science"]) == 0
    row = spark.read.parquet(str(tmp_path / "ix")).first()
    assert row["subject_slug"] == "science" and row["embedding_dim"] == 384
    assert main(["catalog", str(tmp_path)]) == 0
