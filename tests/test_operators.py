"""Chunking, search, gates, answers, evaluation."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.config import Settings
from vellum.functions import answer as A
from vellum.operators import chunk as C
from vellum.operators import evaluate as V
from vellum.operators import gates as G
from vellum.operators import index as I
from vellum.operators import search
from vellum.operators.search import build_ivf, ivf_lists, knn, knn_ivf, probes_for
from vellum.plans.answering import answer_questions


def spans(spark, texts, size=500, overlap=50):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    return [[tuple(s) for s in r["s"] or ()] for r in df.select("i", C.token_spans(F.col("t"), size, overlap).alias("s")).orderBy("i").collect()]


def plain_spans(text, size, overlap):
    out, s, size, overlap = [], 0, size * 4, overlap * 4
    while s < len(text):
        e = s + size
        if e < len(text):
            at = max(text.rfind(p, max(e - overlap, s), e) for p in (". ", ".\n", "?\n", "!\n"))
            if at >= 0:
                e = at + 1
        out.append((s, e))
        s = e - overlap if e < len(text) else len(text)
    return out


def test_token_spans_golden(spark):
    at = lambda n, i: "x" * i + ". " + "x" * (n - i - 2)
    got = spans(spark, ["x" * 2000, "x" * 2001, at(3000, 1900), at(3000, 1799), at(3000, 1999), "", None])
    assert got == [[(0, 2000)], [(0, 2000), (1800, 3800)], [(0, 1901), (1701, 3701)], [(0, 2000), (1800, 3800)], [(0, 2000), (1800, 3800)], [], []]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab.?! \n😀", max_size=200), min_size=1, max_size=10))
def test_token_spans_equal_plain_loop(spark, texts):
    assert spans(spark, texts, 5, 2) == [plain_spans(t, 5, 2) for t in texts]


def test_chunk_documents(spark):
    seg = lambda c: c * 60
    text = seg("a") + "definition:" + seg("b") + "note:" + seg("c")
    s = [{"start_pos": 60, "kind": "definition"}, {"start_pos": 131, "kind": "note"}]
    rows = [(1, text, s), (2, "y" * 2500, []), (3, "z" * 10, None), (4, None, None), (5, "", [])]
    df = spark.createDataFrame(rows, "doc_id long, cleaned_text string, structures array<struct<start_pos: int, kind: string>>")
    out = {(r["doc_id"], r["chunk_index"]): r for r in C.chunk_documents(df).collect()}
    assert [out[1, i]["structure_type"] for i in range(3)] == ["definition", "note", None]
    assert [out[2, i]["start_pos"] for i in range(2)] == [0, 1800] and out[2, 0]["total_chunks"] == 2 and out[2, 0]["token_count"] == 500
    assert out[3, 0]["text"] == "z" * 10 and not {k for k in out if k[0] in (4, 5)}
    aligned = C.by_structure(df, "doc_id", "cleaned_text", aligned_types=True).orderBy("chunk_index").collect()
    assert [r["structure_type"] for r in aligned] == [None, "definition", "note"]
    with pytest.raises(ValueError):
        C.token_spans(F.col("t"), 100, 50)


def vectors(spark, n=300, dim=8, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    rows = [(i, x[i].tolist(), i % 3) for i in range(n)] + [(1000, None, 0), (1001, [1.0] * 3, 0), (1002, x[0].tolist(), 0)]
    return x, spark.createDataFrame(rows, "chunk_id long, embedding array<double>, label int")


def test_knn_equals_brute_force(spark):
    x, df = vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    q = df.where("chunk_id % 20 = 0 and chunk_id < 300").withColumnRenamed("chunk_id", "q_id")
    got = knn(df, q, k=5, exclude_self=True).collect()
    for a in range(0, 300, 20):
        d = ((u - u[a]) ** 2).sum(axis=1)
        mine = [r for r in sorted(got, key=lambda r: r["rank"]) if r["q_id"] == a]
        ids = [1002] if a == 0 else []
        ids += [int(i) for i in np.argsort(d) if i != a]
        assert len(mine) == 5
        if a:
            assert np.allclose([r["distance"] for r in mine], np.sort(np.r_[np.delete(d, a), d[0]])[:5], atol=1e-5)
        assert all(abs(r["score"] - 1 / (1 + r["distance"])) < 1e-9 for r in mine)
    own = knn(df, q, k=5, partition=("label",)).join(df.select("chunk_id", "label"), "chunk_id").join(q.select("q_id", F.col("label").alias("ql")), "q_id")
    assert own.where("label <> ql").count() == 0
    assert knn(df.limit(0), q).count() == 0 and knn(df, q.limit(0)).count() == 0


def test_ivf(spark, monkeypatch):
    _, df = vectors(spark)
    df = df.where("chunk_id < 300")
    q = df.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "q_id")
    exact = {(r["q_id"], r["chunk_id"], r["rank"]) for r in knn(df, q, k=5).collect()}
    indexed, centroids = build_ivf(df, nlist=10)
    full = {(r["q_id"], r["chunk_id"], r["rank"]) for r in knn_ivf(indexed, centroids, q, k=5, nprobe=len(centroids)).collect()}
    some = {(r["q_id"], r["chunk_id"]) for r in knn_ivf(indexed, centroids, q, k=5, nprobe=6).collect()}
    assert full == exact and len(some & {e[:2] for e in exact}) >= 0.8 * len(exact)
    enough = probes_for(df, centroids, k=5)
    told = {(r["q_id"], r["chunk_id"]) for r in knn_ivf(indexed, centroids, q, k=5, nprobe=enough).collect()}
    assert 1 <= enough <= len(centroids) and len(told & {e[:2] for e in exact}) >= 0.9 * len(exact)
    assert probes_for(df.limit(0), centroids) == len(centroids)
    assert ivf_lists(623) == (62, 32) and ivf_lists(100) == (1, 1) and ivf_lists(5000) == (100, 32)
    with pytest.raises(ValueError):
        ivf_lists(0)
    monkeypatch.setattr(search, "LIST_ROWS", 7)  # lists of several blocks
    monkeypatch.setattr(search, "LIST_QUERIES", 4)
    cut = {(r["q_id"], r["chunk_id"], r["rank"]) for r in knn_ivf(indexed, centroids, q, k=5, nprobe=len(centroids)).collect()}
    assert cut == exact


def summary(spark, **kw):
    base = {"q_id": 1, "hits": 5, "top_score": 0.9, "avg_top5": 0.9, "max_score": 0.9, "avg_score": 0.9, "context_chars": 500, "mismatches": 0} | kw
    return spark.createDataFrame([tuple(base.values())], "q_id long, hits long, top_score double, avg_top5 double, max_score double, avg_score double, context_chars long, mismatches long")


@pytest.mark.parametrize(
    ("change", "kind", "stage"),
    [({}, None, None), ({"top_score": 0.45}, None, None), ({"top_score": 0.4499}, "low_confidence", "relevance"), ({"mismatches": 1}, None, None), ({"mismatches": 2}, "off_topic", "subject"),
     ({"avg_top5": 0.37}, "low_confidence", "confidence"), ({"context_chars": 99}, "insufficient_context", "context"), ({"context_chars": 100}, None, None),
     ({"hits": 0, "top_score": None, "avg_top5": None, "max_score": None, "context_chars": None}, "low_confidence", "confidence"), ({"max_score": 0.29}, "off_topic", "topic")],
)
def test_gates(spark, change, kind, stage):
    r = G.apply_gates(summary(spark, **change)).first()
    assert (r["rejection_type"], r["stage"], r["passed"]) == (kind, stage, kind is None)


def one(spark, column):
    return spark.range(1).select(column.alias("o")).first()["o"]


def test_answers(spark):
    s = "This is a sentence of some length. Another one that is long enough! Short. A third sentence, also long?"
    assert one(spark, A.extractive_answer(F.lit(s), F.lit("en"))).split("\n") == [
        "This is a sentence of some length. [Source 1]", "Another one that is long enough. [Source 1]", "A third sentence, also long. [Source 1]"
    ]
    assert one(spark, A.extractive_answer(F.lit("tiny"), F.lit("hi"))) == "tiny [Source 1]"
    assert one(spark, A.extractive_answer(F.lit(None).cast("string"), F.lit("en"))) == A.UNKNOWN_ANSWER
    assert one(spark, A.grounding_score(F.lit("x"), F.lit(1))) == 0.3 and one(spark, A.grounding_score(F.lit("x [Source 1]"), F.lit(1))) == 0.9
    assert one(spark, A.grounding_score(F.lit("x [Source 1]"), F.lit(2))) == 0.7 and one(spark, A.grounding_score(F.lit("x"), F.lit(0))) == 0.0
    pages = lambda *p: F.array(*[F.lit(x) for x in p]).cast("array<int>")
    none = F.lit(None).cast("int")
    assert [one(spark, A.page_range(p, none)) for p in (pages(1, 5, 16), pages(3), pages())] == ["1-16", "3", "Unknown"]
    ch = lambda c, f: one(spark, A.citation_chapter(F.lit(c).cast("string"), F.lit(f)))
    assert [ch(None, "jesc100"), ch("Chapter 2", ""), ch("5", ""), ch(None, "jesc112"), ch("Unknown", "x")] == ["Introduction", "Chapter 2", "Chapter 5", "Chapter 12", "Chapter Unknown"]
    assert one(spark, G.citation_gate(F.lit("A long sentence here. Another long sentence. And a third long one [Source 1]"), F.lit(1))) == "missing_citations"
    assert one(spark, G.grounding_gate(F.lit(0.65), Settings())) is None
    assert one(spark, A.grounding_label(F.lit(0.7))) == "Verified"


def test_validation(spark):
    rows = [("", "5", "x", "en"), ("short", "5", "x", "en"), ("long enough?", "4", "x", "en"), ("long enough?", "5", "", "en"), ("long enough?", "5", "x", "ur"), ("long enough?", "10", "x", "hi"), ("y" * 501, "5", "x", "en")]
    df = spark.createDataFrame(rows, "q string, c string, s string, l string").coalesce(1)
    got = [r["e"] for r in df.select(G.valid_question(F.col("q"), F.col("c"), F.col("s"), F.col("l")).alias("e")).collect()]
    assert got == ["question_missing", "question_short", "class_unknown", "subject_missing", "language_unknown", None, "question_long"]


def test_evaluation(spark):
    df = spark.createDataFrame([("success", 5, True), ("success", 10, None), ("rejected", 5, False), ("error", None, True)], "status string, class int, ok boolean")
    assert {r["status"]: r["percent"] for r in V.status_counts(df).collect()} == {"success": 50.0, "rejected": 25.0, "error": 25.0}
    assert {r["class"]: r["success_percent"] for r in V.class_pivot(df, "class").collect()} == {5: 50.0, 10: 100.0}
    assert tuple(V.passed_of(df, "ok").first()) == (2, 3)
    c = spark.createDataFrame([(1, i, "5", "s", "c", p) for i, p in enumerate("aab")], "q long, n long, class string, subject string, chapter string, page string")
    assert [(r["n"], r["number"]) for r in V.unique_citations(c, "q", "n").orderBy("n").collect()] == [(0, 1), (2, 2)]


def test_nearest_carries_the_best_over_batches_with_ties():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, size=(90, 4)).astype(float)
    ids = rng.permutation(90)
    best = search.Nearest(ids[:10], x[:10], 7, True)
    for a in range(0, 90, 13):
        best.add(ids[a : a + 13], x[a : a + 13])
    got = list(zip(best.asked[best.query].tolist(), best.key.tolist()))
    want = []
    for i in range(10):
        d = np.round(((x - x[i]) ** 2).sum(axis=1), 6)
        want += [(int(ids[i]), k) for _, k in sorted((d[j], int(ids[j])) for j in range(90) if j != i)[:7]]
    assert got == want


def test_outcomes_by_subject_and_times(spark):
    df = spark.createDataFrame([("a", True, 5, "2024-01-01 00:00:00", "2024-01-01 00:00:02"), ("a", False, 9, None, None), ("b", True, 9, None, None)], "s string, ok boolean, class int, x string, y string")
    assert {tuple(r) for r in V.subject_outcomes(df, "s", F.col("ok")).collect()} == {("a", 1, 1, "FAILED"), ("b", 1, 0, "SUCCESS")}
    assert V.cases_of_class(df, 9).count() == 2 and {tuple(r) for r in V.outcomes(df, "s").collect()} == {("a", 2), ("b", 1)}
    times = df.select(F.col("x").cast("timestamp").alias("x"), F.col("y").cast("timestamp").alias("y"))
    assert [r["s"] for r in times.select(V.seconds_between("x", "y").alias("s")).where("s is not null").collect()] == [2.0]


def test_index_and_pipeline(spark, tmp_path):
    x = np.eye(4)
    rows = [(i, x[i % 2].tolist(), f"A sentence number {i} that is long enough to be cited here. " * 3, "5", "Science", "en", "3", None, "jesc103.pdf", [2, 4], 2) for i in range(6)]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, text string, class string, subject string, lang string, chapter string, section string, filename string, page_numbers array<int>, primary_page int")
    I.save_index(chunks, str(tmp_path / "ix"))
    assert I.index_exists(spark, str(tmp_path / "ix")) and not I.index_exists(spark, str(tmp_path / "no"))
    index = I.load_index(spark, str(tmp_path / "ix"))
    assert I.select_index(index, 5, "Science").count() == 6 and I.select_index(index, 5).count() == 6
    assert I.select_index(index, 10, "Science").count() == 0 and I.select_index(index, 5, "Science", "hi").count() == 0
    q = spark.createDataFrame([(1, x[0].tolist(), "5", "Science", "en"), (2, x[2].tolist(), "5", "Science", "en"), (3, x[0].tolist(), "5", "History", "en"), (4, x[0].tolist(), "5", "Science", "hi"), (5, None, "5", "Science", "en")], "q_id long, embedding array<double>, class string, subject string, lang string")
    out = {r["q_id"]: r for r in answer_questions(q, chunks, post_checks=True).collect()}
    assert (out[1]["status"], out[1]["citation"]["page"], out[1]["citation"]["chapter"], out[1]["grounding_score"]) == ("success", "2-4", "Chapter 3", 0.9)
    assert {out[i]["rejection_type"] for i in (2, 3, 4)} == {"low_confidence"} and out[3]["retrieved_chunks"] == out[4]["retrieved_chunks"] == 0
    assert (out[2]["reason"], out[2]["threshold"]) == ("confidence", 0.38) or (out[2]["reason"], out[2]["threshold"]) == ("relevance", 0.45)
    assert "class 5, History" in out[3]["message"] and (out[5]["reason"], out[5]["status"], out[5]["gate_score"]) == ("error", "rejected", None)
    pruned = I.asked_partitions(index, q.where("q_id = 1"))
    assert pruned.count() == 6 and "subject_slug" in pruned._jdf.queryExecution().toString().split("PartitionFilters")[1][:300]
    assert I.asked_partitions(index, q.where("q_id in (3, 4)")).count() == 0 and I.asked_partitions(index, q, most=1).count() == 6
