"""The driver's queries over the test tables, one per operator or family of operators; each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.config import Settings
from vellum.functions import answer as A
from vellum.functions import enrich as E
from vellum.functions import text as T
from vellum.functions.vector import l2_normalize, norm
from vellum.operators import chunk as C
from vellum.operators import evaluate as V
from vellum.operators import gates as G
from vellum.operators import index as I
from vellum.operators.encode import HashingEncoder, embed
from vellum.operators.search import build_ivf, ivf_lists, knn, knn_ivf, probes_for
from vellum.plans.answering import answer_questions, prompts
from vellum.plans.ingest import clean_documents, ingest, page_columns
from vellum.sources.catalog import catalog, class_of_folder, first_folders, pick_subject, subject_of_folder, subjects
from vellum.sources.documents import assemble, join_pages
from vellum.sources.stages import normalized_feedback
from vellum.streaming.feedback import windowed_outcomes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Chunks with each key once; a second delivery has the same text."""
    return _t(spark, d, "chunks").select("chunk_uid", *columns).dropDuplicates(["chunk_uid"])


# --- text


@query
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    """H1-H9."""
    return _t(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query
def clean_hindi_text(spark: SparkSession, d: str) -> DataFrame:
    """H10-H15."""
    return _t(spark, d, "ocr_results").select("doc_id", T.clean_hindi_text(F.col("full_text")).alias("cleaned")).distinct()


@query
def script_ratio(spark: SparkSession, d: str) -> DataFrame:
    """D9, H16."""
    return _t(spark, d, "documents").select("doc_id", T.devanagari_chars(F.col("text")).alias("n"), T.devanagari_percentage(F.coalesce("text", F.lit(""))).alias("percentage"))


@query
def structure_markers(spark: SparkSession, d: str) -> DataFrame:
    """H17, F1."""
    found = _chunks(spark, d, "text").select("chunk_uid", F.posexplode(T.structures(F.col("text"))).alias("nth", "s"))
    return found.select("chunk_uid", "nth", F.col("s.kind").alias("kind"), F.col("s.start_pos").alias("start_pos"), F.col("s.end_pos").alias("end_pos"), F.col("s.marker").alias("marker"))


@query
def chapter_section(spark: SparkSession, d: str) -> DataFrame:
    """H19-H22."""
    c = T.clean_text(F.col("full_text"))
    cleaned = _t(spark, d, "ocr_results").select("doc_id", "filename", c.alias("c")).distinct()
    return cleaned.select("doc_id", T.text_chapter(F.col("c")).alias("chapter"), T.text_section(F.col("c")).alias("section"), T.series_chapter(F.col("filename")).alias("series_chapter"))


@query
def filename_parts(spark: SparkSession, d: str) -> DataFrame:
    """H25, H28, H29."""
    f = F.col("filename")
    return _t(spark, d, "books").select("filename", T.filename_stem(f).alias("stem"), T.filename_chapter(f).alias("chapter"), T.hindi_subject(f).alias("hindi_subject"))


@query
def footer_page_number(spark: SparkSession, d: str) -> DataFrame:
    """H27, F5, A2."""
    page = _t(spark, d, "ocr_results").select("doc_id", F.explode("pages").alias("p"))
    return page.select("doc_id", F.col("p.page_number").alias("page_number"), T.footer_page_number(F.col("p.text")).alias("printed")).distinct()


@query
def joined_pages(spark: SparkSession, d: str) -> DataFrame:
    """B1, D10, D11."""
    scans = _t(spark, d, "ocr_results").select("doc_id", "pages")
    return join_pages(scans).select("doc_id", "full_text", "total_pages", "total_characters").distinct()


@query
def numbered_pages(spark: SparkSession, d: str) -> DataFrame:
    """E5: the pages of every scan's text, parted at blank lines, numbered from 1 with their printed numbers."""
    raw = F.transform(F.split("full_text", "\n\n"), lambda t: F.struct(t.alias("text"), F.lit(None).cast("string").alias("error")))
    scans = _t(spark, d, "ocr_results").where("full_text <> ''").select("doc_id", "pdf_path", raw.alias("raw"), "error")
    page = assemble(scans, "eng", keep=("doc_id",)).select("doc_id", F.explode("pages").alias("p"))
    return page.select("doc_id", "p.page_number", "p.pdf_page_number", "p.char_count").distinct()


@query
def subject_slugs(spark: SparkSession, d: str) -> DataFrame:
    """H41-H43."""
    b = _t(spark, d, "books").select("class", "subject", "lang").distinct()
    return b.select("class", "subject", "lang", T.subject_slug(F.col("subject")).alias("slug"), I.index_path(F.col("class"), F.col("subject"), F.col("lang")).alias("path"))


@query
def text_previews(spark: SparkSession, d: str) -> DataFrame:
    """H57."""
    f = _t(spark, d, "feedback").select("feedback_id", T.preview(F.col("question"), 50, always=True).alias("short"), T.preview(F.col("answer"), 300).alias("long"))
    return f.distinct()


# --- chunks


@query
def chunk_by_tokens(spark: SparkSession, d: str) -> DataFrame:
    """K2, B3, E1, E2, H35."""
    return C.by_tokens(_t(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").select(
        "doc_id", "chunk_index", "total_chunks", "start_pos", "end_pos", "char_count", "token_count", "text"
    )


@query
def chunk_by_structure(spark: SparkSession, d: str) -> DataFrame:
    """K1, B2, E3."""
    docs = _t(spark, d, "cleaned_documents").select("doc_id", "cleaned_text", "structures").dropDuplicates(["doc_id"])
    return C.by_structure(docs, "doc_id", "cleaned_text").select("doc_id", "chunk_index", "total_chunks", "start_pos", "end_pos", "structure_type", "char_count", "text")


@query
def chunk_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """K3, G1."""
    docs = _t(spark, d, "cleaned_documents").select("doc_id", "cleaned_text", "structures").dropDuplicates(["doc_id"])
    chunks = C.chunk_documents(docs)
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("char_count").alias("chars"), F.max("total_chunks").alias("total"), F.count("structure_type").alias("typed"))


@query
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    """H35, D5, D6."""
    c = _chunks(spark, d, "lang", "text")
    n = F.length("text")
    return c.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("chars"), F.max(n).alias("longest"), F.sum(F.floor(n / 4)).alias("tokens"))


@query
def content_types(spark: SparkSession, d: str) -> DataFrame:
    """H30-H32, K4."""
    t = F.col("text")
    return _chunks(spark, d, "text").select("chunk_uid", E.content_type(t).alias("content_type"), E.has_equations(t).alias("has_equations"), E.has_questions(t).alias("has_questions"))


@query
def keywords_top5(spark: SparkSession, d: str) -> DataFrame:
    """H33, H34, C8, D1, F2."""
    k = E.keywords(_chunks(spark, d, "text"), "chunk_uid", "text")
    return k.select("chunk_uid", F.array_join("keywords", " ").alias("keywords"))


@query
def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    """B4, B5, D11."""
    docs = _t(spark, d, "cleaned_documents").select("doc_id", F.col("metadata.pages").alias("pages"), F.col("metadata.class").alias("class"), F.col("metadata.subject").alias("subject"))
    shown = docs.withColumns(page_columns()).select("doc_id", F.array_join("page_numbers", ",").alias("page_numbers"), F.array_join("pdf_page_numbers", ",").alias("printed"), "primary_page", "class", "subject")
    return shown.distinct()


@query
def index_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each partition of the index."""
    c = _chunks(spark, d, "filename").join(_t(spark, d, "books").select("filename", "class", "subject", "lang"), "filename")
    return c.groupBy("class", T.subject_slug(F.col("subject")).alias("subject_slug"), "lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("filename").alias("files"))


@query
def folder_catalog(spark: SparkSession, d: str) -> DataFrame:
    """A5, A6, G3, F6."""
    b = _t(spark, d, "books").select(F.concat(F.lit("class-"), "class").alias("folder"), F.concat(F.col("subject"), F.lit("-"), F.when(F.col("lang") == "hi", "hindi").when(F.col("lang") == "ur", "urdu").otherwise("english")).alias("sub"))
    s = subject_of_folder(F.col("sub"))
    named = b.select("folder", class_of_folder(F.col("folder")).alias("class"), s.alias("s"))
    return named.select("folder", "class", F.col("s.subject").alias("subject"), F.col("s.language").alias("language"), F.col("s.lang_code").alias("lang_code")).distinct()


# --- vectors


def _queries(e: DataFrame) -> DataFrame:
    """Every vector whose key 20 divides asks; all rows are searched."""
    return e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("q_id"), "embedding", "label")


@query
def l2_norms(spark: SparkSession, d: str) -> DataFrame:
    """H36."""
    e = _t(spark, d, "embeddings")
    unit = l2_normalize(F.col("embedding"))
    return e.select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"), F.round(norm(unit), 6).alias("unit_norm"), F.round(unit[0], 6).alias("first"))


@query
def knn_exact_topk(spark: SparkSession, d: str) -> DataFrame:
    """C3, C4, H37, H38, F3, K10, K11."""
    e = _t(spark, d, "embeddings")
    return _rounded(knn(e, _queries(e), k=30, key="vec_id", exclude_self=True))


@query
def knn_label_filtered(spark: SparkSession, d: str) -> DataFrame:
    """C3 within the query's own partition."""
    e = _t(spark, d, "embeddings")
    return _rounded(knn(e, _queries(e), k=10, key="vec_id", exclude_self=True, partition=("label",)))


@query
def knn_ivf_full_probe(spark: SparkSession, d: str) -> DataFrame:
    """K9, C5 with every list probed, so that it is exact."""
    e = _t(spark, d, "embeddings")
    indexed, centroids = build_ivf(e, key="vec_id")
    return _rounded(knn_ivf(indexed, centroids, _queries(e), k=10, nprobe=len(centroids), key="vec_id", exclude_self=True))


@query
def knn_ivf_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether an index of the default lists finds at least nine in ten of the ten nearest, with the default probes or as many as its rows ask for."""
    e = _t(spark, d, "embeddings")
    s = Settings()
    lists, probes = ivf_lists(e.count(), s.nlist, s.nprobe)
    indexed, centroids = build_ivf(e, key="vec_id", nlist=lists)
    probes = max(probes, probes_for(e, centroids, k=10, key="vec_id"))
    found = knn_ivf(indexed, centroids, _queries(e), k=10, nprobe=probes, key="vec_id", exclude_self=True).select("q_id", "vec_id", F.lit(1).alias("met"))
    exact = knn(e, _queries(e), k=10, key="vec_id", exclude_self=True).select("q_id", "vec_id")
    return exact.join(found, ["q_id", "vec_id"], "left").agg((F.count("met") >= 0.9 * F.count(F.lit(1))).alias("enough"), F.count(F.lit(1)).alias("neighbours"))


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("distance", F.round("distance", 5)).withColumn("score", F.round("score", 5))


@query
def chunk_search(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose key 20 divides ask all chunks of their language."""
    c = _t(spark, d, "chunks").where("embedding_dim = 64").select("chunk_uid", "filename", "embedding").dropDuplicates(["chunk_uid"])
    c = c.join(_t(spark, d, "books").select("filename", "lang"), "filename")
    q = c.where(F.col("chunk_uid") % 20 == 0).withColumnRenamed("chunk_uid", "q_id")
    hits = knn(c, q, k=5, key="chunk_uid", exclude_self=True, partition=("lang",))
    return hits.select("q_id", "rank", F.round("distance", 4).alias("distance"))


@query
def encode_hashing(spark: SparkSession, d: str) -> DataFrame:
    """The size of every document's vector and its length, 1 for a text with words and 0 without."""
    v = embed(_t(spark, d, "documents").select("doc_id", "text"), HashingEncoder(384))
    return v.select("doc_id", "embedding_dim", F.size("embedding").alias("size"), F.round(norm(F.col("embedding")), 4).alias("norm"))


# --- gates


def _summary(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    q = _queries(e)
    hits = knn(e, q, k=30, key="vec_id", exclude_self=True)
    labels = e.select("vec_id", F.col("label").alias("_label"))
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    full = hits.join(labels, "vec_id").join(q.select("q_id", "label"), "q_id").join(docs, "vec_id", "left")
    return G.retrieval_summary(full, F.col("_label") != F.col("label"), F.coalesce("chars", F.lit(0)), "vec_id")


def _one_gate(spark: SparkSession, d: str, gate) -> DataFrame:  # noqa: ANN001
    out = G.apply_gates(_summary(spark, d), Settings(), (gate,))
    return out.select("q_id", "passed", "rejection_type", F.round("gate_score", 4).alias("gate_score"), "threshold")


@query
def gate_relevance(spark: SparkSession, d: str) -> DataFrame:
    """L1, D4."""
    return _one_gate(spark, d, G.relevance)


@query
def gate_subject_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """L2, D8, E4."""
    return _one_gate(spark, d, G.subject_match)


@query
def gate_confidence(spark: SparkSession, d: str) -> DataFrame:
    """L3, D2."""
    return _one_gate(spark, d, G.confidence)


@query
def gate_context_sufficiency(spark: SparkSession, d: str) -> DataFrame:
    """L4, D3, D5."""
    return _one_gate(spark, d, G.sufficiency)


@query
def gate_topic(spark: SparkSession, d: str) -> DataFrame:
    """L5, D4."""
    return _one_gate(spark, d, G.topic)


@query
def gate_all_first_failure(spark: SparkSession, d: str) -> DataFrame:
    """L8."""
    out = G.apply_gates(_summary(spark, d))
    return out.select("q_id", "hits", "passed", "rejection_type", "stage", F.round("gate_score", 4).alias("gate_score"), "threshold", F.round("avg_score", 4).alias("avg_score"))


@query
def subject_prefix_match(spark: SparkSession, d: str) -> DataFrame:
    """C6, C7, L2's rule for one hit."""
    b = _t(spark, d, "books")
    wrong = G.subject_mismatch(F.col("class"), F.col("subject"), F.col("filename"), F.col("subject"))
    return b.select("filename", wrong.alias("mismatch"), A.file_subject(F.col("filename"), F.col("subject"), F.lit("asked")).alias("file_subject"))


# --- answers


@query
def extractive_answers(spark: SparkSession, d: str) -> DataFrame:
    """H44, B9, F4, D7, H39, H40, L6, L7."""
    a = A.extractive_answer(F.col("text"), F.when(F.lower("lang").isin("hi", "hin", "hindi"), "hi").otherwise("en"))
    df = _chunks(spark, d, "text", "lang").select("chunk_uid", a.alias("answer"))
    score = A.grounding_score(F.col("answer"), F.lit(1))
    return df.select(
        "chunk_uid", "answer", A.source_count(F.col("answer")).alias("markers"), score.alias("grounding"), A.grounding_label(score).alias("label"),
        G.citation_gate(F.col("answer"), F.lit(1)).alias("citation_gate"), G.grounding_gate(score, Settings()).alias("grounding_gate"),
    )


@query
def citations(spark: SparkSession, d: str) -> DataFrame:
    """H45-H47, C7."""
    c = _chunks(spark, d, "chapter", "filename", "page_numbers", "primary_page", "subject", "class")
    return c.select(
        "chunk_uid", A.page_range(F.col("page_numbers"), F.col("primary_page")).alias("page"), A.citation_chapter(F.col("chapter"), F.col("filename")).alias("chapter"),
        A.file_subject(F.col("filename"), F.col("subject"), F.lit("asked")).alias("subject"), F.col("class"),
    )


@query
def citation_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """G2, E7."""
    c = _chunks(spark, d, "doc_id", "class", "subject", "chapter", "primary_page")
    c = c.withColumn("page", F.col("primary_page").cast("string"))
    return V.unique_citations(c, "doc_id", "chunk_uid").select("doc_id", "chunk_uid", "class", "subject", "chapter", "page", "number")


def _first_five(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, rank, chapter, page, text) of the first five chunks of every document."""
    c = _chunks(spark, d, "doc_id", "chapter", "primary_page", "text").withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy("chunk_uid")))
    return c.where("rank <= 5").select("doc_id", "rank", "chapter", F.col("primary_page").cast("string").alias("page"), "text")


@query
def answer_contexts(spark: SparkSession, d: str) -> DataFrame:
    """H49, H52, H53, E6."""
    best = _first_five(spark, d).groupBy("doc_id").agg(F.collect_list(F.struct("rank", "chapter", "page", "text")).alias("r"))
    extract, hindi = A.textbook_extract(F.col("r")), F.when(F.col("doc_id") % 2 == 0, "hi").otherwise("en")
    return best.select("doc_id", A.context(F.col("r")).alias("context"), extract.alias("extract"), A.complete_answer(F.lit("Answer."), extract, hindi).alias("complete"))


@query
def answer_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What a model would be asked about the first five chunks of every document."""
    five = _first_five(spark, d).withColumnRenamed("doc_id", "q_id")
    asked = five.select("q_id").distinct().withColumns({"question": F.concat(F.lit("Question "), F.col("q_id")), "lang": F.when(F.col("q_id") % 2 == 0, "hi").otherwise("en")})
    return prompts(asked, five).select("q_id", "system", "user", "extract")


@query
def question_validation(spark: SparkSession, d: str) -> DataFrame:
    """B10, H55."""
    f = _t(spark, d, "feedback").select("feedback_id", "question", "metadata").distinct()
    error = G.valid_question(F.col("question"), F.regexp_extract("metadata.class", r"([0-9]+)", 1), F.col("metadata.subject"), F.col("metadata.lang"))
    return f.select("feedback_id", error.alias("error"), A.rejection_message(F.col("metadata.rejection_type"), F.lit(None).cast("string")).alias("message"))


@query
def request_projection(spark: SparkSession, d: str) -> DataFrame:
    """Requests as they are sent."""
    sent = G.request(F.col("question"), F.col("metadata.class"), F.col("metadata.subject"), F.col("metadata.lang"), F.col("asked_at"))
    return _t(spark, d, "feedback").select("feedback_id", sent.alias("r")).select("feedback_id", "r.*").distinct()


@query
def feedback_log(spark: SparkSession, d: str) -> DataFrame:
    """A14, H59."""
    f = normalized_feedback(_t(spark, d, "feedback"))
    return f.select("feedback_id", "answer", "remark", F.col("metadata.rejection_type").alias("rejection_type"), F.col("metadata.grounding_score").alias("grounding_score")).distinct()


@query
def feedback_windows(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of the stream over feedback (extension)."""
    w = windowed_outcomes(_t(spark, d, "feedback").dropDuplicates(["feedback_id"]))
    return w.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "status", "n", "helpful")


@query
def response_validation(spark: SparkSession, d: str) -> DataFrame:
    """B11, over feedback as responses."""
    f = _t(spark, d, "feedback").select("feedback_id", "answer", "metadata").distinct()
    cited = F.when(F.col("metadata.grounding_score").isNotNull(), 1)
    error = G.valid_response(F.col("metadata.status"), F.col("answer"), cited, F.col("metadata.rejection_type"))
    return f.select("feedback_id", error.alias("error"))


@query
def subjects_on_offer(spark: SparkSession, d: str) -> DataFrame:
    """Books of a class whose subject is on offer there."""
    b = _t(spark, d, "books").select("filename", "class", F.lower("subject").alias("s"))
    offer = subjects(spark).select(F.col("class").alias("c"), F.lower("subject").alias("o"))
    hit = b.join(offer, (b["class"] == offer["c"]) & (b["s"] == offer["o"]), "left")
    return hit.select("filename", "class", F.col("o").isNotNull().alias("on_offer"))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """A folder tree of the books: two spellings of a class's folder hold them, of which the first in order counts."""
    b = _t(spark, d, "books")
    roman = F.create_map(*[F.lit(x) for i, n in enumerate(("V", "VI", "VII", "VIII", "IX", "X")) for x in (i + 5, n)])[F.col("class")]
    folder = F.concat(F.when(F.length("filename") % 2 == 0, "CLASS-").otherwise("class-"), F.when(F.length("filename") % 2 == 0, roman).otherwise(F.lower(roman)))
    language = F.when(F.col("lang") == "hi", "hindi").when(F.col("lang") == "ur", "urdu").otherwise("english")
    return b.select(F.concat_ws("/", F.lit("root"), folder, F.concat_ws("-", "subject", language), F.concat("filename", F.lit(".pdf"))).alias("path"))


@query
def folder_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Subjects and numbers of files below the first folder there is of each class."""
    return catalog(first_folders(_paths(spark, d)))


@query
def picked_subject(spark: SparkSession, d: str) -> DataFrame:
    """Of every class the first folder that matches 'science' and 'en', whatever its case."""
    found = catalog(first_folders(_paths(spark, d)))
    out = None
    for c in (5, 6, 9, 10):
        one = pick_subject(found, c, "SCIENCE", "en")
        out = one if out is None else out.union(one)
    return out


@query
def index_selection(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks the index of class, subject and language holds, for one subject, for none named, and for class 10."""
    books = _t(spark, d, "books").select("filename", F.col("class").cast("string").alias("class"), T.subject_slug(F.col("subject")).alias("subject_slug"), "lang")
    index = _chunks(spark, d, "filename").join(books, "filename")
    wanted = (("one", 9, "Social Science", "en"), ("first", 8, None, "hi"), ("whole", 10, "Science", "en"), ("language", None, "Mathematics", "hi"), ("named", 10, "all-subjects-hindi", "hi"))
    out = None
    for name, *which in wanted:
        part = I.select_index(index, *which).groupBy(F.lit(name).alias("selection"), "class", "subject_slug").agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.union(part)
    return out


# --- evaluation


def _results(spark: SparkSession, d: str) -> DataFrame:
    f = _t(spark, d, "feedback").select("feedback_id", "helpful", "metadata").dropDuplicates(["feedback_id"])
    return f.select("feedback_id", "helpful", F.coalesce("metadata.status", F.lit("error")).alias("status"), F.regexp_extract("metadata.class", r"([0-9]+)", 1).try_cast("int").alias("class"), F.col("metadata.lang").alias("lang"))


@query
def eval_status_counts(spark: SparkSession, d: str) -> DataFrame:
    """D12, G4."""
    return V.status_counts(_results(spark, d))


@query
def eval_mode_distribution(spark: SparkSession, d: str) -> DataFrame:
    """The mode of a success is told by its grounding score, 0.9 for extracts."""
    f = _t(spark, d, "feedback").select("feedback_id", "metadata").dropDuplicates(["feedback_id"])
    mode = F.when(F.col("metadata.grounding_score") >= 0.9, "retrieval_only").when(F.col("metadata.grounding_score").isNotNull(), "llm")
    return V.mode_distribution(f.select(F.col("metadata.status").alias("status"), mode.alias("mode")), "mode")


@query
def eval_latency(spark: SparkSession, d: str) -> DataFrame:
    """D14."""
    return V.latency(_t(spark, d, "events"), "value", "event_type")


@query
def eval_rate_limits(spark: SparkSession, d: str) -> DataFrame:
    """Calls by outcome, over rejection types as outcomes; none is an answer."""
    f = _t(spark, d, "feedback").select("feedback_id", "metadata").dropDuplicates(["feedback_id"])
    return V.outcomes(f.select(F.coalesce(F.nullif(F.col("metadata.rejection_type"), F.lit("")), F.lit("answered")).alias("outcome")), "outcome")


@query
def eval_response_time(spark: SparkSession, d: str) -> DataFrame:
    """Seconds between question and log by status."""
    f = _t(spark, d, "feedback").select("feedback_id", "asked_at", "received_at", "metadata").distinct()
    return V.latency(f.select(F.coalesce("metadata.status", F.lit("error")).alias("status"), V.seconds_between("asked_at", "received_at").alias("s")), "s", "status")


@query
def eval_cases_of_class(spark: SparkSession, d: str) -> DataFrame:
    """Test items of one class."""
    return V.cases_of_class(_t(spark, d, "exam_items"), 9).select("item_id", "subject", "lang")


@query
def eval_subject_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """For every chapter of the scans whether it was read without an error, and how many scans were."""
    scans = _t(spark, d, "ocr_results").select("doc_id", "filename", "error").distinct()
    return V.subject_outcomes(scans.join(_t(spark, d, "books").select("filename", "subject"), "filename"), "subject", F.col("error").isNull())


@query
def eval_class_pivot(spark: SparkSession, d: str) -> DataFrame:
    """In order of class."""
    return V.class_pivot(_results(spark, d), "class").orderBy("class")


@query
def eval_passed(spark: SparkSession, d: str) -> DataFrame:
    """D19."""
    return V.passed_of(_results(spark, d), "helpful")


# --- whole pipelines


@query
def cleaned_scans(spark: SparkSession, d: str) -> DataFrame:
    """Scans cleaned, with their structures counted and their metadata by precedence and default."""
    out = clean_documents(_t(spark, d, "ocr_results").select("doc_id", "full_text", "filename", "chapter", "pages", "lang"))
    m = F.col("metadata")
    return out.select(
        "doc_id", "cleaned_text", F.size("structures").alias("structures"), m["chapter"].alias("chapter"), m["section"].alias("section"), m["class"].alias("class"), m["subject"].alias("subject"),
        m["filename"].alias("filename"), "char_count_original", "char_count_cleaned", "total_pages", "devanagari_chars", "devanagari_percentage",
    ).distinct()


@query
def ingest_documents(spark: SparkSession, d: str) -> DataFrame:
    """Scans cleaned, cut, enriched and encoded, one row per chunk."""
    scans = _t(spark, d, "ocr_results").select("doc_id", "full_text", "filename", "chapter", "pages", "lang").dropDuplicates(["doc_id"])
    return ingest(scans).select(
        "doc_id", "chunk_index", "total_chunks", "start_pos", "end_pos", "structure_type", "text", "char_count", "token_count", "content_type", "has_equations", "has_questions",
        F.array_join("keywords", " ").alias("keywords"), "chapter", "primary_page", F.array_join("page_numbers", ",").alias("page_numbers"), "embedding_dim", F.round(norm(F.col("embedding")), 4).alias("norm"),
    )


@query
def answer_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose key 20 divides ask the index of their class, subject and language; gates, answer and citation."""
    books = _t(spark, d, "books").select("filename", F.col("class").cast("string").alias("b_class"), F.col("subject").alias("b_subject"), F.col("lang").alias("b_lang"))
    c = _t(spark, d, "chunks").select("chunk_uid", "filename", "text", "chapter", "page_numbers", "primary_page", F.when(F.col("embedding_dim") == 64, F.col("embedding")).alias("embedding")).dropDuplicates(["chunk_uid"])
    c = c.join(books, "filename").select(
        F.col("chunk_uid").alias("chunk_id"), "filename", "text", F.col("b_class").alias("class"), F.col("b_subject").alias("subject"), F.col("b_lang").alias("lang"), "chapter",
        F.lit(None).cast("string").alias("section"), "page_numbers", "primary_page", "embedding",
    )
    q = c.where(F.col("chunk_id") % 20 == 0).select(F.col("chunk_id").alias("q_id"), "embedding", "class", "subject", "lang")
    out = answer_questions(q, c, exclude_self=True)
    return out.select(
        "q_id", "status", "answer", F.col("citation.class").alias("class"), F.col("citation.subject").alias("subject"), F.col("citation.chapter").alias("chapter"), F.col("citation.page").alias("page"),
        "grounding_score", "reason", "message", "rejection_type", F.round("gate_score", 4).alias("gate_score"), "threshold", "retrieved_chunks", F.round("avg_retrieval_score", 4).alias("avg_retrieval_score"), "mode",
    )
