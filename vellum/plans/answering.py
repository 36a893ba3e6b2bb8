"""From questions to answers: search, gates, extractive answer, citation; for a whole batch of questions at once."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.config import Settings
from vellum.functions.answer import (
    citation_chapter, complete_answer, context, extractive_answer, file_subject, grounding_score, page_range, rejection_message, system_prompt, textbook_extract, user_prompt,
)
from vellum.operators.gates import GATES, apply_gates, citation_gate, gate_message, grounding_gate, retrieval_summary, subject_mismatch
from vellum.operators.index import index_path
from vellum.operators.search import knn


def answer_questions(questions: DataFrame, chunks: DataFrame, settings: Settings | None = None, exclude_self: bool = False, post_checks: bool = False) -> DataFrame:
    """One row per question: status, answer, citation, grounding_score, reason, message, rejection_type, gate_score, threshold, retrieved_chunks,
    avg_retrieval_score, mode.

    questions: q_id, embedding, class, subject, lang. chunks: chunk_id, embedding, text, class, subject, lang, chapter, section, filename,
    page_numbers, primary_page. A question meets only the chunks of its own index, which its class, subject and language choose (class 10
    has one for all subjects of a language); without any it is rejected, never answered from another. Of the hits only lengths travel,
    through one aggregation by question; strings are joined to the best hit alone. A question that cannot be searched, for want of a
    vector, is a rejection with the reason 'error'.
    """
    s = settings or Settings()
    asked = questions.select(
        "q_id", F.col("embedding").alias("_vector"), F.col("class").alias("q_class"), F.col("subject").alias("q_subject"), F.col("lang").alias("q_lang"),
        index_path(F.col("class"), F.col("subject"), F.col("lang")).alias("_index"),
    )
    indexed = chunks.withColumn("_index", index_path(F.col("class"), F.col("subject"), F.col("lang")))
    hits = knn(indexed, asked, k=s.top_k, key="chunk_id", q_vector="_vector", exclude_self=exclude_self, partition=("_index",))
    about = chunks.select("chunk_id", F.length(F.coalesce("text", F.lit(""))).alias("_chars"), F.col("subject").alias("_subject"), "filename")
    broken = F.col("_vector").isNull() | (F.size("_vector") == 0) | F.exists("_vector", lambda x: x.isNull())
    asked = asked.select("q_id", "q_class", "q_subject", "q_lang", F.coalesce(broken, F.lit(True)).alias("_broken"))
    full = hits.join(about, "chunk_id").join(asked, "q_id")
    wrong = subject_mismatch(F.col("q_class").try_cast("int"), F.col("q_subject"), F.col("filename"), F.col("_subject"))
    summary = retrieval_summary(full, wrong, F.col("_chars"))
    gated = apply_gates(asked.join(summary, "q_id", "left").fillna({"hits": 0, "mismatches": 0}), s, GATES)
    best = chunks.select(
        F.col("chunk_id").alias("best"), F.col("text").alias("_text"), F.col("class").alias("_class"), F.col("subject").alias("_subject"), "chapter", "section", "filename", "page_numbers", "primary_page"
    )
    out = gated.join(best, "best", "left")
    cited = F.struct(
        F.coalesce("_class", "q_class").alias("class"), file_subject(F.col("filename"), F.col("_subject"), F.col("q_subject")).alias("subject"),
        citation_chapter(F.col("chapter"), F.col("filename")).alias("chapter"), page_range(F.col("page_numbers"), F.col("primary_page")).alias("page"), F.col("section"),
    )
    out = out.withColumn("answer", F.when(F.col("passed"), extractive_answer(F.col("_text"), F.col("q_lang")))).withColumn("citation", F.when(F.col("passed"), cited))
    out = out.withColumn("grounding_score", F.when(F.col("passed"), grounding_score(F.col("answer"), F.lit(1))))
    if post_checks:
        late = F.coalesce(citation_gate(F.col("answer"), F.lit(1)), grounding_gate(F.col("grounding_score"), s))
        out = out.withColumn("rejection_type", F.when(F.col("passed"), late).otherwise(F.col("rejection_type"))).withColumn("passed", F.col("passed") & late.isNull())
    told = F.coalesce(gate_message(F.col("stage"), F.col("q_class"), F.col("q_subject")), rejection_message(F.col("rejection_type"), F.lit(None).cast("string")))
    ok, failed = F.col("passed"), F.col("_broken")
    return out.select(
        "q_id", F.when(ok, "success").otherwise("rejected").alias("status"), F.when(ok, F.col("answer")).alias("answer"),
        F.when(ok, F.col("citation")).alias("citation"), F.when(ok, F.col("grounding_score")).alias("grounding_score"),
        F.when(failed, "error").otherwise(F.col("stage")).alias("reason"), F.when(failed, "The question has no vector to search with.").when(~ok, told).alias("message"),
        F.when(failed, "insufficient_context").otherwise(F.col("rejection_type")).alias("rejection_type"), F.when(~failed, F.col("gate_score")).alias("gate_score"),
        F.when(~failed, F.col("threshold")).alias("threshold"), F.col("hits").alias("retrieved_chunks"), F.col("avg_score").alias("avg_retrieval_score"), F.when(ok, "retrieval_only").alias("mode"),
    )


class AnswerModel(Protocol):
    """A language model behind a batch call; an Exception in place of a text fails that question only."""

    def complete(self, system: list[str], user: list[str], temperature: float, max_tokens: int) -> list[str | Exception]: ...


def prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(q_id, system, user, extract, q_lang): prompts over the five best hits (q_id, rank, chapter, page, text) of each question (q_id, question, lang)."""
    ranked = hits.where("rank <= 5").groupBy("q_id").agg(F.collect_list(F.struct("rank", "chapter", "page", "text")).alias("_r"))
    lang = F.col("lang")
    df = questions.select("q_id", "question", "lang").join(ranked, "q_id")
    return df.select("q_id", system_prompt(lang).alias("system"), user_prompt(context(F.col("_r")), F.col("question"), lang).alias("user"), textbook_extract(F.col("_r")).alias("extract"), lang.alias("q_lang"))


def model_answers(answered: DataFrame, asked: DataFrame, model: AnswerModel | None, settings: Settings | None = None) -> DataFrame:
    """answered with the model's answers in place of extractive ones, where a model is there, in use, and does not fail.

    Only questions that passed every gate reach the model. mode tells which way each answer came: llm, extractive_fallback (the model
    failed) or retrieval_only (no model).
    """
    s = settings or Settings()
    if model is None or not s.use_llm:
        return answered
    schema = "q_id long, _text string, extract string, q_lang string"

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                got = model.complete(b["system"].tolist(), b["user"].tolist(), s.llm_temperature, s.llm_max_tokens)
            except Exception as e:  # noqa: BLE001
                got = [e] * len(b)
            yield pd.DataFrame({"q_id": b["q_id"], "_text": [None if isinstance(x, Exception) else x for x in got], "extract": b["extract"], "q_lang": b["q_lang"]})

    passed = answered.where("status = 'success'").select("q_id")
    told = asked.join(passed, "q_id", "left_semi").select("q_id", "system", "user", "extract", "q_lang").mapInPandas(call, schema)
    told = told.select("q_id", "_text", complete_answer(F.col("_text"), F.col("extract"), F.col("q_lang")).alias("_whole"), F.lit(True).alias("_asked"))
    out = answered.join(told, "q_id", "left")
    return out.withColumns({
        "answer": F.coalesce("_whole", "answer"),
        "grounding_score": F.when(F.col("_text").isNotNull(), grounding_score(F.col("_text"), F.lit(1))).otherwise(F.col("grounding_score")),
        "mode": F.when(F.col("_text").isNotNull(), "llm").when(F.col("_asked"), "extractive_fallback").otherwise(F.col("mode")),
    }).drop("_text", "_whole", "_asked")
