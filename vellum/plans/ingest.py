"""From scans to an index: clean, find structure, chunk, enrich, encode. One lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.config import Settings
from vellum.functions.enrich import content_type, has_equations, has_questions, keyword_array
from vellum.functions.text import clean_hindi_text, clean_text, devanagari_chars, devanagari_percentage, hindi_subject, once, series_chapter, structures, text_chapter, text_section
from vellum.operators.chunk import chunk_documents
from vellum.operators.encode import Encoder, HashingEncoder, embed


def clean_documents(scans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cleaned documents of scans with key, full_text, filename, chapter, pages, lang; failed and empty scans give a row with an empty text.

    Hindi scans are cleaned in their own way and have no structures; class, subject and section have defaults where nothing is told.
    """
    hindi = F.lower(F.coalesce("lang", F.lit(""))).isin("hi", "hin", "hindi")
    df = once(scans, "cleaned_text", F.when(hindi, clean_hindi_text(F.col("full_text"))).otherwise(clean_text(F.col("full_text"))))
    none = F.lit(None).cast("array<struct<start_pos: int, ord: int, end_pos: int, kind: string, marker: string>>")
    told = F.nullif(F.nullif(F.col("chapter"), F.lit("Unknown")), F.lit(""))
    chapter = F.coalesce(told, text_chapter(F.col("cleaned_text")), series_chapter(F.col("filename")))
    subject = F.when(hindi, hindi_subject(F.col("filename"))).otherwise("Science")
    df = once(df, "structures", F.when(hindi, none).otherwise(structures(F.col("cleaned_text"))))
    return df.select(
        key, F.coalesce("full_text", F.lit("")).alias("original_text"), "cleaned_text", "structures",
        F.struct(chapter.alias("chapter"), F.when(~hindi, text_section(F.col("cleaned_text"))).alias("section"), F.lit("10").alias("class"), subject.alias("subject"),
                 F.col("lang").alias("lang"), F.col("filename").alias("filename"), F.col("pages").alias("pages")).alias("metadata"),
        F.length(F.coalesce("full_text", F.lit(""))).alias("char_count_original"), F.length("cleaned_text").alias("char_count_cleaned"),
        F.coalesce(F.size("pages"), F.lit(0)).alias("total_pages"), devanagari_chars(F.col("cleaned_text")).alias("devanagari_chars"),
        devanagari_percentage(F.col("cleaned_text")).alias("devanagari_percentage"),
    )


def enrich(chunks: DataFrame, enrich_structured: bool = False) -> DataFrame:
    """Content type, flags and keywords. Chunks cut by structure keep NULL there unless asked for."""
    use = F.lit(True) if enrich_structured else F.col("token_count").isNotNull()
    text = F.col("text")
    return chunks.withColumns({
        "content_type": F.when(use, content_type(text)), "has_equations": F.when(use, has_equations(text)),
        "has_questions": F.when(use, has_questions(text)), "keywords": F.when(use, keyword_array(text)),
    })


def page_columns(pages: str = "pages") -> dict:
    """page_numbers, pdf_page_numbers and primary_page of an array of pages."""
    numbers = F.filter(F.transform(pages, lambda p: p["page_number"]), lambda n: n.isNotNull() & (n != 0))
    printed = F.filter(F.transform(pages, lambda p: p["pdf_page_number"]), lambda n: F.coalesce(n, F.lit("")) != "")
    return {"page_numbers": numbers, "pdf_page_numbers": printed, "primary_page": F.get(numbers, F.lit(0))}


#: What chunks carry on from their document.
ABOUT = ("chapter", "section", "class", "subject", "lang", "filename", "page_numbers", "pdf_page_numbers", "primary_page")


def ingest(scans: DataFrame, settings: Settings | None = None, encoder: Encoder | None = None, key: str = "doc_id") -> DataFrame:
    """Encoded chunks of scans, ready for save_index(): one pass without a shuffle, as chunks carry their document's metadata with them."""
    s = settings or Settings()
    docs = clean_documents(scans, key).select(key, "cleaned_text", "structures", "metadata.*").withColumns(page_columns())
    chunks = enrich(chunk_documents(docs, key, chunk_size=s.chunk_size, chunk_overlap=s.chunk_overlap, keep=ABOUT))
    return embed(chunks, encoder or HashingEncoder(s.embedding_dimension), batch_size=s.batch_size)
