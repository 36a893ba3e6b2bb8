"""A folder of paged documents as scans: binary files in, one row per document out, failures as error rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import filename_chapter, filename_stem, footer_page_number

PAGE = "struct<page_number: int, pdf_page_number: string, text: string, char_count: int, error: string>"


class PageExtractor(Protocol):
    """What turns a document's bytes into the text of its pages; an exception fails the document, an Exception in the list one page."""

    def pages(self, content: bytes, lang: str, dpi: int) -> list[str | Exception]: ...


class TextPages:
    """Plain text whose pages a form feed parts. An optical reader takes its place where one is installed."""

    def pages(self, content: bytes, lang: str = "eng", dpi: int = 300) -> list[str | Exception]:  # noqa: ARG002
        if content[:5] == b"%PDF-" or b"\0" in content:
            raise ValueError("not a text: a reader for this format has to be given")
        return list(content.decode("utf-8").split("\f"))


def read_documents(spark: SparkSession, path: str, extractor: PageExtractor, pattern: str = "*.pdf", lang: str = "eng", dpi: int = 300) -> DataFrame:
    """Scans of the documents in one folder (not below it): pdf_path, filename, chapter, pages, full_text, total_pages, total_characters, lang, error.

    A document that fails is a row with error and no pages, a page that fails is a page with error and an empty text.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    schema = "pdf_path string, raw array<struct<text: string, error: string>>, error string"

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"]):
                try:
                    got = extractor.pages(bytes(content), lang, dpi)
                    rows.append((p, [{"text": "", "error": str(x)} if isinstance(x, Exception) else {"text": x.strip(), "error": None} for x in got], None))
                except Exception as e:  # noqa: BLE001
                    rows.append((p, [], str(e)))
            yield pd.DataFrame(rows, columns=["pdf_path", "raw", "error"])

    return assemble(files.mapInPandas(extract, schema), lang)


def assemble(raw: DataFrame, lang: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Number the pages, read their printed numbers, join the text; the columns of keep come along."""
    page = lambda p, i: F.struct(
        (i + 1).alias("page_number"), F.when(p["error"].isNull(), footer_page_number(p["text"])).alias("pdf_page_number"), p["text"].alias("text"),
        F.when(p["error"].isNull(), F.length(p["text"])).alias("char_count"), p["error"].alias("error"),
    )
    df = raw.withColumn("pages", F.transform("raw", page))
    return join_pages(df.select(*keep, "pdf_path", filename_stem(F.col("pdf_path")).alias("filename"), filename_chapter(F.col("pdf_path")).alias("chapter"), "pages", F.lit(lang).alias("lang"), "error"))


def join_pages(df: DataFrame, pages: str = "pages") -> DataFrame:
    """df with full_text (non-empty pages parted by a blank line), total_pages and total_characters."""
    text = F.array_join(F.filter(F.transform(pages, lambda p: p["text"]), lambda t: F.coalesce(t, F.lit("")) != ""), "\n\n")
    return df.withColumn("full_text", F.coalesce(text, F.lit(""))).withColumn("total_pages", F.coalesce(F.size(pages), F.lit(0))).withColumn("total_characters", F.length("full_text"))
