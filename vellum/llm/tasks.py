"""The queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm import canon, lang, leaks, level, neardup, pack, scans, similar, split, topics
from vellum.llm.common import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of which one is among the other's 5 most similar, of a cosine of at least 0.85."""
    chunks = table(spark, sf_dir, "chunks")
    return similar.similar_pairs(similar.similar_vectors(chunks, "chunk_uid", "embedding", k=5, least=0.85, dim=64, dim_column="embedding_dim"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English chunks shelved under class 5 or 6 that read as secondary, or under 9 or 10 that read as primary."""
    chunks = table(spark, sf_dir, "chunks")
    return level.misplaced(chunks, level.fit(chunks, table(spark, sf_dir, "level_labels")), lang.fit(chunks))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned texts and chunks above the limit, and whether they had to be cut within a sentence."""
    cleaned = split.split_oversized(table(spark, sf_dir, "cleaned_documents"), "doc_id", "cleaned_text")
    chunks = split.split_oversized(table(spark, sf_dir, "chunks"), "chunk_uid", "text")
    return split.cut_kind(cleaned, "cleaned").union(split.cut_kind(chunks, "chunk"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks whose sets of three consecutive words have a Jaccard similarity of at least 0.6."""
    pairs = neardup.near_duplicate_pairs(table(spark, sf_dir, "chunks"), size=3, similarity=0.6, least_words=30)
    return pairs.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects of every scanned page: cut words, misread words, running lines and page numbers."""
    return scans.page_defects(scans.repaired_scans(table(spark, sf_dir, "ocr_results"), table(spark, sf_dir, "books")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks that look the same but differ in code points."""
    pairs = canon.look_alike_pairs(table(spark, sf_dir, "chunks"))
    return pairs.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the chunks and scans whose label does not name just the language they are in."""
    chunks, ocr = table(spark, sf_dir, "chunks"), table(spark, sf_dir, "ocr_results")
    model = lang.fit(chunks)
    a = lang.languages(chunks, model, "chunk_uid", "text", extra=("lang",), least_words=lang.LEAST_WORDS)
    b = lang.languages(ocr, model, "doc_id", "full_text", extra=("lang",))
    return lang.mislabelled(a, "lang", "chunk").union(lang.mislabelled(b, "lang", "ocr"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents larger than one container of 2,048 tokens."""
    return pack.larger_than_container(pack.fill_containers(table(spark, sf_dir, "documents")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which at least half of a test item's sequences of three words stand."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "exam_items")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject areas that fill at least a quarter of each document."""
    return topics.main_areas(topics.subject_areas(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels")))


# The operators' own results, of which the queries above keep what they are asked for.


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The up to 5 most similar other chunks of every chunk, of a cosine of at least 0.85."""
    found = similar.similar_vectors(table(spark, sf_dir, "chunks"), "chunk_uid", "embedding", k=5, least=0.85, dim=64, dim_column="embedding_dim")
    return found.select(F.col("uid").alias("chunk_uid"), "other", "rank", F.round("cosine", 6).alias("cosine"))


def p2_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading level of every English chunk against its class."""
    chunks = table(spark, sf_dir, "chunks")
    shelved = chunks.select("chunk_uid", "text", level.class_number(F.col("class")).alias("shelf"))
    return level.reading_levels(shelved, level.fit(chunks, table(spark, sf_dir, "level_labels")), lang.fit(chunks), extra=("shelf",)).distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every chunk and cleaned text above the limit, by position."""
    cleaned = split.split_oversized(table(spark, sf_dir, "cleaned_documents"), "doc_id", "cleaned_text").withColumn("src", F.lit("cleaned"))
    chunks = split.split_oversized(table(spark, sf_dir, "chunks"), "chunk_uid", "text").withColumn("src", F.lit("chunk"))
    piece = cleaned.union(chunks).distinct().select("src", "item_id", F.posexplode("pieces").alias("piece", "p"))
    return piece.select("src", "item_id", "piece", "p.start_pos", "p.end_pos", "p.boundary")


def p3_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every chunk and cleaned text above the limit, whether its pieces cover it without a gap and stay within the limit."""
    cleaned = split.split_oversized(table(spark, sf_dir, "cleaned_documents"), "doc_id", "cleaned_text").withColumn("src", F.lit("cleaned"))
    chunks = split.split_oversized(table(spark, sf_dir, "chunks"), "chunk_uid", "text").withColumn("src", F.lit("chunk"))
    p = F.col("pieces")
    touch = F.forall(F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: (b["start_pos"] <= a["end_pos"]) & (b["end_pos"] > a["end_pos"])), lambda ok: ok)
    whole = (p[0]["start_pos"] == 0) & (F.element_at(p, -1)["end_pos"] == F.col("n_chars")) & touch
    return cleaned.union(chunks).select("src", "item_id", "n_chars", whole.alias("covered"), (F.col("longest") <= split.LIMIT).alias("within")).distinct()


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every chunk: five words, a similarity of 0.8."""
    found = neardup.near_duplicate_groups(table(spark, sf_dir, "chunks"))
    return found.select(F.col("uid").alias("chunk_uid"), F.col("cls").alias("class_id"), "group_id", "links")


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired text of every scan."""
    repaired = scans.repaired_scans(table(spark, sf_dir, "ocr_results"), table(spark, sf_dir, "books"))
    return repaired.select(F.col("item_id").alias("doc_id"), "full_text").distinct()


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every chunk's text."""
    return canon.with_canonical(table(spark, sf_dir, "chunks").select("chunk_uid", "text")).select("chunk_uid", "canonical_text").distinct()


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of one language in the chunks and scans, with its confidence."""
    chunks, ocr = table(spark, sf_dir, "chunks"), table(spark, sf_dir, "ocr_results")
    model = lang.fit(chunks)
    a = lang.languages(chunks, model, "chunk_uid", "text").withColumn("src", F.lit("chunk"))
    b = lang.languages(ocr, model, "doc_id", "full_text").withColumn("src", F.lit("ocr"))
    span = a.union(b).select("src", "item_id", F.explode("spans").alias("s"))
    return span.select("src", "item_id", "s.lang", "s.start_pos", "s.end_pos", F.round("s.confidence", 6).alias("confidence")).distinct()


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document or piece of one."""
    return pack.fill_containers(table(spark, sf_dir, "documents"))


def p8_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and tokens in all containers, containers above the capacity, and pieces that stand in more than one."""
    filled = pack.fill_containers(table(spark, sf_dir, "documents"))
    tokens, places = F.sum("size").over(W.partitionBy("container")), F.count(F.lit(1)).over(W.partitionBy("item_id", "piece"))
    held = filled.select("size", tokens.alias("held"), places.alias("places"))
    return held.agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("tokens"), F.count_if(F.col("held") > pack.CAPACITY).alias("above"), F.count_if(F.col("places") > 1).alias("twice"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each leaked test item's sequences that stand in the document."""
    found = leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "exam_items"))
    return found.select("doc_id", "item_id", F.round("share", 6).alias("share"))


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaked test item with its share, edit distance and place."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "exam_items"))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of every area in every document."""
    found = topics.subject_areas(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"))
    row = found.select("doc_id", F.explode("areas").alias("a"))
    return row.select("doc_id", "a.area", F.round("a.share", 6).alias("share"), F.round("a.of_text", 6).alias("of_text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p2_found, p3_found, p4_found, p5_found, p6_found, p7_found, p8_found, p9_found, p10_found,
        p1_neighbours, p2_levels, p3_pieces, p3_covered, p4_groups, p5_paragraphs, p6_forms, p7_spans, p8_containers, p8_budget, p9_leaks, p9_shares, p10_shares,
    )
}
