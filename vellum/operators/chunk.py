"""Chunking of cleaned documents: by structure where markers are known, else by size with overlap.

The chunks of a document are cut, stripped, sifted and numbered within one array, so that no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import bind, once, strip

LEAST_STRUCTURE = 50


def token_spans(text: Column, chunk_size: int = 500, chunk_overlap: int = 50) -> Column:
    """array<struct<start_pos, end_pos>> of overlapping chunks, four characters to a token.

    A chunk ends after the last sentence end in its last `overlap` characters if there is one; the next begins `overlap` characters
    before that end. The last end may lie beyond the text. One fold per text, in the JVM.
    """
    size, overlap = chunk_size * 4, chunk_overlap * 4
    if size <= 2 * overlap:
        raise ValueError("chunk_size must be more than twice chunk_overlap")
    n = F.length(text)

    def step(acc: Column, _: Column) -> Column:
        s, full = acc["s"], acc["s"] + size
        window = F.reverse(F.substring(text, F.greatest(full - overlap, s) + 1, F.lit(overlap)))
        last = lambda w: F.greatest(*[F.when(F.instr(w, p) > 0, overlap - F.instr(w, p) - 1).otherwise(-1) for p in (" .", "\n.", "\n?", "\n!")])
        end = bind(bind(window, last), lambda at: F.when((full < n) & (at >= 0), full - overlap + at + 1).otherwise(full))
        grown = lambda e: F.concat(acc["out"], F.array(F.struct(s.alias("start_pos"), e.alias("end_pos"))))
        after = bind(end, lambda e: F.struct(F.when(e < n, e - overlap).otherwise(n).alias("s"), grown(e).alias("out")))
        return F.when(s < n, after).otherwise(acc)

    empty = F.from_json(F.lit("[]"), "array<struct<start_pos: int, end_pos: int>>")
    start = F.struct(F.lit(0).alias("s"), empty.alias("out"))
    rounds = F.sequence(F.lit(0), F.floor(n / (size - 2 * overlap + 1)).cast("int"))
    return F.when(n > 0, F.aggregate(rounds, start, step, lambda acc: acc["out"])).otherwise(empty)


def token_pieces(text: Column, chunk_size: int = 500, chunk_overlap: int = 50) -> Column:
    """array<struct<start_pos, end_pos, structure_type, text>> of the chunks by size, blank ones left out."""

    def piece(s: Column) -> Column:
        body = strip(F.substring(text, s["start_pos"] + 1, s["end_pos"] - s["start_pos"]))
        return F.struct(s["start_pos"].alias("start_pos"), s["end_pos"].alias("end_pos"), F.lit(None).cast("string").alias("structure_type"), body.alias("text"))

    return F.filter(F.transform(token_spans(text, chunk_size, chunk_overlap), piece), lambda p: p["text"] != "")


def structure_pieces(text: Column, structures: Column, aligned_types: bool = False) -> Column:
    """array<struct<start_pos, end_pos, structure_type, text>> of the segments between markers, short ones left out.

    A segment has the kind of the structure of its own number, so that the text before the first marker has the first one's; with
    aligned_types it has that of the marker it begins with.
    """
    bounds = F.concat(F.array(F.lit(0)), F.transform(structures, lambda x: x["start_pos"]), F.array(F.length(text)))
    kinds, none = F.transform(structures, lambda x: x["kind"]), F.array(F.lit(None).cast("string"))
    kinds = F.concat(none, kinds) if aligned_types else F.concat(kinds, none)

    def piece(b: Column, i: Column) -> Column:
        start, end = b, F.element_at(bounds, i + 2)
        body = strip(F.substring(text, start + 1, F.greatest(end - start, F.lit(0))))
        return F.struct(start.alias("start_pos"), end.alias("end_pos"), F.element_at(kinds, i + 1).alias("structure_type"), body.alias("text"))

    return F.filter(F.transform(F.slice(bounds, F.lit(1), F.size(bounds) - 1), piece), lambda p: F.length(p["text"]) >= LEAST_STRUCTURE)


def _chunks(df: DataFrame, pieces: Column, key: str, keep: tuple[str, ...]) -> DataFrame:
    """A row for each piece: its place, text and size, its number and how many there are."""
    # The outer form, as the inner one adds a filter for which all pieces would be cut a second time.
    cut = once(df, "_p", pieces).select(key, *keep, F.size("_p").alias("total_chunks"), F.posexplode_outer("_p").alias("chunk_index", "_p")).where("chunk_index is not null")
    return cut.select(
        key, *keep, "_p.start_pos", "_p.end_pos", "_p.structure_type", "_p.text", F.length("_p.text").alias("char_count"), "chunk_index", "total_chunks", F.col("chunk_index").alias("chunk_id")
    )


def by_tokens(df: DataFrame, key: str, text: str, chunk_size: int = 500, chunk_overlap: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, start_pos, end_pos, text, char_count, token_count, chunk_index, total_chunks, chunk_id): chunks by size, blank ones left out."""
    chunks = _chunks(df, token_pieces(F.col(text), chunk_size, chunk_overlap), key, keep).drop("structure_type")
    return chunks.withColumn("token_count", F.floor(F.col("char_count") / 4).cast("int"))


def by_structure(df: DataFrame, key: str, text: str, structures: str = "structures", aligned_types: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, start_pos, end_pos, structure_type, text, char_count, chunk_index, total_chunks, chunk_id): segments between markers.

    structures is an array of structs with start_pos and kind in order of start. Documents without any give no row. See structure_pieces().
    """
    return _chunks(df.where(F.size(structures) > 0), structure_pieces(F.col(text), F.col(structures), aligned_types), key, keep)


def chunk_documents(df: DataFrame, key: str = "doc_id", text: str = "cleaned_text", structures: str = "structures", chunk_size: int = 500, chunk_overlap: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """Both ways in one pass and schema: documents with structures by structure, all others by size (only these have a token_count)."""
    has = F.coalesce(F.size(structures), F.lit(0)) > 0
    pieces = F.when(has, structure_pieces(F.col(text), F.col(structures))).otherwise(token_pieces(F.col(text), chunk_size, chunk_overlap))
    chunks = _chunks(df.withColumn("_has", has), pieces, key, ("_has", *keep))
    return chunks.withColumn("token_count", F.when(~F.col("_has"), F.floor(F.col("char_count") / 4).cast("int"))).drop("_has")
