"""Splitting oversized items at natural boundaries: a recursive hierarchy of separators, then greedy packing with trailing overlap."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import map_batches

LIMIT, OVERLAP = 2000, 200
#: From coarse to fine; a boundary stands after each match. What no level cuts is cut between characters.
LEVELS = (
    ("section", re.compile(r"\n[^\S\n]*\n[^\S\n]*\n+|\f+|\n(?=#{1,6} |(?:chapter|section|अध्याय|प्रकरण|باب|chapitre)\b)", re.I)),
    ("paragraph", re.compile(r"\n[^\S\n]*\n+")),
    ("sentence", re.compile(r"\n+|[.?!।۔؟]+(?=\s|$)")),
    ("word", re.compile(r"\s+")),
)
NATURAL = ("section", "paragraph", "sentence", "end")


def _units(text: str, start: int, end: int, level: int, limit: int, out: list[tuple[int, str]]) -> None:
    """Append (end of unit, name of the boundary there) for text[start:end] cut no finer than needed."""
    if end - start <= limit or len(text[start:end].strip()) <= limit:
        out.append((end, LEVELS[level - 1][0] if level else "end"))
        return
    if level == len(LEVELS):
        at = start
        while end - at > limit:
            at += limit
            out.append((at, "character"))
        out.append((end, LEVELS[level - 1][0]))
        return
    name, separator = LEVELS[level]
    at = start
    for m in separator.finditer(text, start, end):
        if at < m.end() < end:
            _units(text, at, m.end(), level + 1, limit, out)
            out[-1] = (m.end(), name)
            at = m.end()
    if at == start:
        _units(text, start, end, level + 1, limit, out)
    elif at < end:
        last = out[-1:]
        _units(text, at, end, level + 1, limit, out)
        if out[-1:] != last:
            out[-1] = (end, LEVELS[level - 1][0] if level else "end")


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """Pieces (start, end, boundary at the end) of at most limit characters, blanks at a piece's ends not counted.

    A piece begins overlap characters before the end of the one before, moved up to the next word's start; where a whole unit
    would no longer fit, the overlap is shortened rather than the unit cut. Pieces without their overlap give the text again.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    if not text:
        return []
    units: list[tuple[int, str]] = []
    _units(text, 0, len(text), 0, limit, units)
    pieces: list[tuple[int, int, str]] = []
    start, end, name = 0, 0, ""
    for unit_end, unit_name in units:
        if end and len(text[start:unit_end].strip()) > limit:
            pieces.append((start, end, name))
            least = max(end - overlap, start + 1, unit_end - limit)
            m = re.compile(r"(?<=\s)\S").search(text, least, end) if least < end else None
            start = m.start() if m else (min(least, end) if name == "character" else end)
        end, name = unit_end, unit_name
    pieces.append((start, end, "end"))
    return pieces


def split_oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_id, n_chars, pieces array<struct<start_pos, end_pos, boundary>>, longest): one row per row with a text above the limit.

    longest is the length of the longest piece, blanks at its ends not counted.

    Spaces at both ends of a text are not counted and not part of a piece; positions are into the text without them. Items within
    the limit, NULL texts and empty ones give no row. Every item is split by itself, so that no key is hot.
    """

    def cut(cols: dict[str, list]) -> dict[str, list]:
        pieces = [[{"start_pos": a, "end_pos": b, "boundary": c} for a, b, c in split_text(t, limit, overlap)] for t in cols["_t"]]
        longest = [max(len(t[p["start_pos"] : p["end_pos"]].strip()) for p in ps) for t, ps in zip(cols["_t"], pieces)]
        return {"item_id": cols["_k"], "n_chars": [len(t) for t in cols["_t"]], "pieces": pieces, "longest": longest}

    trimmed = df.select(F.col(key).cast("long").alias("_k"), F.trim(F.col(text)).alias("_t")).where(F.length("_t") > limit)
    schema = "item_id long, n_chars long, pieces array<struct<start_pos: long, end_pos: long, boundary: string>>, longest long"
    return map_batches(trimmed, cut, schema)


def cut_kind(split: DataFrame, src: str) -> DataFrame:
    """(src, item_id, cut): 'hard' for an item that had to be cut within a sentence, else 'natural'; repeated rows count once."""
    hard = F.exists("pieces", lambda p: p["boundary"].isin("word", "character"))
    return split.groupBy("item_id").agg(F.max(hard).alias("h")).select(
        F.lit(src).alias("src"), "item_id", F.when(F.col("h"), "hard").otherwise("natural").alias("cut")
    )
