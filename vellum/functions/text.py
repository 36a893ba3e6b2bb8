"""Cleaning, markers and metadata of document text, as expressions over columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space in the Unicode sense; the plain class of the regular expressions here is that of ASCII.
WS = r"[\s\p{Z}\x{85}\x{1C}-\x{1F}]"


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once however often it is used: plain projections are merged into all their uses, also within lambdas."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often the expression reads it."""
    return F.transform(F.array(value), use)[0]


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def clean_text(text: Column) -> Column:
    """Cleaned text of a scanned page in Latin script; NULL gives ''.

    Empty brackets and long runs of underscores and blanks become one space, '|' becomes I and 0 becomes O wherever they stand, and
    what is left of white space becomes single spaces.
    """
    out = F.coalesce(text, F.lit(""))
    for pattern in (rf"\[{WS}*\]", rf"\({WS}*\)", "_{3,}", f"{WS}{{3,}}"):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(F.regexp_replace(F.translate(out, "|0", "IO"), f"{WS}+", " "))


def clean_hindi_text(text: Column) -> Column:
    """Cleaned text of a scanned page in Devanagari; NULL gives ''. Lines are kept, lines of a number alone are dropped."""
    out = F.translate(F.coalesce(text, F.lit("")), "०१२३४५६७८९", "0123456789")
    for pattern, to in (
        (r"[ \t]{3,}", " "), (r"\n{4,}", "\n\n\n"), (rf"\[{WS}*\]", ""), (rf"\({WS}*\)", ""), ("_{3,}", ""),
        (rf"(?md)^{WS}*\p{{Nd}}+{WS}*$", ""), (rf"(?md)^{WS}*[ivxlcdm]+{WS}*$", ""), (" +", " "), ("\n ", "\n"), (" \n", "\n"),
    ):
        out = F.regexp_replace(out, pattern, to)
    return strip(out)


def devanagari_chars(text: Column) -> Column:
    """How many characters are Devanagari."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\x{0900}-\x{097F}]")), F.lit(0))


def devanagari_percentage(text: Column) -> Column:
    """Their share in percent, to one place, halves to even; 0 for an empty text."""
    n = F.length(text)
    return F.when(n > 0, F.bround(devanagari_chars(text) / n * 100, 1)).otherwise(F.lit(0.0))


# What marks a structure in a text, in the order in which structures of one start are listed. Case counts.
MARKERS = (
    ("definition", "definition:"), ("definition", "def:"), ("definition", "defined as"),
    ("example", "example:"), ("example", "for example:"), ("example", r"e\.g\."),
    ("theorem", "theorem:"), ("theorem", r"theorem\s+\d+"),
    ("exercise", "exercise:"), ("exercise", "questions:"),
    ("note", "note:"), ("note", "remember:"),
)


def structures(text: Column) -> Column:
    """array<struct<start_pos, ord, end_pos, kind, marker>> of every marker, overlapping ones too, by start, then by MARKERS."""
    return F.array_sort(F.flatten(F.array(*[_hits(text, order, kind, pattern) for order, (kind, pattern) in enumerate(MARKERS)])))


def _hits(text: Column, order: int, kind: str, pattern: str) -> Column:
    """The hits of one marker in one fold: each starts where the last one ended and the part between them is passed."""
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(hits)), hits, lambda n, m: F.struct(n.alias("gap"), m.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        hit = F.struct(start.alias("start_pos"), F.lit(order).alias("ord"), (start + F.length(x["m"])).alias("end_pos"), F.lit(kind).alias("kind"), x["m"].alias("marker"))
        return F.struct((start + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))

    empty = F.from_json(F.lit("[]"), "array<struct<start_pos: int, ord: int, end_pos: int, kind: string, marker: string>>")
    found = F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.isNotNull(), found)


def filename_stem(path: Column) -> Column:
    """The last part of a path without its last suffix."""
    return F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]*)?$", 1)


def filename_chapter(path: Column) -> Column:
    """The last two digits at the end of the stem as a number, else 'Unknown'."""
    digits = F.regexp_extract(filename_stem(path), r"([0-9]{2})$", 1)
    return F.when(digits == "", "Unknown").otherwise(digits.cast("int").cast("string"))


def series_chapter(path: Column, series: str = "jesc") -> Column:
    """The number after a series' prefix in a file name without leading zeros, '0' for zeros alone; NULL without the prefix."""
    number = F.regexp_extract(F.lower(filename_stem(path)), f"{series}([0-9]+)", 1)
    bare = F.regexp_replace(number, "^0+", "")
    return F.when(number != "", F.when(bare == "", "0").otherwise(bare))


def text_chapter(text: Column) -> Column:
    """The chapter named in the first 500 characters: a number, else Roman letters (any that follow), else NULL."""
    head = F.substring(text, 1, 500)
    number = F.regexp_extract(head, r"(?i)chapter\s+([0-9]+)", 1)
    roman = F.regexp_extract(head, r"(?i)chapter\s+([ivxlcdm]+)", 1)
    return F.coalesce(F.nullif(number, F.lit("")), F.nullif(roman, F.lit("")))


def text_section(text: Column) -> Column:
    """The section number in the first 1,000 characters, else NULL."""
    return F.nullif(F.regexp_extract(F.substring(text, 1, 1000), r"(?i)section\s+([0-9]+\.?[0-9]*)", 1), F.lit(""))


def hindi_subject(path: Column) -> Column:
    """The subject that a Hindi file's name tells."""
    low = F.lower(path)
    return F.when(low.contains("jhsc"), "Science").when(low.contains("jhss"), "Social Science").otherwise("Unknown")


def footer_page_number(text: Column) -> Column:
    """The page number in a page's last three lines, from the bottom up: a line of up to three digits, else the first such number in it."""
    lines = F.slice(F.reverse(F.split(strip(text), "\n")), 1, 3)
    found = F.transform(lines, lambda line: F.regexp_extract(line, r"(?<![\p{L}\p{N}_])([0-9]{1,3})(?![\p{L}\p{N}_])", 1))
    first = F.try_element_at(F.filter(found, lambda x: x != ""), F.lit(1))
    return F.when(F.coalesce(strip(text), F.lit("")) == "", "Unknown").otherwise(F.coalesce(first, F.lit("Unknown")))


def subject_slug(subject: Column) -> Column:
    """A subject as a folder is named: lower case, blanks as hyphens, every 'and' left out, hyphens dropped at the ends."""
    return F.regexp_replace(F.replace(F.replace(F.lower(subject), F.lit(" "), F.lit("-")), F.lit("and"), F.lit("")), "^-+|-+$", "")


def preview(text: Column, n: int, always: bool = False) -> Column:
    """The first n characters and '...', only where the text is longer unless `always`."""
    cut = F.concat(F.substring(text, 1, n), F.lit("..."))
    return cut if always else F.when(F.length(text) > n, cut).otherwise(text)
