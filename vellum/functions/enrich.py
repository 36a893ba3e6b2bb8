"""What a chunk is about: content type, flags, keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import bind

# Content types with what tells them, the first that matches wins.
CONTENT_TYPES = (
    ("definition", r"(definition|defined as|is called|is known as)[:.]"),
    ("example", r"(example|for example|for instance|let us consider)[:.]"),
    ("theorem", r"(theorem|law|principle)[:.]"),
    ("exercise", r"(exercise|activity|question|solve|calculate)s?[:.]"),
    ("note", r"(note|remember|important)[:.]"),
    ("figure", r"(figure|fig\.|diagram|table)\s+[0-9]"),
)
# Words that are no keyword.
STOPWORDS = tuple("the a an and or but in on at to for of with by from as is are was were be this that these those it its will can may".split())


def content_type(text: Column) -> Column:
    """One of CONTENT_TYPES, 'chapter_heading' for a short text that says chapter, else 'explanation'."""
    out = F
    for name, pattern in CONTENT_TYPES:
        out = out.when(text.rlike(f"(?i){pattern}"), name)
    return out.when(F.lower(text).contains("chapter") & (F.length(text) < 500), "chapter_heading").otherwise("explanation")


def has_equations(text: Column) -> Column:
    """Whether the text has a sign of arithmetic, a bracket, a decimal, an arrow or a dash."""
    return text.rlike(r"[=+\-*/()]|[0-9]+\.[0-9]+|→|—")


def has_questions(text: Column) -> Column:
    """Whether the text asks or sets something."""
    return text.rlike(r"(?i)\?|(question|exercise|activity)")


def plain_words(text: Column) -> Column:
    """Words of three or more plain Latin letters in lower case, in order; a word with any other letter in it is none."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.filter(runs, lambda w: w.rlike("^[a-z]{3,}$"))


def keyword_array(text: Column, n: int = 5) -> Column:
    """The n most frequent plain words of a text but STOPWORDS, the one that stands first before others as frequent; [] where there is none.

    Words are sorted, equal neighbours counted, and the counts sorted: no shuffle, and no word is compared with all others.
    """
    words = F.filter(plain_words(F.coalesce(text, F.lit(""))), lambda w: ~w.isin(*STOPWORDS))
    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("first"))))

    def ranked(s: Column) -> Column:
        numbered = F.transform(s, lambda x, k: F.struct(x["word"].alias("word"), x["first"].alias("first"), k.alias("k")))
        heads = F.filter(numbered, lambda x: (x["k"] == 0) | (F.get(s, x["k"] - 1)["word"] != x["word"]))
        count = lambda h, x, j: F.struct((x["k"] - F.coalesce(F.get(h, j + 1)["k"], F.size(s))).alias("n"), x["first"].alias("first"), x["word"].alias("word"))
        return bind(heads, lambda h: F.array_sort(F.transform(h, lambda x, j: count(h, x, j))))

    return F.slice(F.transform(bind(placed, ranked), lambda x: x["word"]), 1, n)


def keywords(df: DataFrame, key: str, text: str, n: int = 5) -> DataFrame:
    """(key, keywords): keyword_array() of each row; NULL keys are left out."""
    return df.where(F.col(key).isNotNull()).select(key, keyword_array(F.col(text), n).alias("keywords"))
