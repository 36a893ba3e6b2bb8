"""Visually identical text: a compiled longest-match transducer over grapheme clusters.

One pass brings every text to one consistent form: full-width and font forms, ligatures, combining accents, blanks, invisible
characters and look-alike letters. What a reader can see stays: letter case, accents, punctuation, raised, lowered, circled and
fraction signs.

Every character is spelled by a precomputed table in letters and marks that have no plainer form; invisible ones are spelled as nothing.
The marks of a cluster are put in their canonical order, and a trie writes the longest sequences it knows as one letter. As what is
written is spelled as what was read, applying it again changes nothing, and invisible characters never matter.
"""

from __future__ import annotations

import functools
import unicodedata

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import map_batches

# Letters with the shape of another letter, and that letter; by script: Cyrillic, Greek, Armenian, Lisu, Cherokee, phonetic
# letters, Arabic letters and digits as Urdu writes them, hyphens.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "Ѵ": "V", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "ѵ": "v", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "Ϲ": "C", "Ϳ": "J", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    "Օ": "O", "օ": "o", "ս": "u", "հ": "h",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S",
    "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L",
    "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "ɑ": "a", "ɡ": "g",
    "ك": "ک", "ي": "ی", "ى": "ی", "ه": "ہ",
    "٠": "۰", "١": "۱", "٢": "۲", "٣": "۳", "٧": "۷", "٨": "۸", "٩": "۹",
    "‐": "-", "‑": "-",
}
# Letters that can also be written as a letter and signs, and so written; then a second way of writing one.
COMPOSED = {"आ": "अा", "ओ": "अो", "औ": "अौ", "ऑ": "अॉ", "ऐ": "एे"}
ALSO = {"अाॅ": "ऑ"}
# Kinds of Unicode decomposition that keep the look, and kinds that show a difference.
ALIKE = {"<wide>", "<narrow>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}
VISIBLE = {"<super>", "<sub>", "<circle>", "<square>", "<fraction>", "<vertical>"}

#: Where Unicode keeps characters that decompose, ideographs and Hangul syllables left out.
BLOCKS = (range(0x80, 0x3400), range(0xA000, 0xAC00), range(0xF900, 0x10000), range(0x10780, 0x107C0), range(0x11000, 0x12000), range(0x1D100, 0x1F200), range(0x1FBF0, 0x1FBFA), range(0x2F800, 0x2FA20))
#: Words whose form is remembered.
MEMORY = 300_000

_HIDDEN = regex.compile(r"\p{Default_Ignorable_Code_Point}")
_JAMO = regex.compile(r"[ᄀ-ᇿ가-힣]")


def _plain(ch: str) -> bool:
    """Whether a compatibility character looks like what it decomposes to."""
    parts = unicodedata.decomposition(ch).split()
    if parts[0] not in ALIKE:
        return False
    out = [chr(int(x, 16)) for x in parts[1:]]
    return not any(c.isspace() or unicodedata.decomposition(c).split(" ")[0] in VISIBLE for c in out)


def _spelled(ch: str) -> str:
    """A character in characters that have no plainer form."""
    if ch in COMPOSED:
        return COMPOSED[ch]
    parts = unicodedata.decomposition(ch).split()
    if not parts or parts[0].startswith("<") and not _plain(ch):
        return LOOK_ALIKES.get(ch, ch)
    return "".join(_spelled(chr(int(x, 16))) for x in parts if not x.startswith("<"))


class Transducer:
    """The compiled tables: how each character is spelled, and a trie of the sequences that are written as one letter."""

    def __init__(self) -> None:
        self.spell: dict[str, str] = {}
        written: dict[str, str] = {}

        def write(key: str, value: str) -> None:
            if written.setdefault(key, value) != value:
                raise ValueError(f"{key!r} would be written {written[key]!r} and {value!r}")

        for ch in (chr(o) for block in BLOCKS for o in block):
            if _HIDDEN.match(ch):
                self.spell[ch] = ""
                continue
            key = _spelled(ch)
            if key == ch:
                continue
            self.spell[ch] = key
            if len(key) > 1 and ch not in COMPOSED and len(value := unicodedata.normalize("NFC", key)) == 1:
                write(key, value)
        for ch in (chr(o) for o in range(0xE0000, 0xE1000)):
            self.spell[ch] = ""
        for ch, key in COMPOSED.items():
            write(key, ch)
        for key, ch in ALSO.items():
            write(key, ch)
        for key in self.spell.values():
            if any(self.spell.get(c, c) != c for c in key):
                raise ValueError(f"{key!r} can be spelled further")
        self.trie: dict = {}
        for key, value in written.items():
            node = self.trie
            for c in key:
                node = node.setdefault(c, {})
            node[""] = value
        self.attach: dict[str, bool] = {}

    def _attaches(self, c: str) -> bool:
        """Whether a character belongs to the cluster before it."""
        got = self.attach.get(c)
        if got is None:
            got = self.attach[c] = unicodedata.category(c)[0] == "M" or "ᅠ" <= c <= "ᇿ"
        return got

    def _write(self, cluster: list[str], out: list[str]) -> None:
        """Append the form of one cluster: marks in canonical order, then the longest sequences of the trie."""
        if len(cluster) == 1:
            out.append(cluster[0])
            return
        if _JAMO.match(cluster[0]):
            out.append(unicodedata.normalize("NFC", "".join(cluster)))
            return
        start = 0
        for i in range(len(cluster) + 1):
            if i == len(cluster) or not unicodedata.combining(cluster[i]):
                if i - start > 1:
                    cluster[start:i] = sorted(cluster[start:i], key=unicodedata.combining)
                start = i + 1
        i = 0
        while i < len(cluster):
            node, n, found, end = self.trie, i, cluster[i], i + 1
            while n < len(cluster) and (node := node.get(cluster[n])) is not None:
                n += 1
                if "" in node:
                    found, end = node[""], n
            out.append(found)
            i = end

    def __call__(self, word: str) -> str:
        """The form of a word without blanks."""
        out: list[str] = []
        cluster: list[str] = []
        for ch in word:
            for c in self.spell.get(ch, ch):
                if cluster and not self._attaches(c):
                    self._write(cluster, out)
                    cluster = []
                cluster.append(c)
        if cluster:
            self._write(cluster, out)
        return "".join(out)


@functools.cache
def transducer() -> Transducer:
    return Transducer()


class _Forms(dict):
    """The form of each word met."""

    def __missing__(self, word: str) -> str:
        if len(self) > MEMORY:
            self.clear()
        form = self[word] = word if word.isascii() else transducer()(word)
        return form


_FORMS = _Forms()


def canonical(text: str) -> str:
    """The one consistent form of a text; blanks at the ends are dropped. Applying it again changes nothing."""
    if text.isascii():
        return " ".join(text.split())
    return " ".join(filter(None, map(_FORMS.__getitem__, text.split())))


def with_canonical(df: DataFrame, text: str = "text", out: str = "canonical_text") -> DataFrame:
    """df with the consistent form of one column. NULL stays NULL, an empty text or one of blanks only gives ''.

    All other columns pass through untouched, whatever their names; a column named as out is replaced.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def form(s):  # noqa: ANN001, ANN202
        return s.map(lambda t: None if t is None else canonical(t))

    return df.withColumn(out, form(F.col(text)))


def text_keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form, raw): 128-bit hashes of the consistent form and of the text as stored, one row per row. NULL texts are left out."""
    import xxhash

    digest = xxhash.xxh3_128_digest

    def keys(cols: dict[str, list]) -> dict[str, list]:
        ids, forms, raws = [], [], []
        for k, t in zip(cols["_k"], cols["_t"]):
            ids.append(k)
            forms.append(digest(canonical(t).encode("utf-8", "surrogatepass")))
            raws.append(digest(t.encode("utf-8", "surrogatepass")))
        return {"key": ids, "form": forms, "raw": raws}

    src = df.select(F.col(key).cast("long").alias("_k"), F.col(text).alias("_t")).where("_t is not null and _k is not null")
    return map_batches(src, keys, "key long, form binary, raw binary")


def look_alike_groups(df: DataFrame, key: str = "chunk_uid", text: str = "text") -> DataFrame:
    """(key, group_id, variant, form): records whose texts look the same share a group; variant tells texts of differing code points apart.

    Only groups of at least two variants come out, one row per record, so exact copies cost one row each and are never paired. A key
    delivered several times with one text is one record. Keys or texts that are NULL are left out; an empty table gives no rows. A group
    of any size is summed up before it is shuffled, and joined to its sum by rows.
    """
    rows = text_keys(df, key, text).distinct()
    several = rows.groupBy("form").agg(F.min("raw").alias("a"), F.max("raw").alias("b"), F.min("key").alias("group_id")).where("a <> b").select("form", "group_id")
    return rows.join(several, "form").select("key", "group_id", F.col("raw").alias("variant"), "form")


def look_alike_pairs(df: DataFrame, key: str = "chunk_uid", text: str = "text") -> DataFrame:
    """(a, b), a < b: pairs of records that look the same and differ in code points.

    Variants meet first and their records after, so that copies of one variant never meet each other.
    """
    g = look_alike_groups(df, key, text)
    variants = g.select("form", "variant").distinct()
    differ = variants.withColumnRenamed("variant", "va").join(variants.withColumnRenamed("variant", "vb"), "form").where("va < vb").select("va", "vb")
    x = g.select(F.col("key").alias("x"), F.col("variant").alias("va"))
    y = g.select(F.col("key").alias("y"), F.col("variant").alias("vb"))
    both = differ.join(x, "va").join(y, "vb").where("x <> y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
