"""Noise in text from scanned pages: running lines and page numbers at the edges, words cut at line ends, misrecognised characters.

Misread words are found in SQL: the anagram hash of a word is the sum of its characters' fifth powers, so that a confusion of characters
is a fixed difference of hashes, and a rare word meets its frequent variants in an equi-join on hash plus difference. Ranked corrections,
edge lines and hyphen evidence are then applied scan by scan.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.common import map_batches, stored

# What a scanner writes, and what stood there.
CONFUSIONS = (
    ("rn", "m"), ("vv", "w"), ("li", "h"), ("cl", "d"), ("ii", "u"), ("c", "e"), ("0", "o"), ("1", "l"), ("|", "l"), ("!", "i"), ("5", "s"),
    ("9", "g"), ("6", "b"), ("8", "b"), ("@", "a"), ("$", "s"),
    ("व", "ब"), ("म", "भ"), ("प", "ष"), ("य", "थ"), ("घ", "ध"), ("ड", "ङ"), ("ट", "ठ"),
)
# Characters at which a word is cut at a line's end.
HYPHENS = "-‐‑¬­–"
# Words for a page and for a chapter, in lower case.
PAGE_WORDS = ("p.", "p", "pg.", "page", "पृष्ठ", "पृ.", "पान", "صفحہ", "ص")
CHAPTER_WORDS = ("chapter", "chapitre", "अध्याय", "प्रकरण", "باب", "lesson", "unit")

#: How many times as frequent a variant must be, and how often it must stand, for a word of plain letters and for one with signs or digits in it.
RATIO, LEAST, ODD_RATIO, ODD_LEAST = 6, 4, 1, 2
#: Characters of a line, and words of one without a page number beside it, beyond which it must recur on half of the pages to be a running line.
LONG, LONG_ALONE = 90, 9
#: Corrections and compounds one task holds at once; more are applied block after block.
BLOCK = 400_000

_EDGE = ".,?;:\"'()।۔؟،؛«»[]“”‘’*" + HYPHENS
_ODD = re.compile(r"[0-9@|!$]")
_LETTER = re.compile(r"[^\W\d_]")
_NUMBER = r"[0-9०-९۰-۹٠-٩]{1,4}"
_PAGE = re.compile(rf"(?:(?:{'|'.join(re.escape(w) for w in PAGE_WORDS)})\s*)?(?:[\[(|–-]\s*)?{_NUMBER}(?:\s*[\])|–-])?", re.I)
_GAP = re.compile(r"\s{2,}|\t")
_CHAPTER = re.compile(rf"(?:{'|'.join(CHAPTER_WORDS)})\s*{_NUMBER}(?:\s+[^\W\d_][\w'’-]*){{0,3}}")
_SENTENCE_END = tuple(".,;:?!।۔؟،\"”»")
_LONE = re.compile(rf"(?<!\w){_NUMBER}(?!\w)")


def clean_word(token: str) -> str:
    """The word of a blank-separated token in lower case: punctuation at its ends dropped, but signs that may be misread letters kept."""
    return token.strip(_EDGE).rstrip("!").lower()


def broken(lines: list[str]) -> list[tuple[int, str, str]]:
    """(line, left, right) of words cut at the end of a line, the hyphen left out; right is the next line's first token, '' if there is none."""
    out = []
    for i, line in enumerate(lines):
        end = line.rstrip()
        if len(end) > 1 and end[-1] in HYPHENS and _LETTER.match(end[-2]) or len(end) > 1 and end[-1] in HYPHENS and ord(end[-2]) > 0x900:
            left = end[:-1].split()[-1]
            after = lines[i + 1].split() if i + 1 < len(lines) else []
            out.append((i, left, after[0] if after else ""))
    return out


def word_counts(scans: DataFrame, pages: str = "pages") -> DataFrame:
    """(word, count, lefts): how often each word stands on any page; words cut at a line's end count whole.

    Words with a hyphen of their own are counted too, only where they stand within a line.
    """

    def count(cols: dict[str, list]) -> dict[str, list]:
        raw: Counter = Counter()
        whole: Counter = Counter()
        for page_list in cols["_p"]:
            for text in page_list or ():
                if not text:
                    continue
                raw.update(text.split())
                lines = [x for x in text.split("\n") if x.strip()]
                for i, left, right in broken(lines):
                    raw[lines[i].split()[-1]] -= 1
                    if right:
                        raw[right] -= 1
                        if "-" not in left + right:  # else it may have been cut at a hyphen of its own
                            whole[clean_word(left + right)] += 1
        for token, n in raw.items():
            if n > 0:
                whole[clean_word(token)] += n
        kept = [(w, n) for w, n in whole.items() if len(w) > 1 and _LETTER.search(w)]
        return {"word": [w for w, _ in kept], "count": [n for _, n in kept]}

    src = scans.select(F.transform(pages, lambda p: p["text"]).alias("_p"))
    return map_batches(src, count, "word string, count long").groupBy("word").agg(F.sum("count").alias("count"))


def anagram_hash(word: Column) -> Column:
    """The sum of the fifth powers of the characters' codes, each kept to 40 bits; the order of the characters does not count."""
    chars = F.filter(F.split(word, ""), lambda c: c != "")

    def power(c: Column) -> Column:
        o = F.ascii(c).cast("long")
        return o * o % _MOD * o % _MOD * o * o % (1 << 40)

    return F.aggregate(chars, F.lit(0).cast("long"), lambda a, c: a + power(c))


#: Powers are kept below 2 ** 40, so that no sum overflows.
_MOD = 1 << 20


def _power(ch: str) -> int:
    o = ord(ch)
    return o * o % _MOD * o % _MOD * o * o % (1 << 40)


def _differences() -> list[tuple[str, str, str, str, int]]:
    """(wrong 1, right 1, wrong 2, right 2, difference of the hashes) for one confusion or two."""
    h = lambda s: sum(map(_power, s))
    one = [(a, b, "", "", h(b) - h(a)) for a, b in CONFUSIONS]
    two = [(a, b, c, d, h(b) - h(a) + h(d) - h(c)) for i, (a, b) in enumerate(CONFUSIONS) for c, d in CONFUSIONS[i:]]
    return one + two


def _reaches(wrong: str, right: str, swaps: list[tuple[str, str]]) -> bool:
    """Whether the swaps, each at one place, turn wrong into right."""
    if not swaps:
        return wrong == right
    a, b = swaps[0]
    at = wrong.find(a)
    while at >= 0:
        if _reaches(wrong[:at] + b + wrong[at + len(a) :], right, swaps[1:]):
            return True
        at = wrong.find(a, at + 1)
    return False


def corrections(counts: DataFrame) -> DataFrame:
    """(word, correct): words that confusions of characters make of a far more frequent word, with the best ranked of those.

    Fewer confusions rank before more, then more frequent words, then the alphabet. So many words are a confusion away from one of two
    letters that only a word with a digit or sign in it is taken for one, and only where that is far more frequent.
    """
    words = counts.where(F.length("word") > 1).withColumn("hash", anagram_hash(F.col("word")))
    odd = F.col("word").rlike(_ODD.pattern)
    differences = _differences()

    def shift(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {x: [] for x in ("word", "n", "odd", "w1", "r1", "w2", "r2", "hash")}
        for w, n, h, o in zip(cols["word"], cols["count"], cols["hash"], cols["odd"]):
            for w1, r1, w2, r2, d in differences:
                if w1 in w and w2 in w:
                    for name, v in zip(out, (w, n, o, w1, r1, w2, r2, h + d)):
                        out[name].append(v)
        return out

    schema = "word string, n long, odd boolean, w1 string, r1 string, w2 string, r2 string, hash long"
    tried = map_batches(words.select("word", "count", "hash", odd.alias("odd")), shift, schema)
    frequent = words.where(~odd & (F.col("count") >= ODD_LEAST)).select("hash", F.col("word").alias("correct"), F.col("count").alias("m"))
    many = (F.col("m") >= LEAST) & (F.col("m") >= F.col("n") * RATIO)
    some = (F.col("m") >= ODD_LEAST) & (F.col("m") >= F.col("n") * ODD_RATIO)
    met = tried.join(frequent, "hash").where(F.when(F.length("correct") == 2, F.col("odd") & many).when(F.col("odd"), some).otherwise(many))

    def verify(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"word": [], "correct": [], "steps": [], "m": []}
        for w, c, w1, r1, w2, r2, m in zip(*(cols[x] for x in ("word", "correct", "w1", "r1", "w2", "r2", "m"))):
            swaps = [(w1, r1)] + ([(w2, r2)] if w2 else [])
            if _reaches(w, c, swaps):
                for name, v in zip(out, (w, c, len(swaps), m)):
                    out[name].append(v)
        return out

    right = map_batches(met.select("word", "correct", "w1", "r1", "w2", "r2", "m"), verify, "word string, correct string, steps int, m long")
    best = F.row_number().over(W.partitionBy("word").orderBy("steps", F.desc("m"), "correct"))
    found = stored(right.withColumn("r", best).where("r = 1").select("word", "correct"), "variants")
    onward = found.select(F.col("word").alias("correct"), F.col("correct").alias("further"))  # a variant that is itself misread
    return found.join(onward, "correct", "left").select("word", F.coalesce("further", "correct").alias("correct"))


def compounds(counts: DataFrame) -> DataFrame:
    """(form): words with a hyphen of their own, and endings ('-' first) that follow at least five different words."""
    own = counts.where(F.col("word").rlike(r"^[^\s-]+(?:-[^\s-]+)+$") & (F.col("count") >= 2))
    parts = own.select("word", F.split("word", "-").alias("p"))
    cut = parts.select("word", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("i"))
    ends = cut.select(F.concat(F.lit("-"), F.array_join(F.slice("p", F.col("i") + 1, F.size("p")), "-")).alias("form"), F.array_join(F.slice("p", F.lit(1), F.col("i")), "-").alias("left"))
    many = ends.groupBy("form").agg(F.countDistinct("left").alias("n")).where("n >= 5").select("form")
    return own.select(F.col("word").alias("form")).union(many)


# Characters that misreadings confuse, as one of them; then pairs that stand for one.
_SKELETON = str.maketrans({"0": "o", "1": "l", "|": "l", "!": "l", "i": "l", "5": "s", "9": "g", "6": "b", "8": "b", "@": "a", "$": "s", "c": "e", "ब": "व", "भ": "म", "ष": "प", "थ": "य"})
_PAIRS = (("rn", "m"), ("vv", "w"), ("ll", "h"), ("el", "d"))


def skeleton(line: str) -> str:
    """A line as all its misreadings would have it: case, blanks and confusable characters do not count."""
    s = "".join(line.casefold().split()).translate(_SKELETON)
    for a, b in _PAIRS:
        s = s.replace(a, b)
    return s


def _edge_line(line: str) -> tuple[bool, str]:
    """Whether a line holds a page number alone or beside other text, and that text ('' if none)."""
    t = line.strip()
    if _PAGE.fullmatch(t):
        return True, ""
    cells = [c for c in _GAP.split(t) if c]
    if len(cells) > 1:
        wide = line.strip()
        for number, rest in ((cells[0], cells[1:]), (cells[-1], cells[:-1])):
            if _PAGE.fullmatch(number) and not (len(rest) == 1 and _PAGE.fullmatch(rest[0])):
                text = wide[len(number) :] if number is cells[0] else wide[: -len(number)]
                return True, text.strip()
    return False, t


def _make(text: str) -> str:
    """What running lines of one make share: the skeleton with its numbers left out."""
    return skeleton(_LONE.sub("#", text))


def _bodies(pages: list[dict], title: str | None) -> tuple[list[set[str]], list[list[str]]]:
    """Of each page, the defects of its edges and the lines that are left without running lines and page numbers."""
    wanted = skeleton(title) if title else None
    chapter = [skeleton(w) for w in CHAPTER_WORDS]
    split = [[x for x in (p["text"] or "").split("\n")] for p in pages]
    edges: list[list[tuple[int, bool, str]]] = []
    makes: Counter = Counter()
    for lines in split:
        full = [i for i, x in enumerate(lines) if x.strip()]
        near = dict.fromkeys([*full[:3], *full[-3:]])
        here = [(i, *_edge_line(lines[i])) for i in near]
        edges.append(here)
        makes.update({_make(t) for _, _, t in here if t and not t.endswith(_SENTENCE_END)})

    def running(text: str, alone: bool) -> bool:
        if not text or not _LETTER.search(text):
            return False
        s = skeleton(text)
        if wanted and s == wanted:
            return True
        plain = _LONE.sub("#", " ".join(text.casefold().split()))
        head = skeleton(plain.split("#")[0])
        if "#" in plain and plain.count("#") == 1 and head in chapter and len(plain.split()) <= 5 and not set(plain) & set(".।۔,;:"):
            return True
        if text.endswith(_SENTENCE_END):
            return False
        long = len(text) > LONG or alone and len(text.split()) > LONG_ALONE
        return makes[_make(text)] >= (max(3, len(pages) / 2) if long else 2)

    defects, bodies = [], []
    for lines, here in zip(split, edges):
        found: set[str] = set()
        known = {i: (number, text) for i, number, text in here}
        drop: set[int] = set()
        full = [i for i, x in enumerate(lines) if x.strip()]
        for order in (full[:3], full[::-1][:3]):
            for i in order:
                number, text = known[i]
                head = running(text, not number)
                if not head and not (number and not text):
                    break
                drop.add(i)
                found |= {"header"} if head else set()
                found |= {"page_number"} if number else set()
        bodies.append([x for i, x in enumerate(lines) if i not in drop])
        defects.append(found)
    return defects, bodies


def _cuts(bodies: list[list[str]], n: int) -> list[tuple[int, str, str]]:
    """broken() of the n-th body, whose last line goes on with the next body."""
    full = [x for x in bodies[n] if x.strip()]
    after = next((x for b in bodies[n + 1 : n + 2] for x in b if x.strip()), "")
    return [c for c in broken([*full, after] if after else full) if c[0] < len(full)]


def read_scan(pages: list[dict], title: str | None, fixes: dict[str, str], forms: Forms) -> tuple[list[list[str]], list[str]]:
    """Defects of each page, and each page's repaired text."""
    defects, bodies = _bodies(pages, title)
    texts = []
    for n, body in enumerate(bodies):
        cut = {}
        for i, left, right in _cuts(bodies, n):
            if not _own_hyphen(left, right, forms):
                defects[n].add("hyphen")
                cut[i] = True
            else:
                cut[i] = False
        texts.append(_reflow(body, cut, fixes))
    for n, page in enumerate(pages):
        if any(_fix(fixes, t) for t in (page["text"] or "").split()):
            defects[n].add("misread")
            continue
        for _, left, right in broken([x for x in (page["text"] or "").split("\n") if x.strip()]):
            if right and clean_word(left + right) in fixes:
                defects[n].add("misread")
    return [sorted(d) for d in defects], texts


def _fix(fixes: dict[str, str], token: str) -> str | None:
    """The correction of a token's word, if it has one."""
    return fixes.get(clean_word(token))


class Forms:
    """Compounds, to be looked up whole, by a beginning that ends before a hyphen, and by their skeleton."""

    def __init__(self, forms: Iterable[str]) -> None:
        self.whole = set(forms)
        self.starts = {f[:i] for f in self.whole for i, c in enumerate(f) if c == "-" and i}
        self.skeletons: dict[str, list[str]] = {}
        for f in self.whole:
            self.skeletons.setdefault(skeleton(f), []).append(f)


def _own_hyphen(left: str, right: str, forms: Forms) -> bool:
    """Whether a word was cut at a hyphen of its own, by the evidence of words that stand within lines."""
    a, b = left.lstrip(_EDGE).lower(), right.rstrip(_EDGE + "!").lower()
    if not b:
        return a in forms.starts
    if f"{a}-{b}" in forms.whole or f"-{b}" in forms.whole:
        return True
    if _ODD.search(a + b):
        alike = forms.skeletons.get(skeleton(f"{a}-{b}"), ())
        return any(f[0] == a[:1] or len(f) in range(len(a + b) - 1, len(a + b) + 4) for f in alike)
    return False


def _corrected(line: str, fixes: dict[str, str]) -> str:
    out = []
    for token in line.split():
        right = _fix(fixes, token)
        if right:
            word = clean_word(token)
            at = token.lower().find(word)
            shown = right.upper() if token[at : at + len(word)].isupper() and len(word) > 1 else right[0].upper() + right[1:] if token[at : at + 1].isupper() else right
            token = token[:at] + shown + token[at + len(word) :]
        out.append(token)
    return " ".join(out)


def _reflow(body: list[str], cut: dict[int, bool], fixes: dict[str, str]) -> str:
    """The lines as paragraphs, which only blank lines part: cut words joined, others parted by a space."""
    out, n, glue = "", -1, True
    for line in body:
        if not line.strip():
            if out and not out.endswith("\n\n"):
                out = out.rstrip() + "\n\n"
                glue = True
            continue
        n += 1
        text = line.strip()
        out += ("" if glue or not out else " ") + text
        glue = False
        if n in cut:
            out = out[:-1] + ("" if cut[n] else "-")
            glue = True
    return "\n\n".join(_corrected(p, fixes) for p in out.strip().split("\n\n"))


def repaired_scans(scans: DataFrame, titles: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(item_id, pages array<struct<page_number, defects, text>>, full_text): one row per distinct scan with its defects and repaired text.

    Statistics are over all scans. titles (filename, title) tells running lines that carry a book's title on one page only. Failed or
    empty pages have no defect and an empty text; NULL pages are no page. full_text joins pages that break off within a sentence.
    """
    counts = stored(word_counts(scans), "words")
    fixes, forms = stored(corrections(counts), "corrections"), stored(compounds(counts), "compounds")
    source = scans.select(F.col(key).cast("long").alias("_k"), F.col("pages").alias("_p"), *(["filename"] if titles is not None else [])).where("_k is not null and _p is not null")
    if titles is not None:
        named = titles.select("filename", F.col("title").alias("_title")).dropDuplicates(["filename"])
        source = source.join(F.broadcast(named) if titles.count() <= BLOCK else named, "filename", "left").select("_k", "_p", "_title")
    else:
        source = source.withColumn("_title", F.lit(None).cast("string"))
    schema = "item_id long, pages array<struct<page_number: int, defects: array<string>, text: string>>, full_text string"
    if fixes.count() + forms.count() <= BLOCK:
        known = scans.sparkSession.sparkContext.broadcast(({r["word"]: r["correct"] for r in fixes.collect()}, Forms(r["form"] for r in forms.collect())))
        return map_batches(source, _reader(known), schema)
    return map_batches(_with_evidence(source, fixes, forms), _reader(None), schema)


class _Asked(dict):
    """Corrections that knows none and notes the words it is asked for."""

    def __init__(self) -> None:
        self.words: set[str] = set()

    def get(self, word: str, default: str | None = None) -> str | None:
        self.words.add(word)
        return default

    def __contains__(self, word: object) -> bool:
        self.words.add(str(word))
        return False


def _with_evidence(source: DataFrame, fixes: DataFrame, forms: DataFrame) -> DataFrame:
    """source with the corrections and compounds that each scan can meet, by joins alone: the way where they are too many for a task.

    First the compounds that bear on the words cut in the scan, by the whole, the beginning and the skeleton; then, as these tell how
    words are joined, the corrections of all words that read_scan() asks for.
    """

    def wants(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"_k": [], "sort": [], "key": []}
        for k, pages, title in zip(cols["_k"], cols["_p"], cols["_title"]):
            mine: set[tuple[str, str]] = set()
            _, bodies = _bodies([p for p in pages if p is not None], title)
            for n in range(len(bodies)):
                for _, left, right in _cuts(bodies, n):
                    a, b = left.lstrip(_EDGE).lower(), right.rstrip(_EDGE + "!").lower()
                    if b:
                        mine |= {("whole", f"{a}-{b}"), ("whole", f"-{b}")} | ({("skeleton", skeleton(f"{a}-{b}"))} if _ODD.search(a + b) else set())
                    elif a:
                        mine.add(("start", a))
            out["_k"] += [k] * len(mine)
            out["sort"] += [x for x, _ in mine]
            out["key"] += [x for _, x in mine]
        return out

    def offers(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"sort": [], "key": [], "form": []}
        for f in cols["form"]:
            keys = [("whole", f), ("skeleton", skeleton(f)), *(("start", f[:i]) for i, c in enumerate(f) if c == "-" and i)]
            out["sort"] += [x for x, _ in keys]
            out["key"] += [x for _, x in keys]
            out["form"] += [f] * len(keys)
        return out

    def asks(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"_k": [], "word": []}
        for k, pages, title, mine in zip(cols["_k"], cols["_p"], cols["_title"], cols["_forms"]):
            asked = _Asked()
            read_scan([p for p in pages if p is not None], title, asked, Forms(mine or ()))
            out["_k"] += [k] * len(asked.words)
            out["word"] += asked.words
        return out

    offered = map_batches(forms, offers, "sort string, key string, form string")
    # Any form with a beginning proves it, so one is enough.
    starts = offered.where("sort = 'start'").groupBy("sort", "key").agg(F.min("form").alias("form"))
    offered = offered.where("sort <> 'start'").union(starts)
    wanted = map_batches(source.select("_k", "_p", "_title"), wants, "_k long, sort string, key string").distinct()
    own = wanted.join(offered, ["sort", "key"]).groupBy("_k").agg(F.collect_set("form").alias("_forms"))
    source = source.join(own, "_k", "left")
    asked = map_batches(source.select("_k", "_p", "_title", "_forms"), asks, "_k long, word string").distinct()
    right = asked.join(fixes, "word").groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("word", "correct"))).alias("_fixes"))
    return source.join(right, "_k", "left")


def _reader(known):  # noqa: ANN001, ANN202
    def read(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"item_id": [], "pages": [], "full_text": []}
        for row, (k, pages, title) in enumerate(zip(cols["_k"], cols["_p"], cols["_title"])):
            fixes, forms = known.value if known else (dict(cols["_fixes"][row] or ()), Forms(cols["_forms"][row] or ()))
            pages = [p for p in pages if p is not None]
            defects, texts = read_scan(pages, title, fixes, forms)
            out["item_id"].append(k)
            out["pages"].append([{"page_number": p["page_number"], "defects": d, "text": t} for p, d, t in zip(pages, defects, texts)])
            whole = ""
            for t in texts:
                if t:
                    whole += ("" if not whole else " " if not whole.endswith(_SENTENCE_END) else "\n\n") + t
            out["full_text"].append(whole)
        return out

    return read


def page_defects(repaired: DataFrame) -> DataFrame:
    """(doc_id, page_number, defect): one row for each page and sort of defect."""
    page = repaired.select(F.col("item_id").alias("doc_id"), F.explode("pages").alias("p"))
    return page.select("doc_id", F.col("p.page_number").alias("page_number"), F.explode("p.defects").alias("defect")).distinct()
