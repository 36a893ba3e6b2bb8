"""Reading level: classic readability formulas from sentence length and syllable counts, combined by the median of their grades.

Each formula joins sentence length with one measure of word difficulty: Flesch-Kincaid (syllables a word), Coleman-Liau (letters a
word), Gunning fog (share of words of three syllables), a form of Linsear Write (share of words of two) and SMOG (words of three
syllables a sentence). As published they are linear and fitted to other texts: very long easy sentences and very short hard ones mislead
them. So each formula is fitted again, with its own two measures, to a bounded sample of rated texts, sentence by sentence.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.canon import canonical
from vellum.llm.common import map_batches, words
from vellum.llm.lang import Model, identify

LEVELS = ("primary", "middle", "secondary")
#: Rated texts the formulas are fitted on at most, words a text must have, characters of another language up to which it is English only.
SAMPLE, LEAST_WORDS, FOREIGN = 6000, 40, 0.1

_WORD = re.compile(r"[A-Za-z]+(?:['’-][A-Za-z]+)*")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')]*\s+")
_VOWELS = re.compile(r"[aeiouy]+")
_SPLIT = re.compile(r"(?:ia|io(?!us|n)|eo(?!us)|iu|ua(?!r)|uo)(?!$)")


# Consonants that are not parted.
_WHOLE = frozenset("ch sh th ph wh gh ck qu bl br cl cr dr fl fr gl gr pl pr sc sk sl sm sn sp st sw tr tw".split())


def _nuclei(w: str) -> list[tuple[int, int]]:
    """The vowels of each syllable, as places in a lower-case word; what is written and not spoken at its end is none."""
    cuts = {m.start() + 1 for m in _SPLIT.finditer(w)}
    out = []
    for m in _VOWELS.finditer(w):
        at = m.start()
        for cut in sorted(c for c in cuts if m.start() < c < m.end()):
            out.append((at, cut))
            at = cut
        out.append((at, m.end()))
    silent = (
        w.endswith("e") and not w.endswith(("le", "ee", "ye", "oe", "ie"))
        or w.endswith("ed") and not w.endswith(("ted", "ded"))
        or w.endswith("es") and not w.endswith(("ses", "zes", "ces", "ges", "xes", "ches", "shes", "ies"))
    )
    return out[:-1] if silent and len(out) > 1 else out


def hyphenated(word: str) -> list[str]:
    """An English word cut where it may be hyphenated: before a lone consonant between vowels, among several before the last that can begin a syllable."""
    w = word.lower().replace("'", "").replace("’", "")
    if "-" in w:
        return [part for p in w.split("-") if p for part in hyphenated(p)]
    if len(w) <= 3:
        return [w]
    cuts = [0]
    places = _nuclei(w)
    for (_, end), (start, _) in zip(places, places[1:]):
        between = start - end
        cuts.append(start - (2 if between >= 2 and w[start - 2 : start] in _WHOLE else min(between, 1)))
    return [w[a:b] for a, b in zip(cuts, [*cuts[1:], len(w)])]


@functools.lru_cache(200_000)
def syllables(word: str) -> int:
    """Syllables of an English word: the parts it may be hyphenated into."""
    return len(hyphenated(word))


def sentences(text: str) -> np.ndarray:
    """Per sentence: words, syllables, letters, words of three and of two syllables or more."""
    out = []
    for s in _SENTENCE.split(text):
        ws = _WORD.findall(s)
        if ws:
            sy = [syllables(w) for w in ws]
            out.append((len(ws), sum(sy), sum(map(len, ws)), sum(x >= 3 for x in sy), sum(x >= 2 for x in sy)))
    return np.array(out, dtype=float).reshape(-1, 5)


def published(total: np.ndarray, n_sentences: int) -> float:
    """The median grade of the formulas as published, for a text's sums over its sentences."""
    w, sy, let, poly, _ = total
    if not w:
        return 0.0
    wps = w / n_sentences
    return float(np.median([
        0.39 * wps + 11.8 * sy / w - 15.59, 0.4 * (wps + 100 * poly / w), 1.043 * np.sqrt(poly * 30 / n_sentences) + 3.1291,
        4.71 * let / w + 0.5 * wps - 21.43, 5.88 * let / w - 29.6 * n_sentences / w - 15.8,
    ]))


def _designs(s: np.ndarray) -> list[np.ndarray]:
    """For each formula its two measures by sentence with their squares and product."""
    n = s[:, 0]
    length = np.log(n)
    out = []
    for hard in (s[:, 1] / n, s[:, 2] / n, np.sqrt(s[:, 3] / n), s[:, 4] / n, np.sqrt(s[:, 3])):
        out.append(np.stack([np.ones_like(n), length, hard, length**2, hard**2, length * hard], axis=1))
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Grader:
    """The fitted formulas and the cuts between levels."""

    def __init__(self, weights: list[np.ndarray], cuts: tuple[float, float]) -> None:
        self.weights, self.cuts = weights, cuts

    def score(self, s: np.ndarray) -> float:
        """0 (primary) to 2 (secondary): by sentence the median of the formulas, by text their mean weighted with words."""
        if not len(s):
            return 0.0
        each = np.median([_softmax(d @ w) @ np.arange(3.0) for d, w in zip(_designs(s), self.weights)], axis=0)
        return float((each * s[:, 0]).sum() / s[:, 0].sum())

    def level(self, score: float) -> str:
        return LEVELS[int(score > self.cuts[0]) + int(score > self.cuts[1])]


def fit_grader(texts: list[str], levels: list[int]) -> Grader:
    """Fit each formula by multinomial regression of a text's level on its sentences, then the cuts on the texts' scores."""
    parts = [sentences(canonical(t)) for t in texts]
    keep = [i for i, p in enumerate(parts) if len(p)]
    if not keep:
        return Grader([np.zeros((6, 3))] * 5, (2 / 3, 4 / 3))
    s = np.concatenate([parts[i] for i in keep])
    y = np.repeat(np.array([levels[i] for i in keep]), [len(parts[i]) for i in keep])
    share = s[:, 0] / s[:, 0].mean()
    target = np.eye(3)[y]
    weights = []
    for d in _designs(s):
        mean, dev = d.mean(axis=0), d.std(axis=0)
        mean[0], dev[dev == 0] = 0, 1
        dev[0] = 1
        x, w = (d - mean) / dev, np.zeros((d.shape[1], 3))
        for _ in range(25):  # Newton steps with the upper bound of the Hessian
            g = x.T @ ((target - _softmax(x @ w)) * share[:, None]) - 1e-2 * w
            h = 0.5 * (x * share[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
            w += 2 * np.linalg.solve(h, g) / 1.5
        raw = w / dev[:, None]
        raw[0] -= (mean[1:, None] / dev[1:, None] * w[1:]).sum(axis=0)
        weights.append(raw)
    grader = Grader(weights, (0.0, 0.0))
    score = np.array([grader.score(parts[i]) for i in keep])
    real = np.array([levels[i] for i in keep])
    grid = np.arange(0.3, 1.71, 0.02)
    low = max(grid[grid < 1], key=lambda c: ((score > c) == (real > 0)).mean())
    high = max(grid[grid > 1], key=lambda c: ((score > c) == (real > 1)).mean())
    return Grader(weights, (float(low), float(high)))


def fit(chunks: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grader:
    """Fit on at most `sample` chunks whose raters agree, chosen by a hash of the key. Only those come to the driver."""
    number = F.create_map(*[F.lit(x) for i, n in enumerate(LEVELS) for x in (n, i)])
    agreed = (
        labels.select("chunk_uid", number[F.lower(F.trim("level_name"))].alias("y")).where("y is not null")
        .groupBy("chunk_uid").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z")
        .orderBy(F.xxhash64("chunk_uid")).limit(sample)
    )
    rows = chunks.select("chunk_uid", "text").where("text is not null").join(F.broadcast(agreed), "chunk_uid").dropDuplicates(["chunk_uid"]).select("chunk_uid", "text", "y").collect()
    rows.sort(key=lambda r: r["chunk_uid"])
    return fit_grader([r["text"] for r in rows], [r["y"] for r in rows])


def class_number(label: Column) -> Column:
    """5 to 10 for a class written as a number or Roman numeral, with or without the word class; else NULL."""
    plain = F.upper(F.regexp_replace(F.trim(label), r"(?i)^(class|grade|std\.?)?[\s\-:]*", ""))
    roman = F.create_map(*[F.lit(x) for i, n in enumerate(("V", "VI", "VII", "VIII", "IX", "X")) for x in (n, i + 5)])
    return F.coalesce(roman[plain], plain.try_cast("int"))


def reading_levels(
    df: DataFrame, grader: Grader, languages: Model, key: str = "chunk_uid", text: str = "text", extra: tuple[str, ...] = (), least_words: int = LEAST_WORDS
) -> DataFrame:
    """(item_id, n_words, n_sentences, grade, score, level, *extra): one row per row with an English-only text of at least least_words words.

    grade is the median of the published formulas, score runs from 0 (primary) to 2 (secondary). NULL, empty and shorter texts and
    those in which another language fills more than FOREIGN give no row.
    """
    known = df.sparkSession.sparkContext.broadcast((grader, languages))
    names = ("item_id", "n_words", "n_sentences", "grade", "score", "level")

    def grade(cols: dict[str, list]) -> dict[str, list]:
        g, model = known.value
        out: dict[str, list] = {n: [] for n in (*names, *extra)}
        for row, (k, t) in enumerate(zip(cols["_k"], cols["_t"])):
            n = len(words(t))
            if n < least_words:
                continue
            form = canonical(t)
            spans = identify(form, model)
            if not spans or sum(b - a for lang, a, b, _ in spans if lang != "en") > FOREIGN * len(form):
                continue
            s = sentences(form)
            score = g.score(s)
            for name, v in zip(names, (k, n, len(s), published(s.sum(axis=0), max(1, len(s))), score, g.level(score))):
                out[name].append(v)
            for e in extra:
                out[e].append(cols[e][row])
        return out

    kinds = dict(df.dtypes)
    src = df.select(F.col(key).cast("long").alias("_k"), F.col(text).alias("_t"), *extra).where("_k is not null and _t <> ''")
    schema = "item_id long, n_words long, n_sentences long, grade double, score double, level string" + "".join(f", {e} {kinds[e]}" for e in extra)
    return map_batches(src, grade, schema)


def misplaced(chunks: DataFrame, grader: Grader, languages: Model) -> DataFrame:
    """(chunk_uid): chunks of class 5 or 6 that read as secondary, and of class 9 or 10 that read as primary. Class NULL never counts."""
    shelved = chunks.select("chunk_uid", "text", class_number(F.col("class")).alias("shelf")).where(F.col("shelf").isin(5, 6, 9, 10))
    read = reading_levels(shelved, grader, languages, extra=("shelf",))
    wrong = (F.col("shelf").isin(5, 6) & (F.col("level") == "secondary")) | (F.col("shelf").isin(9, 10) & (F.col("level") == "primary"))
    return read.where(wrong).select(F.col("item_id").alias("chunk_uid")).distinct()
