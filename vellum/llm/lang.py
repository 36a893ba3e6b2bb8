"""Document language: segmentation-marginalised unigrams over a fixed public vocabulary.

Each language (and each foreign script it is met in) has probabilities of the pieces of one public byte vocabulary. A word's
probability is the sum over all its segmentations into pieces, by the forward algorithm; a segment's is the product over its words.
"""

from __future__ import annotations

import base64
import functools
import math
import os
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.canon import canonical
from vellum.llm.common import map_batches, words

#: The vocabulary's file, from VELLUM_VOCABULARY where that is set; it is read on the driver only.
VOCABULARY = os.environ.get("VELLUM_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Labelled records and distinct words that a language's model is fitted on, passes of expectation maximisation.
SAMPLE, WORDS, PASSES = 400, 3000, 3
#: Characters a language must fill to count, and words a chunk must have.
LEAST_SHARE, LEAST_WORDS = 0.2, 20

# Names a label may give a language, in lower case.
NAMES = {
    "en": "en", "eng": "en", "english": "en",
    "hi": "hi", "hin": "hi", "hindi": "hi", "हिन्दी": "hi", "हिंदी": "hi",
    "mr": "mr", "mar": "mr", "marathi": "mr", "मराठी": "mr",
    "ur": "ur", "urd": "ur", "urdu": "ur", "اردو": "ur",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr", "francais": "fr",
}
# Labels that name no language.
NONE = ("", "und", "unknown", "none", "null")
#: Models: language and script. Latin hi and mr are fitted on the Devanagari text, spelled in Latin letters.
MODELS = (("en", "latin"), ("fr", "latin"), ("hi", "latin"), ("mr", "latin"), ("hi", "devanagari"), ("mr", "devanagari"), ("ur", "arabic"))
SCRIPTS = {"latin": "A-Za-zÀ-ɏḀ-ỿ", "devanagari": "ऀ-ॿ", "arabic": "؀-ۿݐ-ݿ"}

# Devanagari letters in Latin spelling.
CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलळवशषसह", "k kh g gh n ch chh j jh n t th d dh n t th d dh n p ph b bh m y r l l v sh sh s h".split()))
VOWEL_LETTERS = dict(zip("अआइईउऊऋएऐऑओऔ", "a aa i ee u oo ri e ai o o au".split()))
VOWEL_SIGNS = dict(zip("ािीुूृेैॉोौ", "aa i ee u oo ri e ai o o au".split()))
OTHER_SIGNS = {"ं": "n", "ँ": "n", "ः": "h", "़": "", "ऽ": ""}


def named(label: Column) -> Column:
    """The code of the language that a label names, NULL if it names none. A name outside NAMES stays as it is written."""
    low = F.lower(F.trim(label))
    pairs = [x for kv in NAMES.items() for x in kv]
    known = F.create_map(*[F.lit(x) for x in pairs])
    return F.when(low.isNull() | low.isin(*NONE), None).otherwise(F.coalesce(known[low], low))


def latin_spelling(word: str) -> str:
    """A Devanagari word in Latin letters: inherent vowels are written but at the end."""
    out = []
    for i, ch in enumerate(word):
        after = word[i + 1] if i + 1 < len(word) else ""
        if after == "़":
            after = word[i + 2] if i + 2 < len(word) else ""
        if ch in CONSONANTS:
            bare = after in VOWEL_SIGNS or after in ("्", "")
            out.append(CONSONANTS[ch] + ("" if bare else "a"))
        else:
            out.append(VOWEL_LETTERS.get(ch) or VOWEL_SIGNS.get(ch) or OTHER_SIGNS.get(ch, "" if ch == "्" else ch))
    return "".join(out)


@functools.cache
def vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """The pieces and their ids; every single byte is one, so that every text has a segmentation."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    top = max(ranks.values(), default=-1)
    for b in range(256):
        if bytes([b]) not in ranks:
            top += 1
            ranks[bytes([b])] = top
    return ranks


def beginnings(pieces: dict) -> set[bytes]:
    """All beginnings of the pieces, so that a search for them can end where none goes on."""
    return {p[:i] for p in pieces for i in range(1, len(p) + 1)}


def edges(word: str, pieces: dict, heads: set[bytes]) -> list[tuple[int, int, int]]:
    """(start, end, piece) of every piece that occurs in the word with a blank before it, in order of start."""
    raw, out = b" " + word.encode("utf-8", "replace"), []
    for i in range(len(raw)):
        for j in range(i + 1, len(raw) + 1):
            part = raw[i:j]
            if part not in heads:
                break
            p = pieces.get(part)
            if p is not None:
                out.append((i, j, p))
    return out


def log_forward(es: list[tuple[int, int, int]], n: int, logs: list[float]) -> float:
    """The logarithm of the sum over all segmentations of their probabilities, for words whose probability is too small to be held."""
    ahead = [-math.inf] * (n + 1)
    ahead[0] = 0.0
    for i, j, p in es:
        x, y = ahead[i] + logs[p], ahead[j]
        if x > y:
            x, y = y, x
        ahead[j] = y + math.log1p(math.exp(x - y)) if x > -math.inf else y
    return ahead[n]


def fit_pieces(counts: dict[str, int], pieces: dict[bytes, int], passes: int = PASSES) -> dict[int, float]:
    """Piece probabilities that make the counted words likely: expectation maximisation over all segmentations."""
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:WORDS]
    heads = beginnings(pieces)
    lattice = [(edges(w, pieces, heads), len(w.encode("utf-8", "replace")) + 1, math.sqrt(c)) for w, c in top]
    prob: dict[int, float] = {}
    for es, _, c in lattice:
        for i, j, p in es:
            prob[p] = prob.get(p, 0.0) + c * (j - i) ** 2
    for _ in range(passes):
        total = sum(prob.values())
        prob = {p: v / total for p, v in prob.items()}
        count: dict[int, float] = {}
        for es, n, c in lattice:
            ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
            ahead[0] = behind[n] = 1.0
            es[:] = [e for e in es if e[2] in prob]
            for i, j, p in es:
                ahead[j] += ahead[i] * prob[p]
            for i, j, p in reversed(es):
                behind[i] += behind[j] * prob[p]
            if ahead[n] > 0:
                for i, j, p in es:
                    g = c * ahead[i] * prob[p] * behind[j] / ahead[n]
                    if g > 0:
                        count[p] = count.get(p, 0.0) + g
        prob = {p: v for p, v in count.items() if v > 1e-4}
    total = sum(prob.values()) or 1.0
    return {p: v / total for p, v in prob.items()}


class Model:
    """Piece probabilities of all MODELS, and the scores of words met, kept by word."""

    def __init__(self, pieces: dict[bytes, int], fitted: list[dict[int, float]]) -> None:
        used = sorted(set().union(*fitted, (pieces[bytes([b])] for b in range(256))))
        index = {p: n for n, p in enumerate(used)}
        back = {p: b for b, p in pieces.items()}
        self.pieces = {back[p]: index[p] for p in used}
        #: Each model keeps a small part for pieces not seen in its language, single bytes first.
        floor = np.array([1e-4 if len(back[p]) == 1 else 1e-7 for p in used])
        self.prob = np.stack([0.98 * np.array([f.get(p, 0.0) for p in used]) + floor / floor.sum() * 0.02 for f in fitted]).T
        self._ready()

    def _ready(self) -> None:
        self.ids: dict[str, int] = {}
        self.scores = np.zeros((1024, len(MODELS)))
        self.heads = beginnings(self.pieces)
        self.rows = [tuple(map(float, r)) for r in self.prob]
        self.of_script = {s: [i for i, (_, x) in enumerate(MODELS) if x == s] for s in SCRIPTS}

    def __getstate__(self) -> dict:
        return {"pieces": self.pieces, "prob": self.prob}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def score(self, token: str) -> np.ndarray:
        """Log odds of a token's words by model; models of other scripts get none of it (-30 a word), tokens without letters are 0."""
        return sum((self._score(w) for w in _WORD.findall(token)), np.zeros(len(MODELS)))

    def _score(self, word: str) -> np.ndarray:
        out = np.zeros(len(MODELS))
        script = next((s for s, r in _SCRIPT.items() if r.search(word)), None)
        if script is None:
            return out
        out[:] = -30.0
        mine = self.of_script[script]
        if len(mine) == 1:
            out[mine[0]] = -1.0
            return out
        es, n = edges(word, self.pieces, self.heads), len(word.encode("utf-8", "replace")) + 1
        for m in mine:
            ahead = [0.0] * (n + 1)
            ahead[0] = 1.0
            for i, j, p in es:
                ahead[j] += ahead[i] * self.rows[p][m]
            out[m] = math.log(ahead[n]) if ahead[n] > 1e-250 else log_forward(es, n, np.log(self.prob[:, m]).tolist())
        best = out[mine].max()
        out[mine] = np.maximum(out[mine] - best, -8.0)  # one odd word decides nothing
        return out

    def word_ids(self, tokens: list[str]) -> list[int]:
        """Rows of self.scores for the words; scores of new words are added, and all are forgotten beyond 200,000."""
        ids = self.ids
        try:
            return [ids[w] for w in tokens]
        except KeyError:
            pass
        if len(ids) > 200_000:
            ids.clear()
        for w in tokens:
            if w not in ids:
                if len(ids) >= len(self.scores):
                    self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.scores[len(ids)] = self.score(w)
                ids[w] = len(ids)
        return [ids[w] for w in tokens]


_SCRIPT = {s: re.compile(f"[{r}]") for s, r in SCRIPTS.items()}
_SEGMENT = re.compile(r"[^.!?।۔؟\n()]+[.!?।۔؟\n()]*|[.!?।۔؟\n()]+")
_WORD = re.compile(r"[^\W\d_]+(?:[’'ऀ-ःऺ-ॏ़ً-ٰٟ]+[^\W\d_]*)*")
_FOREIGN = re.compile(f"[{SCRIPTS['devanagari']}{SCRIPTS['arabic']}]")
_RUNS = re.compile("|".join(f"[{a}][^{b}]*" for a, b in (
    (SCRIPTS["devanagari"], SCRIPTS["arabic"] + SCRIPTS["latin"]),
    (SCRIPTS["arabic"], SCRIPTS["devanagari"] + SCRIPTS["latin"]),
    (SCRIPTS["latin"], SCRIPTS["devanagari"] + SCRIPTS["arabic"]))) + r"|.", re.S)
#: Log odds against a change of language from one segment to the next.
SWITCH = 6.0


def segments(text: str) -> list[str]:
    """The text in sentences and lines, cut again where the script changes; together they are the text."""
    out = _SEGMENT.findall(text)
    if _FOREIGN.search(text) and _SCRIPT["latin"].search(text):
        out = [r for s in out for r in _RUNS.findall(s)]
    return out


def identify(text: str, model: Model) -> list[tuple[str, int, int, float]]:
    """(language, start, end, confidence) of each stretch of one language, over the consistent form of the text."""
    parts = segments(text)
    if not parts:
        return []
    tokens, cuts = [], []
    for s in parts:
        cuts.append(len(tokens))
        tokens += s.lower().split()
    if not tokens:
        return []
    got = np.fromiter(model.word_ids(tokens), np.int64, len(tokens))  # before the table is read: new words can enlarge it
    sums = np.zeros((len(tokens) + 1, len(MODELS)))
    np.cumsum(model.scores[got], axis=0, out=sums[1:])
    bounds = sums[[*cuts, len(tokens)]]
    each = bounds[1:] - bounds[:-1]
    top = each.argmax(axis=1)
    heard = each.min(axis=1) < 0  # segments without a scored letter say nothing
    said = top[heard]
    if len(said) and (said == said[0]).all():
        e = each[heard]
        sure = 1.0 / np.exp(e - e[:, said[:1]]).sum(axis=1)
        return [(MODELS[said[0]][0], 0, len(text), float(sure.mean()))]
    path = _best_path(each)
    sure = np.exp(each - each.max(axis=1, keepdims=True))
    sure = sure[np.arange(len(parts)), path] / sure.sum(axis=1)
    out: list[list] = []
    at = 0
    for s, p, c, h in zip(parts, path.tolist(), sure.tolist(), heard.tolist()):
        lang, n = MODELS[p][0], len(s)
        if out and out[-1][0] == lang:
            out[-1][2] = at + n
        else:
            out.append([lang, at, at + n, 0.0, 0])
        if h:
            out[-1][3] += c * n
            out[-1][4] += n
        at += n
    return [(lang, a, b, c / n if n else 0.0) for lang, a, b, c, n in out]


def _best_path(each: np.ndarray) -> np.ndarray:
    """The likeliest model of each segment when a change costs SWITCH (Viterbi)."""
    n, k = each.shape
    score, back = each[0].copy(), np.zeros((n, k), dtype=np.int64)
    for i in range(1, n):
        best = int(score.argmax())
        change = score[best] - SWITCH
        back[i] = np.where(score >= change, np.arange(k), best)
        score = np.maximum(score, change) + each[i]
    path = np.zeros(n, dtype=np.int64)
    path[-1] = int(score.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", vocabulary_path: str = VOCABULARY, sample: int = SAMPLE) -> Model:
    """Fit the models on at most `sample` labelled texts of each language, of 200 to 20,000 characters, chosen by a hash of the text.

    A text counts once, however often it comes. How many there are of a language sets a bound on the hash before anything is shuffled,
    so that what is ranked does not grow with the table. Labels can be wrong: after a first fit, records that another model explains
    better leave the sample.
    """
    codes = sorted(set(NAMES.values()))
    lang = named(F.col(label))
    usable = labelled.select(F.col(text).alias("t"), lang.alias("l")).where(lang.isin(*codes) & F.length(text).between(200, 20_000))
    usable = usable.select("l", "t", F.xxhash64("t").alias("h"))
    texts = {r["l"]: r["n"] for r in usable.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()}
    bound = F.lit(0)
    for code, n in texts.items():
        bound = F.when(F.col("l") == code, math.ceil(1_000_000 * min(1.0, 2 * sample / max(1, n)))).otherwise(bound)
    low = usable.where(F.pmod("h", F.lit(1_000_000)) < bound).dropDuplicates(["l", "h"])
    nth = F.row_number().over(W.partitionBy("l").orderBy("h", "t"))
    rows = low.withColumn("n", nth).where(F.col("n") <= sample).select("l", "t").collect()
    records = [(r["l"], _WORD.findall(canonical(r["t"]).lower())) for r in sorted(rows, key=lambda r: (r["l"], r["t"]))]
    return fit_records(records, vocabulary(vocabulary_path))


def fit_records(records: list[tuple[str, list[str]]], pieces: dict[bytes, int]) -> Model:
    """Fit on (language, words) records; a model without any record keeps only its floor."""
    home = {"en": "latin", "fr": "latin", "hi": "devanagari", "mr": "devanagari", "ur": "arabic"}
    model = None
    for last in (False, True):
        counts: dict[str, Counter] = {lang: Counter() for lang in home}
        for lang, ws in records:
            own = [w for w in ws if _SCRIPT[home[lang]].search(w)]
            if len(own) < 0.9 * len(ws) or not ws:
                continue
            if model is not None:
                ids = model.word_ids(own)
                fits = model.scores[ids].sum(axis=0)
                if MODELS[int(fits.argmax())] != (lang, home[lang]):
                    continue
            counts[lang].update(own)
        fitted = []
        for lang, script in MODELS:
            c = counts[lang]
            if script != home[lang]:
                spelled: Counter = Counter()
                for w, n in c.items():
                    spelled[latin_spelling(w)] += n
                c = spelled
            fitted.append(fit_pieces(c, pieces, PASSES if last else 1))
        model = Model(pieces, fitted)
    return model


def languages(df: DataFrame, model: Model, key: str, text: str, extra: tuple[str, ...] = (), least_words: int = 0) -> DataFrame:
    """(item_id, n_chars, parts array<struct<lang, chars, confidence>>, spans array<struct<lang, start_pos, end_pos, confidence>>).

    One row per row of df with a text that is neither NULL nor empty and has at least least_words words; extra columns pass through.
    Positions are into the consistent form of the text. A text without a letter has no part.
    """
    known = df.sparkSession.sparkContext.broadcast(model)

    def assign(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"item_id": [], "n_chars": [], "parts": [], "spans": []} | {e: [] for e in extra}
        for row, (k, t) in enumerate(zip(cols["_k"], cols["_t"])):
            if least_words and len(words(t)) < least_words:
                continue
            form = canonical(t)
            spans = identify(form, known.value)
            share: dict[str, list[float]] = {}
            for lang, a, b, c in spans:
                s = share.setdefault(lang, [0, 0.0])
                s[0] += b - a
                s[1] += (b - a) * c
            out["item_id"].append(k)
            out["n_chars"].append(len(form))
            out["parts"].append([{"lang": x, "chars": n, "confidence": c / n} for x, (n, c) in sorted(share.items()) if n])
            out["spans"].append([{"lang": x, "start_pos": a, "end_pos": b, "confidence": c} for x, a, b, c in spans])
            for e in extra:
                out[e].append(cols[e][row])
        return out

    src = df.select(F.col(key).cast("long").alias("_k"), F.col(text).alias("_t"), *extra).where("_k is not null and _t <> ''")
    kinds = dict(df.dtypes)
    schema = (
        "item_id long, n_chars long, parts array<struct<lang: string, chars: long, confidence: double>>, "
        "spans array<struct<lang: string, start_pos: long, end_pos: long, confidence: double>>" + "".join(f", {e} {kinds[e]}" for e in extra)
    )
    return map_batches(src, assign, schema)


def mislabelled(found: DataFrame, label: str, src: str) -> DataFrame:
    """(src, item_id, found_lang): languages that fill at least LEAST_SHARE of a record, where they are not just the one its label names."""
    large = F.transform(F.filter("parts", lambda p: p["chars"] >= F.col("n_chars") * LEAST_SHARE), lambda p: p["lang"])
    told = named(F.col(label))
    wrong = found.select("item_id", large.alias("large"), told.alias("told")).where(~((F.size("large") == 1) & F.coalesce(F.col("large")[0] == F.col("told"), F.lit(False))))
    return wrong.select(F.lit(src).alias("src"), "item_id", F.explode("large").alias("found_lang")).distinct()
