"""Subject area of each document: distributed latent Dirichlet topics, mapped to areas through their top terms.

Terms are words whose documents lean to one subject of the catalogue; function words, names and words of every lesson take no part.
Topics start from what a bounded sample of judged documents and the catalogue's subjects say about the terms, and are fitted by
variational passes over all documents: each task sums what its documents add, so that only topics times terms come to the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import map_batches, stored, words

AREAS = ("science", "mathematics", "history", "geography", "civics", "literature", "sport", "computing")
# Subjects of the catalogue by their first four letters in lower case, and the areas they hold.
SUBJECTS = {"scie": (0,), "math": (1,), "engl": (5,), "phys": (6,), "comp": (7,), "soci": (2, 3, 4)}
# Beginnings of subjects that are science, though they begin as Physical Education does.
NATURAL = ("physics", "physical s")
#: A term's share of documents at least, documents at least, lift of its leading subject and standard deviations beyond chance.
TERM_SHARE, TERM_DOCS, LIFT, SIGMA = 1e-4, 5, 1.8, 4.0
#: Judged documents used at most, passes over all documents, prior of a document's topics, weight of the start against the documents.
SAMPLE, PASSES, ALPHA, PRIOR = 50_000, 3, 0.05, 0.5
#: Rounds over one document's topics, share of the text with an area that an area must fill, and of all the text.
ROUNDS, LEAST_SHARE, LEAST_TEXT = 20, 0.25, 0.125

_SENTENCE = re.compile(r"(?<=[.?!।۔؟])\s+|\n+")


def subject_key(subject: Column) -> Column:
    """Number of the catalogue's subject that an untidy label names, -1 for none."""
    low = F.lower(F.trim(subject))
    out = F
    for name in NATURAL:
        out = out.when(low.startswith(name), F.lit(0))
    for i, s in enumerate(SUBJECTS):
        out = out.when(F.substring(low, 1, 4) == s, F.lit(i))
    return out.otherwise(F.lit(-1))


def term_table(docs: DataFrame, text: str, subject: str) -> DataFrame:
    """(word, s0..s5, other): documents of each subject that hold the word, and '' for all documents."""

    def count(cols: dict[str, list]) -> dict[str, list]:
        by: dict[int, Counter] = {}
        for t, s in zip(cols["_t"], cols["_s"]):
            c = by.setdefault(s, Counter())
            c.update(set(words(t)))
            c[""] += 1
        rows = [(w, s, n) for s, c in by.items() for w, n in c.items()]
        return {"word": [r[0] for r in rows], "s": [r[1] for r in rows], "n": [r[2] for r in rows]}

    src = docs.select(F.col(text).alias("_t"), subject_key(F.col(subject)).alias("_s")).where("trim(_t) <> ''")
    flat = map_batches(src, count, "word string, s int, n long")
    return flat.groupBy("word").agg(*[F.sum(F.when(F.col("s") == i, F.col("n")).otherwise(0)).alias(f"s{i}") for i in range(len(SUBJECTS))], F.sum("n").alias("docs"))


def terms(table: DataFrame) -> tuple[list[str], np.ndarray]:
    """The terms in order, and for each its documents by subject. Their number has a bound: each fills TERM_SHARE of the documents."""
    names = [f"s{i}" for i in range(len(SUBJECTS))]
    total = table.where("word = ''").first()
    if total is None:
        return [], np.zeros((0, len(SUBJECTS)))
    known = sum(total[n] for n in names)
    if not known:
        return [], np.zeros((0, len(SUBJECTS)))
    n = sum(F.col(x) for x in names)
    leads = F.lit(False)
    for x in names:
        expected = n * (total[x] / known)
        leads = leads | ((F.col(x) >= expected * LIFT) & (F.col(x) - expected >= F.sqrt(expected) * SIGMA) & (expected > 0))
    rows = table.where((F.col("word") != "") & (n >= max(TERM_DOCS, TERM_SHARE * total["docs"])) & leads).orderBy("word").collect()
    return [r["word"] for r in rows], np.array([[r[x] for x in names] for r in rows], dtype=float).reshape(-1, len(SUBJECTS))


def judged(docs: DataFrame, labels: DataFrame, key: str, text: str, index: dict[str, int], sample: int = SAMPLE) -> np.ndarray:
    """(areas, terms): occurrences of terms in at most `sample` judged documents, chosen by a hash of the key. Only the sums come to the driver."""
    numbers = F.create_map(*[F.lit(x) for i, a in enumerate(AREAS) for x in (a, i)])
    named = labels.select(F.col("doc_id").alias("_j"), numbers[F.lower(F.trim("subject_area"))].alias("a")).where("a is not null")
    chosen = named.groupBy("_j").agg(F.collect_set("a").alias("a")).orderBy(F.xxhash64("_j")).limit(sample)
    known = docs.sparkSession.sparkContext.broadcast(index)

    def count(cols: dict[str, list]) -> dict[str, list]:
        sums: dict[tuple[int, int], float] = {}
        for t, areas in zip(cols["_t"], cols["a"]):
            for w in words(t):
                if (i := known.value.get(w)) is not None:
                    for a in areas:
                        sums[a, i] = sums.get((a, i), 0.0) + 1 / len(areas)
        return {"area": [a for a, _ in sums], "term": [i for _, i in sums], "n": list(sums.values())}

    source = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where("_t <> ''").join(F.broadcast(chosen), F.col("_k") == F.col("_j")).select("_t", "a")
    out = np.zeros((len(AREAS), len(index)))
    for r in map_batches(source, count, "area int, term int, n double").groupBy("area", "term").agg(F.sum("n").alias("n")).collect():
        out[r["area"], r["term"]] = r["n"]
    return out


class _Ids(dict):
    """The term of each blank-separated token met, -1 where it is none."""

    def __init__(self, index: dict[str, int]) -> None:
        self.index = index

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        found = self[token] = next((i for w in words(token) if (i := self.index.get(w)) is not None), -1)
        return found


def encoded(docs: DataFrame, key: str, text: str, index: dict[str, int]) -> DataFrame:
    """(doc_id, chars, sizes, ids): characters and number of terms of each sentence, and the terms of all sentences in order."""
    known = docs.sparkSession.sparkContext.broadcast(index)
    met: list[_Ids] = []

    def encode(cols: dict[str, list]) -> dict[str, list]:
        if not met:
            met.append(_Ids(known.value))
        term = met[0].__getitem__
        out: dict[str, list] = {"doc_id": [], "chars": [], "sizes": [], "ids": []}
        for k, t in zip(cols["_k"], cols["_t"]):
            chars, sizes, ids = [], [], []
            for s in _SENTENCE.split(t):
                if s.strip():
                    mine = [i for i in map(term, s.split()) if i >= 0]
                    chars.append(len(s))
                    sizes.append(len(mine))
                    ids += mine
            for name, v in zip(out, (k, chars, sizes, ids)):
                out[name].append(v)
        return out

    src = docs.select(F.col(key).cast("long").alias("_k"), F.col(text).alias("_t")).where("_k is not null and trim(_t) <> ''")
    return map_batches(src, encode, "doc_id long, chars array<int>, sizes array<int>, ids array<int>")


def infer(beta: np.ndarray, ids: np.ndarray, doc: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """(occurrences, topics): how far each occurrence of a term belongs to each topic, given the documents' other terms."""
    k = beta.shape[1]
    own = beta[ids]
    theta = np.full((n, k), 1.0 / k)
    part = own
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, dtype=np.int64)
    for _ in range(rounds):
        part = own * theta[doc]
        part /= part.sum(axis=1, keepdims=True) + 1e-30
        if len(starts):
            theta[doc[starts]] = ALPHA + np.add.reduceat(part, starts, axis=0)
    return part


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All terms of a batch, and the row of each."""
    col = batch.column(batch.schema.get_field_index("ids"))
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(batch.num_rows), col.value_lengths().to_numpy(zero_copy_only=False))


def fit_topics(docs: DataFrame, start: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """(terms, topics): probabilities of the terms in each topic after variational passes over all encoded documents."""
    k, v = start.shape
    prior = start.T / start.sum()
    weights = start.T
    spark = docs.sparkSession
    for _ in range(passes):
        beta = spark.sparkContext.broadcast(_normal(weights))

        def add(batches: Iterator[pa.RecordBatch], beta=beta) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            total = np.zeros((v, k))
            for b in batches:
                ids, doc = _flat(b)
                if len(ids):
                    part = infer(beta.value, ids, doc, b.num_rows)
                    for t in range(k):
                        total[:, t] += np.bincount(ids, part[:, t], v)
            topic, term = np.nonzero(total.T > 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(topic, pa.int32()), pa.array(term, pa.int32()), pa.array(total[term, topic])], names=["topic", "term", "n"])

        rows = docs.select("ids").mapInArrow(add, "topic int, term int, n double").groupBy("topic", "term").agg(F.sum("n").alias("n")).collect()
        found = np.zeros((v, k))
        for r in rows:
            found[r["term"], r["topic"]] = r["n"]
        weights = found + prior * found.sum() * PRIOR
    return _normal(weights)


def _normal(weights: np.ndarray) -> np.ndarray:
    """Weights (terms, topics) as probabilities of the terms within each topic."""
    return (weights + 1e-2) / (weights + 1e-2).sum(axis=0)


def map_topics(beta: np.ndarray, evidence: np.ndarray, top: int = 40) -> list[int]:
    """The area of each topic: the one to which its top terms belong by the evidence (areas, terms)."""
    lean = (evidence + 1e-3) / (evidence + 1e-3).sum(axis=1, keepdims=True)
    lean = np.log(lean / lean.mean(axis=0))
    out = []
    for t in range(beta.shape[1]):
        best = (beta[:, t] * np.log(beta[:, t] / beta.mean(axis=1))).argsort()[::-1][:top]
        out.append(int((lean[:, best] * beta[best, t]).sum(axis=1).argmax()))
    return out


def top_terms(beta: np.ndarray, names: list[str], top: int = 20) -> list[list[str]]:
    """The terms that stand out in each topic, for inspection."""
    return [[names[i] for i in (beta[:, t] * np.log(beta[:, t] / beta.mean(axis=1))).argsort()[::-1][:top]] for t in range(beta.shape[1])]


def subject_areas(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", subject: str = "subject") -> DataFrame:
    """(doc_id, areas array<struct<area, share, of_text>>): shares of the areas in each document with a text.

    share is an area's part of the sentences that have one, of_text its part of the whole text. NULL, empty and blank texts give no
    row; a text without any term has no area. Rows that repeat are documents of their own.
    """
    names, by_subject = terms(stored(term_table(docs, text, subject), "words"))
    schema = "doc_id long, areas array<struct<area: string, share: double, of_text: double>>"
    if not names:
        return docs.sparkSession.createDataFrame([], schema)
    index = {w: i for i, w in enumerate(names)}
    evidence = judged(docs, labels, key, text, index)
    for s, areas in enumerate(SUBJECTS.values()):
        for a in areas:
            evidence[a] += 0.2 * by_subject[:, s] / len(areas)
    start = 1e4 * (evidence + 1e-3) / (evidence + 1e-3).sum(axis=1, keepdims=True)
    coded = stored(encoded(docs, key, text, index), "terms")
    beta = fit_topics(coded, start)
    known = docs.sparkSession.sparkContext.broadcast((beta, map_topics(beta, evidence)))

    def assign(cols: dict[str, list]) -> dict[str, list]:
        b, area_of = known.value
        out: dict[str, list] = {"doc_id": cols["doc_id"], "areas": []}
        n = len(cols["doc_id"])
        lengths = np.array([len(x) for x in cols["ids"]])
        ids = np.fromiter((i for x in cols["ids"] for i in x), np.int64, lengths.sum())
        part = infer(b, ids, np.repeat(np.arange(n), lengths), n)
        at = 0
        for chars, sizes in zip(cols["chars"], cols["sizes"]):
            fill: Counter = Counter()
            for c, m in zip(chars, sizes):
                if m:
                    q = part[at : at + m].sum(axis=0)
                    at += m
                    best = int(q.argmax())
                    if q[best] >= 0.5:
                        fill[AREAS[area_of[best]]] += c
            some, whole = sum(fill.values()), sum(chars)
            out["areas"].append([{"area": a, "share": c / some, "of_text": c / whole} for a, c in sorted(fill.items())])
        return out

    return map_batches(coded, assign, schema)


def main_areas(found: DataFrame) -> DataFrame:
    """(doc_id, subject_area): areas that fill at least a quarter of a document's text on a subject, and not just a line of another text."""
    row = found.select("doc_id", F.explode("areas").alias("a"))
    return row.where((F.col("a.share") >= LEAST_SHARE) & (F.col("a.of_text") >= LEAST_TEXT)).select("doc_id", F.col("a.area").alias("subject_area")).distinct()
