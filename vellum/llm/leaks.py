"""Evaluation texts leaking into training text: pigeonhole edit matching.

An item of n distinct sequences of three words leaks if at least half of them stand in a document, so at most n // 2 may be missing.
Any n // 2 + 1 of them are pieces of which one must occur exactly: an automaton finds exact piece hits in the whole text, and only
documents with a hit are verified, by the exact share and by Myers' bit-parallel distance over words around the hit.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import map_batches, words

RUN, SHARE = 3, 0.5
#: Items held by a task at once; a larger set of items is matched in blocks of this size.
BLOCK = 20_000


def runs(tokens: list[str]) -> set[str]:
    """Distinct sequences of RUN consecutive words."""
    return {" ".join(tokens[i : i + RUN]) for i in range(len(tokens) - RUN + 1)}


def myers(pattern: list[str], tokens: list[str]) -> tuple[int, int]:
    """Least edit distance over words of the pattern to any stretch of tokens, and where that stretch ends (bit-parallel)."""
    m = len(pattern)
    if not m:
        return 0, 0
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    pv, mv, score, best, at = full, 0, m, m, 0
    for j, w in enumerate(tokens, 1):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full  # a match may begin anywhere
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, at = score, j
    return best, at


def pigeonhole(items: list[tuple[int, str]]) -> tuple[dict[int, tuple[list[str], set[str]]], dict[str, list[int]]]:
    """Words and runs by item, and the pieces to look for with the items each stands for: of every item its rarest runs."""
    parsed = {i: (w := words(t), runs(w)) for i, t in items if t}
    df = Counter(r for _, rs in parsed.values() for r in rs)
    pieces: dict[str, list[int]] = {}
    for i, (_, rs) in parsed.items():
        need = -int(-len(rs) * SHARE // 1)
        for r in sorted(rs, key=lambda r: (df[r], -len(r), r))[: len(rs) - need + 1] if rs else ():
            pieces.setdefault(r, []).append(i)
    return parsed, pieces


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, share, distance, last_word): items of which at least SHARE of the distinct runs stand in a document.

    distance is the least number of word edits from the whole item to the text around its hits, last_word the 0-based word at which
    that stretch ends. Items of under RUN words have no run and never match; NULL or empty texts give nothing; repeated rows give one
    row. Items come to the driver in blocks of at most BLOCK; documents never do.
    """
    spark, out = docs.sparkSession, None
    listed = items.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    n = listed.count()
    blocks = max(1, -(-n // BLOCK))
    for b in range(blocks):
        part = listed if blocks == 1 else listed.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        known = spark.sparkContext.broadcast([(r["i"], r["t"]) for r in part.collect()])
        found = map_batches(
            docs.select(F.col(key).cast("long").alias("_k"), F.col(text).alias("_t")).where("_t <> '' and _k is not null"),
            _matcher(known),
            "doc_id long, item_id long, share double, distance int, last_word int",
        )
        out = found if out is None else out.union(found)
    return out.distinct()


def _matcher(known):  # noqa: ANN001, ANN202
    """The batch function; each worker builds the automaton once."""
    built: list = []

    def match(cols: dict[str, list]) -> dict[str, list]:
        if not built:
            import ahocorasick

            parsed, pieces = pigeonhole(known.value)
            auto = ahocorasick.Automaton()
            for r, ids in pieces.items():
                auto.add_word(f" {r} ", (r, ids))
            if pieces:
                auto.make_automaton()
            built.append((parsed, auto if pieces else None))
        parsed, auto = built[0]
        rows: list[tuple] = []
        for k, t in zip(cols["_k"], cols["_t"]):
            tokens = words(t)
            line = f" {' '.join(tokens)} "
            first: dict[int, int] = {}
            last: dict[int, int] = {}
            for end, (_, ids) in auto.iter(line) if auto is not None else ():
                for i in ids:
                    first.setdefault(i, end)
                    last[i] = end
            if not first:
                continue
            mine = runs(tokens)
            for i in first:
                pattern, rs = parsed[i]
                share = len(rs & mine) / len(rs)
                if share < SHARE:
                    continue
                a, b = line.count(" ", 0, first[i]) - 1, line.count(" ", 0, last[i])
                a, b = max(0, a - len(pattern)), min(len(tokens), b + len(pattern))
                distance, at = myers(pattern, tokens[a:b])
                rows.append((k, i, share, distance, a + at - 1))
        names = ("doc_id", "item_id", "share", "distance", "last_word")
        return {n: [r[j] for r in rows] for j, n in enumerate(names)}

    return match
