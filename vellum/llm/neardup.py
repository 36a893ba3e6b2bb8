"""Near-duplicate records with small edits: an LSH forest over shingles of words.

Every record gets a label of min-hashes in each of several trees, packed so that numbers sort as labels do. In a tree's sorted order,
the records that share a beginning with a record stand around it; such a run is found as a group of equal beginnings, so that no task
needs the whole order. How many levels must agree depends on the region: few where few records share them, more where many do, but
never so many that the odds of a pair to meet would depend on how crowded its region is.
A sketch of one-bit min-hashes drops most chance neighbours where they meet; the rest is verified on the whole sets of shingles.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.canon import canonical
from vellum.llm.common import map_batches, stored, words
from vellum.llm.components import components

SHINGLE, SIMILARITY, LEAST_WORDS = 5, 0.8, 1
#: Trees, levels of a label that agree in a sparse region and in a crowded one, and records from which a region is crowded.
TREES, SHALLOW, DEEP, REGION = 20, 2, 3, 400
#: Bits of a label for its levels beyond the first SHALLOW, and crowded regions that are sent to all tasks at most.
TAIL, MOST_SENT = 24, 200_000
#: Bits of the sketch, and standard deviations below its mean at the least similarity from which a pair is dropped.
BITS, MARGIN = 128, 4.5

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of n hash functions on 32 bits."""
    base = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _MIX).astype(np.uint32)
    return base[:n] | np.uint32(1), base[n:]


class _Hashed(dict):
    """64-bit hash of the word of each token met, 0 where only punctuation stands."""

    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        word = "".join(words(token))
        value = self[token] = xxhash.xxh3_64_intdigest(word) or 1 if word else 0
        return value


_HASHED = _Hashed()


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word of the text, in order."""
    tokens = text.split()
    h = np.fromiter(map(_HASHED.__getitem__, tokens), np.uint64, len(tokens))
    return h[h != 0]


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the sequences of `size` words, given as hashes; a shorter text is one sequence."""
    n, size = max(1, len(h) - size + 1), min(size, len(h))
    acc = h[:n] * _MIX
    for i in range(1, size):
        acc = (acc ^ (acc >> np.uint64(29))) * _MIX + h[i : i + n]
    return np.unique(_mix(acc))


def signature(shingles: np.ndarray, trees: int = TREES) -> tuple[np.ndarray, np.ndarray]:
    """Of a set of shingles: the label in each tree, and the sketch. A label's high bits are its first SHALLOW levels, all bits are DEEP levels."""
    a, b = _seeds(trees * DEEP + BITS)
    least = (shingles.astype(np.uint32)[:, None] * a + b).min(axis=0).astype(np.uint64)
    m = least[: trees * DEEP].reshape(trees, DEEP)
    label, head = np.arange(1, trees + 1, dtype=np.uint64), None
    for i in range(DEEP):
        label = _mix(label * _MIX + m[:, i])
        head = label if i + 1 == SHALLOW else head
    tail = np.uint64(TAIL)
    label = head >> tail << tail | label >> (np.uint64(64) - tail)
    sketch = np.packbits((_mix(least[trees * DEEP :]) & np.uint64(1)).astype(np.uint8))
    return label.view(np.int64), sketch.view(np.int64)


def records(df: DataFrame, key: str, text: str, size: int, least_words: int) -> DataFrame:
    """(uid, cls, lead, shingles, labels, s1, s2): one row per row with enough words; cls is the hash of its set of shingles.

    shingles, labels and sketch stand on the first record of a class in each batch only (lead), so that copies cost little.
    shingles holds 32 bits of each hash: two different shingles of one pair of records meet there about once in 10 ** 9 times.
    """

    def make(cols: dict[str, list]) -> dict[str, list]:
        import xxhash

        out: dict[str, list] = {n: [] for n in ("uid", "cls", "lead", "shingles", "labels", "s1", "s2")}
        seen: set[int] = set()
        for k, t in zip(cols["_k"], cols["_t"]):
            h = word_hashes(canonical(t))
            if len(h) < max(1, least_words):
                continue
            s = shingle_hashes(h, size)
            cls = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)
            row: tuple = (None, None, None, None)
            if cls not in seen:
                labels, sketch = signature(s)
                row = (np.unique(s.astype(np.uint32)).view(np.int32), labels, int(sketch[0]), int(sketch[1]))
            for name, v in zip(out, (k, cls, cls not in seen, *row)):
                out[name].append(v)
            seen.add(cls)
        return out

    src = df.select(F.col(key).cast("long").alias("_k"), F.col(text).alias("_t")).where("_k is not null and _t <> ''")
    return map_batches(src, make, "uid long, cls long, lead boolean, shingles array<int>, labels array<long>, s1 long, s2 long")


def _crowds(rows: DataFrame, by: str) -> DataFrame:
    """(by, n) of the values that more than REGION rows share, to be joined to the rows; sent to all tasks only where few enough."""
    crowds = stored(rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > REGION), "crowds")
    return F.broadcast(crowds) if crowds.count() <= MOST_SENT else crowds


def regions(recs: DataFrame) -> DataFrame:
    """(region, blocks, cls, s1, s2): the region of every class in every tree, and the blocks it is met in.

    A region is the classes that agree in SHALLOW levels, or in DEEP levels where more than REGION agree in fewer. Copies become one
    class before their labels are spread. Regions are counted by sums made before the shuffle, and only crowded ones are looked up.
    """
    classes = recs.where("lead").groupBy("cls").agg(F.first("labels").alias("labels"), F.first("s1").alias("s1"), F.first("s2").alias("s2"))
    flat = classes.select("cls", "s1", "s2", F.explode("labels").alias("label"))
    head = F.shiftright("label", TAIL)
    crowds = _crowds(classes.select(F.explode("labels").alias("label")).select(head.alias("head")), "head")
    # A whole label gets a number of its own: it must not be taken for the beginning of another.
    sure = flat.withColumn("head", head).join(crowds, "head", "left").select("cls", "s1", "s2", F.when(F.col("n").isNull(), F.col("head")).otherwise(F.xxhash64("label")).alias("region"), F.col("n").isNotNull().alias("deep"))
    thick = _crowds(sure.where("deep").select("region"), "region")
    return sure.join(thick, "region", "left").select("region", F.coalesce(F.ceil(F.col("n") / REGION), F.lit(1)).cast("int").alias("blocks"), "cls", "s1", "s2")


def candidates(recs: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: classes that are neighbours in some tree and whose sketches do not rule the similarity out."""
    # A large region is met block by block: no task holds more than two blocks, and every pair of the region meets.
    region = regions(recs).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    region = region.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    least = (1 + similarity) / 2
    differ = int(BITS * (1 - least) + MARGIN * (BITS * least * (1 - least)) ** 0.5)
    on = ["region", "lo", "hi"]
    x = region.select(*on, F.col("cls").alias("a"), F.col("s1").alias("x1"), F.col("s2").alias("x2"), F.col("block").alias("bx"))
    y = region.select(*on, F.col("cls").alias("b"), F.col("s1").alias("y1"), F.col("s2").alias("y2"), F.col("block").alias("by"))
    near = F.bit_count(F.col("x1").bitwiseXOR(F.col("y1"))) + F.bit_count(F.col("x2").bitwiseXOR(F.col("y2"))) <= differ
    met = x.join(y, on).where((F.col("a") < F.col("b")) & near & ((F.col("lo") == F.col("hi")) | (F.col("bx") != F.col("by"))))
    return met.select("a", "b").distinct()


def similar_classes(recs: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similarity): pairs of classes (distinct sets of shingles) of at least that Jaccard similarity, each pair once."""
    pairs = candidates(recs, similarity)
    sets = recs.where("lead").select("cls", "shingles").dropDuplicates(["cls"])
    both = pairs.join(sets.withColumnsRenamed({"cls": "a", "shingles": "sa"}), "a").join(sets.withColumnsRenamed({"cls": "b", "shingles": "sb"}), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    both = both.withColumn("common", common).withColumn("similarity", F.col("common") / (F.size("sa") + F.size("sb") - F.col("common")))
    return both.where(F.col("similarity") >= similarity).select("a", "b", "similarity")


def near_duplicate_pairs(df: DataFrame, key: str = "chunk_uid", text: str = "text", size: int = 3, similarity: float = 0.6, least_words: int = 30) -> DataFrame:
    """(a, b), a < b: every pair of records of at least that similarity, members of one class included.

    The output is quadratic in a class by its definition; near_duplicate_groups() gives one row per record instead. A key delivered
    twice with one text is one record. NULL, empty and shorter texts take no part; an empty table gives no rows.
    """
    recs = stored(records(df, key, text, size, least_words), "neardup")
    member = recs.select("uid", "cls").distinct()
    several = member.groupBy("cls").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi")).where("lo <> hi").select("cls")
    copies = member.join(several, "cls", "left_semi")
    within = copies.select("cls", F.col("uid").alias("x")).join(copies.select("cls", F.col("uid").alias("y")), "cls").where("x < y").select("x", "y")
    links = similar_classes(recs, similarity).select("a", "b")
    across = links.join(member.select(F.col("cls").alias("a"), F.col("uid").alias("x")), "a").join(member.select(F.col("cls").alias("b"), F.col("uid").alias("y")), "b").where("x <> y").select("x", "y")
    both = within.union(across)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicate_groups(df: DataFrame, key: str = "chunk_uid", text: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """(uid, cls, group_id, links): one row per record with its class, its group over any number of links, and its class's links.

    Records of one class have the same shingles. A record without a near-duplicate is a group of its own (its class). NULL and empty
    texts and those of fewer words take no part.
    """
    recs = stored(records(df, key, text, size, least_words), "neardup")
    links = stored(similar_classes(recs, similarity), "links")
    groups = components(links)
    ends = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    member = recs.select("uid", "cls").distinct()
    return (
        member.join(ends, "cls", "left").join(groups.withColumnRenamed("key", "cls"), "cls", "left")
        .select("uid", "cls", F.coalesce("component", "cls").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
