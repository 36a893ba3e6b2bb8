"""Most similar vectors for every vector: cells and codes by additive quantisation, lookup-table scores, then exact cosines.

The first book's words make the cells (a second book divides them where there are many vectors), and every vector looks into the cells
nearest to it. How many depends on where it lies: a pilot of the sample tells, region by region, how many cells it takes to meet a
given share of the neighbours. Within a cell nothing is lost: a code's own error bounds what an exact cosine can be.

Cells that lie together make a group, which a task holds as a whole while the vectors that look into it pass by. A vector is sent once
to each group, however many of its cells it looks into, so that what is shuffled follows the groups and not the cells.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.additive import AdditiveQuantizer, kmeans
from vellum.llm.common import map_batches, stored

#: Vectors the codebooks are fitted on at most, vectors a cell holds on average, words of the first book at most, further books.
SAMPLE, CELL_SIZE, CELLS, BOOKS = 20_000, 2000, 1024, 5
#: Share of neighbours to meet from one side, vectors of the sample that tell how many cells this takes, and how many of them speak for one cell.
MEET, PILOT, POOL = 0.95, 4000, 40
#: Words of the first book whose cells are put in order where a second book divides them; words of the second book at most.
FRONT, SECOND = 64, 256
#: Items that a block holds and queries that pass by it at most, and groups of cells there are at least (so that many tasks can share the work).
ITEMS, ASKED, GROUPS = 200_000, 1_000_000, 24
#: Queries gathered before they meet a block, and items of a cell that meet them in one matrix.
GATHERED, TILE = 16_000, 4000
#: What rounding a query to 16 bits may change a cosine by.
ROUNDING = 0.001


def usable(df: DataFrame, key: str, vector: str, dim_column: str | None, dim: int) -> DataFrame:
    """(uid, v): one row per key with a vector of `dim` finite numbers that are not all zero."""
    sized = F.size(vector) == dim
    if dim_column:
        sized = sized & (F.col(dim_column) == dim)
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return df.select(F.col(key).cast("long").alias("uid"), F.col(vector).cast("array<float>").alias("v")).where(F.col("uid").isNotNull() & sized & fine)


class Cells:
    """A quantizer whose first `depth` books make the cells; by word of the first book, the number of cells to look into and the group its cells are in."""

    def __init__(self, quantizer: AdditiveQuantizer, depth: int) -> None:
        self.quantizer, self.depth = quantizer, depth
        self.probes = np.ones(len(quantizer.books[0]), dtype=np.int64)
        self.group = np.zeros(len(quantizer.books[0]), dtype=np.int64)

    def gather(self, groups: int, seed: int = 7) -> None:
        """Put words of the first book that lie together into one of so many groups at most."""
        words = self.quantizer.books[0]
        c = kmeans(words, min(groups, len(words)), 20, seed)
        self.group = (words @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)

    def by_group(self, cells: np.ndarray) -> tuple[list[int], list[list[int]]]:
        """The groups that some cells are in, and the cells in each; the first cell's group and the first cell come first."""
        parts: dict[int, list[int]] = {}
        for g, c in zip(self.group[cells // (self.number // len(self.group))].tolist(), cells.tolist()):
            parts.setdefault(g, []).append(c)
        return list(parts), list(parts.values())

    @property
    def number(self) -> int:
        """Cells there are."""
        return math.prod(len(b) for b in self.quantizer.books[: self.depth])

    def ordered(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, cells) numbers of cells and how far they are, in no order; where a second book divides cells, those of the FRONT nearest words."""
        q = self.quantizer
        dots = x @ q.words.T
        norms = np.einsum("ij,ij->i", q.words, q.words)
        k1 = len(q.books[0])
        cost = norms[:k1] - 2 * dots[:, :k1]
        if self.depth == 1:
            return np.broadcast_to(np.arange(k1), cost.shape), cost
        front = min(FRONT, k1)
        best = np.argpartition(cost, front - 1, axis=1)[:, :front]
        k2 = len(q.books[1])
        cross = q.books[0] @ q.books[1].T
        both = np.take_along_axis(cost, best, axis=1)[:, :, None] + (norms[k1 : k1 + k2] - 2 * dots[:, k1 : k1 + k2])[:, None, :] + 2 * cross[best]
        return (best[:, :, None] * k2 + np.arange(k2)).reshape(len(x), -1), both.reshape(len(x), -1)

    def nearest(self, x: np.ndarray) -> list[np.ndarray]:
        """The cells each vector looks into, its own first."""
        out: list[np.ndarray] = []
        per = self.number // len(self.probes)
        for a in range(0, len(x), 256):
            cells, cost = self.ordered(x[a : a + 256])
            own = np.take_along_axis(cells, cost.argmin(axis=1)[:, None], axis=1)[:, 0]
            counts = np.minimum(self.probes[own // per], cells.shape[1])
            most = int(counts.max())
            top = np.argpartition(cost, most - 1, axis=1)[:, :most] if most < cells.shape[1] else np.tile(np.arange(most), (len(cells), 1))
            top = np.take_along_axis(top, np.take_along_axis(cost, top, axis=1).argsort(axis=1, kind="stable"), axis=1)
            got = np.take_along_axis(cells, top, axis=1)
            out += [g[:c] for g, c in zip(got, counts)]
        return out

    def own(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        out = []
        for a in range(0, len(x), 256):
            cells, cost = self.ordered(x[a : a + 256])
            out.append(np.take_along_axis(cells, cost.argmin(axis=1)[:, None], axis=1)[:, 0])
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def ranks(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How many cells lie nearer to each vector than the given one."""
        out = []
        for a in range(0, len(x), 256):
            cells, cost = self.ordered(x[a : a + 256])
            at = cells == cell[a : a + 256, None]
            mine = np.where(at.any(axis=1), np.where(at, cost, np.inf).min(axis=1), np.inf)
            out.append((cost < mine[:, None]).sum(axis=1))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def settle(self, x: np.ndarray, k: int, least: float | None, meet: float = MEET, seed: int = 7) -> None:
        """Set the probes from the sample x: how many cells lie nearer than a neighbour's, at the share `meet`, in each region.

        Neighbours within the sample lie farther than those among all vectors, so that the count errs towards more cells. A vector
        without a neighbour there of at least `least` stands in with an invented one just that near, in a random direction.
        """
        if meet >= 1:
            self.probes[:] = self.number
            return
        pilot = x[: min(PILOT, len(x))]
        own = self.own(x)
        first, ranks = [], []
        rng = np.random.default_rng(seed)
        per = self.number // len(self.probes)
        for a in range(0, len(pilot), 500):
            part = pilot[a : a + 500]
            s = part @ x.T
            s[np.arange(len(part)), np.arange(a, a + len(part))] = -2
            top = np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k]
            near = np.take_along_axis(s, top, axis=1) >= (-1 if least is None else least)
            i, j = np.nonzero(near)
            first.append(own[a + i] // per)
            ranks.append(self.ranks(part[i], own[top[i, j]]))
            alone = np.flatnonzero(~near.any(axis=1))
            if len(alone):
                u = rng.normal(size=(len(alone), x.shape[1])).astype(np.float32)
                u -= (u * part[alone]).sum(axis=1, keepdims=True) * part[alone]
                u /= np.linalg.norm(u, axis=1, keepdims=True) + 1e-12
                other = least * part[alone] + math.sqrt(max(0.0, 1 - least * least)) * u
                first.append(own[a + alone] // per)
                ranks.append(self.ranks(part[alone], self.own(other)))
        at, rank = np.concatenate(first), np.concatenate(ranks)
        order = at.argsort(kind="stable")
        rank, begin = rank[order], np.searchsorted(at[order], np.arange(len(self.probes) + 1))
        words = self.quantizer.books[0]
        for c in range(len(self.probes)):
            told, held = [], 0
            for other in ((words - words[c]) ** 2).sum(axis=1).argsort(kind="stable"):
                told.append(rank[begin[other] : begin[other + 1]])
                held += len(told[-1])
                if held >= POOL:
                    break
            self.probes[c] = 1 + (int(np.quantile(np.concatenate(told), meet, method="higher")) if held else self.number)


def fit(vectors: DataFrame, n: int, k: int, least: float | None, sample: int = SAMPLE, cells: int = CELLS, cell_size: int = CELL_SIZE, books: int = BOOKS, meet: float = MEET) -> Cells:
    """Cells and quantizer, fitted on at most `sample` vectors chosen by a hash of the key; only those come to the driver."""
    share = min(1.0, 1.5 * sample / max(1, n))
    rows = vectors.where(F.pmod(F.xxhash64("uid"), F.lit(1_000_000)) < math.ceil(1_000_000 * share)).orderBy(F.xxhash64("uid")).limit(sample).select("v").collect()
    x = np.array([r["v"] for r in rows], dtype=np.float64)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    first = max(1, min(cells, len(x) // 4, math.ceil(n / cell_size)))
    divide = 2 ** math.ceil(math.log2(n / (first * cell_size))) if n > first * cell_size else 1
    second = (min(SECOND, divide),) if divide > 1 else ()
    out = Cells(AdditiveQuantizer.fit(x, (first, *second, *(min(256, max(1, len(x) // 4)),) * books)), 1 + len(second))
    out.settle(x, k, least, meet)
    out.gather(max(GROUPS, math.ceil(2 * n / ITEMS)))
    return out


def _encoded(vectors: DataFrame, known: Cells) -> DataFrame:
    """(uid, item, half, groups, cells): unit vector, code, its sum's norm and cosine to the vector in one; the vector in 16 bits; groups looked into and cells in each."""
    shared = vectors.sparkSession.sparkContext.broadcast(known)

    def encode(cols: dict[str, list]) -> dict[str, list]:
        q = shared.value.quantizer
        x = np.array(cols["v"], dtype=np.float64)
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        codes, norms = q.encode(x)
        near = (x * q.decode(codes)).sum(axis=1) / np.sqrt(np.maximum(norms, 1e-12))
        item = np.zeros(len(x), dtype=_item(x.shape[1], len(q.books)))
        item["unit"], item["codes"], item["norm"], item["fit"] = x, codes, norms, near
        looks = [shared.value.by_group(c) for c in shared.value.nearest(x)]
        return {
            "uid": cols["uid"], "item": [r.tobytes() for r in item], "half": [r.tobytes() for r in x.astype(np.float16)], "groups": [g for g, _ in looks], "cells": [c for _, c in looks],
        }

    return map_batches(vectors, encode, "uid long, item binary, half binary, groups array<int>, cells array<array<int>>")


def _item(dim: int, books: int) -> np.dtype:
    """An item's bytes, its unit vector first."""
    return np.dtype([("unit", np.float32, (dim,)), ("codes", np.uint16, (books,)), ("norm", np.float32), ("fit", np.float32)])


def best_of_block(q: AdditiveQuantizer, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norms: np.ndarray, fits: np.ndarray, asked: np.ndarray, y: np.ndarray, k: int, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, item, cosine within ROUNDING): of items x, at least the k most similar to each query y, by the lookup tables' bound.

    The angle of a vector to its code's sum is stored (fits is its cosine), the angle of a query to that sum is looked up, and the angle
    between the two is no smaller than the difference. The k best by lookup give each query a floor, and all items whose bound reaches
    the floor are met exactly, so that no better one is lost.
    """
    found: list[tuple] = []
    kept = min(k + 1, len(ids))
    across = np.sqrt(np.maximum(0.0, 1 - fits.astype(np.float64) ** 2)).astype(np.float32)
    for a in range(0, len(asked), 512):
        part, mine = y[a : a + 512], asked[a : a + 512]
        score = q.scores(q.tables(part), codes, norms)
        self_r, self_c = np.nonzero(ids[:, None] == mine)
        score[self_r, self_c] = -2
        if kept < len(ids):
            best = np.argpartition(-score, kept - 1, axis=0)[:kept]
        else:
            best = np.tile(np.arange(len(ids))[:, None], (1, len(part)))
        near = np.einsum("kqd,qd->kq", x[best], part)
        near[ids[best] == mine] = -2
        floor = np.sort(near, axis=0)[-k] if len(near) >= k else np.full(len(part), -2.0)
        floor = np.maximum(floor, -1.0 if least is None else least) - ROUNDING
        floor = np.clip(floor, -1, 1).astype(np.float32)
        hit = score >= fits[:, None] * floor - across[:, None] * np.sqrt(1 - floor * floor) - 1e-4
        hit |= (fits[:, None] <= -floor) & (score > -2)  # the two angles fill the half circle: the bound says nothing
        if np.count_nonzero(hit) > 0.02 * hit.size:
            exact = x @ part.T
            exact[self_r, self_c] = -2
            r, c = np.nonzero(hit & (exact >= floor))
            near = exact[r, c]
        else:
            r, c = np.nonzero(hit)
            near = np.einsum("nd,nd->n", x[r], part[c])
            fine = near >= floor[c]
            r, c, near = r[fine], c[fine], near[fine]
        order = np.lexsort((-near, c))
        r, c, near = r[order], c[order], near[order]
        begin = np.searchsorted(c, np.arange(len(part)))
        many = np.diff(np.append(begin, len(c))) >= k
        kth = np.full(len(part), -2.0)
        kth[many] = near[begin[many] + k - 1]
        keep = near >= kth[c] - 2 * ROUNDING
        found.append((mine[c[keep]], ids[r[keep]], near[keep]))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def _read(column: pa.ChunkedArray, kind: np.dtype | type) -> np.ndarray:
    """The bytes of all rows of a binary column, one after the other."""
    parts = []
    for c in column.chunks:
        _, ends, data = c.buffers()
        at = np.frombuffer(ends, dtype=np.int32)[c.offset : c.offset + len(c) + 1]
        parts.append(np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]])
    return np.concatenate(parts).view(kind)


class _Block:
    """Items of one block by cell, and the queries gathered for it."""

    def __init__(self, q: AdditiveQuantizer, least: float | None, k: int) -> None:
        self.q, self.least, self.k = q, least, k
        self.items: list[pa.RecordBatch] = []
        self.queries: list[pa.RecordBatch] = []
        self.waiting = 0
        self.ids: np.ndarray | None = None

    def add(self, rows: pa.RecordBatch, asking: bool) -> None:
        (self.queries if asking else self.items).append(rows)
        self.waiting += rows.num_rows * asking

    def settle(self) -> None:
        """Put the items in the order of their cells."""
        t = pa.Table.from_batches(self.items)
        cell = t["cells"].combine_chunks().flatten().to_numpy()
        order = cell.argsort(kind="stable")
        held = _read(t["data"], _item(self.q.words.shape[1], len(self.q.books)))[order]
        self.ids = t["uid"].to_numpy()[order]
        self.unit, self.codes, self.norm, self.fit = (np.ascontiguousarray(held[n]) for n in ("unit", "codes", "norm", "fit"))
        self.cells, self.begin = np.unique(cell[order], return_index=True)
        self.end = np.append(self.begin[1:], len(order))
        self.items = []

    def meet(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, item, cosine within ROUNDING) of the queries gathered, which are then done with."""
        if self.waiting and (self.items or self.ids is not None):
            if self.ids is None:
                self.settle()
            t = pa.Table.from_batches(self.queries)
            asked = t["uid"].to_numpy()
            y = _read(t["data"], np.float16).reshape(len(asked), -1).astype(np.float32)
            y /= np.linalg.norm(y, axis=1, keepdims=True)
            lists = t["cells"].combine_chunks()
            cell, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(asked)), lists.value_lengths().to_numpy())
            order = cell.argsort(kind="stable")
            cell, of = cell[order], of[order]
            for c, first, last in zip(self.cells, self.begin, self.end):
                mine = of[np.searchsorted(cell, c) : np.searchsorted(cell, c, side="right")]
                for a in range(first, last, TILE) if len(mine) else ():
                    s = slice(a, min(a + TILE, last))
                    yield best_of_block(self.q, self.ids[s], self.unit[s], self.codes[s].astype(np.int64), self.norm[s], self.fit[s], asked[mine], y[mine], self.k, self.least)
        self.queries, self.waiting = [], 0


def _meet(q: AdditiveQuantizer, least: float | None, k: int):  # noqa: ANN202
    """The function that meets the blocks of a partition, which come one after the other, the items of each before its queries."""
    out = pa.schema([("uid", pa.int64()), ("other", pa.int64()), ("near", pa.float32())])

    def found(block: _Block) -> Iterator[pa.RecordBatch]:
        for got in block.meet():
            if len(got[0]):
                yield pa.RecordBatch.from_arrays([pa.array(g, f.type) for g, f in zip(got, out)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = _Block(q, least, k), None
        for b in batches:
            numbers, asking = b.column("block").to_numpy(), b.column("asking").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(numbers) != 0) | (asking[1:] != asking[:-1])) + 1
            for first, last in zip([0, *cuts], [*cuts, b.num_rows]):
                if first == last:
                    continue
                if numbers[first] != number:
                    yield from found(block)
                    block, number = _Block(q, least, k), numbers[first]
                block.add(b.slice(first, last - first), bool(asking[first]))
                if block.waiting >= GATHERED:
                    yield from found(block)
        yield from found(block)

    return run


def _blocks(encoded: DataFrame) -> tuple[DataFrame, int]:
    """(block, place, asking, uid, data, cells): each item in a block of its group, then the queries that look into it; and how many places there are.

    A group of more than ITEMS makes several blocks by items, one of more than ASKED queries several by queries. Blocks go to places so
    that these have about the same work; a row for each group (at most CELLS) comes to the driver for this.
    """
    spark = encoded.sparkSession
    asked = encoded.select(F.posexplode("groups").alias("nth", "g")).groupBy("g")
    sizes = asked.agg(F.count_if(F.col("nth") == 0).alias("held"), F.count(F.lit(1)).alias("asked")).where("held > 0").collect()
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, work = [], []
    for r in sorted(sizes, key=lambda r: r["g"]):
        bi, bq = math.ceil(r["held"] / ITEMS), math.ceil(r["asked"] / ASKED)
        rows.append((r["g"], len(work), bi, bq))
        work += [(r["held"] / bi + 1) * (r["asked"] / bq + 1)] * (bi * bq)
    full, place = [(0.0, p) for p in range(places)], [0] * len(work)
    for b in sorted(range(len(work)), key=lambda b: -work[b]):
        so_far, p = heapq.heappop(full)
        place[b] = p
        heapq.heappush(full, (so_far + work[b], p))
    rows = [(g, start, bi, bq, place[start : start + bi * bq]) for g, start, bi, bq in rows]
    known = F.broadcast(spark.createDataFrame(rows, "g int, start int, bi int, bq int, place array<int>"))
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    mine = lambda blocks: F.pmod(F.xxhash64("uid"), F.col(blocks)).cast("int")
    items = encoded.select("uid", F.col("item").alias("data"), F.col("groups")[0].alias("g"), F.array(F.col("cells")[0][0]).alias("cells")).join(known, "g")
    items = items.select("*", mine("bi").alias("i"), each("bq").alias("j"), F.lit(False).alias("asking"))
    looks = encoded.select("uid", F.col("half").alias("data"), F.explode(F.arrays_zip("groups", "cells")).alias("look")).select("uid", "data", "look.groups", "look.cells")
    asking = looks.withColumnRenamed("groups", "g").select("uid", "data", "g", "cells").join(known, "g").select("g", "uid", "data", "cells", "start", "bi", "bq", "place", each("bi").alias("i"), mine("bq").alias("j"), F.lit(True).alias("asking"))
    at = F.col("i") * F.col("bq") + F.col("j")
    return items.unionByName(asking).select((F.col("start") + at).alias("block"), F.col("place")[at].alias("place"), "asking", "uid", "data", "cells"), places


def similar_vectors(
    df: DataFrame, key: str, vector: str, k: int = 5, least: float | None = None, dim: int = 64, dim_column: str | None = None,
    meet: float = MEET, sample: int = SAMPLE, cells: int = CELLS, cell_size: int = CELL_SIZE,
) -> DataFrame:
    """(uid, other, rank, cosine): for every vector its k most similar other vectors, of at least the cosine `least` if given.

    Vectors that are NULL, of another size, not finite or all zero take no part. Equal vectors are searched once and take each other
    first, so that a great group of copies costs a row each; equal cosines rank by key. A key that comes several times should come
    with one vector. Fewer than k come out only where fewer are met.

    `meet` is the share of neighbours that a search from one side should meet, and decides how many cells each region looks into; a
    pair found from either side counts for both. meet=1 looks into all cells and is exact, its time square in the vectors. All else is
    exact as well: cells have no cap, those of many vectors meet block by block.
    """
    vectors = usable(df, key, vector, dim_column, dim)
    classes = stored(vectors.groupBy("v").agg(F.min("uid").alias("uid"), (F.max("uid") > F.min("uid")).alias("several")), "vectors")
    # Copies are told by 128 bits of two hashes, so that no vector is moved for it.
    digest = lambda df, key: df.select(key, F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("h2"))
    copied = digest(classes.where("several").select(F.col("uid").alias("rep"), "v"), "rep")
    members = digest(vectors, "uid").join(copied, ["h", "h2"]).select("rep", "uid").distinct()
    n = classes.count()
    if n == 0:
        return df.sparkSession.createDataFrame([], "uid long, other long, rank int, cosine double")
    known = fit(classes, n, k, least, sample, cells, cell_size, BOOKS, meet)
    encoded = stored(_encoded(classes.select("uid", "v"), known), "codes")
    blocks, places = _blocks(encoded)
    met = blocks.repartitionById(places, "place").drop("place").sortWithinPartitions("block", "asking").mapInArrow(_meet(known.quantizer, least, k), "uid long, other long, near float")

    # The k best over all cells, as far as rounded cosines can tell; a pair that one of the two found counts for both.
    by = W.partitionBy("uid")
    met = met.withColumn("r", F.row_number().over(by.orderBy(F.desc("near"), "other"))).withColumn("kth", F.max(F.when(F.col("r") == k, F.col("near"))).over(by))
    met = met.where(F.coalesce(F.col("near") >= F.col("kth") - 2 * ROUNDING, F.lit(True))).select(F.least("uid", "other").alias("a"), F.greatest("uid", "other").alias("b")).distinct()
    unit = encoded.select("uid", F.substring("item", 1, 4 * dim).alias("unit"))
    pairs = met.join(unit.withColumnsRenamed({"uid": "a", "unit": "ua"}), "a").join(unit.withColumnsRenamed({"uid": "b", "unit": "ub"}), "b")
    exact = map_batches(pairs, _cosines, "a long, b long, cosine double")
    if least is not None:
        exact = exact.where(F.col("cosine") >= least)
    end = lambda a, b: F.struct(F.col(a).alias("rep"), F.col(b).alias("to"), "cosine")
    near = exact.select(F.explode(F.array(end("a", "b"), end("b", "a"))).alias("e")).select("e.*")
    near = near.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy(F.desc("cosine"), "to"))).where(F.col("r") <= k).drop("r")

    # Copies: the first k + 1 of a class stand for it as neighbours.
    lead = members.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy("uid"))).where(F.col("r") <= k + 1).select(F.col("rep").alias("to"), F.col("uid").alias("other"))
    single = classes.where("not several").select(F.col("uid").alias("rep"))
    own = members.select("rep").distinct().select("rep", F.col("rep").alias("to"), F.lit(1.0).alias("cosine"))
    targets = near.union(own).join(lead, "to", "left").select("rep", F.coalesce("other", "to").alias("other"), "cosine")
    everyone = members.union(single.select("rep", F.col("rep").alias("uid")))
    ranked = everyone.join(targets, "rep").where("uid <> other")
    rank = F.row_number().over(W.partitionBy("uid").orderBy(F.desc("cosine"), "other"))
    return ranked.select("uid", "other", rank.alias("rank"), "cosine").where(F.col("rank") <= k)


def _cosines(cols: dict[str, list]) -> dict[str, list]:
    x = np.frombuffer(b"".join(cols["ua"]), dtype=np.float32).reshape(len(cols["a"]), -1).astype(np.float64)
    y = np.frombuffer(b"".join(cols["ub"]), dtype=np.float32).reshape(len(cols["b"]), -1).astype(np.float64)
    return {"a": cols["a"], "b": cols["b"], "cosine": ((x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))).tolist()}


def similar_pairs(found: DataFrame) -> DataFrame:
    """(chunk_a, chunk_b): pairs of which one is among the other's most similar, the smaller key first."""
    return found.select(F.least("uid", "other").alias("chunk_a"), F.greatest("uid", "other").alias("chunk_b")).distinct()
