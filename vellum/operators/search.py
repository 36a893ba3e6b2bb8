"""Nearest neighbours of a set of queries: exact over all rows, or in the nearest lists of a clustered index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries that one pass over the rows holds; more are searched in blocks. Queries of one matrix product.
QUERY_BLOCK, STEP = 20_000, 1024
#: Rows and queries of a list that meet in one task at most; a larger list is cut into blocks.
LIST_ROWS, LIST_QUERIES = 20_000, 20_000
DECIMALS = 6


def _unit(rows: list | np.ndarray, dim: int) -> np.ndarray:
    x = np.asarray(rows, dtype=np.float64).reshape(len(rows), dim)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


class Nearest:
    """The k nearest rows of each query so far: rows come batch by batch, ties go to the smaller key."""

    def __init__(self, asked: np.ndarray, y: np.ndarray, k: int, exclude_self: bool) -> None:
        self.asked, self.y, self.k, self.exclude_self = asked, y, k, exclude_self
        self.squares = (y * y).sum(axis=1)
        self.query, self.key, self.near = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        #: The k-th distance of each query, beyond which no row counts.
        self.limit = np.full(len(asked), np.inf)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        rows, queries, near = [], [], []
        xx = (x * x).sum(axis=1)[:, None]
        for a in range(0, len(self.asked), STEP):
            q, v = self.asked[a : a + STEP], self.y[a : a + STEP]
            d = np.round(np.maximum(xx + self.squares[a : a + STEP] - 2 * x @ v.T, 0), DECIMALS)
            if self.exclude_self:
                d[ids[:, None] == q] = np.inf
            limit = self.limit[a : a + STEP]
            if len(x) > self.k:
                limit = np.minimum(limit, np.partition(d, self.k - 1, axis=0)[self.k - 1])
            r, c = np.nonzero((d <= limit) & np.isfinite(d))
            rows.append(r)
            queries.append(a + c)
            near.append(d[r, c])
        query, key = np.concatenate([self.query, *queries]), np.concatenate([self.key, ids[np.concatenate(rows)]])
        distance = np.concatenate([self.near, *near])
        order = np.lexsort((key, distance, query))
        query, key, distance = query[order], key[order], distance[order]
        begin = np.searchsorted(query, np.arange(len(self.asked) + 1))
        keep = np.arange(len(query)) - begin[query] < self.k
        self.query, self.key, self.near = query[keep], key[keep], distance[keep]
        full = np.flatnonzero(np.diff(begin) >= self.k)
        self.limit[full] = distance[begin[full] + self.k - 1]

    def batch(self) -> pa.RecordBatch:
        """(q_id, other, distance)"""
        return pa.RecordBatch.from_arrays([pa.array(self.asked[self.query]), pa.array(self.key), pa.array(self.near)], names=["q_id", "other", "distance"])


def knn(
    rows: DataFrame, queries: DataFrame, k: int = 30, key: str = "chunk_id", vector: str = "embedding", q_key: str = "q_id", q_vector: str = "embedding",
    exclude_self: bool = False, partition: tuple[str, ...] = (),
) -> DataFrame:
    """(q_id, key, rank, distance, score): for each query the k rows of least squared distance between unit vectors; equal ones rank by key.

    One pass over the rows: a task multiplies each Arrow batch with the queries and carries the k best of each on, so that the shuffle
    sees k rows for a query and task. Queries are sent to the tasks in blocks of QUERY_BLOCK. With `partition`, a query meets only rows
    of its own values there. Rows of another size than the query, and NULL vectors, are no neighbours.
    """
    spark = rows.sparkSession
    place = F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("\x1e")) for p in partition])
    asked = queries.select(F.col(q_key).cast("long").alias("_q"), F.col(q_vector).cast("array<double>").alias("_v"), place.alias("_p"))
    asked = asked.where("_q is not null and _v is not null and size(_v) > 0 and not exists(_v, x -> x is null)")
    n = asked.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    schema = "q_id long, other long, distance double"
    source = rows.select(F.col(key).cast("long").alias("_k"), F.col(vector).cast("array<double>").alias("_v"), place.alias("_p"))
    source = source.where("_k is not null and _v is not null and size(_v) > 0 and not exists(_v, x -> x is null)")
    hits = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == b)
        groups: dict[tuple[int, str], tuple[list, list]] = {}
        for r in part.collect():
            ids, vs = groups.setdefault((len(r["_v"]), r["_p"]), ([], []))
            ids.append(r["_q"])
            vs.append(r["_v"])
        known = spark.sparkContext.broadcast({g: (np.array(ids, dtype=np.int64), _unit(vs, g[0])) for g, (ids, vs) in groups.items()})
        found = source.mapInArrow(_nearest(known, k, exclude_self), schema)
        hits = found if hits is None else hits.union(found)
    return _ranked(hits, k, key)


def _ranked(hits: DataFrame, k: int, key: str) -> DataFrame:
    """(q_id, key, rank, distance, score) of hits (q_id, other, distance)."""
    rank = F.row_number().over(W.partitionBy("q_id").orderBy("distance", "other"))
    top = hits.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.select("q_id", F.col("other").alias(key), "rank", "distance", (1.0 / (1.0 + F.col("distance"))).alias("score"))


def _nearest(known, k: int, exclude_self: bool):  # noqa: ANN001, ANN202
    """The map over a task's batches of rows that keeps the k nearest for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = known.value
        best: dict[tuple[int, str], Nearest] = {}
        for b in batches:
            if not b.num_rows:
                continue
            ids, places = b.column(0).to_numpy(), b.column(2).dictionary_encode()
            number, names = places.indices.to_numpy(), places.dictionary.to_pylist()
            lengths = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            flat, starts = b.column(1).flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(lengths)]
            for at, place in enumerate(names):
                here = np.flatnonzero(number == at)
                for dim in np.unique(lengths[here]).tolist():
                    if (dim, place) not in queries:
                        continue
                    mine = here[lengths[here] == dim]
                    if (dim, place) not in best:
                        best[dim, place] = Nearest(*queries[dim, place], k, exclude_self)
                    best[dim, place].add(ids[mine], _unit(flat[starts[mine][:, None] + np.arange(dim)], dim))
        for found in best.values():
            yield found.batch()

    return run


def ivf_lists(n: int, nlist: int = 100, nprobe: int = 32, index_type: str = "IVF") -> tuple[int, int]:
    """(lists, lists to probe) of an index of n rows; one list where the exact index is taken."""
    if n == 0:
        raise ValueError("no rows to index")
    if index_type != "IVF" or n <= nlist:
        return 1, 1
    lists = min(nlist, n // 10)
    return lists, min(nprobe, lists)


def build_ivf(rows: DataFrame, key: str = "chunk_id", vector: str = "embedding", nlist: int = 100, seed: int = 42, sample: int = 50_000) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows with list_id, centroids): k-means on a bounded sample, then every row goes to its nearest centroid.

    The sample is bounded by a hash of the key before anything is sorted or sent to the driver.
    """
    n = rows.count()
    lists, _ = ivf_lists(n, nlist)
    if lists == 1:
        return rows.withColumn("list_id", F.lit(0)), [np.zeros(len(rows.first()[vector]))]
    centroids = _lloyd(_sampled(rows, n, key, vector, sample), lists, seed)
    known = rows.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        x, c = _unit(v.tolist(), known.value.shape[1]), known.value
        return pd.Series(((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1).astype(np.int32), index=v.index)

    return rows.withColumn("list_id", nearest(F.col(vector))), list(centroids)


def _sampled(rows: DataFrame, n: int, key: str, vector: str, sample: int) -> np.ndarray:
    """Unit vectors of at most `sample` rows chosen by a hash of the key, in order of key; a bound on the hash keeps what is sorted and sent small."""
    low = F.pmod(F.xxhash64(key), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1.0, 1.5 * sample / max(1, n)))
    usable = rows.select(key, F.col(vector).cast("array<double>").alias("_v")).where("_v is not null and size(_v) > 0 and not exists(_v, x -> x is null)").where(low)
    chosen = sorted(usable.orderBy(F.xxhash64(key)).limit(sample).collect(), key=lambda r: r[key])
    dim = len(chosen[0]["_v"]) if chosen else 1
    return _unit([r["_v"] for r in chosen if len(r["_v"]) == dim], dim)


def probes_for(
    rows: DataFrame, centroids: list[np.ndarray], k: int = 30, share: float = 0.95, key: str = "chunk_id", vector: str = "embedding", sample: int = 20_000, pilot: int = 1000
) -> int:
    """How many lists a query must probe to meet `share` of its k nearest, as a pilot of a bounded sample tells.

    Neighbours within the sample lie farther than those among all rows, so that the number errs towards more lists.
    """
    x, c = _sampled(rows, rows.count(), key, vector, sample), np.asarray(centroids, dtype=np.float64)
    if len(x) < 2 or x.shape[1] != c.shape[1]:
        return len(c)
    cost = (c * c).sum(axis=1) - 2 * x @ c.T
    own, ranks = cost.argmin(axis=1), []
    asked = np.random.default_rng(7).permutation(len(x))[:pilot]
    for a in range(0, len(asked), 500):
        part = asked[a : a + 500]
        near = x[part] @ x.T
        near[np.arange(len(part)), part] = -2
        top = np.argpartition(-near, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)]
        mine = np.take_along_axis(cost[part], own[top], axis=1)
        ranks.append((cost[part][:, None, :] < mine[:, :, None]).sum(axis=2).ravel())
    return int(np.quantile(np.concatenate(ranks), share, method="higher")) + 1


def _lloyd(x: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    """k-means on the sample; a centroid without members stays where it is."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        size = np.bincount(near, minlength=len(c))
        total = np.stack([np.bincount(near, x[:, d], len(c)) for d in range(x.shape[1])], axis=1)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


def knn_ivf(
    indexed: DataFrame, centroids: list[np.ndarray], queries: DataFrame, k: int = 30, nprobe: int = 32, key: str = "chunk_id", vector: str = "embedding",
    q_key: str = "q_id", q_vector: str = "embedding", exclude_self: bool = False,
) -> DataFrame:
    """As knn(), but a query meets only the rows of its nprobe nearest lists. With all lists it is exact.

    Lists are few, so each is cut into blocks of at most LIST_ROWS rows and LIST_QUERIES queries; a task meets one of each in one
    matrix product and keeps the k best. Only the number of blocks of each list, as many rows as there are lists, is broadcast.
    """
    c = np.asarray(centroids, dtype=np.float64)
    known = indexed.sparkSession.sparkContext.broadcast(c)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _unit(b.column(1).to_pylist(), known.value.shape[1])
                lists = ((known.value**2).sum(axis=1) - 2 * x @ known.value.T).argsort(axis=1, kind="stable")[:, :nprobe]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists.tolist(), pa.list_(pa.int32()))], names=["q_id", "v", "lists"])

    whole = f"v is not null and size(v) = {c.shape[1]} and not exists(v, x -> x is null)"
    asked = queries.select(F.col(q_key).cast("long").alias("q_id"), F.col(q_vector).cast("array<double>").alias("v")).where(f"q_id is not null and {whole}")
    asked = asked.mapInArrow(probe, "q_id long, v array<double>, lists array<int>").select("q_id", "v", F.explode("lists").alias("list_id"))
    rows = indexed.select(F.col(key).cast("long").alias("other"), F.col(vector).cast("array<double>").alias("v"), F.col("list_id").cast("int").alias("list_id")).where(f"other is not null and {whole}")
    blocks = lambda df, most: df.groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("blocks"))
    sizes = blocks(rows, LIST_ROWS).withColumnRenamed("blocks", "i_blocks").join(blocks(asked, LIST_QUERIES).withColumnRenamed("blocks", "j_blocks"), "list_id")
    sizes = F.broadcast(sizes)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    x = rows.join(sizes, "list_id").select("other", "v", "list_id", own("other", "i_blocks").alias("i"), each("j_blocks").alias("j"))
    y = asked.join(sizes, "list_id").select("q_id", "v", "list_id", own("q_id", "j_blocks").alias("j"), each("i_blocks").alias("i"))

    def meet(_: tuple, items: pa.Table, wanted: pa.Table) -> pa.Table:
        out = pa.schema([("q_id", pa.int64()), ("other", pa.int64()), ("distance", pa.float64())])
        if not items.num_rows or not wanted.num_rows:
            return out.empty_table()
        read = lambda t: t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        best = Nearest(wanted["q_id"].to_numpy(), _unit(read(wanted), c.shape[1]), k, exclude_self)
        best.add(items["other"].to_numpy(), _unit(read(items), c.shape[1]))
        return pa.Table.from_batches([best.batch()]).cast(out)

    met = x.groupBy("list_id", "i", "j").cogroup(y.groupBy("list_id", "i", "j")).applyInArrow(meet, "q_id long, other long, distance double")
    return _ranked(met, k, key)
