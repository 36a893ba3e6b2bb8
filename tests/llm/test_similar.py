"""Most similar vectors against brute force."""

import time

import numpy as np

from vellum.llm import similar
from vellum.llm.additive import AdditiveQuantizer, kmeans


def data(n=1200, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64))
    for i in range(0, n, 6):  # families
        for j in range(1, 4):
            x[i + j] = x[i] + rng.normal(scale=0.25, size=64)
    return x


def brute(ids, x, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    ids, out = np.asarray(ids), set()
    for i, row in enumerate(np.round(s, 12)):
        order = np.lexsort((ids, -row))[:k]
        out |= {(int(ids[i]), int(ids[j])) for j in order if s[i, j] >= least}
    return out


def frame(spark, ids, x, extra=()):
    rows = [(int(i), v.astype(np.float32).tolist(), 64) for i, v in zip(ids, x)] + list(extra)
    return spark.createDataFrame(rows, "chunk_uid long, embedding array<float>, embedding_dim int").selectExpr("*", "1 as uid", "2 as v", "3 as cell")


def test_recall_with_and_without_threshold(spark):
    x = data().astype(np.float32).astype(np.float64)
    ids = list(range(10, 10 + len(x)))
    bad = [(1, None, None), (2, [1.0] * 32, 32), (3, [0.0] * 64, 64), (4, [float("nan")] * 64, 64), (None, [1.0] * 64, 64), (10, x[0].astype(np.float32).tolist(), 64)]
    df = frame(spark, ids, x, bad)
    got = {(r["uid"], r["other"]) for r in similar.similar_vectors(df, "chunk_uid", "embedding", 5, 0.85, dim_column="embedding_dim").collect()}
    want = brute(ids, x, 5, 0.85)
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 1000
    near = {(r["uid"], r["other"]) for r in similar.similar_vectors(df, "chunk_uid", "embedding", 3, dim_column="embedding_dim").collect()}
    assert len(near & brute(ids, x, 3, -1)) >= 0.9 * 3 * len(ids)


def test_copies_take_each_other_by_key(spark):
    x = np.concatenate([np.tile(data(12)[0], (40, 1)), data(300, 1)])
    df = frame(spark, range(len(x)), x)
    rows = similar.similar_vectors(df, "chunk_uid", "embedding", 5, 0.999).collect()
    mine = {r["uid"]: [] for r in rows}
    for r in sorted(rows, key=lambda r: r["rank"]):
        mine[r["uid"]].append(r["other"])
    assert mine[0] == [1, 2, 3, 4, 5] and mine[39] == [0, 1, 2, 3, 4] and mine[3] == [0, 1, 2, 4, 5]


def test_empty(spark):
    assert similar.similar_vectors(frame(spark, [], np.zeros((0, 64))), "chunk_uid", "embedding").count() == 0


def test_beam_is_no_worse_than_greedy_and_scores_are_cosines():
    x = data(600).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = AdditiveQuantizer.fit(x, (32, 32, 32))
    wide, norms = q.encode(x, beam=8)
    slim, _ = q.encode(x, beam=1)
    err = lambda c: ((x - q.decode(c)) ** 2).sum()
    assert err(wide) <= err(slim)
    s = q.scores(q.tables(x[:5]), wide, norms)
    d = q.decode(wide)
    assert np.allclose(s, (d / np.linalg.norm(d, axis=1, keepdims=True)) @ x[:5].T, atol=1e-4)


def recall(spark, x, k, least, **how):
    ids = list(range(len(x)))
    got = {(r["uid"], r["other"]) for r in similar.similar_vectors(frame(spark, ids, x), "chunk_uid", "embedding", k, least, **how).collect()}
    want = brute(ids, x, k, -1 if least is None else least)
    assert len(want) > 1000
    return len(want & got) / len(want), len(got) / len(want)


def dense_third(seed=5):
    rng = np.random.default_rng(seed)
    x = data(1200, seed)
    x[:400] = rng.normal(size=64) + rng.normal(scale=0.3, size=(400, 64))
    return x.astype(np.float32).astype(np.float64)


def test_a_dense_group_of_a_third_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(similar, "ITEMS", 40)  # cells of several blocks of items and of queries
    monkeypatch.setattr(similar, "ASKED", 300)
    for k, least in ((5, 0.85), (3, None)):
        share, size = recall(spark, dense_third(), k, least, cell_size=50)
        assert share >= 0.95 and size <= 1.01


def test_looking_into_all_cells_is_exact(spark):
    assert recall(spark, dense_third(), 5, 0.85, cell_size=50, meet=1.0) == (1.0, 1.0)


def test_two_books_make_the_cells(spark):
    rng = np.random.default_rng(80)
    x = data(1800, 8)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.normal(size=u[:600].shape)
    noise -= (noise * u[:600]).sum(axis=1, keepdims=True) * u[:600]
    x[600:1200] = 0.86 * u[:600] + np.sqrt(1 - 0.86**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    x = x.astype(np.float32).astype(np.float64)
    known = similar.fit(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "uid long, v array<float>"), len(x), 5, 0.85, cells=8, cell_size=25)
    assert known.depth == 2 and known.number == 8 * 16
    assert recall(spark, x, 5, 0.85, cells=8, cell_size=25)[0] >= 0.95


def test_within_a_block_nothing_is_lost():
    x = dense_third().astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = AdditiveQuantizer.fit(x, (16, 16, 16))
    codes, norms = q.encode(x)
    fits = (x * q.decode(codes)).sum(axis=1) / np.sqrt(norms)
    ids = np.arange(len(x))
    for k, least in ((5, 0.85), (3, None), (3, -0.5)):
        a, b, near = similar.best_of_block(q, ids, x, codes, norms, fits, ids, x, k, least)
        got = dict(zip(zip(a.tolist(), b.tolist()), near.tolist()))
        want = brute(ids, x.astype(np.float64), k, -1 if least is None else least)
        assert want <= set(got)
        assert all(abs(got[p] - float(x[p[0]] @ x[p[1]])) < 1e-3 for p in list(want)[:50])


def test_words_without_vectors_are_placed_anew():
    rng = np.random.default_rng(4)
    x = np.concatenate([np.zeros((900, 8)), rng.normal(size=(600, 8)) + 4]).astype(np.float32)
    c = kmeans(x, 400, 10, 1)
    near = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
    assert len(np.unique(near)) > 300


def shuffled(spark):
    """Bytes that all tasks so far have written for shuffles."""
    time.sleep(0.3)  # executors' sums are brought up to date by later tasks, not at once
    spark.range(8).repartition(2).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    seen = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(seen.apply(i).totalShuffleWrite() for i in range(seen.size()))


def test_what_is_shuffled_does_not_follow_the_cells(spark):
    x = np.random.default_rng(3).normal(size=(6000, 64)).astype(np.float32)
    df = frame(spark, range(len(x)), x)
    before = shuffled(spark)
    similar.similar_vectors(df, "chunk_uid", "embedding", 5, 0.85, cell_size=25, meet=1.0).count()  # all of 240 cells
    assert shuffled(spark) - before < 14 * x.nbytes


def test_blocks_that_end_anywhere_in_a_batch_are_met_whole(spark, monkeypatch):
    monkeypatch.setattr(similar, "ITEMS", 40)
    monkeypatch.setattr(similar, "ASKED", 100)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert recall(spark, dense_third(), 5, 0.85, cell_size=50, meet=1.0) == (1.0, 1.0)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_groups_hold_all_cells_looked_into():
    x = data(1200).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    known = similar.Cells(AdditiveQuantizer.fit(x, (48, 4, 8)), 2)
    known.probes[:] = 20
    known.gather(6)
    assert len(set(known.group.tolist())) <= 6
    for own, cells in zip(known.own(x), known.nearest(x)):
        groups, lists = known.by_group(cells)
        assert len(set(groups)) == len(groups) <= 6 and lists[0][0] == own
        assert sorted(c for part in lists for c in part) == sorted(cells.tolist())
        assert all(known.group[c // 4] == g for g, part in zip(groups, lists) for c in part)


def test_zeros_of_either_sign_are_the_same_in_copies(spark):
    x = data(300)
    x[:6] = x[0]
    x[:6, 7] = [0.0, -0.0, 0.0, -0.0, 0.0, 0.0]
    rows = similar.similar_vectors(frame(spark, range(len(x)), x), "chunk_uid", "embedding", 5, 0.999).collect()
    got = {(r["uid"], r["other"]) for r in rows}
    assert {(a, b) for a in range(6) for b in range(6) if a != b} <= got
