"""Near-duplicates against brute force."""

import random

from vellum.llm import neardup
from vellum.llm.canon import canonical
from vellum.llm.common import words
from vellum.llm.components import components


def shingles(text, size):
    w = words(canonical(text))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def corpus(rng, n):
    vocab = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(n):
        base = [rng.choice(vocab) for _ in range(rng.randint(35, 60))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randint(0, 3)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    return rows


def test_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    rows = corpus(rng, 60)
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(2000, None), (2001, ""), (2002, "too short"), (0, rows[0][1]), (2003, "fa​rm " + rows[1][1])]
    sets = {}
    for k, t in rows:
        if t and len(words(t)) >= 30:
            sets[k] = shingles(t, 3)
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows, "chunk_uid long, text string").selectExpr("*", "1 as uid", "2 as cls", "3 as a")
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 800
    assert neardup.near_duplicate_pairs(df.limit(0)).count() == 0


def test_large_regions_are_met_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REGION", 8)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "chunk_uid long, text string")
    assert neardup.near_duplicate_pairs(df).count() == 60 * 59 // 2


def test_a_crowded_family_keeps_the_odds_of_a_small_one(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REGION", 8)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for at in rng.sample(range(150), 5):
            w[at] = f"x{i}-{at}"
        rows.append((i, " ".join(w)))
    sets = {k: shingles(t, 3) for k, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and 0.6 <= len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.75}
    got = {tuple(r) for r in neardup.near_duplicate_pairs(spark.createDataFrame(rows, "chunk_uid long, text string")).collect()}
    assert len(want) > 1000 and len(want & got) >= 0.985 * len(want)


def test_odds_do_not_depend_on_the_region(spark, monkeypatch):
    """One template's records at a similarity of about 0.65: as many are found in crowded regions as in sparse ones."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        w = list(base)
        for at in rng.sample(range(300), 12):
            w[at] = f"x{i}-{at}"
        rows.append((i, " ".join(w)))
    sets = {k: shingles(t, 3) for k, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows, "chunk_uid long, text string")
    for region, sent in ((1000, 0), (40, 200_000), (40, 0)):
        monkeypatch.setattr(neardup, "REGION", region)
        monkeypatch.setattr(neardup, "MOST_SENT", sent)
        got = {tuple(r) for r in neardup.near_duplicate_pairs(df).collect()}
        assert got <= want and len(want) > 20_000 and len(got) >= 0.98 * len(want)


def test_labels_sort_by_levels():
    import numpy as np

    a = neardup.shingle_hashes(neardup.word_hashes(" ".join(f"w{i}" for i in range(60))), 3)
    b = neardup.shingle_hashes(neardup.word_hashes(" ".join(f"w{i}" for i in range(66))), 3)
    x, y = (neardup.signature(s)[0] for s in (a, b))
    both = (x >> neardup.TAIL) == (y >> neardup.TAIL)
    assert 0 < both.sum() and (both | (x != y)).all() and len(np.unique(x)) == neardup.TREES


def test_a_third_in_one_class_is_one_row_before_its_labels_are_spread(spark):
    rows = [(i, "one text of many copies in the whole collection of texts") for i in range(3000)] + [(5000 + i, f"text {i} of its own with words {i} and {i + 1}") for i in range(30)]
    recs = neardup.records(spark.createDataFrame(rows, "chunk_uid long, text string").repartition(3), "chunk_uid", "text", 5, 1)
    assert recs.count() == 3030 and recs.where("labels is not null").count() < 100
    assert neardup.regions(recs).groupBy("region", "cls").count().where("count > 1").isEmpty()


def test_groups_one_row_per_record(spark):
    base = [f"w{i}" for i in range(200)]
    chain = [(i, " ".join(base[3 * i : 3 * i + 100])) for i in range(10)]  # neighbours alike, ends not
    rows = chain + [(100 + i, chain[0][1]) for i in range(300)] + [(900, "alone in the world"), (901, None)]
    df = spark.createDataFrame(rows, "chunk_uid long, text string")
    out = neardup.near_duplicate_groups(df).collect()
    assert len(out) == 311
    assert len({r["group_id"] for r in out}) == 2
    assert next(r["links"] for r in out if r["uid"] == 900) == 0


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9)] + [(i, i + 1) for i in range(100, 160)], "a long, b long")
    got = {r["key"]: r["component"] for r in components(links).collect()}
    assert got[3] == got[1] == 1 and got[5] == 4 and got[160] == 100 and 9 not in got
