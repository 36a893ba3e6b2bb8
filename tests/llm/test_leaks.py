"""Leak search against brute force."""

import random

from vellum.llm import leaks
from vellum.llm.common import words


def edit(pattern, tokens):
    prev, best = list(range(len(pattern) + 1)), (len(pattern), 0)
    for j, w in enumerate(tokens, 1):
        cur = [0] * (len(pattern) + 1)
        for i in range(1, len(pattern) + 1):
            cur[i] = min(prev[i] + 1, cur[i - 1] + 1, prev[i - 1] + (pattern[i - 1] != w))
        prev = cur
        if cur[-1] < best[0]:
            best = (cur[-1], j)
    return best


def test_myers_equals_dynamic_programming():
    for seed in range(500):
        rng = random.Random(seed)
        p, t = [rng.choice("abc") for _ in range(rng.randint(1, 80))], [rng.choice("abc") for _ in range(rng.randint(0, 90))]
        assert leaks.myers(p, t) == edit(p, t)


def test_found_equals_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(2, 25)))) for i in range(40)] + [(90, None), (91, ""), (92, "two words"), (93, items0 := "the same item again and again")]
    items.append((94, items0))
    docs = []
    for d in range(120):
        text = [rng.choice(vocab) for _ in range(30)]
        if d % 3 == 0:
            own = rng.choice([t for _, t in items if t]).split()
            cut = own[: max(1, int(len(own) * rng.random() * 1.4))]
            text[10:10] = [w.upper() + "," if rng.random() < 0.3 else w for w in cut]
        docs.append((d, " ".join(text)))
    docs += [(500, None), (501, ""), (502, "w1 " * 20_000), (0, docs[0][1]), (503, items0)]
    want = set()
    for d, t in docs:
        for i, q in items:
            a, b = leaks.runs(words(q or "")), leaks.runs(words(t or ""))
            if a and len(a & b) * 2 >= len(a):
                want.add((d, i))
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as _t")
    it = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'a' as answer")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(df, it).collect()}
    assert got == want and len(want) > 10
    assert leaks.find_leaks(df.limit(0), it).count() == 0 and leaks.find_leaks(df, it.limit(0)).count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x y z")], "doc_id long, text string")
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c d", "d e f", "x y z", "q r s"])], "item_id long, text string")
    whole = sorted(map(tuple, leaks.find_leaks(docs, items).select("doc_id", "item_id").collect()))
    monkeypatch.setattr(leaks, "BLOCK", 1)
    assert sorted(map(tuple, leaks.find_leaks(docs, items).select("doc_id", "item_id").collect())) == whole == [(1, 0), (1, 1), (2, 2)]
