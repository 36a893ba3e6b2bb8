"""Splitting and packing: exact round trips and bounds."""

import itertools

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.llm import pack, split


def joined(text, pieces):
    out, at = "", 0
    for a, b, _ in pieces:
        assert a <= at < b
        out += text[at:b]
        at = b
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcd  .?।\n\n"), max_size=400), st.integers(10, 60), st.integers(0, 9))
def test_round_trip(text, limit, overlap):
    pieces = split.split_text(text, limit, overlap)
    assert joined(text, pieces) == text
    assert all(len(text[a:b].strip()) <= limit for a, b, _ in pieces)
    assert all(pieces[i][1] - pieces[i + 1][0] <= overlap for i in range(len(pieces) - 1))


def test_natural_where_possible():
    text = "One sentence here. " * 40
    assert {p[2] for p in split.split_text(text, 100, 20)} <= {"sentence", "end"}
    assert {p[2] for p in split.split_text("x" * 250, 100, 20)} == {"character", "end"}
    assert "word" in {p[2] for p in split.split_text("word " * 60, 100, 20)}
    whole = "a" * 60 + ".\n\n" + "b" * 60 + "."
    assert split.split_text(whole, 100, 10)[0][2] == "paragraph"


def test_found(spark):
    rows = [(1, "ab. " * 600), (1, "ab. " * 600), (2, "x" * 2001), (3, "x" * 2000), (4, None), (5, ""), (6, " " * 3000), (7, "  " + "y" * 2000 + "  "), (8, "z" * 100_000)]
    df = spark.createDataFrame(rows, "k long, text string").selectExpr("k as doc_id", "text", "1 as item_id", "text as pieces")
    got = {(r["item_id"], r["cut"]) for r in split.cut_kind(split.split_oversized(df, "doc_id", "text"), "s").collect()}
    assert got == {(1, "natural"), (2, "hard"), (8, "hard")}
    assert split.split_oversized(df.limit(0), "doc_id", "text").count() == 0


def test_bounds_are_optimal():
    hist = {3: 10, 4: 7, 6: 5, 9: 2}
    padded = lambda bounds: sum(n * min(b for b in bounds if b >= s) for s, n in hist.items())
    for k in (1, 2, 3, 4):
        got = pack.bucket_bounds(hist, k)
        assert len(got) <= k and got[-1] == 9
        assert padded(got) == min(padded((*c, 9)) for c in itertools.combinations((3, 4, 6), k - 1))
    assert pack.bucket_bounds({}) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_batches_never_overflow_and_leave_no_two_half_empty(sizes):
    filled = {}
    for s, n in zip(sizes, pack.batches(sizes, 20)):
        filled[n] = filled.get(n, 0) + s
    assert all(v <= 20 for v in filled.values())
    assert sum(v <= 10 for v in filled.values()) <= 1


def test_containers(spark):
    texts = [(i, " ".join(["w"] * (1 + i * 7 % 50))) for i in range(300)] + [(900, "w " * 130), (901, None), (902, ""), (903, " \n"), (904, "a-b c"), (5, "twice")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumnRenamed("nothing", "x").selectExpr("*", "'c' as container", "1 as n")
    out = pack.fill_containers(df, capacity=50)
    rows = out.collect()
    used = {}
    for r in rows:
        used[r["container"]] = used.get(r["container"], 0) + r["size"]
    assert max(used.values()) <= 50
    assert sum(r["size"] for r in rows) == sum(len(t.split()) for _, t in texts if t) + 2
    assert {r["doc_id"] for r in pack.larger_than_container(out).collect()} == {900}
    assert sorted(r["size"] for r in rows if r["item_id"] == 900) == [30, 50, 50]
    assert not {901, 902, 903} & {r["item_id"] for r in rows}
    many = df.where("doc_id < 300").crossJoin(spark.range(8).withColumnRenamed("id", "copy")).withColumn("doc_id", F.expr("doc_id * 8 + copy"))
    wide = pack.fill_containers(many, capacity=400)
    full = wide.groupBy("container").agg(F.sum("size").alias("s")).agg(F.max("s").alias("most"), F.avg("s").alias("mean")).first()
    assert full["most"] <= 400 and full["mean"] > 0.95 * 400
    assert pack.fill_containers(df.limit(0)).count() == 0
