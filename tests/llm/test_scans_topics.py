"""Scan repair and subject areas."""

import random

from vellum.llm import scans, topics

BODY = "the steady river moves the market and the people describe the evaporation of the water near the village every morning".split()


def page(rng, n, header, printed, noise=()):
    lines = [" ".join(rng.choice(BODY) for _ in range(9)) for _ in range(8)]
    for at, line in noise:
        lines[at] = line
    return "\n".join([header, *lines, printed])


def test_defects_and_repair(spark):
    rng = random.Random(0)
    title = "The World of river and coast"
    clean = [[page(rng, p, title, f"{p + 11} |") for p in range(1, 5)] for _ in range(30)]
    noisy = [
        page(rng, 1, title.upper(), "p. 12", [(2, "the market and the evapor-"), (3, "ation of the water")]),
        page(rng, 2, "Chapter 3 Kokosa   [13]", "the rnarket and the water."),
        page(rng, 3, "the river moves the", "the w@ter near the village."),
        "",
    ]
    rows = [(i, "b.pdf", [{"page_number": n + 1, "text": t} for n, t in enumerate(pages)]) for i, pages in enumerate([*clean, noisy])]
    rows += [(900, "c.pdf", None), (901, None, []), (902, "b.pdf", [{"page_number": 1, "text": None}]), (30, "b.pdf", rows[30][2]), (None, "b.pdf", rows[0][2])]
    schema = "doc_id long, filename string, pages array<struct<page_number: int, text: string>>"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "'x' as title", "1 as item_id", "2 as _p")
    titles = spark.createDataFrame([("b.pdf", title), ("b.pdf", title)], "filename string, title string")
    repaired = scans.repaired_scans(df, titles)
    got = {tuple(r) for r in scans.page_defects(repaired).collect()}
    assert {x for x in got if x[0] == 30} == {
        (30, 1, "hyphen"), (30, 1, "header"), (30, 1, "page_number"), (30, 2, "header"), (30, 2, "page_number"), (30, 2, "misread"), (30, 3, "misread"),
    }
    assert {x for x in got if x[0] == 0} == {(0, p, d) for p in range(1, 5) for d in ("header", "page_number")}
    assert not {x for x in got if x[0] in (901, 902)}
    text = next(r["full_text"] for r in repaired.where("item_id = 30").collect())
    assert "evaporation" in text and "market and the water." in text and "the water near" in text and "Chapter" not in text and "@" not in text
    assert scans.page_defects(scans.repaired_scans(df.limit(0), titles)).count() == 0


def test_own_hyphens_stay():
    forms = scans.Forms(["seed-coat", "-sur-oline", "well-known"])
    assert scans._own_hyphen("seed", "coat.", forms) and scans._own_hyphen("Kehara", "sur-Oline", forms) and scans._own_hyphen("well", "", forms)
    assert not scans._own_hyphen("evapor", "ation", forms) and not scans._own_hyphen("", "", forms) and not scans._own_hyphen("-sur", "", forms)
    assert scans._own_hyphen("5eed", "coat", forms) and scans._own_hyphen("we1l", "known", forms) and not scans._own_hyphen("we1l", "knows", forms)
    assert scans._reflow(["a seed-", "coat is a class-", "room", "", "next"], {0: False, 1: True}, {}) == "a seed-coat is a classroom\n\nnext"


def test_long_running_lines_and_words_of_two_letters(spark):
    rng = random.Random(6)
    line = "The long and winding title of this book about all the rivers and the coasts of the world and of the villages by the sea"
    pages = [page(rng, p, line, f"{p}", [(1, "the market 0f the village")] if p == 1 else [(1, "one of the markets of the river")]) for p in range(1, 7)]
    prose = [page(rng, p, "the river runs by the old village and moves the water of the market" if p < 3 else f"own line {p}", f"{p}") for p in range(1, 7)]
    rows = [(i, "b.pdf", [{"page_number": n + 1, "text": t} for n, t in enumerate(ps)]) for i, ps in enumerate((pages, prose))]
    df = spark.createDataFrame(rows, "doc_id long, filename string, pages array<struct<page_number: int, text: string>>")
    got = {tuple(r) for r in scans.page_defects(scans.repaired_scans(df)).collect()}
    assert {p for d, p, k in got if d == 0 and k == "header"} == set(range(1, 7)) and (0, 1, "misread") in got
    assert not [1 for d, p, k in got if d == 1 and k == "header" and p < 3]


def test_evidence_by_joins_equals_broadcast(spark, monkeypatch):
    rng = random.Random(1)
    pages = [[page(rng, p, "x", f"{p}", [(1, "the rnarket is well-known"), (2, "and the peo-"), (3, "ple")] if i == 3 else [(1, "a well-known market")]) for p in (1, 2)] for i in range(40)]
    rows = [(i, "b.pdf", [{"page_number": n + 1, "text": t} for n, t in enumerate(ps)]) for i, ps in enumerate(pages)]
    df = spark.createDataFrame(rows, "doc_id long, filename string, pages array<struct<page_number: int, text: string>>")
    whole = {tuple(r) for r in scans.page_defects(scans.repaired_scans(df)).collect()}
    monkeypatch.setattr(scans, "BLOCK", 0)
    assert {tuple(r) for r in scans.page_defects(scans.repaired_scans(df)).collect()} == whole
    assert (3, 1, "misread") in whole and (3, 1, "hyphen") in whole


def test_anagram_hash_ignores_order_and_matches_the_driver(spark):
    df = spark.createDataFrame([("listen",), ("silent",), ("बदल",), ("😀a",)], "w string").select("w", scans.anagram_hash(scans.F.col("w")).alias("h"))
    h = {r["w"]: r["h"] for r in df.collect()}
    assert h["listen"] == h["silent"] and all(h[w] == sum(map(scans._power, w)) for w in h)


TERMS = {
    "science": ("atom", "magnet", "plant", "acid", "energy", "cell"), "mathematics": ("angle", "fraction", "circle", "sum", "graph", "square"),
    "literature": ("poem", "rhyme", "author", "novel", "stanza", "verse"), "sport": ("ball", "race", "coach", "goal", "match", "team"),
}
SUBJECT = {"science": "Science", "mathematics": "math.", "literature": "English", "sport": "Physical Education"}


def lesson(rng, area, n=6):
    return " ".join(f"The {rng.choice(TERMS[area])} near the {rng.choice(TERMS[area])} is described in the lesson of the day." for _ in range(n))


def test_physics_is_no_sport(spark):
    df = spark.createDataFrame([("Physics",), (" physical science",), ("Phys.",), ("PHYSICAL EDUCATION",), ("Scie.",), ("music",), (None,)], "s string")
    keys = [list(topics.SUBJECTS)[r[0]] if r[0] >= 0 else None for r in df.select(topics.subject_key(topics.F.col("s"))).collect()]
    assert keys == ["scie", "scie", "phys", "phys", "scie", None, None]


def test_areas(spark):
    rng = random.Random(0)
    docs, labels, want = [], [], {}
    for i in range(400):
        a, b = rng.sample(sorted(TERMS), 2)
        both = i % 10 == 0
        docs.append((i, lesson(rng, a, 4) + (" " + lesson(rng, b, 4) if both else ""), SUBJECT[a] if rng.random() < 0.9 else rng.choice(["Science", None])))
        want[i] = {a, b} if both else {a}
        if i % 8 == 0:
            labels += [(i, x) for x in want[i]]
    docs += [(900, None, "Science"), (901, "", "Science"), (902, "The office is closed in the morning. Bags are sold.", None), (903, "  ", None), (904, lesson(rng, "sport", 800), None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, subject string").selectExpr("*", "1 as chars", "2 as ids", "'x' as word")
    lab = spark.createDataFrame(labels, "doc_id long, subject_area string")
    got = {}
    for r in topics.main_areas(topics.subject_areas(df, lab)).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject_area"])
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.97 * len(want)
    assert got[904] == {"sport"} and not {900, 901, 902, 903} & set(got)
    assert topics.subject_areas(df.limit(0), lab).count() == 0


def test_all_evidence_comes_by_joins(spark, monkeypatch):
    rng = random.Random(2)
    known = [[page(rng, 1, "x", "1", [(1, "a well-known market by the seed-coat")])] for _ in range(20)]
    odd = [
        [page(rng, 1, "x", "1", [(7, "the market is well-")]), "x\n\nknown by the river\nthe water moves\n2"],  # goes on after the next page's edge
        [page(rng, 1, "x", "1", [(7, "the market is well-")])],  # nothing follows
        [page(rng, 1, "x", "1", [(2, "the river and the 5eed-"), (3, "coat near the village")])],  # a misread compound
        ["x\nthe river is near the rnar-", "x\nket near the village"],  # a misread word cut at the page's end
    ]
    rows = [(i, "b.pdf", [{"page_number": n + 1, "text": t} for n, t in enumerate(ps)]) for i, ps in enumerate([*known, *odd])]
    df = spark.createDataFrame(rows, "doc_id long, filename string, pages array<struct<page_number: int, text: string>>")
    read = lambda: {r["item_id"]: (r["pages"], r["full_text"]) for r in scans.repaired_scans(df).collect()}
    whole = read()
    assert not [i for i in (20, 21, 22) for p in whole[i][0] if "hyphen" in p["defects"]]
    monkeypatch.setattr(scans, "BLOCK", 0)
    assert read() == whole
