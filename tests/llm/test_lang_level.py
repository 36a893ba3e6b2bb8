"""Languages and reading levels: held-out accuracy on texts made here, and the edges."""

import math
import os
import random
from fractions import Fraction

import pytest

from vellum.llm import lang, level

pytestmark = pytest.mark.skipif(not os.path.exists(lang.VOCABULARY), reason="no public vocabulary")

EN = "the quick river runs beside the old village and children read about plants in their school every morning before they walk home with friends".split()
FR = "la rivière rapide coule près du vieux village et les enfants étudient les plantes dans leur école chaque matin avant de rentrer avec des amis".split()
HI = "नदी तेज बहती है और बच्चे हर सुबह अपने विद्यालय में पौधों के बारे में पढ़ते हैं फिर वे मित्रों के साथ घर जाते हैं".split()
MR = "नदी वेगाने वाहते आणि मुले दररोज सकाळी शाळेत वनस्पतींबद्दल वाचतात नंतर ते मित्रांसोबत घरी जातात असे शिक्षक म्हणाले".split()
UR = "دریا تیز بہتا ہے اور بچے ہر صبح اپنے اسکول میں پودوں کے بارے میں پڑھتے ہیں پھر وہ دوستوں کے ساتھ گھر جاتے ہیں".split()
ALL = {"en": EN, "fr": FR, "hi": HI, "mr": MR, "ur": UR}


def text(rng, code, n=40):
    words = [rng.choice(ALL[code]) for _ in range(n)]
    return " ".join(w + (". " if i % 8 == 7 else "") for i, w in enumerate(words))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(0)
    records = [(c, text(rng, c).lower().replace(".", "").split()) for c in ALL for _ in range(40)]
    records += [("en", text(rng, "fr").lower().replace(".", "").split())] * 3  # wrong labels
    return lang.fit_records(records, lang.vocabulary())


def shares(form, model):
    out = {}
    for code, a, b, _ in lang.identify(form, model):
        out[code] = out.get(code, 0) + (b - a) / len(form)
    return out


def test_held_out(model):
    rng = random.Random(1)
    for code in ALL:
        for _ in range(20):
            assert shares(text(rng, code), model).get(code, 0) > 0.95


def test_mixed_and_foreign_letters(model):
    rng = random.Random(2)
    both = shares(text(rng, "en") + " " + text(rng, "fr"), model)
    assert both["en"] > 0.3 and both["fr"] > 0.3
    latin = " ".join(lang.latin_spelling(w) for w in text(rng, "hi").split())
    assert shares(latin, model).get("hi", 0) > 0.9
    assert lang.latin_spelling("इंटरनेट") == "intaranet" and lang.latin_spelling("चित्र") == "chitr"
    assert lang.identify("123 456", model) == [] or lang.identify("123 456", model)[0][3] == 0
    assert lang.identify("", model) == []


def test_forward_sums_all_segmentations():
    pieces = {b" ": 0, b"a": 1, b"b": 2, b"ab": 3, b" a": 4}
    fitted = lang.fit_pieces({"ab": 10, "a": 5}, pieces)
    assert abs(sum(fitted.values()) - 1) < 1e-9 and all(v >= 0 for v in fitted.values())
    assert {(i, j) for i, j, _ in lang.edges("ab", pieces, lang.beginnings(pieces))} == {(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)}


def test_long_words_are_scored_whole(model):
    long = "rivière" * 30 + "the" * 40
    es, n = lang.edges(long, model.pieces, model.heads), len(long.encode()) + 1
    for m in range(4):
        total = sum_exactly(es, n, model.prob[:, m])
        want = math.log(total.numerator) - math.log(total.denominator)
        assert abs(lang.log_forward(es, n, [math.log(p) for p in model.prob[:, m]]) - want) < 1e-6
    assert model.score("a" * 200 + "é").shape == (len(lang.MODELS),)
    assert not (model.score("school" * 40) == model.score("school" * 10 + "école" * 30)).all()


def sum_exactly(es, n, prob):
    ahead = [Fraction(0)] * (n + 1)
    ahead[0] = Fraction(1)
    for i, j, p in es:
        ahead[j] += ahead[i] * Fraction(float(prob[p]))
    return ahead[n]


def test_the_sample_takes_each_text_once(spark, model):
    rng = random.Random(9)
    rows = [(text(rng, c, 60), c) for c in ALL for _ in range(30)]
    many = rows + [(rows[0][0], "en")] * 3000
    a, b = (lang.fit(spark.createDataFrame(r, "text string, lang string")) for r in (rows, many))
    assert a.pieces == b.pieces and (a.prob == b.prob).all()


def test_found(spark, model):
    rng = random.Random(3)
    rows = [(1, text(rng, "en"), "English"), (2, text(rng, "en"), "hi"), (3, text(rng, "hi"), None), (4, text(rng, "ur") + text(rng, "en"), "ur"), (5, "short text", "fr"),
            (6, None, "en"), (7, "", "en"), (2, text(rng, "en"), "hi"), (8, text(rng, "mr") * 200, " Marathi "), (9, text(rng, "fr"), "und")]
    df = spark.createDataFrame(rows, "chunk_uid long, text string, lang string").selectExpr("*", "1 as item_id", "2 as parts", "'x' as _k")
    found = lang.languages(df, model, "chunk_uid", "text", extra=("lang",), least_words=20)
    got = {(r["item_id"], r["found_lang"]) for r in lang.mislabelled(found, "lang", "chunk").collect()}
    assert got == {(2, "en"), (3, "hi"), (4, "ur"), (4, "en"), (9, "fr")}
    for r in found.collect():
        assert all(0 <= p["confidence"] <= 1 for p in r["parts"])
    assert lang.languages(df.limit(0), model, "chunk_uid", "text").count() == 0
    assert lang.fit(df.limit(0)).score("word").shape == (len(lang.MODELS),)


def test_syllables():
    for word, n in {"cat": 1, "table": 2, "reading": 2, "photosynthesis": 5, "jumped": 1, "wanted": 2, "houses": 2, "well-known": 2, "be": 1, "the": 1}.items():
        assert level.syllables(word) == n, word


def test_hyphenation_loses_no_letter():
    cuts = {"reading": "rea-ding", "table": "ta-ble", "photosynthesis": "pho-to-syn-the-sis", "children": "chil-dren", "river": "ri-ver", "jumped": "jumped"}
    for word, parts in cuts.items():
        assert "-".join(level.hyphenated(word)) == parts, word
    for word in ("evaporation", "thermodynamics", "queue", "rhythm", "well-known", "it's", "x"):
        assert "".join(level.hyphenated(word)) == word.replace("-", "").replace("'", "")
        assert level.syllables(word) == len(level.hyphenated(word)) >= 1


EASY = "The cat sat on the mat. We ran to the shop. It is red and big. I see a dog."
MIDDLE = "The students of the village described the regular magnet and wrote the results in a notebook before lunch."
HARD = "Notwithstanding the hierarchical interpretation of thermodynamics, philosophers hypothesised its indispensable significance considerably."


def grader():
    rng = random.Random(0)
    make = lambda s: " ".join(w for _ in range(4) for w in [s] + [rng.choice(s.split()) + "."])
    texts = [make(s) for s in (EASY, MIDDLE, HARD) for _ in range(20)]
    return level.fit_grader(texts, [i for i in range(3) for _ in range(20)])


def test_levels_in_order():
    g = grader()
    scores = [g.score(level.sentences((s + " ") * 5)) for s in (EASY, MIDDLE, HARD)]
    assert [g.level(x) for x in scores] == list(level.LEVELS)
    assert level.published(level.sentences(HARD).sum(axis=0), 1) > level.published(level.sentences(EASY).sum(axis=0), 4)
    assert level.fit_grader([], []).level(0.1) == "primary"


def test_misplaced(spark, model):
    g = grader()
    rows = [(1, (HARD + " ") * 5, "Class 5"), (2, (EASY + " ") * 5, " VI"), (3, (EASY + " ") * 5, "class-10"), (4, (HARD + " ") * 5, "9"), (5, (HARD + " ") * 5, None),
            (6, None, "5"), (7, "", "5"), (8, HARD, "5"), (1, (HARD + " ") * 5, "Class 5"), (9, text(random.Random(5), "fr", 60), "5"), (10, (HARD + " ") * 5, "VII")]
    df = spark.createDataFrame(rows, "chunk_uid long, text string, class string").selectExpr("*", "1 as level", "2 as _t", "'en' as lang")
    english = lang.fit_records([("en", (EN + EASY.split() + HARD.split() + MIDDLE.split()) * 5)] * 20 + [("fr", FR * 5)] * 20, lang.vocabulary())
    assert {r["chunk_uid"] for r in level.misplaced(df, g, english).collect()} == {1, 3}
    assert level.misplaced(df.limit(0), g, english).count() == 0
