"""Golden cases of the text functions, and property tests against plain Python."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import enrich as E
from vellum.functions import text as T


def apply(spark, values, fn, schema="t string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}").coalesce(1)
    return [r["o"] for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]


def test_clean_text(spark):
    assert apply(spark, ["a [ ] b|0", "x___y\n\n\n\nz", None, "", "  (  ) 10 "], T.clean_text) == ["a bIO", "x y z", "", "", "1O"]


def test_clean_hindi_text(spark):
    got = apply(spark, ["१२ पाठ\n  42 \nअगला   शब्द [ ]", "xiv\nA\n\n\n\n\nB", None], T.clean_hindi_text)
    assert got[0].startswith("12 पाठ") and "42" not in got[0] and "[" not in got[0]
    assert got[1] == "A\n\n\nB" and got[2] == ""


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab |0_[]()\n\t १.", max_size=30), min_size=1, max_size=20))
def test_clean_text_equals_python(spark, texts):
    def plain(t):
        for p in (r"\[\s*\]", r"\(\s*\)", r"_{3,}", r"\s{3,}"):
            t = re.sub(p, " ", t)
        return re.sub(r"\s+", " ", t.replace("|", "I").replace("0", "O")).strip()

    assert apply(spark, texts, T.clean_text) == [plain(t) for t in texts]


def test_structures(spark):
    got = apply(spark, ["for example: x", "Definition: x", "note: a theorem 12 note:", None], T.structures)
    assert [(s["kind"], s["start_pos"], s["end_pos"], s["marker"]) for s in got[0]] == [("example", 0, 12, "for example:"), ("example", 4, 12, "example:")]
    assert got[1] == [] and [s["start_pos"] for s in got[2]] == [0, 8, 19] and not got[3]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["note:", "example:", "for ", "theorem 3", " ", "def:", "é", "e.g."]), max_size=12).map("".join), min_size=1, max_size=10))
def test_structures_equal_finditer(spark, texts):
    want = [sorted((m.start(), o, m.end(), k, m.group()) for o, (k, p) in enumerate(T.MARKERS) for m in re.finditer(p, t)) for t in texts]
    assert [[tuple(s) for s in row] for row in apply(spark, texts, T.structures)] == want


def test_footer_page_number(spark):
    assert apply(spark, ["a\nb\nScience 25", "in 2024", "", None, "7\na\nb\nc", "x\n12\ny"], T.footer_page_number) == ["25", "Unknown", "Unknown", "Unknown", "Unknown", "12"]


def test_names(spark):
    assert apply(spark, ["jesc110.pdf", "jesc101", "abc", "a/b/x12.pdf"], T.filename_chapter) == ["10", "1", "Unknown", "12"]
    assert apply(spark, ["jesc101.pdf", "jesc000", "x"], T.series_chapter) == ["101", "0", None]
    assert apply(spark, ["Chapter discusses", "chapter 7 of", "no"], T.text_chapter) == ["di", "7", None]
    assert apply(spark, ["Section 2.3 x", ""], T.text_section) == ["2.3", None]
    assert apply(spark, ["Health and Physical Science", "English"], T.subject_slug) == ["health--physical-science", "english"]
    assert apply(spark, ["x/jhsc1.pdf", "jhss", "y"], T.hindi_subject) == ["Science", "Social Science", "Unknown"]


def test_devanagari(spark):
    assert apply(spark, ["कab", "", None], T.devanagari_percentage)[:2] == [33.3, 0.0]


@pytest.mark.parametrize(("text", "kind"), [("Example: x", "example"), ("an example of x", "explanation"), ("definition. y", "definition"), ("fig. 3", "figure"), ("Chapter one", "chapter_heading"), ("chapter " * 80, "explanation"), ("questions: a", "exercise")])
def test_content_type(spark, text, kind):
    assert apply(spark, [text], E.content_type) == [kind]


def test_flags(spark):
    assert apply(spark, ["a-b", "plain", "x → y"], E.has_equations) == [True, False, True]
    assert apply(spark, ["Why?", "An Activity", "none"], E.has_questions) == [True, True, False]


def test_keywords(spark):
    texts = ["zeta alpha zeta the the beta", "café naïve test", "", None, "b1 abc abc_d xyz"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    want = [["zeta", "alpha", "beta"], ["test"], [], [], ["abc", "xyz"]]
    want[4] = ["xyz"] if "abc" not in re.findall(r"\b[a-zA-Z]{3,}\b", texts[4]) else ["abc", "xyz"]
    rows = {r["k"]: r["keywords"] for r in E.keywords(df, "k", "t").collect()}
    assert [rows[i] for i in range(5)] == want
    assert apply(spark, texts, E.keyword_array) == want
