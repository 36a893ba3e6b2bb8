"""Canonical text: one form for what looks alike, differences kept."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import canon

ALIKE = [
    ("ＡＢ１２", "AB12"), ("école", "école"), ("a b 　c", "a b c"), ("fa​rm﻿", "farm"), ("pаper", "paper"), ("ﬁeld", "field"),
    ("ज़", "ज़"), ("كي", "کی"), ("𝟏𝟐", "12"), ("ئ", "ئ"), ("ο​n", "on"), ("अा", "आ"), ("a‍́", "á"), (" x ", "x"),
    ("ρυɡѵ", "pugv"), ("ꓐꓳꓫ", "BOX"), ("आॅ", "ऑ"), ("ی\u200bٔ", "ئ"), ("а́", "á"),
]
HIDDEN = "\u200b\u00ad\u200d\u2060\ufe0f\ufeff\U000e0101"
DIFFERENT = [("A", "a"), ("e", "é"), ("x2", "x²"), ("1", "①"), ("H2", "H₂"), ("½", "1/2"), ("a b", "a, b"), ("naive", "naïve"), ("tm", "™"), ("ab", "a b")]


@pytest.mark.parametrize(("a", "b"), ALIKE)
def test_alike(a, b):
    assert canon.canonical(a) == canon.canonical(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(a, b):
    assert canon.canonical(a) != canon.canonical(b)


def test_tables_have_no_chain_and_keep_visible_signs():
    t = canon.transducer()
    assert all(t.spell.get(c, c) == c for v in t.spell.values() for c in v)
    assert not {"²", "₂", "①", "½", "™"} & set(t.spell)
    assert all(canon.canonical(canon.canonical(chr(o))) == canon.canonical(chr(o)) for block in canon.BLOCKS for o in block)


def test_a_hundred_thousand_strings_are_stable_and_blind_to_what_is_invisible():
    rng = random.Random(7)
    marks = [chr(o) for o in range(0x300, 0x1E00) if unicodedata.category(chr(o))[0] == "M"]
    letters = "aeonAｅﬁаеνكيیەہاअआएकनरयडोेौॉॅा़्ँैُِّٔ각가ｶﾞ.-1１ \u00a0"
    for _ in range(100_000):
        text = "".join(rng.choice(letters) if rng.random() < 0.7 else rng.choice(marks) for _ in range(rng.randint(1, 6)))
        form = canon.canonical(text)
        assert canon.canonical(form) == form, ascii(text)
        at = rng.randint(0, len(text))
        assert canon.canonical(text[:at] + rng.choice(HIDDEN) + text[at:]) == form, ascii(text)
        assert canon.canonical(HIDDEN[0].join(text)) == form, ascii(text)
        assert canon.canonical(unicodedata.normalize("NFD", text)) == canon.canonical(unicodedata.normalize("NFC", text)) == form, ascii(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeo é़्́̂​‍­ксаﬁＡ１²①क़अाियी \n  "), max_size=30))
def test_idempotent(text):
    once = canon.canonical(text)
    assert canon.canonical(once) == once
    assert "  " not in once and once == once.strip()


def test_pairs(spark):
    rows = [(1, "a farm", "x"), (2, "a fa​rm", "x"), (3, "a  farm", None), (3, "a  farm", None), (4, "a farm", "y"), (5, "A farm", "y"), (6, None, "y"), (7, "", "y"), (None, "a farm", "z")]
    df = spark.createDataFrame(rows, "chunk_uid long, text string, form string")
    got = {tuple(r) for r in canon.look_alike_pairs(df).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)}
    groups = canon.look_alike_groups(df).collect()
    assert sorted(r["key"] for r in groups) == [1, 2, 3, 4] and {r["group_id"] for r in groups} == {1}
    assert canon.look_alike_pairs(df.limit(0)).count() == 0
    forms = {r["chunk_uid"]: r["canonical_text"] for r in canon.with_canonical(df).collect()}
    assert forms[2] == "a farm" and forms[6] is None and forms[7] == ""


def test_hot_group_of_copies_makes_no_pairs(spark):
    df = spark.range(3000).selectExpr("id as chunk_uid", "case when id % 3 = 0 then 'same text' else concat('own ', id) end as text")
    assert canon.look_alike_groups(df).count() == 0
