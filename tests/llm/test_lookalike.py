from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from fathomline.llm import lookalike as L

TO = L.representatives({})


@pytest.fixture(scope="module")
def form():
    return L.Rewriter(TO).form


SAME = [("ﬁn oﬃce", "fin office"), ("Ｆｕｌｌ，１２３！", "Full,123!"), ("café", "café"), ("a​b­c﻿", "abc"), ("a b c d　e", "a b c d e"), ("co‑op‐x－y", "co-op-x-y"), ("Моѕсоw", "Moscow"), ("Αθήνα", "Aθήνa".replace("a", "α")), ("е́", "é"), ("е‍́", "é"), ("ё", "ë"), ("й", "й"), ("ό", "ó"), ("Å", "Å"), ("q̣̇", "q̣̇"), ("ΡΑΧ", "PAX"), ("ﬁ", "fі")]
DIFFERENT = [("a", "A"), ("e", "é"), ("é", "è"), ("a.", "a,"), ("l", "I"), ("0", "O"), ("1", "l"), ("a—b", "a-b"), ("a–b", "a-b"), ("²", "2"), ("б", "6"), ("'", "’"), ("и", "й"), ("a b", "ab"), ("з", "3")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(form, a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different_look(form, a, b):
    assert form(a) != form(b)


def test_the_automaton_decides(monkeypatch):
    """Without the automaton, with the canonical forms alone, most of the same looks are told apart."""
    without = L.Rewriter(TO)
    monkeypatch.setattr(without, "_rewrite", lambda text: text)
    assert sum(without.form(a) == without.form(b) for a, b in SAME) < len(SAME) / 2
    assert without.form("е̂") != without.form("ê") and L.Rewriter(TO).form("е̂") == L.Rewriter(TO).form("ê")


def test_classes_from_the_tables(form):
    assert form("a⁃b֊c᐀d‐e") == "a-b-c-d-e" and form("Ⅷ ⅸ") == "VIII ix" and form("ӏ") == form("l") and form("が각") == form("\u304b\u3099\u1100\u1161\u11a8")
    assert form("a⸗b") != form("a-b") and form("a᠆b") != form("a-b")


def test_no_two_ascii_characters_share_a_class():
    for members in L.look_classes()[0]:
        assert sum(m.isascii() for m in members) <= 1


def test_every_member_has_the_form_of_its_class(form):
    for members in L.look_classes()[0]:
        assert len({form(m) for m in members if not L.invisible().search(m)}) <= 1, members
    for c in L.look_classes()[1]:
        assert form(c) == form(unicodedata.normalize("NFKC", c).replace("s", "ſ") if c == "ﬅ" else unicodedata.normalize("NFKC", c))


def test_forms_are_final_and_follow_frequency(form):
    texts = ["".join(p) for p in SAME] + ["Ｆﬁ­é а́ ё"]
    assert all(form(form(t)) == form(t) for t in texts)
    cyrillic = L.Rewriter(L.representatives({"а": 5, "a": 2, "é": 9}))
    assert cyrillic.form("a") == "а" and cyrillic.form("é") == "é" and cyrillic.form("é") == cyrillic.form("е́")


def test_union_find_is_transitive():
    uf = L.Classes()
    for a, b in ("ab", "cd", "bc", "xy"):
        uf.union(a, b)
    assert sorted(uf.members()) == [["a", "b", "c", "d"], ["x", "y"]]


def test_table(spark):
    rows = [(1, "fine"), (2, "ﬁne"), (3, "fine"), (4, "Fine"), (5, None), (6, ""), (7, "​"), (8, "x" * 50_000), (9, "х" + "x" * 49_999), (None, "fіne"), (10, "fine")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"look": F.lit(1), "code": F.lit("c"), "n": F.lit(0)})
    looks = L.text_looks(df, "doc_id", "text").cache()
    assert sorted(map(tuple, L.look_pairs(looks, "doc_id").collect())) == [(1, 2), (2, 3), (2, 10), (6, 7), (8, 9)]
    forms = {r.doc_id: r.form for r in L.text_forms(df, "doc_id", "text").collect()}
    assert forms[1] == forms[2] == forms[3] == forms[None] and forms[4] != forms[1] and forms[5] is None and forms[7] == "" and forms[8] == forms[9]
    members = {r.doc_id: (r.class_id, r.n_pages, r.n_texts) for r in L.look_members(looks, "doc_id").collect()}
    assert members[2] == (1, 5, 3) and members[7] == (6, 2, 2) and 5 not in members
    assert L.text_looks(df.limit(0), "doc_id", "text").count() == 0 and L.text_forms(df.limit(0), "doc_id", "text").count() == 0


def test_counts_cover_the_corpus(spark):
    df = spark.createDataFrame([("аbа é",), (None,), ("é",)] * 700, "text string")
    counts = L.corpus_counts(df, "text")
    assert counts["а"] == 1400 and counts["é"] == 700 and counts["é"] == 700
