import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sorimill.functions.composed import nfc, nfc_mapped, snapped, source_span
from sorimill.operators.normalize import convert, normalize


def composed(text):
    """Clusters composed one by one: a character, or letters of a syllable, with the marks behind it."""
    out, spans, rewrites, at = [], [], [], 0
    while at < len(text):
        end = at + 1

        def marks():
            nonlocal end
            while end < len(text) and unicodedata.combining(text[end]):
                end += 1

        marks()
        whole = "\uac00" <= text[at] <= "\ud7a3"
        lead = "\u1100" <= text[at] <= "\u115f"
        open_ = whole and (ord(text[at]) - 0xAC00) % 28 == 0
        if lead and end < len(text) and "\u1160" <= text[end] <= "\u11a7":
            end += 1
            marks()
            open_ = True
        if open_ and end < len(text) and "\u11a8" <= text[end] <= "\u11ff":
            end += 1
            marks()
        before, place = text[at:end], {"start": at, "end": end}
        after = unicodedata.normalize("NFC", before)
        out.append(after)
        spans += [place] * len(after)
        if after != before:
            rewrites.append(place | {"before": before, "after": after})
        at = end
    return {"text": "".join(out), "spans": spans, "rewrites": rewrites}


NFD = lambda s: unicodedata.normalize("NFD", s)
TEXTS = ["", "plain é 국물", NFD("국물 3개"), "éa", "각나", "ᄀ", "ᆨᅡ", "á̧b", "Å", "q́", "́x", None]


ALPHABET = "ab가각나ȩ\u0301\u1100\u1161\u11a8\u0327각\u3099か\u3099Å\u0308क़"


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from(ALPHABET), max_size=12), min_size=200, max_size=200))
def test_clusters(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    for r in rows.select("x", nfc_mapped(F.col("x")).alias("m")).collect():
        assert r.m.asDict(True) == composed(r.x)


@pytest.fixture(scope="module")
def mapped(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, x string")
    return {r.i: r for r in rows.select("i", nfc(F.col("x")).alias("n"), nfc_mapped(F.col("x")).alias("m")).collect()}


def test_composition(mapped):
    for i, text in enumerate(TEXTS):
        if text is None:
            assert mapped[i].n is None and mapped[i].m is None
        else:
            assert mapped[i].n == unicodedata.normalize("NFC", text) == mapped[i].m.text
            assert mapped[i].m.asDict(True) == composed(text)


def test_spans(mapped):
    assert [tuple(s) for s in mapped[2].m.spans] == [(0, 3), (3, 6), (6, 7), (7, 8), (8, 10)]
    assert [tuple(s) for s in mapped[4].m.spans] == [(0, 2), (2, 3)]
    assert [tuple(r) for r in mapped[4].m.rewrites] == [(0, 2, "각", "각")]
    assert [tuple(s) for s in mapped[9].m.spans] == [(0, 2), (0, 2)] and not mapped[9].m.rewrites


def test_ranges(spark):
    rows = spark.createDataFrame([("aq́b", 2, 3), ("aq́b", 0, 2), ("aq́b", 1, 1), ("aq́b", 3, 9), ("abc", 1, 2), ("", 0, 0)], "x string, a int, b int")
    m, a, b = nfc_mapped(F.col("x")), F.col("a"), F.col("b")
    got = rows.withColumn("m", m).select(source_span(F.col("m"), a, b).alias("s"), snapped(F.col("m"), a, b).alias("w")).collect()
    assert [r.s and tuple(r.s) for r in got] == [(1, 3), (0, 3), None, None, (1, 2), None]
    assert [r.w and tuple(r.w) for r in got] == [(1, 3), (0, 3), (1, 1), None, (1, 2), (0, 0)]


def test_engine_on_decomposed_text(spark):
    text = NFD("사과 3개")
    got = spark.createDataFrame([(text,)], "x string").select(normalize(F.col("x")).alias("n"), convert(F.col("x")).alias("c")).first()
    assert got.n == got.c.normalized_text == "사과 세 개" and got.c.complete and got.c.source == text
    spoken = [r for r in got.c.rewrites if r.stage == "verbalization"]
    assert [(text[r.start : r.end], r.before, r.after) for r in spoken] == [(NFD("3개"), "3개", "세 개")]
    composed_ = [r for r in got.c.rewrites if r.stage == "unicode"]
    assert [(text[r.start : r.end], r.after) for r in composed_] == [(NFD(c), c) for c in "사과개"]
    # a computed text, too
    twice = spark.createDataFrame([("3개",)], "x string").select(convert(normalize(F.col("x")))["normalized_text"].alias("n")).first()
    assert twice.n == "세 개"
