"""Scalar functions on hand-made rows; the expected values are Python's."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliomill.functions import text as T


def value(spark, column, **row):
    names = list(row)
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("raw", "loose", "exact"),
    [("  Alpha, part one ", "alpha part one", "alpha,partone"), ("½ Émile ", "½ émile", "½émile"), ("a b!", "a b", "a b!"), ("---", "", "---"), ("éx", "ex", "éx"), ("", "", "")],
)
def test_B5_B6_keys(spark, raw, loose, exact):
    assert value(spark, T.key_loose("h"), h=raw) == loose
    assert value(spark, T.key_exact("h"), h=raw) == exact


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x2FF, exclude_categories=["Cs", "Cn", "Cc", "Cf", "No", "Lm", "Sk"]), max_size=30))
def test_B6_is_pythons_word_class(spark, raw):
    assert value(spark, T.key_loose("h"), h=raw) == re.sub(r"[^\w\s]", "", raw).strip().lower()


def test_B1_B2_B4(spark):
    assert value(spark, T.strip_control("h"), h="a\x00b\tc‎") == "abc"
    assert value(spark, T.trim_chain("h"), h='"" Title  \r\n"') == "Title"
    assert value(spark, T.heading_clean("h"), h="\r\n“A/B” (c)'s \n") == "AB cs "


def test_B3_stopwords(spark):
    assert value(spark, T.not_stopword("h", ["Index"]), h="INDEX") is False
    assert value(spark, T.not_stopword("h", []), h="INDEX") is True


def test_B8_fuzzy_is_containment_both_ways(spark):
    f = lambda t, h, **k: value(spark, T.matches_fuzzy(F.col("t"), F.col("h"), **k), t=t, h=h)
    assert f("1", "Chapter 1") and not f("1", "Chapter 1", both_ways=False)
    assert f("see Chapter 1: start", "chapter 1")
    assert f("anything", "---")
    assert not f("", "Chapter 1")


def test_B11_null_is_no_match(spark):
    assert value(spark, T.matches_exact(F.col("t"), F.col("h")), t=None, h="a") is False
    assert value(spark, T.matches_fuzzy(F.col("t"), F.col("h")), t="a", h=None) is False


@pytest.mark.parametrize(("raw", "number"), [("12", 12), (" 7 ", 7), ("", None), ("p3", None), (None, None), ("99999999999", None)])
def test_B14_safe_int(spark, raw, number):
    assert value(spark, T.safe_int("h"), h=raw) == number


def test_B16_B17_B18_B19(spark):
    assert value(spark, T.token_count("h"), h=" a  b c ") == 3 and value(spark, T.token_count("h"), h=" ") == 0
    near = T.within_one(F.col("t"), F.col("h"))
    assert value(spark, near, t="Alpha", h="Alpho") and not value(spark, near, t="Alpha", h="Alphoo") and value(spark, near, t="é", h="e")
    assert value(spark, T.squeezed("h"), h="a b\tc") == "ab\tc"
    assert value(spark, T.ratio(F.lit(1), F.lit(0)), h="") == 0.0


def test_B21_slugs(spark):
    assert value(spark, T.slug_trimmed("h"), h="book_12") == "book"
    assert value(spark, T.slug_with_tool_quirk("h"), h="the-relationship.pdf") == "the-relationshi"
