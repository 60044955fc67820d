"""Text functions on literal cases; the native expressions against the plain functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillcheck.functions import pages
from quillcheck.functions import pytext as P
from quillcheck.functions import textexpr as X
from quillcheck.functions import udfs as U
from quillcheck.functions.figures import figures


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("It cost $2.5M.", [("2500000", "$")]),
        ("2,500,000 dollars", [("2500000", "$")]),
        ("2.5 million users", [("2500000", "")]),
        ("$7-12 a seat", [("7", "$"), ("12", "$")]),
        ("7 to 12 million", [("7000000", ""), ("12000000", "")]),
        ("30-40%", [("30", "%"), ("40", "%")]),
        ("version 3.4.5 of G2 and Q3", []),
        ("forty-two seats", [("42", "")]),
        ("two hundred and six percent", [("206", "%")]),
        ("hundreds, and one more", []),
        ("USD 19 and EUR 20", [("19", "$"), ("20", "€")]),
        ("a fee of .5%", [("0.5", "%")]),
        ("5m away", [("5", "")]),
        ("5M accounts", [("5000000", "")]),
        ("three million dollars", [("3000000", "$")]),
    ],
)
def test_figures(text, want):
    assert figures(text) == want


def test_folded_text_reads_small_letters_as_scales():
    assert figures("5m accounts", folded=True) == [("5000000", "")]


PAGE = "Basic\n$19 /seat\n4 users\nPlus\n$49 /seat\n\nThe suite costs $29 per month. It does not include calls, says Acme Inc. in a note. It has 1,200 clients."


@pytest.mark.parametrize(
    ("quote", "want"),
    [
        ("costs $29", "the suite costs $29 per month."),
        ("costs $2", None),
        ("include calls", "it does not include calls, says acme inc. in a note."),
        ("1,200 clients", "it has 1200 clients"),
        ("Plus ... $49 /seat", "plus $49 /seat"),
        ("Basic ... $49", "basic $49 /seat"),
        ("$49 ... Plus", None),
        ("suite ... calls", None),
        ("", None),
    ],
)
def test_passages_of_quotes(quote, want):
    got = P.passage(quote, PAGE)
    assert got == want or (want and got.rstrip(".") == want.rstrip("."))


def test_context_shows_what_a_table_quote_skips():
    before, between, after = P.context("Basic ... $49 /seat", PAGE)
    assert between == "basic | $19 /seat | 4 users | plus | $49 /seat"
    assert before == "" and after.startswith("the suite")


@given(st.integers(1, 10**6), st.integers(0, 99))
@settings(max_examples=200, deadline=None)
def test_a_price_is_found_whole_or_not_at_all(units, cents):
    price = f"${units:,}.{cents:02d}"
    page = f"The plan costs {price} per seat. Nothing else is charged."
    assert P.passage(f"costs {price}", page)
    assert P.passage(f"costs ${units * 10}", page) is None
    assert figures(price)[0][1] == "$"


def test_html():
    title, text = pages.html_text("<html><title>A &amp; B</title><svg><title>no</title></svg><script>var t='</p>'</script><p>One<br>two</p><td>c</td></html>")
    assert (title, text) == ("A & B", "One\ntwo\n\nc")
    assert pages.links('<a href="/b#x">B <b>c</b></a><a href="mailto:x">m</a><a href="http://[bad">', "https://a.example/") == [("https://a.example/b", "B c")]


def test_people():
    assert P.person("The board thanked CEO Jane Doe.") == "Jane Doe"
    assert P.person("led by a team and John Smith") == "John Smith"
    assert P.person("hired Acme Works", allowed="Acme Works") is None
    assert P.person("the ceo said so") is None


TEXTS = ["Prices, priced and pricing of 1,234,567 studies", "You cannot lose — they don’t “fail”", "no support for Яндекс or Any.do 3M", "", "ASCII and​ zero-width", "étude"]


def test_native_expressions_agree_with_plain_functions(spark):
    df = spark.createDataFrame([(t, P.norm(t)) for t in TEXTS], "t string, n string")
    rows = df.select("t", "n", U.norm("t").alias("u"), X.norm_composed(F.col("t")).alias("x"), X.content_words_n(F.col("n")).alias("cw"), X.tokens_n(F.col("n")).alias("tok"), X.names_n(F.col("n")).alias("names")).collect()
    for r in rows:
        assert r.u == r.n
        assert r.x == r.n or "́" in r.t
    by = {r.t: r for r in rows}
    assert by[TEXTS[0]].cw == ["pric", "pric", "pric", "study"]
    assert by[TEXTS[1]].tok[:4] == ["you", "can", "not", "lose"] and "not" in by[TEXTS[1]].tok[4:]
    assert by[TEXTS[2]].names == ["no", "support", "for", "яндекс", "or", "any", "do", "3m"]


def test_overlap_and_polarity(spark):
    row = spark.sql(
        "SELECT 'the plan does not include phone support' AS a, 'plan includes phone support' AS b, 'totally different words' AS c, '' AS e"
    ).select(
        X.polarity_mismatch_n(F.col("a"), F.col("b")).alias("ab"),
        X.polarity_mismatch_n(F.col("b"), F.col("b")).alias("bb"),
        X.polarity_mismatch_n(F.col("a"), F.col("c")).alias("ac"),
        X.overlap_n(F.col("b"), F.col("a")).alias("o"),
        X.overlap_n(F.col("e"), F.col("a")).alias("e"),
        X.overlap_n(F.col("b"), F.col("c"), F.col("a")).alias("i"),
    ).first()
    assert (row.ab, row.bb, row.ac, row.o, row.e, row.i) == (True, False, False, 1.0, 1.0, 1.0)
