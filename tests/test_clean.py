"""Cleaning, imputation and rescue."""

import pytest
from pyspark.sql import functions as F

from bibspark.functions import text as tx
from bibspark.operators import clean

H1 = "hop1_id string, hop0_id string, hop1_title string, hop1_abstract string, hop1_year int, intent_label string, citation_text string, seq int"
H2 = "hop2_id string, hop1_id string, hop2_title string, hop2_abstract string, hop2_year int, citation_text string, seq int"
H0 = "source_paper_id string, title string, abstract string, year int"


def test_strip_blanks(spark):
    raw = ["\ta\n", " a ", " a ", "a b", "\x1ca", "", "a"]
    df = spark.createDataFrame([(r,) for r in raw], "x string")
    assert [r[0] for r in df.select(tx.strip_blanks(F.col("x"))).collect()] == [r.strip() for r in raw]


def test_labels_are_preferred(spark, rows):
    labels = ["unknown", None, "method", "background", "UNKNOWN"]
    h1 = spark.createDataFrame([("a", "b", "t", None, 2000, x, f"c{i}", i) for i, x in enumerate(labels)], H1)
    assert rows(clean.dedup_labelled(h1, ["seq"]), "intent_label", "seq") == [("background", 3)]
    no_label = h1.where("intent_label is null or lower(intent_label) = 'unknown'")
    # As text, capitals sort before small letters and null last.
    assert rows(clean.dedup_labelled(no_label, ["seq"]), "intent_label") == [("UNKNOWN",)]


def test_layers_without_shared_edges(spark, rows):
    h0 = spark.createDataFrame([("s", "first", None, 1), (" s", "second", None, 2), (None, "x", None, 3)], H0)
    h1 = spark.createDataFrame([("a", "s\n", "t", None, 1, "method", None, 1), ("a_b", "c", "t", None, 1, None, None, 2)], H1)
    h2 = spark.createDataFrame([("a", "s", "t", None, 1, None, 1), ("a", "b_c", "t", None, 1, None, 2),
                                ("z", "a", "t", None, 1, "x", 9), ("z", "a", "t", None, 1, "w", 3)], H2)
    c0, c1, c2 = clean.clean_layers(h0, h1, h2, ["seq"])
    assert c0.count() == 1 and rows(c1, "hop1_id", "hop0_id") == [("a", "s"), ("a_b", "c")]
    # "a_b"+"c" and "a"+"b_c" are different edges.
    assert rows(c2, "hop2_id", "hop1_id", "citation_text") == [("a", "b_c", None), ("z", "a", "w")]


def test_imputation_order(spark):
    df = spark.createDataFrame([(None, None, None), ("T", None, 1999), (None, "A", None)], "t string, a string, y int")
    got = [tuple(r) for r in clean.impute_missing(df, "a", "t", "y", 2011).collect()]
    assert got == [("Unknown Title", "No abstract available", 2011), ("T", "T", 1999), ("Unknown Title", "A", 2011)]


def test_median_year(spark):
    y = spark.createDataFrame([(2000,), (2001,), (None,)], "y int")
    z = spark.createDataFrame([(2003,), (2010,)], "z int")
    assert clean.median_year(y, z).first()[0] == 2002
    assert clean.median_year(y.where("y is null")).first()[0] == 2018


def tier(spark, data):
    return spark.createDataFrame(data, "source_paper_id string, abstract string, year int")


def test_tiered_fill(spark):
    papers = spark.createDataFrame(
        [("whole", "T", "abs", 2000, "s2_batch"), ("mixed", "T", " ", None, "s2_batch"), ("blank", "", "", None, "s2_batch"),
         ("none", "T", "", None, "not_found"), ("first", "T", "", 2000, "s2_batch"), ("half", "T", "", None, "s2_batch")],
        "source_paper_id string, title string, abstract string, year int, source string")
    got = clean.tiered_fill(papers, {
        "s2_single": tier(spark, [("mixed", "one", None), ("first", "one", 1), ("blank", "", None)]),
        "openalex": tier(spark, [("blank", "never", 1990), ("mixed", "two", 0)]),
        "crossref": tier(spark, [("mixed", "three", 2003), ("half", "", 2005)])})
    got = {r.source_paper_id: (r.abstract, r.year, r.source) for r in got.collect()}
    assert got == {"whole": ("abs", 2000, "s2_batch"), "mixed": ("one", 2003, "crossref"), "blank": ("", None, "none"),
                   "none": ("", None, "none"), "first": ("one", 2000, "s2_single"), "half": ("", 2005, "crossref")}


def test_tiered_authors(spark, rows):
    def t(data):
        return spark.createDataFrame(data, "paper_id string, author_id string, author_name string")

    got = clean.tiered_authors(spark.createDataFrame([("p",), ("q",), ("r",)], "paper_id string"), {
        "S2": t([("p", "1", "A"), ("p", "2", "B")]), "OpenAlex": t([("p", "oa_1", "A"), ("q", "oa_9", "Q")]),
        "CrossRef": t([("q", "cr_9", "Q")])})
    assert rows(got) == [("p", "1", "A", "S2"), ("p", "2", "B", "S2"), ("q", "oa_9", "Q", "OpenAlex"),
                         ("r", "final_unknown_r_0", "Unknown", "Dummy_Gen")]


def test_rebuild_text(spark):
    df = spark.createDataFrame([({"b": [1, 5], "a": [0], "c": [3]},), ({"x": [0], "y": [0]},), ({},), (None,)],
                               "inv map<string,array<int>>")
    got = [r[0] for r in df.select(tx.rebuild_text(F.col("inv"))).collect()]
    assert got[0] == "a b c b" and got[1] in ("x", "y") and got[2] == "" and got[3] is None


@pytest.mark.parametrize("markup, text", [
    ("<jats:p> One <i>two</i> three</jats:p>", "Onetwothree"),
    ("a &amp;lt; b &#8217;&nbsp;", "a &lt; b ’"),
    ("x<!-- <b>no</b> -->y<script>var t='</p>';</script>z<style>p{}</style>", "xyz"),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("<p>caf&eacute;</p>\n<p>line</p>", "caféline")])
def test_strip_markup(spark, markup, text):
    df = spark.createDataFrame([(markup,)], "m string")
    assert df.select(tx.strip_markup(F.col("m"))).first()[0] == text


def test_cascade(spark, rows):
    h0 = spark.createDataFrame([("s", None, None, None)], H0)
    h1 = spark.createDataFrame([("a", "s", None, None, 1, None, None, 1), ("b", "gone", None, None, 1, None, None, 2)], H1)
    h2 = spark.createDataFrame([("x", "a", None, None, 1, None, 1), ("y", "b", None, None, 1, None, 2)], H2)
    k1, k2 = clean.referential_cascade(h0, h1, h2)
    assert rows(k1, "hop1_id") == [("a",)] and rows(k2, "hop2_id") == [("x",)]


def test_merge_rescued_prefers_the_original(spark, rows):
    a = spark.createDataFrame([("p", "t", None, 2000)], H0)
    b = spark.createDataFrame([("p", "u", "x", 2001), ("q", "v", "y", 2002)], H0)
    assert rows(clean.merge_rescued(a, b)) == [("p", "t", None, 2000), ("q", "v", "y", 2002)]
