"""Text primitives, question analysis and tables on hand-worked cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import questions as q
from lodestone.functions.tables import is_ragged, to_markdown
from lodestone.functions.text import peel, sentences, split_words, strip, tokens, word_count


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_tokens_keep_letters_and_numbers_of_any_script(spark):
    assert one(spark, "Café ½ naïve_x 10% Привет", tokens) == ["café", "½", "naïve_x", "10", "привет"]


def test_words_split_at_unicode_white_space(spark):
    text = "a\u001cb c d\u0085e f"
    assert one(spark, text, split_words) == text.split()
    assert one(spark, text, word_count) == 6
    assert one(spark, "  x  ", strip) == "x"


def test_sentences(spark):
    assert one(spark, "One. Two!  Three?\nfour\nfive. 3.14 is. e.g. this", sentences) == ["One.", "Two!", "Three?", "four\nfive.", "3.14 is.", "e.g.", "this"]
    assert one(spark, "A. [TABLE]\nx. y\n[/TABLE] B.", sentences) == ["A.", "[TABLE]\nx. y\n[/TABLE]", "B."]
    assert one(spark, "[TABLE] open. end", sentences) == ["[TABLE] open. end"]
    assert one(spark, " \n ", sentences) == []


def test_peel(spark):
    assert one(spark, "(\"word's!?\")", peel) == "word's"


@pytest.mark.parametrize(
    "typed, fixed",
    [
        ("(Retreival?)", "(retrieval?)"),
        ("RETREIVAL", "RETREIVAL"),
        ("retreival-2", "retreival-2"),
        ("reTreival", "reTreival"),
        ("no  change   here", "no  change   here"),
        ("modle  of porject", "model of project"),
        ("certifications  x", "certifications x"),
        ("...", "..."),
        ("", ""),
    ],
)
def test_correction(spark, typed, fixed):
    assert one(spark, typed, q.correct) == fixed


@pytest.mark.parametrize(
    "typed, intent",
    [("show allocation", "broad"), ("summarize this pdf", "broad"), ("summarized results", "specific"), ("overview", "broad"), ("Summary of the file!", "broad"), ("key points please.", "broad"), ("key figures", "specific"), ("", "specific"), ("List All Skills now", "broad")],
)
def test_intent(spark, typed, intent):
    assert one(spark, typed, q.intent) == intent


def test_expansion(spark):
    assert one(spark, "what is the heading", q.variants) == [
        "what is the heading",
        "what is the title",
        "what is the header",
        "what is the name",
        "what is the document name",
        "what is the topic",
        "what is the heading title header name document name topic",
    ]
    assert one(spark, "Nothing Here", q.variants) == ["Nothing Here"]
    got = one(spark, "Title, title", q.variants)
    assert got[0] == "Title, title" and got[1] == "heading title" and got[-1] == "Title, title heading name header document title"
    assert len(got) == len(set(got)) == 10


@pytest.mark.parametrize("typed, sources, page", [("page 0", 2, 0), ("webpage 3", 2, 3), ("last page", 1, 9), ("last page", 2, None), ("First page", 2, 1), ("Page   12 and page 4", 1, 12), ("pages", 1, None), ("page 99999999999", 1, None)])
def test_page_reference(spark, typed, sources, page):
    assert one(spark, typed, lambda c: q.page_reference(c, F.lit(sources), F.lit(9))) == page


def test_markdown(spark):
    t = [["name", "a\nb"], ["x", None], [" wide cell ", "1"]]
    df = spark.createDataFrame([(t, 1), ([["h"]], 2), ([["a", "b"], ["c"]], 3), ([], 4), ([[]], 5), (None, 6)], "t array<array<string>>, k int")
    got = {r["k"]: (r["md"], r["bad"]) for r in df.select("k", F.when(~is_ragged(F.col("t")), to_markdown(F.col("t"))).alias("md"), is_ragged(F.col("t")).alias("bad")).collect()}
    assert got[1] == ("| name      | a b |\n| --------- | --- |\n| x         |     |\n| wide cell | 1   |", False)
    assert got[2] == ("| h |\n| - |\n", False)
    assert got[3] == (None, True)
    assert got[4] == got[5] == got[6] == ("", False)


def model_correct(text):
    """Row-at-a-time model, written from the blueprint."""
    from lodestone.functions.lexicon import TYPOS

    edge, out, hit = ".,!?;:'\"()", [], False
    for w in text.split():
        core = w.strip(edge)
        lead = w[: len(w) - len(w.lstrip(edge))]
        skip = not core or "-" in core or any(c.isupper() for c in core[1:]) or core.isupper() or any(c.isdigit() for c in core)
        if not skip and core.lower() in TYPOS:
            out.append(lead + TYPOS[core.lower()] + w[len(lead) + len(core) :])
            hit = True
        else:
            out.append(w)
    return " ".join(out) if hit else text


def test_correction_equals_a_model(spark):
    parts = st.lists(st.sampled_from(["modle", "Modle", "MODLE", "(skils)", "skils!", "porject-x", "a", "...", "  ", "mOdle", "atention,", "x1"]), max_size=6)
    seen = []

    @settings(max_examples=150, deadline=None, database=None)
    @given(parts)
    def draw(p):
        seen.append(" ".join(p))

    draw()
    df = spark.createDataFrame([(t,) for t in seen], "t string")
    for r in df.select("t", q.correct(F.col("t")).alias("c")).collect():
        assert r["c"] == model_correct(r["t"])
