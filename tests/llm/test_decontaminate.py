"""Items that templates of five words alone miss."""

import pytest

from hushgrid.llm import decontaminate

DENSE = [
    "12 15 18 21 24 27 30 33 36",
    "Add 3 + 4 = 7 and 8 + 9 = 17 and 10 + 11 = 21",
    "Anna Bert Carl Dora Emil Fritz Gustav Hanna Ida",
    "WHICH OF THESE RIVERS IS THE LONGEST IN EUROPE",
    "Who Wrote The Old Man And The Sea",
]
SHORT = ["What is the largest planet here", "Name the capital of a country", "Is it so or not", "Which bird cannot fly at all but runs"]


def found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.coverage, r.reparameterised) for r in decontaminate.contaminated(docs, bench, ["doc_id"]).collect()}


@pytest.mark.parametrize("before", ["", "some words come first. ", "a line without end mark\n", "then (as said, "])
def test_dense_items_are_found_word_by_word(spark, before):
    got = found(spark, [f"{before}{x} and then other words follow here" for x in DENSE], DENSE)
    assert set(got) == {(i, i) for i in range(len(DENSE))}


def test_dense_windows_with_other_values_are_not_copies(spark):
    assert found(spark, ["13 16 19 22 25 28 31 34 37", "Kurt Lena Max Nora Otto Paul Rita Sven Tina", "plain words only in this one"], DENSE) == {}


@pytest.mark.parametrize("before", ["a line without end mark\n", "he said, ", "so it went; \"quoted\" ", "see the note) ", "3 "])
def test_short_items_inside_a_sentence_are_found(spark, before):
    got = found(spark, [f"{before}{x}\nmore words after it" for x in SHORT], SHORT)
    assert got == {(i, i): (1.0, False) for i in range(len(SHORT))}


def test_long_texts_and_clashing_keys(spark):
    item = "the quick brown fox jumps over the lazy dog near the river"
    docs = spark.createDataFrame([(1, "word " * 60_000 + item), (2, "word " * 60_000)], "item_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = decontaminate.contaminated(docs, bench, ["item_id"])
    assert got.columns == ["item_id_", "item_id", "coverage", "reparameterised"]
    assert [(r.item_id_, r.item_id, r.coverage) for r in got.collect()] == [(1, 7, 1.0)]


def test_a_few_words_of_a_dense_item_are_no_copy(spark):
    item = "Mix 12 g and 34 g with 56 ml and 78 ml then wait 9 min"
    texts = ["we stood there for an hour and 5 min then wait for the bus home", "and so on: " + item + " at least", "so we wait 9 min", "Mix 12 g and 34 g with 56 ml"]
    assert set(found(spark, texts, [item])) == {(1, 0)}


def test_keys_named_like_results_whatever_their_case(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog")], "COVERAGE long, text string")
    bench = spark.createDataFrame([(7, "the quick brown fox jumps over the lazy dog")], "item_id long, text string")
    got = decontaminate.contaminated(docs, bench, ["COVERAGE"])
    assert got.columns == ["COVERAGE_", "item_id", "coverage", "reparameterised"] and got.count() == 1
