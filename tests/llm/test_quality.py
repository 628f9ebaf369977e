from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hazegrid.llm import quality

from .conftest import prose


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
def test_repeated_words_equal_all_windows(words):
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times = Counter(grams)
    want = {p for i, g in enumerate(grams) if times[g] > 1 for p in range(i, i + 8)}
    assert quality.repeated_words(words) == len(want)


def test_base_counts():
    n, chars, symbols, dup, repeat = quality.base_counts("É b#\nx y\n\nx y\n | \n".encode())
    assert (n, chars, symbols, dup, repeat) == (7, 8, 2, 1, 0)


def test_js_distance_bounds():
    a, b = np.array([1.0, 0]), np.array([0, 5.0])
    assert quality.js_distance(a, a) == 0 and quality.js_distance(a, b) == 1 and quality.js_distance(a, np.zeros(2)) == 1


def test_edge_rows_are_judged_one_by_one(edge_docs, edge_rows):
    out = quality.judge(edge_docs).collect()
    assert len(out) == len(edge_rows)
    by_id = {r.doc_id: r for r in out}
    for i in (30, 31, 32):
        assert by_id[i].n_words == 0 and by_id[i].base_failed and not by_id[i].kept
    assert by_id[35].n_words == 6000


def test_junk_goes_and_prose_stays(spark):
    clean = [(i, prose(200, i), "en") for i in range(60)]
    junk = [(100, " ".join(w + "%%%&&&" for w in prose(200, 3).split()), "en"), (101, " ".join(f"{i * 7919 % 9973} | {i}" for i in range(150)), "en")]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == set(range(60))


def test_empty_table_and_columns(no_docs, edge_docs):
    assert quality.judge(no_docs).count() == 0
    assert quality.keep_good(no_docs).columns == no_docs.columns and quality.keep_good(no_docs).count() == 0
    assert quality.keep_good(edge_docs).schema == edge_docs.schema


def test_many_small_parts_give_the_same_references(spark, monkeypatch):
    """A few words to a task, or one task for all: the same common words and counts, and no word list beyond the common ones."""
    rows = [(i, prose(40 + i % 30, i), ("en", "fr", None)[i % 3]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = quality.references(docs.coalesce(1))
    monkeypatch.setattr(quality, "HELD_WORDS", 20)
    many = quality.references(docs.repartition(200))
    assert one.keys() == many.keys() and len(one) >= 2
    for name in one:
        assert one[name][1] == many[name][1] and 0 < len(one[name][1]) <= 1 / quality.COMMON_SHARE
        assert (one[name][0] == many[name][0]).all() and (one[name][2] == many[name][2]).all()
