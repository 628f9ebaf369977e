import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hazegrid.llm import tokcount

FILE = public_tokenizers.path("byte_bpe_50k.json")
WHOLE, UNSURE = tokcount.whole_tokens(FILE), tokcount.unsure_characters(FILE)
COUNT, LIBRARY = tokcount.counter(FILE, WHOLE, UNSURE), Tokenizer.from_file(FILE)


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_whole_tokens_are_proved():
    assert len(WHOLE) > 40_000 and " the" in WHOLE and "<|endoftext|>" not in WHOLE
    assert all(library(w) == 1 for w in WHOLE[::500])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet=st.sampled_from("ab 'sltre\n\t1é  !?<|endoftext>\u00a0\u2003" + UNSURE[:3]), max_size=40)))
def test_counts_equal_library(text):
    assert COUNT(text) == library(text)


def test_special_strings():
    for t in ("<|endoftext|>", "a<|endoftext|>b", "<|endoftext|><|endoftext|> x", "<|endoftext|", " <|endoftext|> \n"):
        assert COUNT(t) == library(t)


def test_cache_may_be_emptied(monkeypatch):
    monkeypatch.setattr(tokcount, "CACHE", 2)
    count = tokcount.counter(FILE, WHOLE[:10], UNSURE)
    assert count("some thing else entirely different words here") == library("some thing else entirely different words here")


def test_rows(edge_docs, edge_rows, no_docs):
    got = tokcount.token_counts(edge_docs, FILE).collect()
    want = [(r[0], len((r[1] or "").encode()), library(r[1] or ""), library(r[1] or "") > 1024) for r in edge_rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokcount.token_counts(no_docs, FILE).count() == 0
