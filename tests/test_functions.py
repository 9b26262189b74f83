"""Stems, sentences, distances, the query language: golden values and properties."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscope.functions.distance import alignment, distance, table, within
from corpuscope.functions.porter import stem_ctes
from corpuscope.functions.sentences import naive_sentences, split_sentences
from corpuscope.functions.stopwords import DOMAIN, SNOWBALL, STOP_WORDS
from corpuscope.operators.query_language import lex, parse
from corpuscope.plans.dialect import DUCK, SPARK

STEMS = {
    "caresses": "caress", "ponies": "poni", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
    "conditional": "condit", "triplicate": "triplic", "hopefulness": "hope", "revival": "reviv", "adoption": "adopt", "probate": "probat", "controll": "control", "is": "is", "yes": "ye",
}


@pytest.mark.parametrize("d", [SPARK, DUCK])
def test_stems(d, spark):
    words = ", ".join(f"('{w}')" for w in STEMS)
    ctes = ", ".join(f"{n} AS ({q})" for n, q in [("src", f"SELECT word FROM (VALUES {words}) AS v(word)"), *stem_ctes(d, "src")])
    sql = f"WITH {ctes} SELECT word, stem FROM stem_dim"
    rows = duckdb.connect().sql(sql).fetchall() if d is DUCK else [tuple(r) for r in spark.sql(sql).collect()]
    assert dict(rows) == STEMS


def test_stop_word_counts():
    assert (len(SNOWBALL), len(DOMAIN), len(set(STOP_WORDS))) == (174, 17, 191)


def test_sentences():
    assert split_sentences("We saw Dr. Smith et al. in Fig. 3. It rose by 2.5 mg. Why? \"Yes.\" He left") == ["We saw Dr. Smith et al. in Fig. 3.", "It rose by 2.5 mg. Why?", "\"Yes.\"", "He left"]
    assert split_sentences("E. coli grew. then it stopped... Then more!") == ["E. coli grew. then it stopped...", "Then more!"]
    assert split_sentences(None) == split_sentences(" \n") == []
    assert naive_sentences("a. b? c") == ["a", "b", "c"]


def test_distances():
    assert distance("kitten", "sitting") == 3
    assert distance("ab", "ba") == 1 and distance("ab", "ba", transpositions=False) == 2
    assert distance("ca", "abc") == 3
    assert [op for op, _, _ in alignment("ab", "ba")] == ["transpose"]


words = st.text("abc", max_size=7)


@settings(max_examples=200, deadline=None)
@given(words, words, st.integers(0, 4))
def test_bounded_distance_is_the_distance(a, b, k):
    d, plain = distance(a, b), table(a, b, False)[-1][-1]
    assert within(a, b, k) == (d if d <= k else None)
    assert d <= plain <= 2 * d
    assert sum(op != "match" for op, _, _ in alignment(a, b)) == d


def test_query_language():
    assert [k for k, _, _ in lex('a and (b || "c d") -e title:f')] == ["TERM", "AND", "(", "TERM", "OR", "PHRASE", ")", "NOT", "TERM", "TERM"]
    assert parse("a b OR c AND NOT d").describe() == "((a AND b) OR (c AND NOT d))"
    assert parse("a b", "OR").describe() == "(a OR b)"
    assert parse("title:x* y~2 )").describe() == "(title:x* AND y~2)"
    assert parse("") is None and parse("AND") is None
