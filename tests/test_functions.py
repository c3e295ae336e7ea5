"""Scalar functions and patterns against values worked out by hand, and properties."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from murmura import constants as C
from murmura.functions import patterns, scores
from murmura.functions.normalize import normalizer

WORD = "grabbit"  # a neutral stand-in for a configured word


def column(spark, f, rows, *names):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], names or ("x",))
    return [r[0] for r in df.select(f(*[F.col(c) for c in df.columns])).collect()]


def test_lengths_count_utf16(spark):
    assert column(spark, scores.u16_len, ["abc", "a😀", ""]) == [3, 3, 0]


@pytest.mark.parametrize(
    "text, score",
    [("A" * 11, -0.1), ("abc", -0.1), ("", -0.1), ("Ab" * 3 + "cdefgh", 0.05), ("Abcdefghij" * 4, 0.1), ("Abcdefghijk", 0.0), ("123", -0.1)],
)
def test_caps(spark, text, score):
    assert column(spark, scores.caps_score, [text]) == [pytest.approx(score)]


@pytest.mark.parametrize("n, score", [(300, 0.0), (301, 0.02), (501, 0.05), (2000, 0.05), (2001, 0.3)])
def test_length(spark, n, score):
    assert column(spark, scores.length_score, ["x" * n]) == [score]


@pytest.mark.parametrize(
    "text, score",
    [("Hi.", 0.0), ("Hi. You.", 0.15), ("Hi. You?", 0.0), ("a,b,c", 0.02), ("a'b'c'd", 0.15), ("what??", 0.1), ("what??\nno", 0.1), ("a\nb\nc", 0.25), ("," * 50, 0.1)],
)
def test_punctuation(spark, text, score):
    assert column(spark, scores.punctuation_score, [text]) == [pytest.approx(score)]


@pytest.mark.parametrize("text, score", [("?", 0.08), ("????", 0.2), ("if you would go", 0.1), ('"a"', 0.1), ("a. b. c. " * 10, 0.1), ("what if ", 0.05)])
def test_debate(spark, text, score):
    assert column(spark, scores.debate_score, [text]) == [pytest.approx(score)]


def test_durations(spark):
    assert column(spark, scores.format_duration, [0, 59, 60, 3661, 90061, 86400]) == ["0s", "59s", "1m", "1h 1m 1s", "1d 1h 1m 1s", "1d"]


def test_timeouts_saturate(spark):
    rows = [(0, "flat", 60), (1, "flat", 60), (3, "factorial", 60), (25, "factorial", 60), (20, "factorial", 10**15), (2, "exponential", 60), (9, "exponential", 60), (-1, "flat", 60)]
    assert column(spark, scores.timeout_seconds, rows, "l", "m", "b") == [0, 60, 360, 86400, 86400, 3600, 86400, 0]


def test_context_depth(spark):
    assert column(spark, scores.context_depth, [0, 3, 4, 5, 6, 9, 10]) == [8, 8, 6, 6, 4, 4, 0]


def test_bars_and_colors(spark):
    assert column(spark, scores.heat_bar, [0.5, 2.0, -1.0]) == ["[" + "█" * 10 + "░" * 10 + "]", "[" + "█" * 20 + "]", "[" + "░" * 20 + "]"]
    assert column(spark, scores.alert_color, [0.9, 0.6, 0.4]) == ["orange-red", "orange", "yellow"]


def test_overlapping_trigrams(spark):
    assert column(spark, scores.trigram_count, ["erere", "THE the", "x"]) == [2, 2, 0]


def test_damping(spark):
    assert column(spark, scores.damped_affection, [(0.0, 3.0), (2.0, 1.0), (9.9, 50.0)], "a", "b") == [3.0, 2.5, 10.0]


def test_nulls_stay_null(spark):
    df = spark.createDataFrame([(None,)], "x string")
    for f in (scores.caps_score, scores.punctuation_score, scores.debate_score, scores.strip_markdown, scores.strip_urls, scores.shorten):
        df.select(f(F.col("x"))).collect()


NORMAL = [("𝗚𝗿𝗮𝗯", "grab"), ("🄶🅁🄰🄱", "grab"), ("gr@b", "grab"), ("GR4B", "grab"), ("ｇｒａｂ", "grab"), ("gráb", "grab"), ("it's", "its"), ("g​rab", "grab"), ("12:30", "i2ieo"), ("💀", ""), ("ⓖⓡⓐⓑ", "grab"), ("ΑΒ", "ab"), ("straße", "straße")]


@pytest.mark.parametrize("text, want", NORMAL)
def test_normalize(text, want):
    assert normalizer()(text) == want


@given(st.text(alphabet="abcxyz 0134578@$!|*:'", max_size=30))
def test_normalize_is_idempotent_on_its_output(text):
    f = normalizer()
    assert f(f(text)) == f(text)


def test_grammar_variants():
    assert patterns.grammar_variants("grab") == ["grab", "grabs", "grab's", "grabs'", "grabed", "grabing", "grabbing", "grabbed"]
    assert patterns.grammar_variants("love") == ["love", "loves", "love's", "loves'", "loved", "loveing"]
    assert len(patterns.grammar_variants("at")) == 6


@settings(deadline=None, max_examples=40)
@given(st.text(alphabet="abc.+", min_size=1, max_size=8))
def test_spaced_regex_is_the_language_of_space_variants(word):
    regex = re.compile(patterns.spaced(word))
    variants = list(patterns.space_variants(word))
    assert len(variants) == 2 ** (len(word) - 1) == len(set(variants))
    assert all(regex.fullmatch(v) for v in variants)
    assert not regex.fullmatch(" " + word) and not regex.fullmatch(word + " ")


@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=4), min_size=1, max_size=8), st.text(alphabet="abc", max_size=12))
def test_trie_regex_finds_what_alternation_finds(words, text):
    assert bool(re.search(patterns.trie_regex(words), text)) == any(w in text for w in words)


@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=4), max_size=8))
def test_layers_are_prefix_free(words):
    layers = patterns.prefix_free_layers(words)
    assert sorted(w for layer in layers for w in layer) == sorted(set(words))
    assert not any(a != b and b.startswith(a) for layer in layers for a in layer for b in layer)


def test_keyspace():
    (row,) = patterns.keyspace([WORD], normalizer())
    assert row["grammar"] == 8 and row["spaced"] == sum(2 ** (len(v) - 1) for v in patterns.grammar_variants(WORD))


def test_constants_are_consistent():
    assert len(C.DEBATE_PHRASES) == 25 and len(C.TRIGRAMS) == 20 and len(C.CONDITIONALS) == 7
