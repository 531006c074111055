import pytest
from pyspark.sql import functions as F

from textloom.functions.stem import STEP_4, measure, shape, stem
from textloom.functions.stopwords import default_stop_words, load_stop_words
from textloom.functions.text import alpha_tokens, basic_tokens, jaccard, raw_tokens


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Don't stop", ["dont", "stop"]),
        ("Schindler’s List", ["schindler", "list"]),
        ("Singin’ in the Rain", ["singin", "in", "the", "rain"]),
        ("well-known Café 42", ["wellknown", "café", "42"]),
        ("a b\tc", ["a", "b", "c"]),
        ("", []),
        (None, []),
        ("  ,, ", []),
    ],
)
def test_basic_tokens(spark, text, expected):
    assert one(spark, text, basic_tokens) == expected


@pytest.mark.parametrize("text,expected", [("well-known Café", ["well", "known", "caf"]), ("\u212aK x", ["k", "x"]), ("12 34", []), (None, []), ("", [])])
def test_alpha_tokens(spark, text, expected):
    assert one(spark, text, alpha_tokens) == expected


def test_raw_tokens_keep_case(spark):
    assert one(spark, "The the", raw_tokens) == ["The", "the"]


def test_jaccard(spark):
    df = spark.createDataFrame([("to be or not", "not to me")], "a string, b string")
    assert df.select(jaccard(alpha_tokens(F.col("a")), alpha_tokens(F.col("b")))).first()[0] == pytest.approx(2 / 5)
    empty = spark.createDataFrame([("", None)], "a string, b string")
    assert empty.select(jaccard(alpha_tokens(F.col("a")), alpha_tokens(F.col("b")))).first()[0] == 0


# Examples of the paper, and words on which the departures act.
STEMS = """caresses caress|ponies poni|caress caress|cats cat|feed feed|agreed agre|plastered plaster|bled bled|motoring motor|sing sing
conflated conflat|troubled troubl|sized size|hopping hop|tanned tan|falling fall|hissing hiss|fizzed fizz|failing fail|filing file
happy happi|sky sky|relational relat|conditional condit|rational ration|valenci valenc|digitizer digit|conformabli conform
radicalli radic|differentli differ|vileli vile|analogousli analog|vietnamization vietnam|predication predic|operator oper
feudalism feudal|decisiveness decis|hopefulness hope|callousness callous|formaliti formal|sensitiviti sensit|sensibiliti sensibl
triplicate triplic|formative form|formalize formal|electriciti electr|electrical electr|hopeful hope|goodness good
revival reviv|allowance allow|inference infer|airliner airlin|gyroscopic gyroscop|adjustable adjust|defensible defens|irritant irrit
replacement replac|adjustment adjust|dependent depend|adoption adopt|homologou homolog|communism commun|activate activ|angulariti angular
homologous homolog|effective effect|bowdlerize bowdler|probate probat|rate rate|cease ceas|controll control|roll roll
apology apolog|possibly possibl|aing a|ies i|as as|a a|yyy yyi|scoring score|ranking rank|web web|algorithm algorithm"""


@pytest.mark.parametrize("pair", [p for line in STEMS.splitlines() for p in line.split("|")])
def test_stem(pair):
    word, expected = pair.split()
    assert stem(word) == expected


def test_shape_and_measure():
    assert shape("toy") == "cvc" and shape("syzygy") == "cvcvcv"
    assert [measure(w) for w in ("tr", "ee", "tree", "y", "by", "trouble", "oats", "trees", "ivy", "troubles", "private", "oaten")] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2]
    assert len(STEP_4) == 19


def test_stop_words(spark, tmp_path):
    assert "a" not in default_stop_words() and "b" in default_stop_words() and "a" in default_stop_words(filter_a=True)
    path = tmp_path / "stop.txt"
    path.write_bytes("﻿a\nThe \n\n of\r\nthe\n".encode())
    assert {r.term for r in load_stop_words(spark, str(path)).collect()} == {"﻿a", "the", "of"}
    assert {r.term for r in load_stop_words(spark, str(path), filter_a=True).collect()} == {"a", "the", "of"}
