"""Patterns of the dialect, as Java runs them, against what they must find."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import filters as X
from siltstone.functions.patterns import java_pattern

CASES = [
    ("auth$", ["auth", "an auth"], ["auth\n", "auth\nx"]),
    ("(?m)auth$", ["auth", "auth\n", "auth\nx"], ["auth\rx", "auth x", "authx"]),
    ("(?m)^b", ["b", "a\nb"], ["a\rb", "ab"]),
    ("(?m)^$", ["a\n", "", "a\n\nb"], ["a"]),
    ("^b", ["b"], ["a\nb"]),
    ("a.b", ["axb", "a\rb", "a b"], ["a\nb"]),
    ("(?s)a.b", ["a\nb"], ["ab"]),
    ("(?s:a.)b.", ["a\nbx"], ["a\nb\n"]),
    ("^[[:digit:]]+$", ["12"], ["1a", "٣", "digit"]),
    ("^[[:^digit:]x]+$", ["ax"], ["a1"]),
    ("^[[:punct:]]+$", ["!~[\\"], ["a", " "]),
    (r"^\d+$", ["12", "٣"], ["1a"]),
    (r"(?-u)^\d+$", ["12"], ["٣"]),
    (r"^\w+$", ["é_1"], ["a b"]),
    ("(?P<first_one>a)(?<b>b)", ["ab"], ["a"]),
    (r"^\x{e9}\u{e9}é\U000000e9\xe9$", ["ééééé"], ["e"]),
    (r"^\x{1F600}$", ["\U0001f600"], ["x"]),
    (r"^[\x{1F600}-\x{1F603}a-c-]+$", ["\U0001f601b-"], ["d"]),
    (r"^a\vb\a$", ["a\x0bb\x07"], ["a\nb\x07"]),
    ("^[a-z--[aeiou]]+$", ["xyz"], ["xay"]),
    ("^[a-f&&[d-z]]+$", ["def"], ["abc", "xyz"]),
    ("^[a-d~~c-f]+$", ["abef"], ["c", "d"]),
    ("^[^a-d~~c-f]+$", ["cdz"], ["a", "f"]),
    ("^[]a]+$", ["]a"], ["b"]),
    ("^[^]a]+$", ["b["], ["]"]),
    ("^[a[bc]&&[^b]]+$", ["ac"], ["b"]),
    (r"^[\d&&[^3]]+$", ["124"], ["123"]),
    (r"^[.$^|*+?{}()\[\]/-]+$", [".$^|*+?{}()[]/-"], ["a"]),
    ("^a*+$", ["aaa", ""], ["b"]),
    ("^(?:ab){2}?$", ["abab"], ["ab"]),
    ("^a{,2}$", ["", "aa"], ["aaa"]),
    ("^a{ 2 }$", ["aa"], ["a"]),
    ("^(?:a{2}){2}$", ["aaaa"], ["aaa"]),
    ("(?i)straße|ÄB", ["STRAßE", "äb"], ["x"]),
    ("a(?i)b|c", ["aB", "C"], ["Ab"]),
    ("(a(?i)b)c", ["aBc"], ["aBC"]),
    ("(?i:a)b", ["Ab"], ["aB"]),
    ("(?x) a b # both\n c [x y]", ["abcx"], ["a b c", "abc "]),
    (r"\bé\b", ["é", "a é"], ["éa"]),
    (r"\<cat\>", ["a cat"], ["cats", "bobcat"]),
    (r"\b{start}cat", ["cats"], ["bobcat"]),
    (r"^\p{Greek}\p{Lu}\pL\P{Nd}\p{^Lu}$", ["αÄxyz"], ["aÄxyz", "αäxyz"]),
    (r"^\p{Script=Cyrillic}+$", ["жд"], ["a"]),
    (r"(?U)^a+?$", ["aaa"], ["b"]),
    ("a|", ["", "b"], []),
    ("", ["", "b"], []),
    (r"^a\ b\#\-\&\~$", ["a b#-&~"], ["ab"]),
    ("^-]$", ["-]"], ["-"]),
]


def test_cases(spark):
    rows = [(i, t, True) for i, (_, yes, _) in enumerate(CASES) for t in yes] + [(i, t, False) for i, (_, _, no) in enumerate(CASES) for t in no]
    df = spark.createDataFrame(rows, "i int, msg string, hit boolean")
    wrong = []
    for i, (pattern, _, _) in enumerate(CASES):
        wrong += [(pattern, java_pattern(pattern), r["msg"]) for r in df.where((F.col("i") == i) & (X.msg_matches(pattern) != F.col("hit"))).collect()]
    assert wrong == []


@pytest.mark.parametrize("bad", [
    "(?=a)", "(?!a)", "(?<=a)", "(?<!a)", "(?>a)", "(a", "a)", "[a", "[]", "[z-a]", r"\1", r"(a)\k<a>", r"\Z", r"\G", r"\R", r"\Qa\E", r"\h", "*a", "a|*", "a{2,1}", "{2}", "a{", r"\x{110000}", r"\x{D800}", r"\p{Nothing}", r"a\y", "(?y)a", "(?#a)", "(?)", r"[a-\d]", "(?P=a)",
])
def test_refused(spark, bad):
    with pytest.raises(ValueError):
        X.msg_matches(bad)
    with pytest.raises(ValueError):
        X.prop_not_matches("k", bad)


def test_negative_and_props(spark):
    df = spark.createDataFrame([(1, "auth\n", [("k", "12\n")]), (2, "auth", [("k", "12")]), (3, None, [])], "i int, msg string, props array<struct<key:string,value:string>>")
    ids = lambda test: [r["i"] for r in df.where(test).collect()]
    assert ids(X.msg_matches("auth$")) == [2] and ids(X.msg_not_matches("auth$")) == [1]
    assert ids(X.prop_matches("k", "^[[:digit:]]+$")) == [2] and ids(X.prop_not_matches("k", "^[[:digit:]]+$")) == [1]
