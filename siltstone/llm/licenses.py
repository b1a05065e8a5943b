"""License scans.

One Aho-Corasick automaton finds identifier tags and notice phrases in a document's normalised words; what
follows an identifier tag is parsed as a license expression by the shunting-yard method (``with`` binds
tighter than ``and``, ``and`` tighter than ``or``; parentheses) and evaluated against a set of accepted licenses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.common import table

#: Phrases whose words must stand consecutively, with their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notices.
NOTICE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc0": "cc0",
    "creative commons": "creative-commons",
    "public domain": "public-domain",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "eclipse public license": "epl",
    "isc license": "isc",
}
#: Words of a tag that an expression follows.
TAG = "spdx license identifier"
#: Licenses under which a text may be used; the evaluation of an expression is against these.
ACCEPTED = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "cc-by-4.0", "unlicense"})

_ASCII = bytes((c + 32 if 65 <= c <= 90 else c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256))
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_EXPRESSION_TOKEN = re.compile(r"\(|\)|[a-z0-9.+-]+")
_TAG_TEXT = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)")


def normal_words(text: str | None) -> list[bytes]:
    """Lower-case words ([0-9A-Za-z] and everything beyond ASCII) of the whole text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_ASCII).split()


def shunting_yard(expression: str) -> list[str]:
    """Postfix form of a lower-case license expression; reading stops at the first token that can't continue it.
    An expression without an operand, or with unbalanced parentheses, gives []."""
    out: list[str] = []
    stack: list[str] = []
    operand = False  # whether an operand has just been read
    for token in _EXPRESSION_TOKEN.findall(expression):
        if token in _PRECEDENCE:
            if not operand:
                return []
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = False
        elif token == "(":
            if operand:
                break
            stack.append(token)
        elif token == ")":
            if not operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            if operand:
                break
            out.append(token)
            operand = True
    if not operand or "(" in stack:
        return []
    return out + stack[::-1]


def evaluate(postfix: list[str], accepted: frozenset[str] = ACCEPTED) -> bool:
    """Whether the accepted licenses satisfy the expression. ``a with e`` is accepted where a is: an exception only adds permissions."""
    stack: list[bool] = []
    for token in postfix:
        if token in _PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            stack.append({"or": left or right, "and": left and right, "with": left}[token])
        else:
            stack.append(token in accepted)
    return bool(stack and stack[-1])


def build_automaton(phrases: dict[str, str]):
    """Automaton over normalised text with one blank between and around words; each hit gives (label, phrase)."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for phrase, label in phrases.items():
        out.add_word(f" {phrase} ", (label, phrase))
    out.make_automaton()
    return out


def scan(text: str | None, automaton, base: dict[str, str]) -> tuple[int, int, int | None, int | None, str, str, float, list[str], bool | None]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions (postfix), accepted (of all expressions).

    score: 0 without any sign, 0.95 for a parsed expression, 0.9 for a base phrase, 0.7 for other notices.
    """
    words = normal_words(text)
    plain = f" {b' '.join(words).decode('utf-8', 'replace')} "
    starts, base_labels, labels, tagged = [], set(), set(), False
    for end, (label, phrase) in automaton.iter(plain):
        labels.add(label)
        if phrase == TAG:
            labels.discard(label)
            tagged = True
        elif phrase in base:
            base_labels.add(label)
            starts.append(end - len(phrase) - 1)
    expressions: list[str] = []
    verdicts: list[bool] = []
    if tagged:
        for found in _TAG_TEXT.finditer(text.lower()):
            if postfix := shunting_yard(found[1]):
                expressions.append(" ".join(postfix))
                verdicts.append(evaluate(postfix))
                after_with = {i for i, t in enumerate(postfix) if i + 1 < len(postfix) and postfix[i + 1] == "with"}
                labels.update(t for i, t in enumerate(postfix) if t not in _PRECEDENCE and i not in after_with)
    score = 0.95 if expressions else 0.9 if base_labels else 0.7 if labels else 0.0
    place = lambda at: plain.count(" ", 0, at + 1) - 1  # noqa: E731  number of the word that starts after this blank
    first, last = (place(min(starts)), place(max(starts))) if starts else (None, None)
    return len(words), len(starts), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, expressions, all(verdicts) if verdicts else None


def license_scan(df: DataFrame, id_column: str = "doc_id", text: str = "text", notices: dict[str, str] | None = None) -> DataFrame:
    """One row per row of df. A null or empty text has no words, no labels and score 0; repeated rows are scanned each.
    Further columns of df aren't read. Whole texts are scanned in one pass each; nothing is shuffled.

    Labels come from base phrases (always), notice phrases and the licenses named in identifier tags' expressions.
    """
    base = dict(BASE_PHRASES)
    phrases = dict(NOTICE_PHRASES if notices is None else notices) | base | {TAG: "tag"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = build_automaton(phrases)
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "accepted"]
        for batch in batches:
            rows = [scan(t, automaton, base) for t in batch["_text"]]
            out = pd.DataFrame(rows, columns=names)
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            out["accepted"] = out["accepted"].astype("boolean")
            out.insert(0, "doc_id", batch["_id"].to_numpy())
            yield out

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(df[id_column].alias("_id"), df[text].alias("_text")).mapInPandas(
        run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, accepted boolean"
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
