"""Toxicity: gradient-boosted trees over dense features of the whole text, with isotonic calibration.

The features are mostly rates: densities of lexicon words (a fixed list, as written and after undoing obfuscation, and a
lexicon of word beginnings learnt from labels, so that it covers any language and inflection), lexicon words near a
second-person pronoun, capitals, punctuation and obfuscated words. The lexicon, the trees and the calibration are
learnt from different labelled rows, so that none trusts what another has memorised.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import materialize, table

INSULTS = frozenset("idiot idiots moron morons loser losers clown clowns scum trash garbage fool fools imbecile dumbass jerk jerks creep cretin vermin".split())
CONTEMPT = frozenset("stupid pathetic worthless disgusting dumb useless ugly hate despicable filthy revolting shut kill".split())
SECOND_PERSON = frozenset("you your yours yourself u ur youre du dich dir dein deine tu te toi ton ta vous votre usted ti tus vosotros".split())
#: Words between an insult and a pronoun that count as near.
NEAR = 4
#: Characters that stand for letters in obfuscated words.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None})
FEATURES = ("insults", "insult_count", "contempt", "learnt", "learnt_count", "learnt_distinct", "learnt_strongest", "near_second_person", "second_person", "capital_words", "capital_letters", "exclamations", "questions", "punctuation_runs", "obfuscated", "obfuscated_insults", "words")

#: Labelled rows that the lexicon, the trees and the calibration are fitted on at most: rows are taken by a hash of their id.
MAX_TRAINING_ROWS = 40_000
#: Fifths of these rows from which the lexicon is learnt, the trees are grown, and scores are calibrated.
FOLDS = {"lexicon": (0, 1), "trees": (2, 3), "calibration": (4,)}
#: A learnt entry is a word beginning of so many letters, in so many toxic rows at least, with log-odds of at least so much.
STEM, MIN_TOXIC, MIN_ODDS = (3, 8), 4, 2.5
TREES, DEPTH, STEP = 20, 3, 0.3
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\S+")
_MIXED = re.compile(r"[^\W\d_][0-9@$!*._-]+[^\W\d_]")
_RUN = re.compile(r"[!?]{2,}|([^\w\s])\1+")


def stems(text: str | None) -> set[str]:
    """The word beginnings of a text."""
    low, high = STEM
    words = {w.lower()[:high] for w in _WORD.findall(text or "")}
    return {w[:k] for w in words for k in range(low, len(w) + 1)}


class Lexicon:
    """Learnt word beginnings with their log-odds."""

    def __init__(self, odds: dict[str, float]):
        self.odds = odds
        self.first = frozenset(w[: STEM[0]] for w in odds)

    def weight(self, word: str) -> float:
        """Greatest log-odds among the word's beginnings; 0 without one."""
        if word[: STEM[0]] not in self.first:
            return 0.0
        return max((self.odds.get(word[:k], 0.0) for k in range(STEM[0], min(len(word), STEM[1]) + 1)), default=0.0)


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Log-odds of the word beginnings of labelled rows (_text, label). Tasks count before they shuffle; the driver gets the entries that pass
    MIN_TOXIC and MIN_ODDS, whose number is bounded by the words of at most MAX_TRAINING_ROWS rows."""
    totals = rows.agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).first()
    if not totals["t"] or not totals["c"]:
        return {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                toxic, clean = Counter(), Counter()
                for text, label in zip(part["_text"], part["label"], strict=True):
                    (toxic if label else clean).update(stems(text))
                words = list(toxic.keys() | clean.keys())
                yield pd.DataFrame({"stem": words, "t": [toxic[w] for w in words], "c": [clean[w] for w in words]})

    counts = rows.mapInPandas(run, "stem string, t long, c long").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (totals["t"] + 1)) - F.log((F.col("c") + 0.5) / (totals["c"] + 1))
    best = counts.where(F.col("t") >= MIN_TOXIC).withColumn("odds", odds).where(F.col("odds") >= MIN_ODDS)
    return {r["stem"]: r["odds"] for r in best.select("stem", "odds").collect()}


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The FEATURES of a whole text; a null text counts as empty, whose rates are all 0."""
    text = text or ""
    written = _WORD.findall(text)
    words = [w.lower() for w in written]
    n = max(len(words), 1)
    insult_at = [i for i, w in enumerate(words) if w in INSULTS]
    contempt_at = [i for i, w in enumerate(words) if w in CONTEMPT]
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    learnt = [(i, w, x) for i, w in enumerate(words) if w[: STEM[0]] in lexicon.first and (x := lexicon.weight(w))]
    near = 0
    if second:
        at = np.array(second)
        for i in {*insult_at, *contempt_at, *(i for i, _, _ in learnt)}:
            k = int(np.searchsorted(at, i))
            near += any(0 <= j < len(at) and abs(int(at[j]) - i) <= NEAR for j in (k - 1, k))
    mixed = hidden = 0
    if _MIXED.search(text):
        for token in _TOKEN.findall(text):
            if _MIXED.search(token):
                mixed += 1
                plain = token.lower().translate(LEET)
                hidden += plain in INSULTS or plain in CONTEMPT
    letters = max(sum(map(len, written)), 1)
    capitals = sum(1 for c in text if c.isupper()) if not text.islower() else 0
    return [
        len(insult_at) / n, math.log1p(len(insult_at) + len(contempt_at)), len(contempt_at) / n,
        sum(x for _, _, x in learnt) / n, math.log1p(len(learnt)), math.log1p(len({w for _, w, _ in learnt})), max((x for _, _, x in learnt), default=0.0),
        near / n, len(second) / n,
        sum(1 for w in written if len(w) > 1 and w.isupper()) / n, capitals / letters, text.count("!") / n, text.count("?") / n,
        sum(1 for _ in _RUN.finditer(text)) / n, mixed / n, hidden / n, math.log1p(len(words)),
    ]


def text_features(df: DataFrame, odds: dict[str, float], id_column: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, features array<double>, and the columns carry) per row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(odds)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["_id"], "features": [features(t, lexicon) for t in batch["_text"]], **{c: batch[c] for c in carry}})

    kind = df.schema[id_column].dataType.simpleString()
    more = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in carry)
    return df.select(df[id_column].alias("_id"), df[text].alias("_text"), *carry).mapInPandas(run, f"doc_id {kind}, features array<double>{more}")


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity_scores(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", max_training_rows: int = MAX_TRAINING_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of df: doc_id, held_out, score (0 to 1), predicted (1 from THRESHOLD on), and the columns carry as they are.

    labels: (doc_id, toxic). Null labels count as none; of several for one id the largest holds. Rows with a null id
    are scored and never learnt from. Of the labelled rows that aren't held out, two fifths give the
    lexicon, two grow the trees and one calibrates. Without two classes to learn from, every score is the share of label 1 (0 without labels).
    Empty, null, repeated and very long texts are scored like others, equal texts alike; a score of just THRESHOLD is predicted 1. An empty
    df gives no rows; further columns aren't read.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    known = known.where(~held_out(F.col("doc_id")))
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("train")), F.lit(1_000_000))
    total = known.count()
    if total > max_training_rows:
        known = known.where(share < int(970_000 * max_training_rows / total))  # a hash takes a few more or less
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fold")), F.lit(5))
    known = materialize(known.withColumn("fold", fold), "known")
    texts = df.select(df[id_column].alias("doc_id"), df[text].alias("_text")).join(F.broadcast(known), "doc_id")  # at most max_training_rows
    odds = learn_lexicon(texts.where(F.col("fold").isin(*FOLDS["lexicon"])).select("_text", "label"))
    rows = materialize(text_features(df, odds, id_column, text, carry), "toxicity")
    learnt = known.where(F.col("fold").isin(*FOLDS["trees"], *FOLDS["calibration"]))
    training = materialize(rows.join(F.broadcast(learnt), "doc_id").select("features", "label", F.col("fold").isin(*FOLDS["calibration"]).alias("calibrates")), "training")
    training = training.select(array_to_vector("features").alias("vector"), "label", "calibrates")
    seen = training.agg(
        F.count("*").alias("n"), F.avg("label").alias("mean"), F.count(F.when(F.col("calibrates"), 1)).alias("c"),
        F.avg(F.when(~F.col("calibrates"), F.col("label"))).alias("m"),
    ).first()
    out = rows.withColumn("held_out", held_out(F.col("doc_id")))
    if seen["m"] is None or not 0 < seen["m"] < 1:
        score = F.lit(float(seen["mean"] or 0.0))
    else:
        trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=11, maxMemoryInMB=128)
        model = trees.fit(training.where(~F.col("calibrates")).select("vector", "label"))
        probability = vector_to_array("probability")[1]
        out = model.transform(out.withColumn("vector", array_to_vector("features"))).withColumn("raw", probability)
        score = F.col("raw")
        if seen["c"]:
            checks = model.transform(training.where("calibrates").select("vector", "label")).select(probability.alias("raw"), "label")
            curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(checks)
            out = curve.transform(out.drop("prediction"))
            score = F.col("calibrated")
    score = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    return out.select("doc_id", "held_out", score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), *carry)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
