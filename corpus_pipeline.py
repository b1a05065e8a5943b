"""From documents to packed training sequences: quality rules, toxicity, near-duplicates, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import if_small, materialize, table
from siltstone.llm.neardup import near_duplicates
from siltstone.llm.packing import pack
from siltstone.llm.quality import quality_rules
from siltstone.llm.toxicity import toxicity_scores

#: Near-duplicates in the pipeline: shingles of five words, similarity of 80 % or more.
WIDTH, PERCENT = 5, 80
#: With the id, what names a row: rows that agree in it agree in all columns.
ROW = "_row"


def _named(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW, F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in docs.columns]))


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows of docs but those named in bad (doc_id, ROW). Only the rejected names are joined, broadcast if they are few, so the texts stay
    where they are. Every row is judged by itself: neither a null nor a repeated id ties it to others."""
    bad = if_small(materialize(bad.select(F.col("doc_id").alias("_id"), F.col(ROW).alias("_bad")).distinct(), "rejected"))
    rows = _named(docs)
    return rows.join(bad, rows["doc_id"].eqNullSafe(bad["_id"]) & (rows[ROW] == bad["_bad"]), "left_anti").drop(ROW)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep the quality rules, row by row; null and empty texts go. An empty table stays empty."""
    return _without(docs, quality_rules(_named(docs), carry=(ROW,)).where(~F.col("kept")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, row by row. Without labels nothing is."""
    return _without(docs, toxicity_scores(_named(docs), table(spark, sf_dir, "labels"), carry=(ROW,)).where("predicted = 1"))


def neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id; of rows that repeat an id, one (the least by a hash of all columns). Rows
    with a null id, which can't be named, stay."""
    found = materialize(near_duplicates(docs, width=WIDTH, percent=PERCENT), "neardup")
    bad = if_small(materialize(found.where(~F.col("kept")).select(F.col("doc_id").alias("_bad")).distinct(), "rejected"))
    out = docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti")
    again = found.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1").select("_again")
    again = materialize(again, "repeated")
    if again.isEmpty():
        return out
    same = out["doc_id"] == again["_again"]
    one = _named(out.join(again, same, "left_semi")).groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.col(ROW)).alias("_d"))
    return out.join(again, same, "left_anti").unionByName(one.select("_d.*"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents; null and empty texts give the end id alone, repeated rows a piece each."""
    return pack(docs)


STAGES = [("quality rules", quality), ("toxicity", toxicity), ("near-duplicates", neardup), ("best-fit packing", packing)]
#: Models, tokenizers and set joins: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
