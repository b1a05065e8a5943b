"""Exact duplicates with a split of heavy hitters. DataFrame functions only.

Every row is named by the SHA-256 of its normalised text, and only ids and digests move from then on. Misra-Gries counters (Spark's
freqItems) over 64 bits of the digests name every digest that may hold SHARE of the rows, at most 1 / SHARE of them. A pass
over those alone counts the full digests, so a candidate that isn't frequent, or shares its 64 bits with another, falls away. The winners
that are left, at most 1 / SHARE rows, are broadcast: tasks decide the copies of heavy digests where they lie. All other digests have
less than SHARE of the rows each and are shuffled by digest in the ordinary way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import materialize, table

#: Share of all rows from which on a digest is heavy. 1 / SHARE counters are kept, and as many rows broadcast at most (about 100 kB).
SHARE = 1 / 1000
BLANKS = r"[\x20\x09-\x0D]+"


def normal_text(text: Column) -> Column:
    """Each run of blanks as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def _order(id_column: str) -> Column:
    """Smallest id first, null ids last, and rows that repeat an id as they are stored."""
    return F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), F.col("_row").alias("row"))


def heavy_winners(rows: DataFrame, id_column: str, share: float = SHARE) -> DataFrame:
    """(_digest, _size, _best) of every digest that at least share of the rows (_digest, _row, id) have, stored."""
    least = max(2, int(rows.count() * share))
    short = F.xxhash64("_digest")
    candidates = rows.select(short.alias("_short")).freqItems(["_short"], share).select(F.explode("_short_freqItems").alias("_short"))
    among = rows.withColumn("_short", short).join(F.broadcast(materialize(candidates, "candidates")), "_short", "left_semi")
    counted = among.groupBy("_digest").agg(F.count("*").alias("_size"), F.min(_order(id_column)).alias("_best"))
    return materialize(counted.where(F.col("_size") >= least), "winners")


def exact_groups(df: DataFrame, id_column: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), share: float = SHARE) -> DataFrame:
    """(id, *carry, keep_id, group_size, kept, text_sha256): one row for each row of df, whatever becomes of it.

    Rows are equal if their normalised texts are; the one with the smallest id stays. Null texts count as empty, so they are equal to texts
    without characters, but not to texts of blanks (which are one space). Rows with a null id are members of their group and stay only if no row of
    it has an id; of rows that repeat both the id and the text exactly one stays. Texts may be of any length: one at a time is normalised and
    hashed, and none is moved or stored unless carry names its column. carry: columns of df to hand through; they may have any name but
    those of the result, and ValueError is raised for these. An empty df gives no rows.
    """
    clash = {id_column, *carry} & {"keep_id", "group_size", "kept", "text_sha256"} or {c for c in carry if c == id_column}
    if clash:
        raise ValueError(f"the result has columns of these names already: {sorted(clash)}")
    digest = F.unhex(F.sha2(normal_text(df[text]), 256))
    rows = df.select(df[id_column], *[df[c].alias(f"_c_{c}") for c in carry], digest.alias("_digest"))
    # stored with the row's number, so that a task that runs again meets the same rows under the same numbers
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "digests")
    winners = F.broadcast(heavy_winners(rows.select("_digest", "_row", id_column), id_column, share))
    heavy = rows.join(winners, "_digest")
    group = Window.partitionBy("_digest")
    light = rows.join(winners, "_digest", "left_anti").withColumn("_size", F.count("*").over(group)).withColumn("_best", F.min(_order(id_column)).over(group))
    both = heavy.select(*light.columns).unionByName(light)
    return both.select(
        id_column, *[F.col(f"_c_{c}").alias(c) for c in carry], F.col("_best.id").alias("keep_id"), F.col("_size").alias("group_size"),
        (F.col("_best.row") == F.col("_row")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def without_copies(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns."""
    others = tuple(c for c in df.columns if c != id_column)
    named = df.select(F.col(id_column), *[F.col(c).alias(f"x_{c}") for c in others])
    out = exact_groups(named, id_column, f"x_{text}", tuple(f"x_{c}" for c in others)).where("kept")
    return out.select(*[F.col(c) if c == id_column else F.col(f"x_{c}").alias(c) for c in df.columns])


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP13_SQL = r"""WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256 FROM d WINDOW w AS (PARTITION BY text_sha256)"""
