"""Approximate nearest neighbours with randomly rotated one-bit codes.

Vectors are dealt to the nearest of some centres. Within such a list each vector's difference to the centre is scaled to length
one and rotated at random; the signs are its code, packed to bits. Two scalars per vector (its distance to the centre, and the
inner product of the unit vector with its code) turn a bit count into an unbiased estimate of an inner product, whose error is
bounded by the spread of a random rotation. Only vectors whose bound doesn't exceed the best k exact distances so far
are compared on the original vectors.

A query asks its nearest list first; the k-th distance found there is its limit in its other lists. Lists and their
queries meet in tasks of bounded size: at most about TILE vectors and QUERY_BLOCK queries, however large a list is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import materialize, table

SEED = 77
#: Half-width of the error bounds in standard deviations of the estimate.
EPSILON = 2.5
#: Bits to which a rotated query's components are rounded.
QUERY_BITS = 6
#: Vectors and queries that meet in a task, about; and queries whose bounds a task holds at a time.
TILE, QUERY_BLOCK, ROWS_AT_ONCE = 16_384, 1_024, 64
#: The centres are fitted on a sample, chosen by a hash of the ids, of at most so many vectors and so many numbers, whatever the table's size.
SAMPLE_ROWS, SAMPLE_NUMBERS = 20_000, 8_000_000
#: Vectors of the sample for each centre at least, and rounds of Lloyd's algorithm.
ROWS_PER_CENTRE, FIT_ROUNDS = 40, 12
#: Queries of the sample on which the number of lists to ask is chosen, and the share of their neighbours in the sample that it must reach.
TRIALS, REACH = 400, 0.97


def rotation(dim: int) -> np.ndarray:
    """Random orthonormal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and every component present and finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0)


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes (rows of 64-bit words), distances to the centre (one, or one for each row), and the unit vectors' inner products with their codes."""
    rest = x - centre
    norm = np.linalg.norm(rest, axis=1)
    unit = (rest / np.where(norm > 0, norm, 1.0)[:, None]) @ turn.T
    dim = x.shape[1]
    bits = np.zeros((len(x), -(-dim // 64) * 64), np.uint8)
    bits[:, :dim] = unit > 0
    codes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return codes, norm, np.abs(unit).sum(axis=1) / math.sqrt(dim)


class Queries:
    """Queries prepared for the codes of one list: rotated, and rounded to bit planes."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        self.dim = vectors.shape[1]
        rest = vectors - centre
        self.norm = np.linalg.norm(rest, axis=1)
        unit = (rest / np.where(self.norm > 0, self.norm, 1.0)[:, None]) @ turn.T
        self.low = unit.min(axis=1)
        self.step = np.maximum((unit.max(axis=1) - self.low) / (2**QUERY_BITS - 1), 1e-12)
        whole = np.rint((unit - self.low[:, None]) / self.step[:, None]).astype(np.uint16)
        self.sum = (whole * self.step[:, None] + self.low[:, None]).sum(axis=1)
        planes = np.zeros((QUERY_BITS, len(vectors), -(-self.dim // 64) * 64), np.uint8)
        for j in range(QUERY_BITS):
            planes[j, :, : self.dim] = (whole >> j) & 1
        self.planes = np.packbits(planes, axis=2, bitorder="little").view(np.uint64)

    def lower_bounds(self, codes: np.ndarray, norm: np.ndarray, aligned: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances, queries by codes."""
        counts = np.zeros((len(self.norm), len(codes)), np.float32)
        ones = np.bitwise_count(codes).sum(axis=1).astype(np.float32)
        for j in range(QUERY_BITS):
            hits = np.zeros(counts.shape, np.uint16)
            for w in range(codes.shape[1]):
                hits += np.bitwise_count(self.planes[j][:, w, None] & codes[None, :, w])
            counts += np.float32(2**j) * hits
        # <q, code> for code components +-1/sqrt(dim): twice the sum over set bits less the sum over all
        over_set = self.step[:, None].astype(np.float32) * counts + self.low[:, None].astype(np.float32) * ones[None, :]
        inner = (2 * over_set - self.sum[:, None].astype(np.float32)) / np.float32(math.sqrt(self.dim))
        spread = np.sqrt(np.maximum(1 - aligned**2, 0)) / aligned / math.sqrt(max(self.dim - 1, 1))
        # and half a step for each of the query's components, as their signs fall at random
        width = (EPSILON * spread)[None, :] + (0.5 * self.step)[:, None] / aligned[None, :]
        top = np.minimum(inner / aligned[None, :] + width, 1.0)
        return self.norm[:, None] ** 2 + norm[None, :] ** 2 - 2 * self.norm[:, None] * norm[None, :] * top


def nearest_in_tile(asked: pd.DataFrame, rows: pd.DataFrame, centre: np.ndarray, kind: str, k: int) -> pd.DataFrame:
    """(query_id, vec_id, score): for each query of asked (query_id, vector, limit) its nearest k ids of rows within its limit, the query's own
    aside. Of several vectors of an id the nearest counts."""
    turn, dim = rotation(len(centre)), len(centre)
    codes = np.frombuffer(b"".join(rows["code"]), np.uint64).reshape(len(rows), -1)
    vectors = np.frombuffer(b"".join(rows["packed"]), kind).reshape(len(rows), dim)
    ids, norm, aligned = rows["vec_id"].to_numpy(), rows["norm"].to_numpy(), np.maximum(rows["aligned"].to_numpy(), 1e-9)
    out: list[pd.DataFrame] = []
    for at in range(0, len(asked), ROWS_AT_ONCE):
        part = asked.iloc[at : at + ROWS_AT_ONCE]
        own, limits = np.stack(part["vector"].to_numpy()), part["limit"].to_numpy()
        bounds = Queries(own, centre, turn).lower_bounds(codes, norm, aligned)
        for q, (who, limit) in enumerate(zip(part["query_id"], limits, strict=True)):
            best_d, best_i = np.empty(0), np.empty(0, np.int64)
            near = np.flatnonzero((bounds[q] <= limit**2 * (1 + 1e-9) + 1e-12) & (ids != who))
            if len(near) > 8 * k:  # the nearest by estimate come first and give a limit to the others
                near = near[np.argsort(bounds[q][near], kind="stable")]
            for first, last in ((0, 8 * k), (8 * k, len(near))):
                some = near[first:last]
                some = some[bounds[q][some] <= limit**2 * (1 + 1e-9) + 1e-12]
                distance = np.sqrt(((vectors[some].astype(float) - own[q]) ** 2).sum(axis=1))
                d, i = np.concatenate([best_d, distance]), np.concatenate([best_i, ids[some]])
                order = np.lexsort((i, d))
                order = order[np.sort(np.unique(i[order], return_index=True)[1])][:k]
                best_d, best_i = d[order], i[order]
                if len(best_d) == k:
                    limit = min(limit, best_d[-1])
            inside = best_d <= limit
            out.append(pd.DataFrame({"query_id": who, "vec_id": best_i[inside], "score": best_d[inside]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


@dataclass
class Index:
    """rows: list, vec_id, code, norm, aligned, packed (the vector's numbers, of type kind), stored; the lists' centres; how many lists a query asks."""

    rows: DataFrame
    centres: np.ndarray
    probes: int
    kind: str


def fit_centres(sample: np.ndarray, total: int, k: int) -> tuple[np.ndarray, int]:
    """Centres of the lists, and how many nearest lists hold the share REACH of a query's k neighbours, as tried on the sample. Where vectors lie in no
    clusters that may be most lists; rows that aren't in the sample only make neighbours nearer."""
    count = int(max(1, min(round(math.sqrt(total) / 4), len(sample) // ROWS_PER_CENTRE)))
    rng = np.random.default_rng(SEED)
    centres = sample[rng.permutation(len(sample))[:count]].copy()
    for _ in range(FIT_ROUNDS if count > 1 else 1):
        owner = np.concatenate([squares(sample[a : a + 2_000], centres).argmin(axis=1) for a in range(0, len(sample), 2_000)])
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, sample)
        sizes = np.bincount(owner, minlength=count)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    if count == 1:
        return centres, 1
    owner = np.concatenate([squares(sample[a : a + 2_000], centres).argmin(axis=1) for a in range(0, len(sample), 2_000)])
    places = []
    for a in range(0, min(TRIALS, len(sample)), 50):
        own = sample[a : a + 50]
        near = np.argpartition(squares(own, sample), min(k, len(sample) - 1), axis=1)[:, : k + 1]  # with the query itself
        rank = squares(own, centres).argsort(axis=1).argsort(axis=1)
        places.append(np.take_along_axis(rank, owner[near], axis=1).ravel())
    return centres, int(np.quantile(np.concatenate(places), REACH, method="higher")) + 1


def build_index(rows: DataFrame, dim: int, k: int = 10) -> Index:
    """Index of rows (vec_id, vector array<float> or array<double> of dim finite numbers), stored: every row is in it."""
    kind = "<f4" if rows.schema["vector"].dataType.elementType.typeName() == "float" else "<f8"
    total = rows.count()
    wanted = min(SAMPLE_ROWS, max(SAMPLE_NUMBERS // dim, 1))
    share = F.pmod(F.xxhash64("vec_id", F.lit("centres")), F.lit(1_000_000_000))
    some = rows.where(share < math.ceil(1_000_000_000 * min(1.0, 0.9 * wanted / max(total, 1)))) if total > wanted else rows
    sample = some.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(wanted).toPandas()
    x = np.stack(sample["vector"].to_numpy()).astype(float) if len(sample) else np.zeros((1, dim))
    centres, probes = fit_centres(x, total, k)

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = rotation(dim)
        for batch in batches:
            for at in range(0, len(batch), 4_096):
                part = batch.iloc[at : at + 4_096]
                vectors = np.stack(part["vector"].to_numpy()).astype(float)
                owner = squares(vectors, centres).argmin(axis=1)
                code, norm, aligned = encode(vectors, centres[owner], turn)
                packed = vectors.astype(kind)
                yield pd.DataFrame({"list": owner.astype(np.int32), "vec_id": part["vec_id"].to_numpy(), "code": [c.tobytes() for c in code], "norm": norm, "aligned": aligned, "packed": [v.tobytes() for v in packed]})

    index = rows.mapInPandas(codes, "list int, vec_id long, code binary, norm double, aligned double, packed binary")
    return Index(materialize(index, "index"), centres, probes, kind)


def scan(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest, within the query's limit, that each tile of the lists holds. asked: (list, query_id, vector, limit), stored."""
    centres, kind = index.centres, index.kind
    # one row for each list, of which there are at most SAMPLE_ROWS / ROWS_PER_CENTRE
    tiles = index.rows.groupBy("list").agg(F.ceil(F.count("*") / TILE).cast("int").alias("_tiles"))
    blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("_blocks"))
    plan = F.broadcast(materialize(tiles.join(blocks, "list"), "lists"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(plan, "list").select("list", each("_tiles").alias("tile"), F.pmod(F.xxhash64("query_id"), F.col("_blocks")).alias("block"), "query_id", "vector", "limit")
    right = index.rows.join(plan, "list").select("list", F.pmod(F.xxhash64("vec_id", "packed"), F.col("_tiles")).alias("tile"), each("_blocks").alias("block"), "vec_id", "code", "norm", "aligned", "packed")

    def meet(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return nearest_in_tile(queries, rows, centres[int(key[0])], kind, k)

    by = [F.col(c).cast("long").alias(c) for c in ("list", "tile", "block")]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(meet, "query_id long, vec_id long, score double")


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for each row of queries (vec_id, vector): smallest
    Euclidean distance in double precision, ties to the smaller vec_id, never the query's own id. A query id with several vectors asks with
    the least of them (in the order of arrays)."""
    centres, probes = index.centres, index.probes
    one = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                vectors = np.stack(batch["vector"].to_numpy()).astype(float)
                lists = squares(vectors, centres).argsort(axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield pd.DataFrame({"query_id": batch["vec_id"].to_numpy(), "vector": list(vectors), "lists": list(lists)})

    asks = materialize(one.mapInPandas(choose, "query_id long, vector array<double>, lists array<int>"), "queries")
    first = asks.select(F.element_at("lists", 1).alias("list"), "query_id", "vector", F.lit(float("inf")).alias("limit"))
    found = materialize(scan(index, first, k), "found")
    if probes > 1:
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("n", F.row_number().over(order))
        limits = best.where(F.col("n") == k).select("query_id", F.col("score").alias("limit"))
        others = asks.join(limits, "query_id", "left").select(
            F.explode(F.slice("lists", 2, probes)).alias("list"), "query_id", "vector", F.coalesce("limit", F.lit(float("inf"))).alias("limit")
        )
        found = found.unionByName(scan(index, materialize(others, "queries"), k))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(df: DataFrame, query: Column, id_column: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the rows of df for which query (a condition on vec_id) holds, each with its k nearest other rows.

    Vectors that are null, empty, zero or hold a null or non-finite component, and rows with a null id, take no part. Vectors of different
    dimensions have no distance: each dimension is searched by itself. All rows of a repeated id are indexed; a neighbour counts once, by its nearest
    vector, and the id asks with the least of its vectors. With fewer than k others all are given; an empty df gives no rows. Further columns,
    whatever their names, aren't read. Ids are whole numbers.
    """
    kind = df.schema[vector].dataType.elementType.typeName()
    rows = df.select(df[id_column].cast("long").alias("vec_id"), df[vector].cast("array<float>" if kind == "float" else "array<double>").alias("vector"))
    rows = materialize(rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))), "vectors")
    out = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for (dim,) in sorted(rows.select(F.size("vector")).distinct().collect()):
        same = rows.where(F.size("vector") == dim)
        out = out.unionByName(search(build_index(same, dim, k), same.where(query), k))
    return out


def op3_one_bit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
