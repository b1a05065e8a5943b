"""Centroid clustering in whole numbers, with n-simplex projection as a filter.

Some vectors are pivots. Their distances to each other span a simplex, and a vector's distances to them place it as the apex of
a larger one: coordinates within the pivots' span, and a height above it. The apexes of all vectors are computed once and stored beside
them. For two apexes the span's distance with the difference of the heights is a lower bound of the vectors' distance, and
with their sum an upper one. In every round a centroid whose lower bound exceeds the least upper bound isn't compared; the others
are, exactly, in 64-bit whole numbers.

The pivots are the first centroids and what the same rounds make of them on a bounded sample: real centroids stay near the span
of these, so their heights, and with them the gaps between the bounds, are small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import materialize, table

DIM, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, "3"
#: Vectors, the first by hash, on which the pivots are fitted: a sample of bounded size, whatever the table's. It decides what is filtered, never a result.
SAMPLE = 2_048
#: Components with magnitudes up to this have squared distances that fit 64 bits.
LIMIT = 1 << 27
#: Vectors that a task compares at a time.
ROWS_AT_ONCE = 4_096
#: A pivot that lies in the span of those before it, but for this share of its squared distance, adds nothing and is left out.
FLAT = 1e-6
#: Rounding of doubles that the bounds allow for, as a share of the squared distances to the first pivot.
SLACK = 1e-8


@dataclass
class Simplex:
    """The pivots' simplex: the pivots, and the triangular matrix of their own coordinates from the first on."""

    pivots: np.ndarray
    base: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray) -> Simplex:
        """Of the points, in order, those that add a dimension."""
        kept, base = [points[0]], np.zeros((0, 0))
        for p in points[1:]:
            own = squares(np.stack(kept), p[None, :])[:, 0]
            inner = (own[0] + squares(np.stack(kept[1:]), kept[0][None, :])[:, 0] - own[1:]) / 2 if len(kept) > 1 else np.zeros(0)
            row = np.linalg.solve(base, inner) if len(kept) > 1 else np.zeros(0)
            height = own[0] - row @ row
            if height > FLAT * max(own[0], 1.0):
                n = len(base)
                base = np.block([[base, np.zeros((n, 1))], [row[None, :], np.full((1, 1), np.sqrt(height))]])
                kept.append(p)
        return cls(np.stack(kept), base)

    def apexes(self, x: np.ndarray) -> np.ndarray:
        """Rows of coordinates, and the height last, from the distances of x to the pivots."""
        to = squares(x, self.pivots)
        if len(self.base) == 0:
            return np.sqrt(to)
        sides = squares(self.pivots[1:], self.pivots[:1])[:, 0]
        inner = (to[:, :1] + sides[None, :] - to[:, 1:]) / 2
        inside = np.linalg.solve(self.base, inner.T).T
        return np.column_stack([inside, np.sqrt(np.maximum(to[:, 0] - (inside * inside).sum(axis=1), 0))])


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all of y (64-bit whole numbers), as doubles."""
    return np.column_stack([((x - row) ** 2).sum(axis=1) for row in y]).astype(float) if len(y) else np.zeros((len(x), 0))


def bounds(apexes: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances between the vectors of apexes and those of centres."""
    a, b = apexes[:, :-1], centres[:, :-1]
    flat = np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0)
    high, own = apexes[:, -1:], centres[None, :, -1]
    slack = SLACK * ((apexes * apexes).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :]) + 1e-6
    return flat + (high - own) ** 2 - slack, flat + (high + own) ** 2 + slack


def assign(x: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid of each row of x, ties to the smaller number; and how many pairs were compared."""
    low, high = bounds(apexes, simplex.apexes(centroids))
    open_ = low <= high.min(axis=1)[:, None]
    best, number = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int32)
    for j, centroid in enumerate(centroids):
        at = np.flatnonzero(open_[:, j])
        d = ((x[at] - centroid) ** 2).sum(axis=1)
        nearer = d < best[at]
        best[at[nearer]], number[at[nearer]] = d[nearer], j
    return number, best, int(open_.sum())


def moved(centroids: np.ndarray, counts: dict[int, int], sums: dict[int, list[int]]) -> np.ndarray:
    """Floors of the means, in whole numbers of any size; a centroid without vectors stays."""
    return np.array([[s // counts[j] for s in sums[j]] if counts.get(j) else c.tolist() for j, c in enumerate(centroids)], np.int64)


def fit(x: np.ndarray, centroids: np.ndarray, rounds: int) -> list[np.ndarray]:
    """Centroids before and after each round over the rows of x alone."""
    steps = [centroids]
    for _ in range(rounds):
        owner = squares(x, steps[-1]).argmin(axis=1)
        counts = {j: int((owner == j).sum()) for j in range(len(centroids))}
        steps.append(moved(steps[-1], counts, {j: [int(s) for s in x[owner == j].sum(axis=0)] for j, n in counts.items() if n}))
    return steps


def whole(vector: Column, dim: int, scale: int) -> Column:
    """The components as whole numbers; null for a vector of another size, with a null or non-finite component, or one beyond LIMIT."""
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & F.floor(x * scale).between(-LIMIT, LIMIT)  # noqa: E731  floor gives the ends of long for infinite ones
    v = vector.cast("array<double>")
    return F.when((F.size(v) == dim) & F.forall(v, fits), F.transform(v, lambda x: F.floor(x * scale).cast("long")))


def _columns(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch, with their vectors."""
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        part = batch.slice(at, ROWS_AT_ONCE)
        yield part, np.frombuffer(b"".join(part.column("x").to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)


def _apexes(part: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(part.column("apex").to_pylist()), "<f8").reshape(part.num_rows, -1)


def stored_apexes(rows: DataFrame, simplex: Simplex, id_column: str, dim: int) -> DataFrame:
    """(id, x, apex): the vectors' numbers and their apexes, packed, stored."""
    kind = rows.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                packed, apexes = x.astype("<i4"), simplex.apexes(x).astype("<f8")
                yield pa.RecordBatch.from_arrays([part.column(id_column), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array([r.tobytes() for r in apexes], pa.binary())], [id_column, "x", "apex"])

    return materialize(rows.mapInArrow(run, f"`{id_column}` {kind.simpleString()}, x binary, apex binary"), "apexes")


def round_sums(stored: DataFrame, centroids: np.ndarray, simplex: Simplex) -> tuple[dict[int, int], dict[int, list[int]]]:
    """Vectors and sums of components by nearest centroid: each task sends one row a centroid, which Spark adds up."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dim), np.int64)
        for batch in batches:
            for part, x in _columns(batch, dim):
                number, _, _ = assign(x, _apexes(part), centroids, simplex)
                for j in np.unique(number):
                    counts[j] += (number == j).sum()
                    sums[j] += x[number == j].sum(axis=0)  # within 64 bits up to 2^36 vectors a task
        some = np.flatnonzero(counts)
        flat = [(int(j), d, int(counts[j]), int(sums[j][d])) for j in some for d in range(dim)]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["cluster", "d", "n", "s"])

    parts = stored.select("x", "apex").mapInArrow(run, "cluster int, d int, n long, s long")
    total = parts.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # one row for each centroid and component
    sums: dict[int, list[int]] = {r["cluster"]: [0] * dim for r in total}
    for r in total:
        sums[r["cluster"]][r["d"]] = int(r["s"])
    return {r["cluster"]: r["n"] for r in total}, sums


def assigned(stored: DataFrame, centroids: np.ndarray, simplex: Simplex, id_column: str) -> DataFrame:
    """(id, cluster, distance, compared): compared is the number of centroids that the bounds left."""
    dim, kind = centroids.shape[1], stored.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _columns(batch, dim):
                number, best, compared = assign(x, _apexes(part), centroids, simplex)
                share = np.full(len(x), compared // max(len(x), 1), np.int32)
                share[: compared % max(len(x), 1)] += 1  # adds up to the pairs compared
                yield pa.RecordBatch.from_arrays([part.column(id_column), pa.array(number), pa.array(best), pa.array(share)], [id_column, "cluster", "distance", "compared"])

    return stored.mapInArrow(run, f"`{id_column}` {kind}, cluster int, distance long, compared int")


def clusters(
    df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance, compared), stored; final centroids).

    Components become floor(scale * x). Vectors that are null, of another size than dim, hold a null or non-finite component, or one whose whole number
    is beyond 2^27 (then squared distances don't fit 64 bits) take no part. The first centroids are the k vectors with the smallest SHA-256 of
    `seed:id` (a null id is hashed as no digits; of rows that repeat an id, the least vector comes first); with fewer than k vectors there are as many
    centroids as vectors. Equal vectors may be centroids of several numbers: the smallest gets all, the others keep their place and no vectors. Every row
    that takes part has one row in the result, repeated ones too; with none there is none, and no centroid. Further columns, whatever their names,
    aren't read.
    """
    rows = df.select(df[id_column], whole(df[vector], dim, scale).alias("x")).where("x is not null")
    shape = f"`{id_column}` {df.schema[id_column].dataType.simpleString()}, cluster int, distance long, compared int"
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    first = rows.select("x", name.alias("h")).orderBy("h", "x").limit(max(SAMPLE, k)).collect()
    if not first:
        return df.sparkSession.createDataFrame([], shape), np.zeros((0, dim), np.int64)
    sample = np.array([r["x"] for r in first], np.int64)
    centroids = sample[:k]
    simplex = Simplex.of(np.concatenate([centroids, fit(sample, centroids, rounds)[-1]]))
    stored = stored_apexes(rows, simplex, id_column, dim)
    for _ in range(rounds):
        centroids = moved(centroids, *round_sums(stored, centroids, simplex))
    return materialize(assigned(stored, centroids, simplex, id_column), "clusters"), centroids


def cluster_report(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows of clusters() with cluster_inertia, inertia and the centroids' digests: one small row for each centroid is broadcast."""
    spark = rows.sparkSession
    digests = [(j, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # one row for each centroid
    inertia = {r["cluster"]: int(r["s"]) for r in sums}
    known = [(j, inertia[j], sum(inertia.values()), h) for j, h in digests if j in inertia]
    return rows.join(F.broadcast(spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster")


def op12_simplex_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster_report(*clusters(table(spark, sf_dir, "embeddings")))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op12_sql() -> str:
    nearest = lambda t: (
        f"(SELECT vec_id, j, d2 FROM (SELECT v.vec_id, c.j, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d2, row_number() OVER (PARTITION BY v.vec_id ORDER BY sum((v.x - c.x) * (v.x - c.x)), c.j) AS r "
        f"FROM v JOIN {t} c ON v.d = c.d GROUP BY v.vec_id, c.j) WHERE r = 1)"
    )
    steps = [
        f"kept AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"v AS MATERIALIZED (SELECT vec_id, d, CAST(floor({SCALE} * CAST(e[d] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, {DIM + 1}) r(d))",
        f"c0 AS MATERIALIZED (SELECT j, d, x FROM (SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS j FROM kept) JOIN v USING (vec_id) WHERE j < {CENTROIDS})",
    ]
    for n in range(ROUNDS):
        steps += [
            f"m{n} AS (SELECT a.j, v.d, sum(v.x) AS s, count(*) AS n FROM {nearest(f'c{n}')} a JOIN v USING (vec_id) GROUP BY a.j, v.d)",
            f"c{n + 1} AS MATERIALIZED (SELECT c.j, c.d, CAST(CASE WHEN m.n IS NULL THEN c.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS BIGINT) AS x FROM c{n} c LEFT JOIN m{n} m ON c.j = m.j AND c.d = m.d)",
        ]
    return "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, CAST(a.j AS INT) AS cluster, a.d2 AS distance, CAST(sum(a.d2) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(a.d2) OVER () AS BIGINT) AS inertia, h.h AS centroid_sha256
FROM {nearest(f'c{ROUNDS}')} a JOIN (SELECT j, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS h FROM c{ROUNDS} GROUP BY j) h ON a.j = h.j"""


OP12_SQL = _op12_sql()
