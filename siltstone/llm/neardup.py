"""MinHash near-duplicates by an LSH forest.

Signatures of TREES * (a permuted choice of DEPTH components) give several sorted orders of the documents. In each
order a document's neighbours are those with the longest common prefixes; up to REACH on either side, with a
common prefix of MIN_DEPTH or more, are its candidates. How deep a prefix a candidate must share thus adapts to
the region: where many documents share short prefixes, the neighbours share longer ones. The orders are
made by range partitioning on the whole key, so a crowded region is split over tasks like any other.

Candidates are confirmed on the full shingle sets in passes: first each document's best one; then, of the others, only
pairs whose documents aren't yet in one component. Last, the regions with more documents than REACH covers are searched
whole: in each, all pairs of different components are compared on the full sets, inside tasks and without sending pairs
around; large regions are cut into blocks, and each pair of blocks is a task's work. Equal sets are one class throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import materialize, semi_by_ids, shuffle_partitions, table
from siltstone.llm.components import connected_components

HASHES, TREES, DEPTH, MIN_DEPTH, REACH = 128, 24, 12, 4, 4
#: Rows of a region that are one block; larger regions are cut into blocks of about so many, of which all pairs are searched.
REGION_ROWS = 5_000
#: The same for the sum of their shingles, so that a block of long documents fits a task as well.
REGION_SHINGLES = 1_500_000
SEED = 20240501


def _numbers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odd factors, terms, and for each tree the components that it reads."""
    rng = np.random.default_rng(SEED)
    factors = rng.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
    terms = rng.integers(0, 2**63, HASHES, dtype=np.uint64)
    return factors, terms, np.stack([rng.permutation(HASHES)[:DEPTH] for _ in range(TREES)])


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-case (A-Z only) words of the whole text, in order."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), upper, lower), "[ \t-\r]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; with fewer words than width, one for the whole sequence."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    k = min(width, n)
    with np.errstate(over="ignore"):
        h = np.full(n - k + 1, 0x9E3779B97F4A7C15 * k % 2**64, np.uint64)
        for j in range(k):
            h = (h ^ words[j : n - k + 1 + j]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
    return np.unique(h)


def minhash(shingles: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """HASHES 16-bit components: the low bits of each permutation's least value."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 1024):
            part = shingles[at : at + 1024]
            low = np.minimum(low, (factors[:, None] * part[None, :] + terms[:, None]).min(axis=1))
        low ^= low >> np.uint64(29)
        low *= np.uint64(0xBF58476D1CE4E5B9)
    return (low >> np.uint64(48)).astype(">u2")


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values, offsets = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield values[a:b]


def signatures(df: DataFrame, id_column: str, text: str, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_hash, signature) per row; set_hash and signature are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        factors, terms, _ = _numbers()
        for batch in batches:
            sizes, hashes, made = [], [], []
            for words in _lists(batch.column("_w")):
                shingles = shingle_set(words, width)
                sizes.append(len(shingles))
                hashes.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                made.append(minhash(shingles, factors, terms).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(made, pa.binary())],
                ["doc_id", "n_shingles", "set_hash", "signature"],
            )

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(df[id_column].alias("_id"), word_hashes(df[text]).alias("_w")).mapInArrow(
        run, f"doc_id {kind}, n_shingles long, set_hash binary, signature binary"
    )


def _regions(parts: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """Number of each key's region: its order and its first MIN_DEPTH components."""
    with np.errstate(over="ignore"):
        start = np.ascontiguousarray(parts[:, :MIN_DEPTH]).view(np.uint64).ravel()
        return ((start + tree.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _orders(classes: DataFrame, with_region: bool) -> DataFrame:
    """A row per class and order: (tree, key, doc_id, n), or (region, doc_id, n)."""
    kind = classes.schema["doc_id"].dataType.simpleString()

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = _numbers()[2]
        for batch in batches:
            if len(batch):
                parts = np.frombuffer(b"".join(batch["signature"]), ">u2").reshape(len(batch), HASHES)
                for t in range(TREES):
                    rows = np.ascontiguousarray(parts[:, trees[t]])
                    rest = {"doc_id": batch["doc_id"].to_numpy(), "n": batch["n_shingles"].to_numpy()}
                    if with_region:
                        yield pd.DataFrame({"region": _regions(rows, np.full(len(rows), t)), **rest})
                    else:
                        packed = rows.tobytes()
                        yield pd.DataFrame({"tree": np.int32(t), "key": [packed[i : i + 2 * DEPTH] for i in range(0, len(packed), 2 * DEPTH)], **rest})

    return classes.mapInPandas(keys, f"region long, doc_id {kind}, n long" if with_region else f"tree int, key binary, doc_id {kind}, n long")


def scan_orders(classes: DataFrame, ratio: float) -> DataFrame:
    """Neighbouring classes (a < b) of the forest's orders with their common prefix, as (a, b, depth); and the regions' sizes, as
    (region, run), to be summed. classes: (doc_id, n_shingles, signature), stored. Pairs whose sizes rule out the
    similarity are left out."""
    kind = classes.schema["doc_id"].dataType.simpleString()

    def nothing(n: int) -> pd.Series:
        return pd.Series([None] * int(n), dtype=object) if kind == "string" else pd.Series(pd.array([None] * int(n), "Int64"))

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, run, first = None, None, True
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            old = 0 if rest is None else len(rest)
            parts = np.frombuffer(b"".join(rows["key"]), ">u2").reshape(len(rows), DEPTH)
            tree, ids, n = rows["tree"].to_numpy(), rows["doc_id"].to_numpy(), rows["n"].to_numpy()
            for j in range(1, min(REACH, len(rows) - 1) + 1):
                at = np.arange(max(0, old - j), len(rows) - j)
                depth = np.cumprod(parts[at] == parts[at + j], axis=1).sum(axis=1)
                small, large = np.minimum(n[at], n[at + j]), np.maximum(n[at], n[at + j])
                keep = (tree[at] == tree[at + j]) & (depth >= MIN_DEPTH) & (small >= ratio * large) & (ids[at] != ids[at + j])
                at, depth = at[keep], depth[keep]
                yield pd.DataFrame({"a": np.minimum(ids[at], ids[at + j]), "b": np.maximum(ids[at], ids[at + j]), "depth": depth.astype(np.int32), "region": 0, "run": 0})
            regions = _regions(parts[old:], tree[old:])
            starts = np.concatenate([[0], np.flatnonzero(np.diff(regions)) + 1])
            names, sizes = regions[starts], np.diff(np.concatenate([starts, [len(regions)]]))
            if run is not None:
                if names[0] == run[0]:
                    sizes[0] += run[1]
                else:
                    names, sizes = np.concatenate([[run[0]], names]), np.concatenate([[run[1]], sizes])
            run = (names[-1], sizes[-1])
            # a run at a border of the partition may go on in the next one, so it counts whatever its size
            whole = sizes[:-1] > 1
            if first and len(whole):
                whole[0], first = True, False
            yield pd.DataFrame({"a": nothing(whole.sum()), "b": nothing(whole.sum()), "depth": 0, "region": names[:-1][whole], "run": sizes[:-1][whole]})
            rest = rows.iloc[-REACH:]
        if run is not None:
            yield pd.DataFrame({"a": nothing(1), "b": nothing(1), "depth": 0, "region": [run[0]], "run": [run[1]]})

    parts = shuffle_partitions(classes.sparkSession)
    ordered = _orders(classes, False).repartitionByRange(parts, "tree", "key", "doc_id").sortWithinPartitions("tree", "key", "doc_id")
    return ordered.mapInPandas(neighbours, f"a {kind}, b {kind}, depth int, region long, run long")


def crowded_rows(classes: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, doc_id, n) of the classes in regions (region), stored."""
    rows = _orders(classes.select("doc_id", "n_shingles", "signature"), True)
    return materialize(semi_by_ids(rows, regions, "region"), "crowded")


def region_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(region, x, y, own, doc_id, component): the rows (region, doc_id, n, component; stored) dealt to the pairs of blocks (x, y)
    in which each meets all that it can be linked with; own is the row's block, x or y.

    A region of up to REGION_ROWS rows and REGION_SHINGLES shingles is one block. A larger one is cut by size, into bands in which documents can only be similar
    to their own and the next band; by whether a document is in the region's largest component; and by a hash of the id, into blocks
    of about so much (a longer document may be one by itself). Pairs of blocks are left out only if their sizes rule out the similarity or all is one component."""
    sizes = rows.groupBy("region").agg(F.count("*").alias("_n"), F.sum("n").alias("_s"), F.min("component").alias("_low"), F.max("component").alias("_high"))
    sizes = materialize(sizes.where("_low <> _high").select("region", ((F.col("_n") > REGION_ROWS) | (F.col("_s") > REGION_SHINGLES)).alias("_large")), "regions")
    one = F.lit("")
    whole = rows.join(sizes.where(~F.col("_large")), "region").select("region", one.alias("x"), one.alias("y"), one.alias("own"), "doc_id", "component")
    if sizes.where("_large").isEmpty():
        return whole
    large = rows.join(sizes.where("_large").select("region"), "region")
    lead = large.groupBy("region", "component").agg(F.count("*").alias("_n")).groupBy("region").agg(F.max(F.struct("_n", "component")).alias("_m"))
    lead = materialize(lead.select("region", F.col("_m.component").alias("_lead")), "regions")
    # a little wider than the ratio, so that rounding parts no pair at the threshold by two bands
    band = max(math.log(100 / max(percent, 1)), 1e-6) * (1 + 1e-9)
    large = large.join(lead, "region").select(
        "region", "doc_id", "n", "component", (F.col("component") == F.col("_lead")).cast("int").alias("_side"), F.floor(F.log("n") / band).alias("_band")
    )
    counts = large.groupBy("region", "_side", "_band").agg(F.ceil(F.greatest(F.count("*") / REGION_ROWS, F.sum("n") / REGION_SHINGLES)).alias("_blocks"))
    large = large.join(materialize(counts, "regions"), ["region", "_side", "_band"])
    large = materialize(large.withColumn("own", F.concat_ws(":", "_side", "_band", F.pmod(F.xxhash64("doc_id"), F.col("_blocks")))), "blocks")
    blocks = materialize(large.groupBy("region", "own", "_band").agg(F.min("component").alias("_low"), F.max("component").alias("_high")), "regions")
    side = lambda name: blocks.select("region", *[F.col(c).alias(f"{name}{c}") for c in ("own", "_band", "_low", "_high")])
    pairs = side("x").join(side("y"), "region").where(
        (F.col("xown") <= F.col("yown")) & (F.abs(F.col("x_band") - F.col("y_band")) <= 1) & (F.least("x_low", "y_low") != F.greatest("x_high", "y_high"))
    ).select("region", F.col("xown").alias("x"), F.col("yown").alias("y"))
    pairs = materialize(pairs.withColumn("own", F.explode(F.array_distinct(F.array("x", "y")))), "regions")
    return whole.unionByName(large.join(pairs, ["region", "own"]).select("region", "x", "y", "own", "doc_id", "component"))


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each i of left with the exact sizes of its set's intersections with those of right. Shingles that many of right have are
    counted by a matrix product, the others by their lists."""
    lengths = np.array([len(s) for s in sets])
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(lengths)
    owner, place = np.repeat(np.arange(len(sets)), lengths), np.full(len(sets), -1)
    place[right] = np.arange(len(right))
    held = place[owner] >= 0
    order = np.argsort(shingle[held], kind="stable")
    lists, count = place[owner[held]][order], np.bincount(shingle[held], minlength=shingle.max(initial=-1) + 1)
    start = np.cumsum(count) - count
    often = np.flatnonzero(count > max(16, len(right) // 16))
    column = np.full(len(count), -1)
    column[often] = np.arange(len(often))
    exact = np.float32 if lengths.max(initial=0) < 2**24 else np.float64
    dense = np.zeros((len(right), len(often)), exact)
    among = held & (column[shingle] >= 0)
    dense[place[owner[among]], column[shingle[among]]] = 1
    for first in range(0, len(left), 256):
        some = left[first : first + 256]
        own = [shingle[ends[i] - lengths[i] : ends[i]] for i in some]
        mine = np.zeros((len(some), len(often)), exact)
        for k, s in enumerate(own):
            mine[k, column[s[column[s] >= 0]]] = 1
        for i, s, both in zip(some, own, mine @ dense.T, strict=True):
            s = s[(column[s] < 0) & (count[s] > 0)]
            k = count[s]
            at = np.repeat(start[s] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            yield i, both.astype(np.int64) + np.bincount(lists[at], minlength=len(right))


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles) per row of texts (doc_id, text): the sorted distinct hashes, as long as n_shingles however long the text is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(words, width) for words in _lists(batch.column("_w"))]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["doc_id", "shingles"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", word_hashes(F.col("text")).alias("_w")).mapInArrow(run, f"doc_id {kind}, shingles array<long>")


def region_links(rows: DataFrame, stars: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links between components in the regions. rows: crowded_rows; stars: the components so far. Regions of a single
    component are left out before texts are met. A task takes a pair of a region's blocks and compares the full sets of all
    pairs of different components; what a link has joined isn't linked again, and only links are returned, fewer
    than the blocks have documents."""
    named = rows.join(stars.select(F.col("a").alias("doc_id"), F.col("b").alias("_least")), "doc_id", "left")
    named = materialize(named.select("region", "doc_id", "n", F.coalesce("_least", "doc_id").alias("component")), "region-rows")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def links(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("doc_id")
        sets = [np.asarray(w, np.int64).view(np.uint64) for w in batch["shingles"]]
        ids, n = batch["doc_id"].to_numpy(), np.array([len(s) for s in sets])
        component = np.unique(batch["component"].to_numpy(), return_inverse=True)[1]
        if batch["x"].iloc[0] == batch["y"].iloc[0]:  # pairs within the largest component are none
            left, right = np.flatnonzero(component != np.bincount(component).argmax()), np.arange(len(ids))
        else:
            left, right = (np.flatnonzero(batch["own"] == batch[c]) for c in ("x", "y"))
        out = []
        for i, both in overlaps(sets, left, right):
            for j in right[(component[right] != component[i]) & (100 * both >= percent * (n[right] + n[i] - both))]:
                if component[i] != component[j]:
                    out.append((ids[i], ids[j]))
                    component[component == component[j]] = component[i]
        return pd.DataFrame(out, columns=["a", "b"])

    done = materialize(region_pairs(named, percent), "region-pairs")
    needed = semi_by_ids(texts, materialize(done.select("doc_id").distinct(), "region-ids"), "doc_id")
    met = done.join(shingle_sets(needed, width), "doc_id")
    return met.groupBy("region", "x", "y").applyInPandas(links, f"a {kind}, b {kind}").distinct()


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union. texts: (doc_id, text), read
    only where a pair needs them; pairs: stored and distinct. A document is in a bounded number of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for x, y in zip(_lists(batch.column("_x")), _lists(batch.column("_y")), strict=True):
                x, y = shingle_set(x, width), shingle_set(y, width)
                both = len(np.intersect1d(x, y, assume_unique=True))
                hits.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(hits, pa.bool_()))

    ids = materialize(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "pair-ids")
    needed = semi_by_ids(texts, ids, "doc_id")
    left = needed.select(F.col("doc_id").alias("a"), F.col("text").alias("_a"))
    right = needed.select(F.col("doc_id").alias("b"), F.col("text").alias("_b"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b")
    kind = pairs.schema["a"].dataType.simpleString()
    return met.select("a", "b", word_hashes(F.col("_a")).alias("_x"), word_hashes(F.col("_b")).alias("_y")).mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 4, percent: int = 80) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Documents without words (null, empty or blank texts) are linked with nothing. Repeated rows, and other documents
    with equal shingle sets, are one class from the start. Ids may be numbers or strings. Rows of one doc_id with different texts count as one
    document whose links are pooled. A row with a null doc_id can't be named: it is linked with nothing, its
    component_id is null and kept is true. Other columns aren't read. A neighbour pair that a partition's
    border cuts is met in the search of its region.

    Texts of any length are read whole; a document that is larger than a block by itself is a block. An empty df gives no rows.

    A link of similarity s shares no region with probability (1 - s ** MIN_DEPTH) ** TREES: 3e-6 at 0.8. No other link is missed, in crowded
    regions or elsewhere: every pair that shares a region and isn't yet in one component is confirmed on the full sets. Sets hold 64-bit hashes of
    shingles, made from 64-bit hashes of words; two given shingles meet with probability 5e-20, so two sets of a thousand are off by one
    shingle with less than 1e-13.
    """
    docs = materialize(signatures(df, id_column, text, width), "signatures")
    usable = docs.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = usable.groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = materialize(classes, "classes")
    texts = df.select(df[id_column].alias("doc_id"), df[text].alias("text"))

    scanned = materialize(scan_orders(classes.select("doc_id", "n_shingles", "signature"), percent / 100), "scan")
    found = materialize(scanned.where("a IS NOT NULL").groupBy("a", "b").agg(F.max("depth").alias("depth"), F.count("*").alias("orders")), "candidates")
    ends = found.select("a", "b", "depth", "orders", F.col("a").alias("v")).union(found.select("a", "b", "depth", "orders", F.col("b").alias("v")))
    best = ends.groupBy("v").agg(F.min(F.struct((-F.col("orders")).alias("_o"), (-F.col("depth")).alias("_d"), "a", "b")).alias("x"))
    first = materialize(best.select("x.a", "x.b").distinct(), "pairs")
    links = materialize(confirm(first, texts, width, percent), "links")
    stars = connected_components(links)

    root = lambda side: stars.select(F.col("a").alias(side), F.col("b").alias(f"_{side}"))
    apart = (
        found.select("a", "b").join(root("a"), "a", "left").join(root("b"), "b", "left")
        .where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
        .join(first.withColumn("_seen", F.lit(True)), ["a", "b"], "left_anti")
    )
    second = materialize(apart, "pairs")
    more = materialize(confirm(second, texts, width, percent), "links")
    stars = connected_components(stars.unionByName(more))

    crowds = scanned.where("a IS NULL").groupBy("region").agg(F.sum("run").alias("n"), F.count("*").alias("runs"))
    # a region that a partition's border cuts is searched whole, since neighbours don't meet over the border
    crowds = crowds.where((F.col("n") > REACH + 1) | (F.col("runs") > 1)).select("region")
    crowd = crowded_rows(classes, materialize(crowds, "crowds"))
    links = materialize(region_links(crowd, stars, texts, width, percent), "links")
    if not links.isEmpty():
        stars = connected_components(stars.unionByName(links))

    named = classes.join(stars.select(F.col("a").alias("doc_id"), F.col("b").alias("_least")), "doc_id", "left")
    named = named.select(F.col("set_hash"), F.coalesce("_least", "doc_id").alias("_component"))
    out = docs.join(named, "set_hash", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
