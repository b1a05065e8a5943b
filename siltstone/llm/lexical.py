"""Ranked lexical search with two trees.

Texts are read once for their numbers of terms and the counts of the items' terms; every document becomes a sparse vector of whole
numbers. These vectors are brought into an order in which documents that score by the same rare terms lie together, and are cut into batches.
Over a batch a tree of documents holds the largest value of every coordinate at each node; a tree of items holds the same of the items'
weights. The product of two nodes' maxima bounds the score of every item below the one with every document below the other. A pair of nodes
whose bound is below the weakest k-th score so far among its items is left out whole, down from the roots, where a pair is all
items of a group with a whole batch; what is left at the leaves is scored. Bounds and scores are whole numbers, so nothing is lost.

For each item the batch with the largest bound is searched first, by one job; the k-th scores found there are where all other tasks start from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import materialize, table

K = 10
#: Terms of the items that one pass over the documents looks for, about; with more, the items are dealt to several passes.
BLOCK_TERMS = 16_384
#: Documents of a batch at most, and numbers that the maxima of a batch's documents take at most.
BATCH_ROWS, BATCH_CELLS = 2_048, 1 << 24
#: Children of a node of documents, and of one of items.
WIDTH, ITEM_WIDTH = 4, 8
#: Bytes of a text that are split into terms at a time.
PIECE = 1 << 20

#: Bytes that stand in no term become blanks, A to Z small letters.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in pieces of about PIECE bytes; a term is never cut."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end].translate(_BYTES).split()
        at = end


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 8 m) with m = 10 + (90 n N) div L, below 10^6."""
    m = 10 + (90 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass
class Node:
    """Items, or nodes of them, with their terms and the largest weight that an item below gives each."""

    terms: np.ndarray
    weights: np.ndarray
    items: list[int]
    below: list[Node]


def item_tree(items: list[np.ndarray], weights: np.ndarray) -> list[Node]:
    """Roots of the tree over the items (arrays of terms). Items that hold the same of the most shared terms lie together."""
    shared = np.bincount(np.concatenate(items), minlength=len(weights)) if items else np.zeros(0)
    common = np.argsort(-shared, kind="stable")[:64]
    order = sorted(range(len(items)), key=lambda i: np.isin(common, items[i], invert=True).tolist())
    level = [Node(items[i], weights[items[i]].astype(float), [i], []) for i in order]
    for _ in range(2):
        level = [_over(level[a : a + ITEM_WIDTH], weights) for a in range(0, len(level), ITEM_WIDTH)]
    return level


def _over(nodes: list[Node], weights: np.ndarray) -> Node:
    terms = np.unique(np.concatenate([n.terms for n in nodes]))
    return Node(terms, weights[terms].astype(float), [i for n in nodes for i in n.items], nodes)


class Best:
    """The k best documents of each item so far: highest scores, ties to the smaller id. floor: scores below which a document isn't wanted."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floor = k, floors.astype(float)
        self.scores = [np.zeros(0)] * len(floors)
        self.ids = [np.zeros(0, np.int64)] * len(floors)

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        wanted = (scores >= self.floor[item]) & (scores > 0)
        if not wanted.any():
            return
        scores, ids = np.concatenate([self.scores[item], scores[wanted]]), np.concatenate([self.ids[item], ids[wanted]])
        first = np.lexsort((ids, -scores))[: self.k]
        self.scores[item], self.ids[item] = scores[first], ids[first]
        if len(first) == self.k:
            self.floor[item] = max(self.floor[item], self.scores[item][-1])


class Batch:
    """Documents of a batch as rows of a matrix, and the maxima of their tree: leaves of WIDTH documents, nodes of WIDTH leaves, and so on to the root."""

    def __init__(self, ids: np.ndarray, terms: list[np.ndarray], values: list[np.ndarray], width: int):
        self.ids = ids
        docs = np.zeros((-(-len(ids) // WIDTH) * WIDTH, width), np.int32)
        docs[np.repeat(np.arange(len(ids)), [len(t) for t in terms]), np.concatenate(terms)] = np.concatenate(values)
        self.levels = [docs[: len(ids)]]
        while True:
            self.levels.append(docs.reshape(-1, WIDTH, width).max(axis=1))
            if len(self.levels[-1]) == 1:
                break
            docs = np.pad(self.levels[-1], ((0, -len(self.levels[-1]) % WIDTH), (0, 0)))
        self.top = len(self.levels) - 1

    def bounds(self, level: int, at: np.ndarray, node: Node) -> np.ndarray:
        """Of the nodes `at` of a level with node; scores, if both are single."""
        return self.levels[level][at[:, None], node.terms].astype(float) @ node.weights

    def children(self, level: int, at: np.ndarray) -> np.ndarray:
        out = (at[:, None] * WIDTH + np.arange(WIDTH)).ravel()
        return out[out < len(self.levels[level - 1])]


def search_batch(batch: Batch, roots: list[Node], best: Best, seen: Counter) -> None:
    """Adds the batch's documents to best. seen counts the pairs of nodes that were bounded, and the pairs that were scored."""
    for root in roots:
        meet(batch, root, batch.top, np.zeros(1, np.int64), best, seen)


def meet(batch: Batch, node: Node, level: int, at: np.ndarray, best: Best, seen: Counter) -> None:
    """Descends both trees at once, a single item or leaves waiting for the other side. at: nodes of a level of the documents' tree, of which
    those stay whose bound reaches the weakest floor of node's items."""
    seen["bounded"] += len(at)
    bounds = batch.bounds(level, at, node)
    weakest = best.floor[node.items].min()
    live = (bounds >= weakest) & (bounds > 0)
    at, bounds = at[live], bounds[live]
    if not len(at):
        return
    if node.below or level > 1:
        at = batch.children(level, at) if level > 1 else at
        for child in node.below or [node]:
            meet(batch, child, max(level - 1, 1), at, best, seen)
        return
    # one item, and leaves: those of the largest bounds first, more and more of them as the floor rises
    order = np.argsort(-bounds, kind="stable")
    at, bounds, item, done, take = at[order], bounds[order], node.items[0], 0, 4
    while done < len(at) and bounds[done] >= best.floor[item]:
        docs = batch.children(1, at[done : done + take])
        seen["scored"] += len(docs)
        best.add(item, batch.bounds(0, docs, node), batch.ids[docs])
        done, take = done + take, 2 * take


@dataclass
class Items:
    """A block of items: their ids, their terms by number, the numbers of all terms, and the weights once they are known."""

    ids: list[int]
    terms: list[np.ndarray]
    vocabulary: dict[bytes, int]
    weights: np.ndarray | None = None


def item_block(rows: list[tuple[int, list[str]]]) -> Items:
    vocabulary: dict[bytes, int] = {}
    terms = [np.array(sorted({vocabulary.setdefault(t.encode(), len(vocabulary)) for t in found}), np.int64) for _, found in rows]
    return Items([i for i, _ in rows], terms, vocabulary)


def document_vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tf) of docs (doc_id long, text binary): all terms with repeats, and of those in the vocabulary numbers and counts, packed; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in batches:
            n, terms, tf = [], [], []
            for text in batch.column("text"):
                found: Counter = Counter()
                for some in terms_of(text.as_py() or b""):
                    found.update(map(number, some))
                n.append(found.total())
                found.pop(None, None)
                terms.append(np.fromiter(found.keys(), "<i4", len(found)).tobytes())
                tf.append(np.fromiter(found.values(), "<i4", len(found)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tf, pa.binary())], ["doc_id", "n", "terms", "tf"])

    return materialize(docs.mapInArrow(run, "doc_id long, n long, terms binary, tf binary"), "vectors")


def document_counts(vectors: DataFrame, width: int) -> np.ndarray:
    """Documents of each term of the block: each task sends one row a term at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(width, np.int64)
        for batch in batches:
            counts += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4"), minlength=width)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some])], ["term", "n"])

    out = np.zeros(width, np.int64)
    for r in vectors.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # one row a term of the block
        out[r["term"]] = r["n"]
    return out


def in_batches(vectors: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int, rows: int) -> DataFrame:
    """(batch, doc_id, terms, value): documents with terms of positive weight, ordered by the two terms that give them most, then by a hash that also parts
    groups of documents with equal ones; in batches of up to `rows`; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first, second, values, terms = [], [], [], [], []
            for doc, n, t, f in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "n", "terms", "tf")], strict=True):
                own = np.frombuffer(t, "<i4")
                value = impacts(np.frombuffer(f, "<i4").astype(np.int64), np.int64(n), n_docs, n_terms)
                gain = value * weights[own]
                top = np.lexsort((own, -gain))[:2]
                if not len(top) or gain[top[0]] <= 0:
                    continue
                ids.append(doc)
                first.append(int(own[top[0]]))
                second.append(int(own[top[-1]]))
                terms.append(t)
                values.append(value.astype("<i4").tobytes())
            columns = [pa.array(ids, pa.int64()), pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(terms, pa.binary()), pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a", "b", "terms", "value"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = (np.int64(part) << 32) + (done + np.arange(batch.num_rows)) // rows
            done += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(ids), *[batch.column(c) for c in ("doc_id", "terms", "value")]], ["batch", "doc_id", "terms", "value"])

    made = vectors.where(F.octet_length("terms") > 0).mapInArrow(run, "doc_id long, a int, b int, terms binary, value binary")
    keys = ["a", "b", F.xxhash64("doc_id")]
    ordered = made.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(ordered.mapInArrow(number, "batch long, doc_id long, terms binary, value binary"), "batches")


def each_batch(parts: Iterator[pa.RecordBatch], width: int, use: Callable[[int, Batch], None]) -> None:
    """Calls use with every batch in a task's rows, of which one is held at a time. A batch that is read in two tasks is two smaller ones."""
    held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def close(number: int) -> None:
        ids, terms, values = zip(*held, strict=True)
        use(number, Batch(np.array(ids, np.int64), list(terms), list(values), width))
        held.clear()

    last = None
    for part in parts:
        for number, doc, t, v in zip(*[part.column(c).to_pylist() for c in ("batch", "doc_id", "terms", "value")], strict=True):
            if held and number != last:
                close(last)
            last = number
            held.append((doc, np.frombuffer(t, "<i4"), np.frombuffer(v, "<i4")))
    if held:
        close(last)


def first_batches(rows: DataFrame, items: Items) -> DataFrame:
    """(batch): for each item the batch whose root has the largest bound. Each task sends a row an item."""
    width, weights = len(items.vocabulary), items.weights
    single = [Node(t, weights[t].astype(float), [i], []) for i, t in enumerate(items.terms)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, where = np.zeros(len(single)), np.zeros(len(single), np.int64)

        def use(number: int, batch: Batch) -> None:
            for node in single:
                bound = batch.bounds(batch.top, np.zeros(1, np.int64), node)[0]
                if bound > top[node.items[0]]:
                    top[node.items[0]], where[node.items[0]] = bound, number

        each_batch(parts, width, use)
        some = np.flatnonzero(top)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(where[some]), pa.array(top[some])], ["item", "batch", "bound"])

    found = rows.mapInArrow(run, "item long, batch long, bound double")
    return materialize(found.groupBy("item").agg(F.max_by("batch", F.struct("bound", "batch")).alias("batch")).select("batch").distinct(), "first")


def search_rows(rows: DataFrame, items: Items, floors: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): what each task finds, at most k rows an item, none below its floor."""
    width, weights, n = len(items.vocabulary), items.weights, len(items.ids)
    roots = item_tree(items.terms, weights)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, seen = Best(floors, k), Counter()
        each_batch(parts, width, lambda _, batch: search_batch(batch, roots, best, seen))
        owner = np.repeat(np.arange(n), [len(s) for s in best.scores])
        yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores).astype(np.int64))], ["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, items: Items, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score) for the items of a block."""
    spark = docs.sparkSession
    shape = "item_id long, rank int, doc_id long, score long"
    vectors = document_vectors(docs, items.vocabulary)
    n_docs, n_terms = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_terms or not items.vocabulary:
        return spark.createDataFrame([], shape)
    width = len(items.vocabulary)
    items.weights = np.array([weight(n_docs, int(df)) for df in document_counts(vectors, width)], np.int64)
    rows = in_batches(vectors.where("doc_id is not null"), items.weights, n_docs, n_terms, max(WIDTH, min(BATCH_ROWS, BATCH_CELLS // width)))
    first = F.broadcast(first_batches(rows, items))  # at most one row an item of the block
    floors = np.zeros(len(items.ids))
    begun = materialize(search_rows(rows.join(first, "batch", "left_semi"), items, floors, k), "begun")
    for r in _ranked(begun, k).where(F.col("rank") == k).select("item", "score").collect():  # at most one row an item of the block
        floors[r["item"]] = r["score"]
    rest = search_rows(rows.join(first, "batch", "left_anti"), items, floors, k)
    names = F.broadcast(spark.createDataFrame(list(enumerate(items.ids)), "item long, item_id long"))
    return _ranked(begun.unionByName(rest), k).join(names, "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents of the highest scores above 0, ties to the smaller doc_id, ranks from 1.

    Null and empty texts have no terms: such documents count nowhere, such items have no rows. Rows of items that share an id are one item of all their
    terms; items without an id are left out. Documents that repeat an id or a text are documents of their own, each with its rank. Documents without an id
    count in the statistics, but can't be named and aren't ranked. Texts may be of any length: one is held at a time, and its terms a megabyte at a time.
    With an empty table on either side there are no rows. Further columns, whatever their names, aren't read. Ids are whole numbers. A
    document's number of terms times the number of documents must stay below 10^17.

    Items whose terms are too many for one pass (BLOCK_TERMS) are dealt by hash to several passes, each over all documents.
    """
    spark = docs.sparkSession
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = F.translate(F.coalesce(items[item_text], F.lit("")), capitals, capitals.lower())
    found = items.select(items[item_id].cast("long").alias("item_id"), F.array_distinct(F.regexp_extract_all(lower, F.lit(pattern), F.lit(0))).alias("terms"))
    found = materialize(found.where("item_id is not null"), "items")
    blocks = math.ceil((found.agg(F.sum(F.size("terms"))).first()[0] or 0) / BLOCK_TERMS)
    plain = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[doc_text].cast("binary").alias("text"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        own = found.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        own = own.groupBy("item_id").agg(F.flatten(F.collect_list("terms")).alias("terms")).orderBy("item_id")
        rows = [(r["item_id"], r["terms"]) for r in own.collect()]  # of about BLOCK_TERMS terms
        if rows:
            out = out.unionByName(search_block(plain, item_block(rows), k))
    return out


def op11_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
OP11_SQL = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_TERMS} AS term FROM documents),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id), s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
i AS MATERIALIZED (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} AS term FROM benchmark)),
t AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term, docs),
p AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) AS gain FROM t JOIN n USING (doc_id) JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM i JOIN p USING (term) GROUP BY item_id, doc_id),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM o WHERE rank <= {K}"""
