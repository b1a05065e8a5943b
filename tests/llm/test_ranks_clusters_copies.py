"""Ranked search, centroid clustering and exact duplicates against brute force, SQL and odd input."""

import glob
import hashlib
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_small import LONG, ODD, documents, prose

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_dual_tree_search", "op12_simplex_clusters", "op13_exact_dedup"])
def test_sql(spark, name):
    import duckdb

    from siltstone.llm.queries import ORACLE_SQL, QUERIES

    db = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df, result = QUERIES[name](spark, SF_DIR), db.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(repr([row[names.index(c)] for c in df.columns]) for row in result.fetchall())
    assert sorted(repr(list(r)) for r in df.collect()) == expected and expected


# -- exact duplicates


def groups_by_hand(rows):
    """rows: (id, text); per row (id, keep_id, size, digest), and how many stay for each digest."""
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    of = {}
    for (i, _), t in zip(rows, normal, strict=True):
        of.setdefault(t, []).append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in of.items()}
    return sorted(((i, keep[t], len(of[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, normal, strict=True)), key=repr)


@pytest.mark.parametrize("share", [1 / 1000, 1 / 50, 1 / 4])
def test_exact_groups(spark, share):
    from siltstone.llm.exactdup import exact_groups

    rnd = random.Random(4)
    texts = [*ODD, *[prose(i % 30, 12) for i in range(200)], *["the hot  text"] * 150, *["the\thot text"] * 50, *[" "] * 9, "a\x0bb", "a b", "a b", LONG, LONG + " "]
    rnd.shuffle(texts)
    df = documents(spark, texts).repartition(7)
    df = df.unionByName(df.where("doc_id % 50 = 3"))
    rows = df.collect()
    out = exact_groups(df, carry=("lang", "size"), share=share).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out), key=repr) == groups_by_hand([(r["doc_id"], r["text"]) for r in rows])
    stay = Counter(r["text_sha256"] for r in out if r["kept"])
    assert set(stay.values()) == {1} and set(stay) == {r["text_sha256"] for r in out}
    assert all(r["doc_id"] == r["keep_id"] for r in out if r["kept"])
    own = {(r["doc_id"], r["lang"], r["size"]) for r in rows}
    assert {(r["doc_id"], r["lang"], r["size"]) for r in out} == own
    assert exact_groups(documents(spark, [])).count() == 0


def test_without_copies(spark):
    from siltstone.llm.exactdup import exact_groups, without_copies

    df = documents(spark, ["a b", "a  b", "c", "NULL", "", "d"])
    assert sorted(r["doc_id"] for r in without_copies(df).collect()) == [0, 2, 3, 5] and without_copies(df).columns == df.columns
    clash = df.withColumnRenamed("size", "kept").withColumnRenamed("shard", "_digest").withColumnRenamed("label", "_row")
    assert sorted(r["doc_id"] for r in without_copies(clash).collect()) == [0, 2, 3, 5]
    assert exact_groups(clash, carry=("_digest", "_row")).count() == 6
    with pytest.raises(ValueError):
        exact_groups(clash, carry=("kept",))


def test_heavy_digests_are_not_shuffled(spark):
    from siltstone.llm.exactdup import heavy_winners

    rows = spark.createDataFrame([(i, f"{i % 200 if i % 3 else 'hot'}".encode(), i) for i in range(3_000)], "doc_id long, _digest binary, _row long")
    found = heavy_winners(rows, "doc_id", 0.01).collect()
    assert [(bytes(r["_digest"]), r["_size"], r["_best"]["id"]) for r in found] == [(b"hot", 1_000, 0)]


# -- clusters


def clusters_by_hand(rows, k, rounds, dim):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda j: (square(v, centroids[j]), j))
    for _ in range(rounds):
        owner = [nearest(v) for _, v in kept]
        for j in range(len(centroids)):
            if mine := [v for o, (_, v) in zip(owner, kept, strict=True) if o == j]:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return sorted(((i, j := nearest(v), square(v, centroids[j])) for i, v in kept), key=repr), centroids


@pytest.mark.parametrize("seed", range(4))
def test_clusters(spark, seed):
    from siltstone.llm.centroids import cluster_report, clusters

    rnd, dim = random.Random(seed), 6
    n = [0, 3, 40, 300][seed]
    around = [[rnd.uniform(-3, 3) for _ in range(dim)] for _ in range(5)]
    rows = [(i, [x + rnd.gauss(0, 0.2) for x in rnd.choice(around)]) for i in range(n)]
    rows += [(900, None), (901, []), (902, [1.0] * (dim + 1)), (903, [float("nan")] * dim), (904, [None] * dim), (905, [float("inf"), *[0.0] * (dim - 1)]), (906, [float("-inf"), *[0.0] * (dim - 1)])]
    rows += [(7, [0.0] * dim), (7, [0.0] * dim), (None, [-1e-9] * dim), (8, [1000.0] * dim)] * bool(n)
    df = spark.createDataFrame([(i, v, "x", 1, 1.5) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int, apex double").repartition(3)
    out, centroids = clusters(df, dim=dim)
    expected, finals = clusters_by_hand(rows, 8, 10, dim)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in out.collect()), key=repr) == expected
    assert centroids.tolist() == finals
    report = cluster_report(out, centroids).collect()
    for r in report:
        own = [d for _, j, d in expected if j == r["cluster"]]
        assert (r["cluster_inertia"], r["inertia"]) == (sum(own), sum(d for _, _, d in expected))
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, finals[r["cluster"]])).encode()).hexdigest()
    assert len(report) == len(expected)


def test_far_vectors_take_no_part(spark):
    from siltstone.llm.centroids import LIMIT, clusters

    df = spark.createDataFrame([(1, [0.0, LIMIT / 1024]), (2, [0.0, LIMIT / 1024 + 1]), (3, [-LIMIT / 1024, 0.0]), (4, [1e300, 0.0])], "vec_id long, embedding array<double>")
    out, _ = clusters(df, dim=2)
    assert sorted((r["vec_id"], r["distance"]) for r in out.collect()) == [(1, 0), (3, 0)]


@pytest.mark.parametrize("seed", range(6))
def test_simplex_bounds(seed):
    from siltstone.llm.centroids import Simplex, assign, bounds, squares

    rng = np.random.default_rng(seed)
    dim = [64, 64, 3, 5, 1, 64][seed]
    x = rng.integers(-2_000, 2_000, (500, dim))
    pivots = np.concatenate([x[:8], x[:3], x[:2] + 1]) if seed < 5 else np.repeat(x[:1], 9, axis=0)
    simplex = Simplex.of(pivots)
    assert len(simplex.pivots) <= dim + 1
    centroids = np.concatenate([x[:4], rng.integers(-500, 500, (4, dim))])
    low, high = bounds(simplex.apexes(x), simplex.apexes(centroids))
    exact = squares(x, centroids)
    assert (low <= exact).all() and (exact <= high).all()
    own = squares(x[:4], simplex.pivots)  # a pivot's own distances are met exactly
    assert np.allclose(bounds(simplex.apexes(simplex.pivots), simplex.apexes(x[:4]))[0].clip(0), own.T, rtol=1e-5, atol=1)
    number, best, compared = assign(x, simplex.apexes(x), centroids, simplex)
    assert (number == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all() and compared <= exact.size


# -- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked_by_hand(docs, items, k=10):
    terms = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    joined = {}
    for i, t in items:
        if i is not None:
            joined.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in joined.items():
        scores = []
        for i, c in found:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def few_words(seed, n):
    rnd = random.Random(seed)
    return " ".join(f"{rnd.choice('ABcdéß日')}{rnd.choice('xyz')}{int(rnd.expovariate(0.3))}" for _ in range(n))


@pytest.mark.parametrize("block_terms, batch_rows", [(16_384, 2_048), (40, 8)])
def test_ranked_search(spark, monkeypatch, block_terms, batch_rows):
    from siltstone.llm import lexical

    monkeypatch.setattr(lexical, "BLOCK_TERMS", block_terms)
    monkeypatch.setattr(lexical, "BATCH_ROWS", batch_rows)
    texts = [*ODD, *[few_words(i % 150, 5 + i % 60) for i in range(220)], *[few_words(999, 30)] * 25, "ABCdé", "abcDÉ", "x" * 3_000_000 + " ax1"]
    docs = documents(spark, texts).repartition(5)
    docs = docs.unionByName(docs.where("doc_id % 60 = 20"))
    items = [(i, few_words(i + 5, 4 + 3 * i)) for i in range(12)] + [(3, "ax1 AY2, ay2"), (50, None), (51, ""), (52, "...!"), (53, "same TEXT here"), (None, "same text"), (54, "nowhere at all zzz"), (55, "abcdé")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, rank int")
    got = sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.ranked_search(docs, frame).collect())
    assert got == ranked_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    assert lexical.ranked_search(documents(spark, []), frame).count() == 0
    assert lexical.ranked_search(docs, frame.where("false")).count() == 0
    assert lexical.ranked_search(documents(spark, ["NULL", "", "..."]), frame).count() == 0


def test_terms_in_pieces(monkeypatch):
    from siltstone.llm import lexical

    monkeypatch.setattr(lexical, "PIECE", 7)
    for text in ("", "a", "A-Z aZ09 é_日本@x`y{z}", "one two threefourfivesix seven" * 5, " " * 30, "x" * 50):
        assert [t.decode() for piece in lexical.terms_of(text.encode()) for t in piece] == TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


@pytest.mark.parametrize("seed", range(5))
def test_trees_lose_nothing(seed):
    from siltstone.llm.lexical import Batch, Best, item_tree, search_batch

    rng = np.random.default_rng(seed)
    width, n_items, n_docs, k = 60, [1, 7, 30, 100, 200][seed], [1, 3, 50, 260, 700][seed], 5
    items = [np.unique(rng.integers(0, width, rng.integers(0, 12))) for _ in range(n_items)]
    weights = rng.integers(0, 9, width)
    terms = [np.unique(np.minimum(rng.geometric(0.08, rng.integers(1, 25)) - 1, width - 1)) for _ in range(n_docs)]
    values = [rng.integers(0, 5, len(t)) for t in terms]
    best, seen = Best(np.zeros(n_items), k), Counter()
    for part in np.array_split(np.arange(n_docs), max(1, n_docs // 100)):
        search_batch(Batch(part, [terms[i] for i in part], [values[i] for i in part], width), item_tree(items, weights), best, seen)
    for i, own in enumerate(items):
        scores = [(-int(sum(weights[t] * v for t, v in zip(terms[d], values[d], strict=True) if t in own)), d) for d in range(n_docs)]
        expected = [(d, -s) for s, d in sorted(scores) if s < 0][:k]
        assert list(zip(best.ids[i].tolist(), best.scores[i].astype(int).tolist(), strict=True)) == expected
    assert seen["scored"] <= n_items * n_docs
