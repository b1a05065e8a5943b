"""Operators on hand-made tables: against brute force, and with nulls, empty and long texts, ties, repeated rows, empty
tables and clashing columns."""

import binascii
import itertools
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))


def documents(spark, texts, first=0):
    """A documents table with columns whose names operators might use themselves."""
    rows = [(i + first if t != "NOID" else None, None if t in ("NULL", "NOID") else t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 2}", 0, i, i, "x", 1.5, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, label string, score double, length int")


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(["th", "on", "er", "a", "re", "ing"]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


ODD = ["NULL", "", "   \n\t ", "one", "One", "two words", "NOID", LONG, "\x00\x1c odd  é ß 日本 \U0001f600", "same text here again", "same text here again"]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# -- packing


def test_packing(spark):
    from tokenizers import Tokenizer

    from siltstone.llm.common import tokenizer_file
    from siltstone.llm.packing import VOCABULARY, pack

    texts = ODD + [prose(i, 20 + 37 * i) for i in range(40)]
    out = pack(documents(spark, texts), with_ids=True).toPandas()
    whole = Tokenizer.from_file(tokenizer_file(VOCABULARY))
    expected = sorted(np.array(whole.encode("" if x in ("NULL", "NOID") else x, add_special_tokens=False).ids + [0], "<u4").tobytes() for x in texts)
    rows = out.sort_values(["doc_id", "piece"])
    got = sorted(b"".join(g["ids"]) for _, g in rows.groupby(rows["doc_id"].fillna(-1)))
    assert got == expected
    assert (out["length"] == out["ids"].str.len() // 4).all() and (out["ids_crc32"] == out["ids"].map(zlib.crc32)).all()
    assert (out["start"] == out["piece"] * 2048).all()
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 2048
    total = out["length"].sum()
    assert out["sequence_id"].nunique() <= -(-total // 2048) + 1
    assert pack(documents(spark, [])).count() == 0


def first_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        for i, b in enumerate(bins):
            if b + n <= capacity:
                bins[i] += n
                break
        else:
            bins.append(n)
    return len(bins)


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    from siltstone.llm.packing import GAP, make_plan, places, solve

    rnd = random.Random(seed)
    capacity = rnd.choice([10, 64, 200])
    lengths = [rnd.randint(1, capacity) if seed % 3 else rnd.randint(capacity // 5, capacity // 2) for _ in range(rnd.choice([1, 2, 30, 400]))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    cover = solve(histogram, capacity)
    assert cover.value <= (1 + GAP) * cover.bound + 1e-9 and sum(cover.uses.values()) == pytest.approx(cover.value)
    for n, k in histogram.items():  # every length is covered whole
        assert sum(x * p.count(n) for p, x in cover.uses.items()) >= k * (1 - 1e-9)
    assert sum(histogram[n] * y for n, y in cover.prices.items()) == pytest.approx(cover.bound)
    worth = [0.0] * (capacity + 1)  # no pattern is worth more than 1, so the bound is one
    for c in range(1, capacity + 1):
        worth[c] = max([worth[c - 1]] + [worth[c - n] + y for n, y in cover.prices.items() if n <= c])
    assert worth[-1] <= 1 + 1e-9
    plan = make_plan(histogram, capacity)
    used: dict[int, int] = {}
    for pattern, count in zip(plan.patterns, plan.counts, strict=True):
        assert sum(pattern) <= capacity and count > 0
        for n in pattern:
            used[n] = used.get(n, 0) + count
    assert used == histogram
    assert cover.bound - 1e-9 <= sum(plan.counts) <= first_fit(lengths, capacity) + max(1, len(lengths) // 50)
    slots = set()
    for n, start, ranks, copies, sequence, offset in places(plan):
        for r in range(start, start + ranks):
            at = (sequence + (r - start) // copies, offset + (r - start) % copies * n, n)
            assert at not in slots
            slots.add(at)
    assert len(slots) == len(lengths)


def test_plan_is_of_the_program():
    """On many lengths, nine in ten sequences or more are patterns of the program, and the count is the bound's."""
    from siltstone.llm.packing import Plan, make_plan, round_cover, solve

    rng = np.random.default_rng(6)
    lengths = np.minimum(np.exp(rng.normal(5.5, 1.0, 3_000)).astype(int) + 1, 1023)
    histogram = {int(n): int(k) for n, k in zip(*np.unique(lengths, return_counts=True), strict=True)}
    cover, left, plan = solve(histogram, 1024), dict(histogram), Plan()
    round_cover(cover, left, 1024, plan)
    whole = sum(make_plan(histogram, 1024).counts)
    assert sum(plan.counts) >= 0.9 * whole
    assert whole <= cover.bound * 1.005 + 2


def test_pricing():
    from siltstone.llm.packing import best_values, trace

    rnd = random.Random(5)
    for _ in range(20):
        lengths = np.array(sorted(rnd.sample(range(1, 30), 5)))
        weights = np.array([rnd.random() for _ in lengths])
        best = [0.0] * 41
        for c in range(1, 41):
            best[c] = max([best[c - 1]] + [best[c - n] + w for n, w in zip(lengths, weights, strict=True) if n <= c])
        value = best_values(weights, lengths, 40)
        got = trace(value, weights, lengths)
        assert np.allclose(value, best) and lengths[got].sum() <= 40 and abs(weights[got].sum() - best[40]) < 1e-9
        most = np.array([rnd.randrange(3) for _ in lengths])
        assert (np.bincount(trace(value, weights, lengths, most), minlength=5) <= most).all()


# -- near-duplicates


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_components(ids, texts, width=4, percent=80):
    sets = [shingles(t, width) for t in texts]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return {i: find(i) for i in ids}, {i: len(s) for i, s in zip(ids, sets, strict=True)}


def near_texts(seed):
    rnd = random.Random(seed)
    texts = []
    for g in range(25):
        words = prose(seed * 100 + g, rnd.choice([3, 8, 40, 150])).split()
        texts.append(" ".join(words))
        for _ in range(rnd.choice([0, 1, 4, 9])):
            if rnd.random() < 0.7:
                words = list(words)
                words[rnd.randrange(len(words))] = f"new{rnd.random()}"
            texts.append(rnd.choice([" ", "  \n"]).join(words).upper() if rnd.random() < 0.3 else " ".join(words))
    return texts


@pytest.mark.parametrize(("seed", "width"), [(1, 4), (2, 5)])
def test_near_duplicates(spark, seed, width):
    from siltstone.llm.neardup import near_duplicates

    texts = [t for t in ODD if t != "NOID"] + near_texts(seed)
    out = by_id(near_duplicates(documents(spark, texts, 100), width=width))
    ids = list(range(100, 100 + len(texts)))
    roots, sizes = brute_components(ids, ["" if t == "NULL" else t for t in texts], width)
    assert {i: out[i]["component_id"] for i in ids} == roots
    assert {i: out[i]["n_shingles"] for i in ids} == sizes
    assert all(out[i]["kept"] == (roots[i] == i) for i in ids)


def test_near_duplicates_odd(spark):
    from siltstone.llm.neardup import near_duplicates

    assert near_duplicates(documents(spark, [])).count() == 0
    assert near_duplicates(documents(spark, ["NULL", ""])).where("kept").count() == 2
    out = near_duplicates(documents(spark, ["NOID", "NOID"])).collect()
    assert all(r["component_id"] is None and r["kept"] for r in out)
    named = documents(spark, ["x y z a b c", "x y z a b c", " ".join(LONG.split()[:300]), " ".join(LONG.split()[:301]), "else"]).selectExpr("concat('id', doc_id) AS doc_id", "text")
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(named).collect()} == {"id0": "id0", "id1": "id0", "id2": "id2", "id3": "id2", "id4": "id4"}
    df = documents(spark, ["a b c d e", "a b c d e"])
    assert {(r["doc_id"], r["component_id"]) for r in near_duplicates(df.unionByName(df)).collect()} == {(0, 0), (1, 0)}


def test_components(spark):
    from siltstone.llm.components import connected_components

    edges = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 103), (200, 200)] + [(300, 300 + i) for i in range(1, 20)]
    out = {r["a"]: r["b"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(1, 61)} | {103: 100, 105: 100} | {300 + i: 300 for i in range(1, 20)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- nearest neighbours


def brute_nearest(ids, x, q, k=10):
    """Distances of the k nearest other ids to row q, ties to the smaller id."""
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    best: dict[int, float] = {}
    for i, v in zip(ids, d, strict=True):
        if i != ids[q]:
            best[int(i)] = min(best.get(int(i), np.inf), float(v))
    return sorted(best.items(), key=lambda p: (p[1], p[0]))[:k]


def test_ann(spark):
    from pyspark.sql import functions as F

    from siltstone.llm.ann import nearest_neighbours

    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 48)).astype(np.float32)
    x[100:160] = x[5]  # many equal vectors
    rows = [(int(i), [float(v) for v in x[i]], 0) for i in range(900)]
    rows += [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 48, 0), (1003, [float("nan")] * 48, 0), (1004, [None] * 48, 0), (1005, [float("inf")] + [1.0] * 47, 0), (None, rows[0][1], 0)]
    rows += [(1050, [1.0, 2.0], 0), (1051, [1.0, 3.0], 0)]  # of another dimension
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    asks = F.col("vec_id") % 50 == 0
    out = nearest_neighbours(df, asks).toPandas()
    hit = 0
    for q in range(0, 900, 50):
        expected = brute_nearest(range(900), x.astype(float), q)
        mine = out[out["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        assert mine["score"].tolist() == [d[i] for i in mine["vec_id"]]
        hit += len({i for i, _ in expected} & set(mine["vec_id"]))
        if q == 100:
            assert mine["vec_id"].tolist() == [i for i, _ in expected]
    assert hit >= 0.9 * 180
    assert out[out["query_id"] == 1050][["rank", "vec_id", "score"]].values.tolist() == [[1, 1051, 1.0]]
    assert len(out) == 181
    assert nearest_neighbours(df, F.lit(False)).count() == 0
    assert nearest_neighbours(df.where("vec_id < 4"), F.lit(True)).groupBy("query_id").count().collect()[0]["count"] == 3
    assert nearest_neighbours(df.where("vec_id = 1000"), asks).count() == 0


def test_ann_blocks_and_repeated_ids(spark, monkeypatch):
    """Thousands of queries over several tiles and blocks, clustered vectors of which a third are one hot group, and repeated ids."""
    from pyspark.sql import functions as F

    from siltstone.llm import ann

    monkeypatch.setattr(ann, "TILE", 700)
    rng = np.random.default_rng(4)
    n, dim = 6_000, 24
    x = rng.standard_normal((40, dim))[rng.integers(0, 40, n)] + 0.3 * rng.standard_normal((n, dim))
    x[:2_000] = x[0] + 0.01 * rng.standard_normal((2_000, dim))
    ids = np.arange(n)
    ids[4_000:4_050] = np.arange(3_000, 3_050)  # with other vectors
    ids[4_050:4_100], x[4_050:4_100] = ids[3_900:3_950], x[3_900:3_950]  # the same rows again
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    rows = df.select("vec_id", F.col("embedding").alias("vector"))
    index = ann.build_index(rows, dim)
    assert index.rows.count() == n and 1 < len(index.centres) and index.probes < len(index.centres) / 2
    out = ann.search(index, rows.where("vec_id % 4 <> 1"), 10).toPandas()
    asked = sorted({int(i) for i in ids if i % 4 != 1})
    assert len(asked) > 4_096 and sorted(set(out["query_id"])) == asked and len(out) == 10 * len(asked)
    hit, tried = 0, asked[::40] + [3_000, 3_002, 3_900]
    for who in tried:
        q = min((tuple(x[k]), k) for k in np.flatnonzero(ids == who))[1]
        mine = out[out["query_id"] == who].sort_values("rank")
        expected = brute_nearest(ids, x, q)
        assert mine["vec_id"].is_unique and who not in set(mine["vec_id"])
        hit += len({i for i, _ in expected} & set(mine["vec_id"]))
    assert hit >= 0.9 * 10 * len(tried)


def test_ann_bounds():
    """Bounds from packed bits lie below the true squared distances, but for the share that their width leaves."""
    from siltstone.llm.ann import Queries, encode, rotation

    rng = np.random.default_rng(5)
    x, q, centre = rng.standard_normal((500, 96)), rng.standard_normal((40, 96)), rng.standard_normal(96) * 0.1
    codes, norm, aligned = encode(x, centre, rotation(96))
    bounds = Queries(q, centre, rotation(96)).lower_bounds(codes, norm, aligned)
    true = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    assert 0.97 < (bounds <= true).mean() <= 1 and np.corrcoef(bounds.ravel(), true.ravel())[0, 1] > 0.7


# -- quality


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality(spark):
    from siltstone.llm.quality import quality_rules

    texts = ODD + [prose(i, 60 + i) + ".\n" + prose(i + 500, 40) for i in range(200)]
    texts += ["### " * 40 + " ".join(f"w{i}%%%" for i in range(100)), "a b c d e f g h i\n" * 30, prose(3, 100) + " " + " ".join(["x y z a b c d e q"] * 2), "é ñ # | <b>\n\n \n" * 4, prose(9, 25) + "\x0b\x0c\r" + prose(9, 25)]
    out = {(r["doc_id"], r["n_words"]): r for r in quality_rules(documents(spark, texts)).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        expected = brute_quality("" if t in ("NULL", "NOID") else t)
        r = out[None if t == "NOID" else i, expected[0]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == expected, t[:40]
        assert not (r["kept"] and r["base_failed"])
        if 11 <= i < 211:
            assert r["kept"], (i, r["d2"])
    assert not out[211, 140]["kept"]
    assert quality_rules(documents(spark, [])).count() == 0


def brute_mcd(x, features):
    """Plain version of the estimate: exact quantiles, all steps on the rows themselves."""
    from siltstone.llm import quality as Q

    prior, least = (np.array(v) for v in zip(*features.values(), strict=True))

    def scatter(cov, n, scale=1.0):
        return (n * scale * cov + Q.PRIOR_ROWS * np.diag(prior**2)) / (n + Q.PRIOR_ROWS) + np.diag(least**2)

    def distances(m, s):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)

    def nearest(m, s, share):
        d = distances(m, s)
        own = x[d <= np.sort(d)[int(np.ceil(share * len(x))) - 1]]
        return own.mean(axis=0), scatter(np.cov(own.T, bias=True), len(own))

    middle = np.median(x, axis=0)
    plain = (middle, scatter(np.diag((1.4826 * np.median(np.abs(x - middle), axis=0)) ** 2), len(x)))
    best = None
    for start in (plain, nearest(*plain, 0.5)):
        now = nearest(*start, Q.COVERAGE)
        while True:
            new = nearest(*now, Q.COVERAGE)
            if np.linalg.slogdet(new[1])[1] >= np.linalg.slogdet(now[1])[1] - Q.SETTLED:
                break
            now = new
        if best is None or np.linalg.slogdet(now[1])[1] < np.linalg.slogdet(best[1])[1]:
            best = now
    core = x[distances(*best) <= Q.CHI_975 * Q.FACTOR_CORE]
    m, s = core.mean(axis=0), scatter(np.cov(core.T, bias=True), len(core), Q.FACTOR_975)
    return m, s, distances(m, s)


def test_mcd_against_brute_force(spark):
    """Two cells, with far rows and without: centres, scatters and verdicts are the plain version's, and a normal law's share is beyond the cutoff."""
    from siltstone.llm.quality import CUTOFF, FEATURES, _distance, fit_cells

    rng = np.random.default_rng(1)
    names, tables = list(FEATURES), {}
    scale = np.array([0.1, 1.5, 1.2, 1.0, 0.05])
    mix = np.eye(5) + 0.4 * rng.standard_normal((5, 5))
    for cell, bad in (("a", 300), ("b", 0)):
        good = rng.standard_normal((1_500, 5)) @ mix * scale + [1.6, 0.2, 0.1, 0.1, 0.13]
        tables[cell] = np.vstack([good, rng.standard_normal((bad, 5)) * scale + [3.6, 14, 11, 9, 1.1]])
    rows = pd.concat([pd.DataFrame(x, columns=names).assign(cell=c, i=range(len(x))) for c, x in tables.items()])
    df = spark.createDataFrame(rows)
    cells = fit_cells(df.select("cell", *names), FEATURES)
    d2 = _distance(df, cells, names).select("cell", "i", "d2").toPandas().sort_values(["cell", "i"])
    estimates = {r["cell"]: r for r in cells.collect()}
    for cell, x in tables.items():
        m, s, expected = brute_mcd(x, FEATURES)
        r = estimates[cell]
        factor = np.array([[r[f"l{i}_{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
        assert np.allclose([r[f"m{i}"] for i in range(5)], m, atol=0.05 * scale.max()) and np.allclose(factor @ factor.T, s, atol=0.1 * np.sqrt(np.outer(np.diag(s), np.diag(s))).max())
        got = d2[d2["cell"] == cell]["d2"].to_numpy()
        y = np.linalg.solve(factor, (x - [r[f"m{i}"] for i in range(5)]).T)
        assert np.allclose((y**2).sum(axis=0), got) and np.corrcoef(got, expected)[0, 1] > 0.99
        assert ((got > CUTOFF) == (expected > CUTOFF)).mean() > 0.998
        assert (got[1_500:] > CUTOFF).all() and (got[:1_500] <= CUTOFF).mean() > 0.995
        assert 3.0 < np.median(got[:1_500]) < 5.0  # of a chi-square with 5 degrees of freedom: 4.35


# -- licenses


def test_licenses(spark):
    from siltstone.llm.licenses import evaluate, license_scan, shunting_yard

    texts = ["NULL", "", "All rights RESERVED. all rights, reserved", "licensed under CC-BY 4.0", "cc\nby", "ccby", "éall rights reserved", "This GNU General Public License, version 3", "x SPDX-License-Identifier: (MIT OR GPL-2.0) AND ISC\ny", "SPDX-License-Identifier:", "all rights all rights reserved", LONG]
    out = by_id(license_scan(documents(spark, texts)))
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), "" if t == "NULL" else t))
        at = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = out[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(at)), t[:40]
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x[1] for x in at}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert out[8]["labels"] == "gpl-2.0,isc,mit" and out[8]["accepted"] is True and out[8]["expressions"] == ["mit gpl-2.0 or isc and"]
    assert license_scan(documents(spark, [])).count() == 0
    assert shunting_yard("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert shunting_yard("(a or b) and c") == ["a", "b", "or", "c", "and"]
    assert [shunting_yard(x) for x in ("", "and a", "(a", "a or", ")")] == [[], [], [], [], []]
    assert shunting_yard("mit license text") == ["mit"]
    assert evaluate(shunting_yard("mit and gpl-3.0")) is False and evaluate(shunting_yard("gpl-3.0 or mit with x")) is True


# -- sharding


def test_sharding(spark):
    from pyspark.sql import functions as F

    from siltstone.llm.sharding import rendezvous, shard_records

    df = documents(spark, ODD + [prose(i, 9) for i in range(500)])
    text = F.coalesce("text", F.lit(""))
    out = shard_records(df, "doc_id", [1.0] * 6, F.octet_length(text) + 8, ["doc_id", "text"]).toPandas()
    assert len(out) == len(ODD) + 500
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    again = shard_records(df.unionByName(df), "doc_id", [1.0] * 6, F.octet_length(text) + 8, ["doc_id", "text"]).toPandas()
    assert again.groupby("shard")["slot"].apply(lambda s: sorted(s) == list(range(len(s)))).all()
    assert dict(zip(out["doc_id"].fillna(-1), out["shard"], strict=True)) == dict(zip(again["doc_id"].fillna(-1), again["shard"], strict=True))
    keys = spark.range(4000)
    moved = keys.select(rendezvous(F.col("id"), [1.0] * 6).alias("a"), rendezvous(F.col("id"), [1.0] * 7).alias("b")).toPandas()
    changed = moved[moved["a"] != moved["b"]]
    assert (changed["b"] == 6).all() and 0.10 < len(changed) / 4000 < 0.19
    heavy = keys.select(rendezvous(F.col("id"), [1.0, 3.0]).alias("s")).toPandas()["s"].mean()
    assert 0.70 < heavy < 0.80
    assert shard_records(df.limit(0), "doc_id", [1.0], F.lit(8), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        rendezvous(F.col("id"), [])


def test_sharding_query(spark, tmp_path):
    from siltstone.llm.sharding import op7_rendezvous_sharding

    texts = ["NULL", "", "é", LONG]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    for r in op7_rendezvous_sharding(spark, str(tmp_path)).collect():
        data = ("" if texts[r["doc_id"]] == "NULL" else texts[r["doc_id"]]).encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 8, binascii.crc32(data), "key")
        assert (r["shard"], r["grown_shard"]) == tuple(brute_shard(r["doc_id"], [1.0] * n) for n in (24, 25))


def brute_shard(key, weights):
    """The winner, hashed outside Spark: the key's hash is the seed of the shard number's."""
    seed = xxhash.xxh64_intdigest("\x00null" if key is None else str(key), seed=42)
    scores = []
    for shard, weight in enumerate(weights):
        u = (xxhash.xxh64_intdigest(struct.pack("<i", shard), seed=seed) % 2**53 + 0.5) / 2**53
        scores.append((-math.log(u) / weight, shard))
    return min(scores)[1]


def test_sharding_against_brute_force(spark):
    from pyspark.sql import functions as F

    from siltstone.llm.sharding import rendezvous

    weights = [1.0, 2.5, 0.5, 1.0, 4.0]
    keys = [None, "", "k", LONG, *[f"key {i} é" for i in range(500)]]
    out = spark.createDataFrame([(k,) for k in keys], "k string").select("k", rendezvous(F.col("k"), weights).alias("s"))
    assert {r["k"]: r["s"] for r in out.collect()} == {k: brute_shard(k, weights) for k in keys}


# -- byte-level BPE


def test_bpe(spark):
    import hashlib

    import public_tokenizers
    import tiktoken

    from siltstone.llm.bpe import coder, decode_ids, digest_texts, encode_texts, read_ranks, tokenizer_file

    path = tokenizer_file("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    one = coder(path)
    rnd = random.Random(7)
    parts = ["a", "b", "th", "ing", "é", " ", "\n", ".", "###", "12", "'s", "日本", "\U0001f600", "\x1c", "A", "aaaa", "<|endoftext|>"]
    texts = ["".join(rnd.choice(parts[: rnd.randint(1, 17)]) for _ in range(rnd.choice([1, 30, 300]))) for _ in range(400)] + ["a" * 3000, "ab" * 2000, "-" * 2500, LONG]
    for t in texts:
        ids = one.encode(t)
        assert ids == library.encode_ordinary(t) and one.decode(ids) == t.encode()
    before = one.joins
    for word in ("unbelievably", " antidisestablishment", "xqzvw"):  # ordinary words are halved and joined too, from single bytes up
        one.halves.clear()
        assert one.encode(word) == library.encode_ordinary(word)
    assert one.joins - before >= 11 + 20 + 4 - 8
    for n in (5_001, 20_001):
        start = time.process_time()
        assert one.encode("a" * n) == library.encode_ordinary("a" * n)
        assert time.process_time() - start < 3
    df = documents(spark, ODD + texts[:30])
    out = {r["doc_id"]: r for r in digest_texts(df).collect()}
    for i, t in enumerate(ODD + texts[:30]):
        t = "" if t in ("NULL", "NOID") else t
        r = out[None if (ODD + texts[:30])[i] == "NOID" else i]
        ids = library.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    back = {r["doc_id"]: bytes(r["decoded"]) for r in decode_ids(encode_texts(df)).collect()}
    assert back[7] == LONG.encode() and back[0] == b""
    assert digest_texts(documents(spark, [])).count() == 0


# -- toxicity


def test_toxicity(spark):
    from siltstone.llm.toxicity import toxicity_scores

    rnd = random.Random(2)
    texts, toxic = [], []
    for i in range(800):
        bad = i % 4 == 0
        words = prose(i, 60).split()
        if i % 8 == 0:  # words of no list
            for w in ("grunzak", "grunzelt", "grunz"):
                words.insert(rnd.randrange(len(words)), w)
        elif bad:
            for w in rnd.sample(["idiot", "scum", "pathetic", "loser", "trash"], 3):
                words.insert(rnd.randrange(len(words)), w)
        texts.append(" ".join(words))
        toxic.append(int(bad))
    df = documents(spark, texts + ["NULL", "", LONG, "NOID"])
    labels = spark.createDataFrame([(i, t, 1) for i, t in enumerate(toxic)] + [(0, 1, 1), (800, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    out = toxicity_scores(df, labels).toPandas().set_index("doc_id")
    assert len(out) == 804 and out["score"].between(0, 1).all()
    for i in range(800):
        assert bool(out.loc[i, "held_out"]) == (binascii.crc32(str(i).encode()) % 3 == 1)
        assert out.loc[i, "predicted"] == int(out.loc[i, "score"] >= 0.7)
    out.index = [-1 if i != i else int(i) for i in out.index]
    held = out.loc[range(800)][out.loc[range(800), "held_out"]]
    assert (held["predicted"] == [toxic[i] for i in held.index]).mean() > 0.97
    twisted = labels.where("doc_id IS NOT NULL").selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    assert toxicity_scores(df, twisted).toPandas().sort_values(["doc_id", "score"])["score"].tolist() == toxicity_scores(df, labels).toPandas().sort_values(["doc_id", "score"])["score"].tolist()
    assert toxicity_scores(df, labels.limit(0)).where("score <> 0").count() == 0
    assert toxicity_scores(df.limit(0), labels).count() == 0


def test_toxicity_features():
    from siltstone.llm.toxicity import FEATURES, Lexicon, features, stems

    f = dict(zip(FEATURES, features("You are an IDIOT!! 1d10t m0ron, loweischaft", Lexicon({"lowei": 3.0})), strict=True))
    assert len(f) == len(FEATURES) and f["learnt_strongest"] == 3.0 and f["learnt"] > 0
    assert f["insults"] > 0 and f["near_second_person"] > 0 and f["capital_words"] > 0 and f["exclamations"] > 0 and f["obfuscated_insults"] > 0 and f["punctuation_runs"] > 0
    assert set(features(None, Lexicon({}))) == {0.0} == set(features("", Lexicon({})))
    assert stems("Ab abcd é") == {"abc", "abcd"}


def brute_features(text, odds):
    from siltstone.llm.toxicity import CONTEMPT, INSULTS, LEET, SECOND_PERSON

    written = ["".join(g) for letter, g in itertools.groupby(text, str.isalpha) if letter]
    words = [w.lower() for w in written]
    n, letters = max(len(words), 1), max(sum(map(len, written)), 1)
    weights = [max([odds[w[:k]] for k in range(3, 9) if len(w) >= k and w[:k] in odds], default=0) for w in words]
    hits = [i for i, w in enumerate(words) if w in INSULTS or w in CONTEMPT or weights[i]]
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    insults, contempt = sum(w in INSULTS for w in words), sum(w in CONTEMPT for w in words)
    runs = sum(len(list(g)) > 1 for c, g in itertools.groupby(text, lambda c: "!?" if c in "!?" else None if c.isalnum() or c.isspace() or c == "_" else c) if c)
    mixed = []
    for token in text.split():
        at = [i for i, c in enumerate(token) if c.isalpha()]
        if any(j > i + 1 and set(token[i + 1 : j]) <= set("0123456789@$!*._-") for i, j in itertools.pairwise(at)):
            mixed.append(token.lower().translate(LEET))
    return [
        insults / n, math.log(1 + insults + contempt), contempt / n,
        sum(weights) / n, math.log(1 + sum(x > 0 for x in weights)), math.log(1 + len({w for w, x in zip(words, weights, strict=True) if x})), max(weights, default=0),
        sum(any(abs(i - j) <= 4 for j in second) for i in hits) / n, len(second) / n,
        sum(len(w) > 1 and w == w.upper() != w.lower() for w in written) / n, sum(map(str.isupper, text)) / letters, text.count("!") / n, text.count("?") / n,
        runs / n, len(mixed) / n, sum(w in INSULTS or w in CONTEMPT for w in mixed) / n, math.log(1 + len(words)),
    ]


def test_toxicity_features_against_brute_force():
    from siltstone.llm.toxicity import Lexicon, features

    odds = {"gru": 2.6, "grunzel": 4.0, "the": 3.0}
    parts = ["you", "YOUR", "tu", "idiot", "Scum", "pathetic", "1d10t", "m0r0n,", "st*pid", "grunzelt", "grub", "there", "é", "日本", "a.b", "A", "word", "!!", "?!", "...", "--", "-", "_", "x_y", "12", "\n", "(ok)"]
    rnd = random.Random(12)
    for text in ["", " ", LONG, *[" ".join(rnd.choice(parts) for _ in range(rnd.randint(1, 80))) for _ in range(400)]]:
        assert features(text, Lexicon(odds)) == pytest.approx(brute_features(text, odds)), text


def test_crowded_regions(spark):
    """More similar documents than a document has neighbours, some of them at the threshold."""
    from siltstone.llm.neardup import near_duplicates

    rnd = random.Random(8)
    base = prose(77, 260).split()
    texts = []
    for k in range(70):
        words = list(base)
        for j in rnd.sample(range(len(words)), 4 if k % 3 else 13):
            words[j] = f"x{k}y{j}"
        texts.append(" ".join(words))
    out = by_id(near_duplicates(documents(spark, texts)))
    roots, _ = brute_components(list(range(70)), texts)
    assert {i: out[i]["component_id"] for i in range(70)} == roots


def test_large_regions(spark, monkeypatch):
    """Regions of many times the rows of a block; links at the threshold are found there too."""
    from siltstone.llm import neardup

    rnd = random.Random(5)
    base, texts = prose(78, 400).split(), []
    for k in range(200):  # a family at 0.75; each second text is at 0.81 to the one before
        words = texts[-1].split() if k % 2 else list(base)
        for j in rnd.sample(range(len(words)), 10 if k % 2 else 7):
            words[j] = f"x{k}y{j}"
        texts.append(" ".join(words))
    monkeypatch.setattr(neardup, "REGION_ROWS", 8)
    out = by_id(neardup.near_duplicates(documents(spark, texts)))
    roots, _ = brute_components(list(range(len(texts))), texts)
    assert len(set(roots.values())) > 50
    assert {i: out[i]["component_id"] for i in roots} == roots


def test_overlaps():
    from siltstone.llm.neardup import overlaps

    rnd = random.Random(3)
    sets = [np.array(sorted(rnd.sample(range(60 if k % 3 else 4000), rnd.randrange(1, 60))), np.uint64) for k in range(300)]
    left, right = np.arange(0, 300, 2), np.arange(5, 290)
    found = dict(overlaps(sets, left, right))
    assert sorted(found) == left.tolist()
    for i in left:
        assert found[i].tolist() == [len(np.intersect1d(sets[i], sets[j])) for j in right]


def test_region_blocks_are_bounded(spark, monkeypatch):
    """Neither many copies beside one other document nor long documents come into one task, and every pair that may be a link meets."""
    from siltstone.llm import neardup

    monkeypatch.setattr(neardup, "REGION_ROWS", 10)
    monkeypatch.setattr(neardup, "REGION_SHINGLES", 2_000)
    rows = [(1, i, 100 + i % 7, 0) for i in range(400)] + [(1, 400, 103, 400)]  # one component and a row of another
    rows += [(2, 1000 + i, 900 + i, 1000 + i // 2) for i in range(9)]  # few rows, many shingles
    rows += [(3, 2000 + i, 5, 2000) for i in range(20)]  # a single component
    df = spark.createDataFrame(rows, "region long, doc_id long, n long, component long")
    groups = {}
    for r in neardup.region_pairs(df, 80).collect():
        groups.setdefault((r["region"], r["x"], r["y"]), set()).add(r["doc_id"])
    n, component = {r[1]: r[2] for r in rows}, {r[1]: r[3] for r in rows}
    assert max(map(len, groups.values())) <= 60 and max(sum(n[i] for i in g) for g in groups.values()) <= 7_000
    assert all(len({component[i] for i in g}) > 1 for g in groups.values())
    met = {(a, b) for g in groups.values() for a in g for b in g}
    assert {(a, b) for _, a, na, ca in rows[:409] for _, b, nb, cb in rows[:409] if ca != cb and (a < 1000) == (b < 1000)} <= met


def test_few_documents_in_many_partitions(spark):
    """A border of the orders' partitions between two documents parts no pair."""
    from siltstone.llm.neardup import near_duplicates

    words = prose(79, 200).split()
    texts = [" ".join(words), " ".join([*words, "more"]), prose(80, 200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        out = {i: r["component_id"] for i, r in by_id(near_duplicates(documents(spark, texts))).items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out == {0: 0, 1: 0, 2: 2}


def test_quality_of_rare_languages(spark):
    """An outlier of a rare language is rejected: by small languages pooled, or by all rows if these are too few."""
    from siltstone.llm.quality import quality_rules

    bad = "### " * 40 + " ".join(f"w{i}%%%" for i in range(100))
    for rare, n in ((70, 100), (5, 100), (30, 0)):
        rows = [(i, prose(i, 60 + i) + ".\n" + prose(i + 500, 40), "en" if i >= rare else f"l{i % 9}", "s") for i in range(rare + n)]
        rows += [(900, bad, "xx", "s"), (901, bad, None, None)]
        out = by_id(quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
        assert len(out) == len(rows) and all(r["d2"] is not None for r in out.values())
        assert not out[900]["kept"] and not out[901]["kept"]
        assert sum(r["kept"] for r in out.values()) >= rare + n - 1
