"""The pipeline against a plain version of its stages, on a table with planted cases."""

import random

import corpus_pipeline
from tests.llm.test_small import LONG, brute_components, brute_quality, documents, prose


def test_pipeline(spark, tmp_path):
    rnd = random.Random(4)
    texts, toxic = [], {}
    for i in range(240):
        words = prose(i, 80).split()
        if i % 6 == 0:
            for w in ("idiot", "scum", "loser", "trash"):
                words.insert(rnd.randrange(80), w)
        texts.append(" ".join(words))
        toxic[i] = int(i % 6 == 0)
    texts += [texts[1], texts[2] + " tail", "short", "", "NULL", LONG, "a b c d e f g h i\n" * 40]
    docs = documents(spark, texts)
    docs.unionByName(docs.where("doc_id = 7")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, t, 1) for i, t in toxic.items()], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))

    seen, stage = {}, docs.unionByName(docs.where("doc_id = 7"))
    for name, step in corpus_pipeline.STAGES[:-1]:
        stage = corpus_pipeline.materialize(step(spark, stage, str(tmp_path)), "stage")
        assert stage.columns == docs.columns
        seen[name] = sorted(r["doc_id"] for r in stage.select("doc_id").collect())
    clean = [i for i, t in enumerate(texts) if not brute_quality("" if t == "NULL" else t)[5]]
    assert set(seen["quality rules"]) == set(clean)
    assert set(seen["toxicity"]) == {i for i in clean if not toxic.get(i)}
    left = sorted(set(seen["toxicity"]))
    roots, _ = brute_components(left, [texts[i] for i in left], 5)
    assert seen["near-duplicates"] == sorted(i for i in left if roots[i] == i)
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(set(packed["doc_id"])) == seen["near-duplicates"]
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 2048


def test_pipeline_rows(spark, tmp_path):
    """Rows are judged by themselves: neither null nor repeated ids tie good rows to bad ones. An empty table stays empty."""
    bad = "a b c d e f g h i\n" * 40
    rows = [(i, prose(i, 80), "en", "s") for i in range(90)]
    rows += [(None, prose(200, 80), "en", "s"), (None, bad, "en", "s"), (5, bad, "en", "s"), (6, prose(201, 80), "en", "s"), (6, prose(201, 80), "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    left = corpus_pipeline.materialize(corpus_pipeline.quality(spark, docs, str(tmp_path)), "stage")
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, left.collect()), key=key) == sorted((r for r in rows if r[1] != bad), key=key)
    kept = corpus_pipeline.neardup(spark, left, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in kept]
    assert sorted(i for i in ids if i is not None) == list(range(90)) and ids.count(None) == 1
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
