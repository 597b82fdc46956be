import zlib

import numpy as np
from pyspark.sql import functions as F

from cohortline.llm import toxicity


def vectors(n, v, seed):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        t = np.sort(r.choice(v, int(r.integers(0, 12)), replace=False))
        w = r.random(len(t)) + 0.1
        out.append((t, w / np.sqrt((w * w).sum()) if len(t) else w))
    return out


def test_index_finds_the_nearest():
    rows, queries = vectors(700, 60, 1), vectors(150, 60, 2)
    rows[5] = rows[6] = rows[7]  # ties
    dense = np.zeros((700, 60))
    for i, (t, w) in enumerate(rows):
        dense[i, t] = w
    index = toxicity.Index(rows, 60)
    for i, (t, w) in enumerate(queries + rows[:20]):
        cosines = dense[:, t] @ w
        want = [e for e in np.lexsort((np.arange(700), -np.round(cosines, 9))) if cosines[e] > 1e-12 and e != i][:15]
        ids, found = index.nearest(t, w, 15, i)
        assert ids.tolist() == want and np.allclose(found, cosines[want])


def test_long_lists_and_early_ends_change_nothing():
    """Examples with frequent and rare terms: some searches end early, most lists of frequent terms are held as rows."""
    r = np.random.default_rng(8)
    n, words = 3000, 2500
    rows = []
    for i in range(n):
        t = np.unique(r.zipf(1.15, int(r.integers(1, 120))) % words)
        w = r.random(len(t)) * np.where(t < 20, 0.05, 1.0) * np.where(t % 97 == 1, 20.0, 1.0)
        rows.append((t, w / np.sqrt((w * w).sum())))
    dense = np.zeros((n, words))
    for i, (t, w) in enumerate(rows):
        dense[i, t] = w
    index = toxicity.Index(rows, words)
    assert 5 < len(index.dense) < 512
    for without_own, asked in ((True, rows[:200]), (False, rows[500:700])):
        for i, ((t, w), (ids, found)) in enumerate(zip(asked, index.many(asked, 15, without_own), strict=True)):
            cosines = dense[:, t] @ w
            want = [e for e in np.lexsort((np.arange(n), -np.round(cosines, 9))) if cosines[e] > 1e-12 and not (without_own and e == i)][:15]
            assert ids.tolist() == want and np.allclose(found, cosines[want])
    assert not index.asked.any()


def corpus(n=900):
    r = np.random.default_rng(6)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{x}" for x in r.zipf(1.3, int(r.integers(0, 80))) % 400]
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            words.insert(int(r.integers(0, len(words) + 1)), str(r.choice(["Scum", "IDIOT.", "moron"])))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    extra = [(None, None), (10_000, ""), (10_000, ""), (10_001, "no known terms"), (10_002, "idiot " * 9000)]
    d = spark.createDataFrame([(*x, 0.5) for x in docs + extra], "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (77_777, 1)], "doc_id long, toxic int")
    out = toxicity.scored(d, lab, lambda k: ~toxicity.held_out(k), min_rows=5).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(out) == len(docs) + len(extra) and all(0 <= r.score <= 1 for r in out)
    truth = dict(labels)
    tested = [r for r in out if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in tested} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([(r.score >= 0.3) == bool(truth[r.doc_id]) for r in tested]) > 0.97
    assert [r.score for r in out if r.doc_id == 10_002][0] > 0.5 and [r.score for r in out if r.doc_id == 10_001][0] < 0.3
    assert all(r.evidence[0].label == 1 for r in tested if truth[r.doc_id])


def test_no_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    every = lambda k: F.lit(True)
    assert toxicity.scored(none, labels, every).count() == 0
    docs = spark.createDataFrame([(1, "a"), (2, "b")], none.schema)
    assert [r.score for r in toxicity.scored(docs, labels, every).collect()] == [0.0, 0.0]
    assert [r.score for r in toxicity.scored(docs, spark.createDataFrame([(1, 1)], labels.schema), every).collect()] == [1.0, 1.0]


def test_texts_without_telling_terms_have_neighbours(spark):
    docs = [(i, f"plain{i % 50} word{i % 7} common") for i in range(300)] + [(1000, "plain7 common"), (1001, "unheard of")]
    labels = [(i, int(i % 10 == 3)) for i in range(300)]
    out = toxicity.scored(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"),
                          lambda k: F.lit(True))
    found = {r.doc_id: r.evidence for r in out.collect()}
    assert all(found[i] for i in range(300)) and not found[1001]
    assert {int(e.example) % 50 for e in found[1000]} == {7}


def test_rare_labels(spark):
    r = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(1200):
        words = [f"w{x}" for x in r.integers(0, 3000, 30)]
        toxic = i % 100 == 5
        if toxic:
            words += ["scum", "moron"][: 1 + i // 100 % 2]
        docs.append((i, " ".join(words)))
        if i < 1000:
            labels.append((i, int(toxic)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    for rows in (8000, 300):  # the smaller sample holds all ten toxic rows by its strata
        score = {x.doc_id: x for x in toxicity.scored(d, lab, lambda k: F.lit(True), sample_rows=rows).collect()}
        assert min(score[1005].score, score[1105].score) > max(x.score for x in score.values() if x.doc_id % 100 != 5)
        assert all(e.label == 1 for e in score[1005].evidence)


def test_sample_has_both_labels_and_weights(spark):
    labels = spark.createDataFrame([(i, int(i % 100 == 5)) for i in range(3000)], "doc_id long, toxic int")
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    got, counts = toxicity.sample(docs, labels, "toxic", "doc_id", "text", lambda k: F.lit(True), 200)
    assert counts == {0: 2970, 1: 30}
    assert {r.label: r["count"] for r in got.groupBy("label").count().collect()} == {0: 170, 1: 30}
