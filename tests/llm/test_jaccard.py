import numpy as np
from pyspark.sql import functions as F

from cohortline.llm import jaccard


def brute(rows, threshold=0.8, size=5):
    sets = []
    for _, text in rows:
        words = (text or "").encode().split()
        k = min(size, len(words))
        sets.append({tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if words else set())
    n = len(rows)
    links = {i: set() for i in range(n)}
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i].add(j)
                links[j].add(i)
    root = list(range(n))
    for _ in range(n):
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(n)]
    return sorted(((rows[i][0], min(rows[j][0] for j in range(n) if root[j] == root[i]), len(links[i])) for i in range(n)), key=str)


def planted(seed=3):
    r = np.random.default_rng(seed)
    word = lambda: "w" + str(r.integers(0, 500))
    rows = []
    for group in range(12):
        base = [word() for _ in range(int(r.integers(3, 200)))]
        for copy in range(int(r.integers(1, 9))):
            w = list(base)
            for _ in range(copy // 2):
                w[int(r.integers(0, len(w)))] = word()
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n"), (len(rows) + 3, "a b"), (len(rows) + 4, "a b")]
    return rows


def test_equals_brute_force(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit(1)).withColumn("key", F.lit("x"))
    for block in (256, 2):  # with 2, groups are compared in many pairs of blocks
        got = [(r.doc_id, r.class_id, r.n_links) for r in jaccard.similar(docs, block=block).collect()]
        assert sorted(got, key=str) == brute(rows)


def test_no_rows(spark):
    assert jaccard.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_estimates():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 900, dtype=np.uint64)
    b = np.concatenate([a[:800], r.integers(0, 1 << 63, 100, dtype=np.uint64)])
    assert abs((jaccard.signature(a) == jaccard.signature(b)).mean() - 0.8) < 0.12
    fewest = jaccard.least_matches(0.8, 1e-6, 16)
    assert 0 < fewest[16] < 13 and fewest[192] < 0.8 * 192
