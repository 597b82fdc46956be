import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cohortline.llm import ranked
from cohortline.llm.queries import op12_ranked_search
from cohortline.llm.registry import ORACLES
from tests.compare import compare, connect

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    bags = [(key, Counter(split(text))) for key, text in docs]
    n = [sum(b.values()) for _, b in bags]
    n_docs, total = sum(x > 0 for x in n), sum(n)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for (key, bag), size in zip(bags, n, strict=True):
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (10**9 * bag[t] // (1000 * bag[t] + 20 * (50 + 50 * size * n_docs // total))) for t in set(split(text)) if bag[t])
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scored)[:k], 1)]
    return out


def rows(seed=5):
    r = random.Random(seed)
    word = lambda: r.choice(["w%d" % min(60, int(r.expovariate(0.1))), "É", "ab'c", "X9"])
    text = lambda n: " ".join(word() for _ in range(n))
    docs = [(i if i % 19 else None, text(r.randrange(0, 40))) for i in range(250)]
    docs += [(500 + i, docs[3][1]) for i in range(70)] + [(7, "w1 w2"), (7, "w1 w2"), (800, None), (801, ""), (802, "- ."), (803, "w1 " * 9000)]
    r.shuffle(docs)
    items = [(i, text(r.randrange(1, 12))) for i in range(15)] + [(3, "w1 w2"), (20, None), (21, ""), (22, "nowhere"), (None, "W1, w5"), (23, docs[0][1])]
    return docs, items


def order(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize("k,block,item_terms", [(50, 1 << 20, 200_000), (3, 300, 30), (1, 1, 200_000), (400, 700, 200_000)])
def test_equals_brute_force(spark, k, block, item_terms):
    docs, items = rows()
    d = spark.createDataFrame([(*x, 1, "q") for x in docs], "doc_id long, text string, score int, item string").repartition(5)
    b = spark.createDataFrame([(*x, "z", 2) for x in items], "item_id long, text string, rank string, n int")
    got = ranked.search(d, b, k, block_postings=block, item_terms=item_terms).collect()
    assert sorted(map(tuple, got), key=order) == sorted(brute(docs, items, k), key=order)


def test_text_keys_and_no_rows(spark):
    docs = [("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "x"), ("d", "z"), ("e", "z")]
    d = spark.createDataFrame(docs, "name string, body string")
    b = spark.createDataFrame([("q", "Y x")], "item string, ask string")
    names = {"key": "name", "text": "body", "item_key": "item", "item_text": "ask"}
    got = sorted((r["rank"], r["name"]) for r in ranked.search(d, b, 3, **names).collect())
    assert got == [(1, "a"), (2, "b"), (3, None)]
    assert ranked.search(d.limit(0), b, **names).count() == 0
    assert ranked.search(d, b.limit(0), **names).count() == 0


def test_range_maxima():
    r = np.random.default_rng(2)
    for n in (1, 2, 7, 64, 100):
        v = r.integers(0, 9, n)
        m = ranked.RangeMaxima(v)
        low, high = np.array([(a, b) for a in range(n) for b in range(a + 1, n + 1)]).T
        assert m.places(low, high).tolist() == [a + int(v[a:b].argmax()) for a, b in zip(low, high, strict=True)]


def test_few_documents_are_scored():
    """Bounds leave most of the documents alone when few hold an item's rare terms."""
    r = np.random.default_rng(4)
    n, common = 4000, 30
    doc, term = np.nonzero(r.random((n, common)) < 0.3)
    rare = r.choice(n, 200, replace=False)
    doc, term = np.concatenate([doc, rare]), np.concatenate([term, np.full(200, common)])
    df = np.bincount(term, minlength=common + 1)
    block = ranked.Block(doc, term, np.ones(len(doc), dtype=np.int64), r.integers(60, 150, n), ranked.weights(n, df), np.arange(n))
    seen = []
    bounds = block._bounds
    block._bounds = lambda low, high: seen.append(len(low)) or bounds(low, high)
    assert len(block.best(np.array([0, 1, common]), 10)) == 10
    assert sum(seen) < n


def test_query(spark, data):
    assert compare(spark, data, op12_ranked_search, ORACLES["op12_ranked_search"], connect(data)) is None
