import hashlib
from collections import Counter

import numpy as np
import pytest

from cohortline.llm import phrases


def brute(rows, window):
    split = [(t or "").encode().split() for _, t in rows]
    times = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if times[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def planted(seed=4):
    r = np.random.default_rng(seed)
    w = lambda n, v=3000: [f"w{i}é" if i % 7 else f"W{i}" for i in r.integers(0, v, n)]
    passages = [w(int(n)) for n in r.integers(30, 90, 12)]
    rows = []
    for i in range(90):
        words = w(int(r.integers(0, 120)))
        for _ in range(int(r.integers(0, 3))):
            p = passages[int(r.integers(0, 12))]
            a, b = sorted(r.integers(0, len(p), 2)) if i % 2 else (0, len(p))
            at = int(r.integers(0, len(words) + 1))
            words[at:at] = p[a:b]
        rows.append((i % 80 if i % 9 else None, "\n".join(words) if i % 5 else "  ".join(words)))
    rows += rows[:3] + [(200, None), (201, ""), (202, "on he. " * 60), (203, "on he. " * 40 + "x"), (204, " ".join(["z"] * 36)), (205, "q r " * 10)]
    return rows


@pytest.mark.parametrize("window", [35, 8, 3])
def test_equals_brute_force(spark, window):
    rows = planted()
    docs = spark.createDataFrame([(*x, 1, "s") for x in rows], "doc_id long, text string, shard int, mark string")
    got = [tuple(r) for r in phrases.without_repeats(docs, window).collect()]
    want = brute(rows, window)
    assert sum(r[2] for r in want) > 1000
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_rows(spark):
    assert phrases.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
