import hashlib
import re

import numpy as np

from cohortline.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = split(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w and item is not None else 0):
            windows.setdefault(tuple(w[i:i + k]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for key, text in docs:
        w, hit, names = split(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (found := windows.get(tuple(w[i:i + k]))) is not None:
                    hit.update(range(i, i + k))
                    names |= found
        out.append((key, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def rows(seed=1):
    r = np.random.default_rng(seed)
    w = lambda n, v: " ".join(r.choice([f"w{i}" for i in range(v)], n))
    items = [(i, w(int(r.integers(10, 30)), 40)) for i in range(12)]
    items += [(12, "One"), (13, "two THREE"), (14, "é four; five"), (15, None), (16, ""), (None, "x y z"), (3, w(12, 40)), (17, items[0][1]),
              (18, " ".join(["same"] * 15))]
    docs = []
    for i in range(60):
        text = w(int(r.integers(0, 60)), 60)
        if i % 3 == 0:
            a = items[int(r.integers(0, 12))][1].split()
            cut = int(r.integers(0, 5))
            text += ", " + " ".join(a[cut:cut + int(r.integers(8, 20))]).upper() + "\n" + w(5, 60)
        docs.append((i % 50 if i % 11 else None, text))
    return docs + [(70, None), (71, ""), (72, "one"), (73, "ONE two three É é four five x"), (74, "same " * 40), (75, "x y z")], items


def test_equals_brute_force(spark):
    docs, items = rows()
    d = spark.createDataFrame([(*x, 1, "k") for x in docs], "doc_id long, text string, row long, key string")
    b = spark.createDataFrame([(*x, "p") for x in items], "item_id long, text string, phrase string")
    for block in (1_000_000, 60):
        got = decontamination.digest(decontamination.contamination(d, b, block=block)).collect()
        assert sorted(map(tuple, got), key=str) == sorted(brute(docs, items), key=str)


def test_no_rows(spark):
    docs, items = rows()
    none = spark.createDataFrame([], "doc_id long, text string")
    d, b = spark.createDataFrame(docs, none.schema), spark.createDataFrame(items, "item_id long, text string")
    assert decontamination.contamination(none, b).count() == 0
    assert decontamination.contamination(d, b.limit(0)).where("contaminated").count() == 0
