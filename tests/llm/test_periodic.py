import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from cohortline.llm import periodic
from cohortline.llm.queries import op13_periodic_runs
from cohortline.llm.registry import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(x, exponent=4, least=6):
    """Every stretch of every period; of equal stretches the least period stays."""
    n, out = len(x), {}
    for q in range(1, n // exponent + 1):
        same = [x[i] == x[i + q] for i in range(n - q)] + [False]
        start = None
        for i, s in enumerate(same):
            if s and start is None:
                start = i
            elif not s and start is not None:
                if i + q - start >= max(least, exponent * q):
                    out.setdefault((start, i + q), q)
                start = None
    return sorted((s, e - s, q) for (s, e), q in out.items())


def sequence(r):
    v = r.choice([1, 2, 2, 3, 10])
    x = [r.randrange(v) for _ in range(r.randrange(0, 90))]
    for _ in range(r.randrange(0, 4)):
        unit, at = [r.randrange(v + 1) for _ in range(r.randrange(1, 9))], r.randrange(0, len(x) + 1)
        x[at:at] = (unit * 50)[:r.randrange(0, 50)]
    return x


@pytest.mark.parametrize("exponent,least", [(2, 1), (3, 6), (4, 6), (5, 2)])
def test_batches_of_any_size_give_all_runs(exponent, least):
    r = random.Random(exponent)
    for _ in range(250):
        x = sequence(r)
        want = brute(x, exponent, least)
        for step in (1, r.randrange(2, 20), len(x) or 1):
            seen = periodic.Catchers(exponent, least)
            for at in range(0, len(x), step):
                seen.append(np.array(x[at:at + step]))
            assert seen.runs() == want


def test_long_sequences():
    seen = periodic.Catchers()
    seen.append(np.zeros(150_000, dtype=np.int64))
    assert seen.runs() == [(0, 150_000, 1)]
    seen = periodic.Catchers()
    x = np.random.default_rng(1).permutation(120_000)
    x[70_000:110_000] = x[70_000 + np.arange(40_000) % 7_919]
    for at in range(0, len(x), 4_000):
        seen.append(x[at:at + 4_000])
    assert seen.runs() == [(70_000, 40_000, 7_919)]
    with pytest.raises(ValueError):
        periodic.Catchers(exponent=1)


def test_equal_hashes_are_no_runs(monkeypatch):
    monkeypatch.setattr(periodic, "mix", lambda h: h * np.uint64(0))
    r = random.Random(9)
    for _ in range(60):
        x = sequence(r)
        seen = periodic.Catchers()
        for at in range(0, len(x), 5):
            seen.append(np.array(x[at:at + 5]))
        assert seen.runs() == brute(x)


def expected(key, text):
    w = WORD.findall(text or "")
    n = len(w)
    if key is not None and n:
        h = zlib.crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    best = max(runs, key=lambda r: (r[1] * 10**12 // r[2], -r[0], -r[2]), default=None)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = (None, None, None, None) if best is None else (*best, 1000 * best[1] // best[2])
    return (key, len(runs), *first, digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            digest(" ".join(x for i, x in enumerate(w) if i not in drop)))


CASES = [(1, None), (2, ""), (3, "  \t\n"), (4, "a b " * 30), (None, "x " * 7), (None, "x " * 5), (4, "a b " * 30), (5, "na na na na " * 4),
         (6, "é è " * 5 + "z " * 9 + "\x1c \x85 " * 8), (7, "one"), (8, "a " * 6 + "b " * 6)] + [(k, " ".join(f"w{i % (k % 9 + 20)}" for i in range(k))) for k in range(10, 130)]


def test_documents_equal_brute_force(spark):
    docs = spark.createDataFrame([(*x, "k", 3) for x in CASES], "doc_id long, text string, runs string, best int")
    docs = docs.withColumn("text", periodic.planted(docs["doc_id"], docs["text"]))
    got = periodic.digest(periodic.periodic(docs)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([expected(*x) for x in CASES], key=str)
    assert periodic.periodic(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    text = "start " + "la di da " * 100_000 + "end"
    row = periodic.periodic(spark.createDataFrame([("t", text)], "doc_id string, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 300_000, 3)] and row["best"] == 0 and row["kept"] == "start la di da end"


def test_query_equals_brute_force(spark, data):
    got = {r["doc_id"]: tuple(r) for r in op13_periodic_runs(spark, data).collect()}
    rows = [r for r in table(spark, data, "documents").select("doc_id", "text").collect() if len((r["text"] or "").split()) < 1500]
    assert len(rows) > 150 and sum(got[r["doc_id"]][1] > 0 for r in rows) > 5
    for r in rows:
        assert got[r["doc_id"]] == expected(*r)
