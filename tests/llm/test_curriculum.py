import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.llm import curriculum, ordering
from cohortline.llm.queries import op11_curriculum_mix
from cohortline.llm.registry import table
from tests.compare import compare, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shares(sizes, weights, share, limit):
    """Rounds of dealing: what goes above a limit is dealt anew among the rest."""
    target, left = dict.fromkeys(sizes, 0.0), share * sum(sizes.values())
    open_ = {s for s in sizes if weights[s] > 0}
    while open_ and left > 1e-9:
        per = left / sum(weights[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += per * weights[s]
            if target[s] >= limit * sizes[s]:
                left += target[s] - limit * sizes[s]
                target[s] = limit * sizes[s]
                open_.remove(s)
    return target


def brute_taken(docs, share=1.5, limit=2.0):
    size = [len(WORD.findall(t or "")) for _, t, _ in docs]
    sources = sorted({s for *_, s in docs}, key=lambda s: (s is None, s))
    sizes = {s: sum(n for n, d in zip(size, docs) if d[2] == s) for s in sources}
    target = shares(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}, share, limit)
    out = []
    for s in sources:
        mine = [(hashlib.md5(f"mix:{'' if k is None else k}".encode()).hexdigest(), n, k) for n, (k, _, x) in zip(size, docs) if x == s]
        at = 0
        for _, n, k in sorted(mine, key=lambda r: r[:2]):
            got = sum(max(0, min(n, int(target[s] + 1e-6) - at - e * sizes[s])) for e in range(2))
            out.append((k, n, sizes[s], round(target[s], 4), got))
            at += n
    return out


def documents(seed=3):
    r = np.random.default_rng(seed)
    docs = []
    for i in range(300):
        s = ["hot", "a", "b", "ü", None, "z", "tiny"][min(6, int(r.exponential(2)))]
        docs.append((int(i) if i % 13 else None, " \t".join(["w"] * int(r.integers(0, 40))) if i % 17 else None, s))
    return docs + [(7, "x y z", "a"), (7, "x y z", "a"), (900, "w " * 3000, "b"), (901, None, "empty"), (902, "", "empty")]


def test_taken_equals_brute_force(spark):
    docs = documents()
    frame = spark.createDataFrame([(*d, 5, "k") for d in docs], "doc_id long, text string, source string, row int, target string")
    mixed = curriculum.mix(frame, lambda s: curriculum.cycled(s, curriculum.FALLING_RISING_STEADY))
    got = [(*r[:3], round(r[3], 4), r[4]) for r in curriculum.digest(mixed).collect()]
    assert sorted(got, key=str) == sorted(brute_taken(docs), key=str)
    moved = curriculum.mix(frame.repartition(7), lambda s: curriculum.cycled(s, curriculum.FALLING_RISING_STEADY))
    again = [(*r[:3], round(r[3], 4), r[4]) for r in curriculum.digest(moved).collect()]
    assert sorted(again, key=str) == sorted(got, key=str)


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert curriculum.mix(none, lambda s: curriculum.cycled(s, [[(0, 1), (1, 1)]])).count() == 0


def test_positions_follow_the_schedules(spark):
    docs = [(f"{s}{i}", "w " * 5, s) for s in "abc" for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id string, text string, source string")
    knots = {"a": [(0.0, 3.0), (1.0, 1.0)], "b": [(0.0, 0.0), (0.5, 0.0), (0.5, 2.0), (1.0, 2.0)], "c": [(0.0, 0.0), (1.0, 2.0)]}
    schedules = spark.createDataFrame([(s, [{"at": t, "weight": w} for t, w in k]) for s, k in knots.items()], f"source string, knots {curriculum.KNOTS}")
    rows = curriculum.mix(frame, schedules, share=1.0).collect()
    position = [r["position"] for r in rows if r["words"]]
    assert position == sorted(position) and 0 <= position[0] and position[-1] <= 1
    taken = defaultdict(list)
    for r in rows:
        if r["words"]:
            taken[r["source"]].append(r["position"])
    target = {r["source"]: r["target"] for r in rows}
    assert target == pytest.approx({"a": 3000.0, "b": 1500.0, "c": 1500.0})
    for at in (0.25, 0.5, 0.75, 1.0):
        want = {"a": (3 * at - at * at) / 2, "b": max(0.0, at - 0.5) * 2, "c": at * at}
        for s, share in want.items():
            assert sum(p <= at for p in taken[s]) * 5 == pytest.approx(share * target[s], abs=10)


def test_unlisted_sources_and_too_much_demand(spark):
    frame = spark.createDataFrame([(1, "a b c d", "x"), (2, "a b", "y"), (3, "a", None)], "doc_id long, text string, source string")
    schedules = spark.createDataFrame([("x", [{"at": 0.0, "weight": 1.0}, {"at": 1.0, "weight": 1.0}]), ("gone", None)], f"source string, knots {curriculum.KNOTS}")
    rows = {r["doc_id"]: r for r in curriculum.digest(curriculum.mix(frame, schedules)).collect()}
    assert (rows[1]["target"], rows[1]["taken"], rows[2]["taken"], rows[3]["target"]) == (8.0, 8, 0, 0.0)


def test_arranged_documents_keep_their_columns(spark):
    frame = spark.createDataFrame([(i, "w " * i, "s", "x") for i in range(20)], "doc_id long, text string, source string, row string")
    got = curriculum.arranged(frame, lambda s: curriculum.cycled(s, [[(0, 1), (1, 1)]])).collect()
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    assert all(len(r["doc"]["text"].split()) == r["doc"]["doc_id"] and r["doc"]["row"] == "x" for r in got)
    assert sum(r["words"] for r in got) == int(1.5 * sum(range(20)))


def test_sums_before(spark):
    r = np.random.default_rng(0)
    x = [(int(v), i) for i, v in enumerate(r.integers(0, 50, 500))]
    got = ordering.sums_before(spark.createDataFrame(x, "v long, i long"), [F.col("v"), F.col("i")], {"before": F.col("v"), "n": F.lit(1)}).collect()
    total = 0
    for place, row in enumerate(sorted(got)):
        assert (row["before"], row["n"]) == (total, place)
        total += row["v"]


def test_query(spark, data):
    from cohortline.llm.registry import ORACLES

    assert compare(spark, data, op11_curriculum_mix, ORACLES["op11_curriculum_mix"], connect(data)) is None
    docs = [tuple(r) for r in table(spark, data, "documents").select("doc_id", "text", "source").collect()]
    got = [(*r[:3], round(r[3], 4), r[4]) for r in op11_curriculum_mix(spark, data).collect()]
    assert sorted(got) == sorted(brute_taken(docs))
