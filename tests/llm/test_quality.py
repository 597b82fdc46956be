import re
from collections import Counter

import numpy as np

from cohortline.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    times = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    repeated = {i + j for i in range(len(words) - 7) if times[tuple(words[i:i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated),
            len(words) < 20 or 100 * len(repeated) > 30 * len(words))


CASES = [None, "", " \n\t", "one", "a\nb\na\n\na ", "é😀 # ß|\x1c x\xa0y", "l\r\nl\r\n", "a b c d e f g h " * 3, "z " * 50, "x" * 300_000 + " y\n" * 9,
         "##\n##\n ##\n", " ".join(f"w{i}" for i in range(40)), "<a> & $5 * 3%\n" * 4]


def test_counts_equal_brute_force(spark, data):
    texts = CASES + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rows = [(i % 90 if i % 8 else None, t, "c", 1.0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, counts string, words double")
    rules = quality.DecisionList([[("words", ">", 1e6)], [("symbols_per_word", ">", 0.5), ("digits", "<=", 0.3)]])
    out = quality.judge(docs, rules).select("doc_id", "judged.n_words", "judged.word_chars", "judged.n_symbols", "judged.n_dup_lines",
                                            "judged.n_repeat_words", "judged.base_failed", "judged.kept", "judged.rule").collect()
    assert sorted((tuple(r)[:7] for r in out), key=str) == sorted(((k, *brute(t)) for k, t, *_ in rows), key=str)
    assert all(r.kept == (not r.base_failed and r.rule == 0) for r in out) and any(r.rule == 2 for r in out)


def test_learner_finds_planted_rules():
    r = np.random.default_rng(8)
    x = r.random((3000, 3))
    bad = (x[:, 0] > 0.8) & (x[:, 1] <= 0.5) | (x[:, 2] > 0.9)
    rules = quality.learn_rules(x, bad ^ (r.random(3000) < 0.01), ["a", "b", "c"])
    found = np.zeros(3000, dtype=bool)
    for rule in rules.rules:
        found |= quality._meets(x, rule, ["a", "b", "c"])
    assert (found == bad).mean() > 0.97 and (bad[found]).mean() > 0.95
    assert rules.expressions()[0].count("`") == 2 * len(rules.rules[0])


def test_learner_leaves_noise_alone():
    r = np.random.default_rng(9)
    assert quality.learn_rules(r.random((2000, 3)), r.random(2000) < 0.1, ["a", "b", "c"]).rules == []
    assert quality.learn_rules(np.zeros((0, 3)), np.zeros(0, dtype=bool), ["a", "b", "c"]).rules == []
    assert quality.learn_rules(np.zeros((50, 3)), np.ones(50, dtype=bool), ["a", "b", "c"]).rules == []


def test_fit_and_no_rows(spark):
    good = [(i, f"plain words number {i} " + " ".join(f"w{i}x{j}" for j in range(40)), 1) for i in range(240)]
    bad = [(1000 + i, " ".join(f"w{i}y{j}$$" for j in range(40)), 0) for i in range(120)]
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([r[:2] for r in good + bad], schema)
    labels = spark.createDataFrame([(r[0], r[2]) for r in good + bad] + [(None, 0), (7, None), (99_999, 0)], "doc_id long, quality int")
    rules = quality.fit(docs, labels)
    kept = {r.doc_id for r in quality.judge(docs, rules).where("judged.kept").collect()}
    assert kept == {r[0] for r in good}
    none = spark.createDataFrame([], schema)
    assert quality.fit(none, labels).rules == [] and quality.judge(none, rules).count() == 0
    assert quality.judge(docs, quality.fit(docs, labels.limit(0))).where("judged.kept").count() == len(good + bad)
