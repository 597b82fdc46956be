import zlib

import numpy as np
import pytest

import corpus_pipeline as pipeline
from cohortline.llm.tokens import default_path
from tests.llm import test_decontamination, test_jaccard, test_packing, test_quality, test_secrets


def test_stages_equal_brute_force(spark, data):
    stages = dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_decontamination", "secret_scans", "pack"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    held = {"docs": docs}

    def after(name):
        held["docs"] = pipeline.materialize(stages[name](spark, held["docs"], data))
        assert name == "pack" or held["docs"].schema == docs.schema
        return held["docs"].collect()

    before = docs.collect()
    kept = after("quality_rules")
    texts = {r.doc_id: r for r in before}
    assert {r.doc_id for r in kept} <= {r.doc_id for r in before if not test_quality.brute(r.text)[5]} and len(kept) > 0.5 * len(before)
    assert all(r == texts[r.doc_id] for r in kept)

    single = after("near_duplicates")
    classes = {}
    for key, cls, _ in test_jaccard.brute([(r.doc_id, r.text) for r in kept]):
        classes.setdefault(cls, []).append(key)
    assert sorted(len({r.doc_id for r in single} & set(c)) for c in classes.values()) == [1] * len(classes)

    clean = after("benchmark_decontamination")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    hit = {x[0] for x in test_decontamination.brute([(r.doc_id, r.text) for r in single], items) if x[5]}
    assert {r.doc_id for r in clean} == {r.doc_id for r in single} - hit

    masked = after("secret_scans")
    assert {r.doc_id for r in masked} == {r.doc_id for r in clean}
    for r in masked:
        assert r.n_chars == len(r.text) and test_secrets.brute(r.text)[:3] == (0, 0, 0)
        if "[SECRET]" not in r.text:
            assert r.text == texts[r.doc_id].text

    pieces = after("pack")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    ids = {r.doc_id: np.array([*model.encode(r.text, add_special_tokens=False).ids, 0], dtype="<u4") for r in masked}
    test_packing.verify([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in pieces], {k: len(v) for k, v in ids.items()}, 1024)
    assert all(zlib.crc32(r.ids) == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) for r in pieces)


def test_null_and_repeated_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(30)
    odd = spark.createDataFrame([(None, None, None, None, None), (5, "a b", "en", None, 3), (5, "a b", "en", None, 3)], docs.schema)
    both = docs.unionByName(docs).unionByName(odd)
    out = both
    for _, stage in pipeline.STAGES[1:]:
        out = pipeline.materialize(stage(spark, out, data))
    assert out.count() > 0
    none = docs.limit(0)
    for _, stage in pipeline.STAGES:
        none = stage(spark, none, data)
    assert none.count() == 0


NAMES = ["judged", "counts", "features", "row", "Spans", "found", "key", "mark", "class_id", "copies", "contaminated", "__row", "__counts", "kept", "ids", "start"]


def test_columns_of_any_name_come_through(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40)
    tail = " ".join(f"palabra{i}" for i in range(30_000))
    long = spark.createDataFrame([(9001, tail, "en", "s", len(tail)), (9002, None, "en", "s", None), (9003, "", "en", "s", 0)], docs.schema)
    wide = pipeline.materialize(docs.unionByName(long).selectExpr("*", *[f"concat('{n} ', doc_id) AS `{n}`" for n in NAMES]))
    out = wide
    for _, stage in pipeline.STAGES[:-1]:
        out = pipeline.materialize(stage(spark, out, data))
        assert out.schema == wide.schema
    rows = out.collect()
    assert len(rows) > 15 and all(r[n] == f"{n} {r.doc_id}" for r in rows for n in NAMES)
    assert not {9002, 9003} & {r.doc_id for r in rows}
    assert pipeline.STAGES[-1][1](spark, out, data).count() >= len(rows)


def test_judging_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, counts string")
    rules = test_quality.quality.DecisionList([])
    assert test_quality.quality.judge(docs, rules).first()["counts"] == "x"
    with pytest.raises(ValueError):
        test_quality.quality.judge(docs, rules, "counts")
