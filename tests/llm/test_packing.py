import zlib
from collections import defaultdict

import numpy as np

from cohortline.llm import packing
from cohortline.llm.tokens import default_path

PATH = default_path("byte_bpe_50k.json")


def verify(pieces, lengths, limit):
    """Every id in one piece; sequences without gaps, and full or of a power of two."""
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for key, start, n, sequence, offset in pieces:
        of_doc[key].append((start, n))
        of_sequence[sequence].append((offset, n))
    for key, n in lengths.items():
        at = 0
        for start, m in sorted(of_doc[key]):
            assert start == at and m > 0
            at += m
        assert at == n
    for parts in of_sequence.values():
        at = 0
        for offset, m in sorted(parts):
            assert offset == at
            at += m
        assert at == limit or at & (at - 1) == 0
    return [sum(m for _, m in parts) for parts in of_sequence.values()]


def test_stream():
    r = np.random.default_rng(1)
    for limit, n in ((64, 2000), (1024, 800), (10, 300)):
        docs = [(i, np.full(int(x), i, dtype="<u4")) for i, x in enumerate(r.integers(1, 3 * limit, n))]
        rows = list(packing.pack_stream(iter(docs), limit))
        if limit & (limit - 1) == 0:
            verify([(k, s, len(ids), w, o) for k, s, ids, _, w, o in rows], {k: len(x) for k, x in docs}, limit)
        assert all((ids == k).all() for k, _, ids, *_ in rows)


def test_level_minimises_the_squares():
    r = np.random.default_rng(2)
    levels = packing.LevelArray(32)
    for size in r.integers(1, 33, 3000).tolist():
        before = levels.counts.copy()
        _, level, full = levels.place(size)
        def total(h):
            n = before.copy()
            n[h] -= h > 0
            n[h + size] += h + size < 32
            return int((n[1:32] ** 2).sum())
        usable = [h for h in range(33 - size) if h == 0 or before[h] > 0]
        assert total(level) == min(map(total, usable)) and full == (level + size == 32)
        assert all(len(levels.open[h]) == levels.counts[h] for h in range(1, 32))
    assert ((32 - np.arange(33)) * levels.counts).sum() < 0.05 * 3000 * 16.5  # little room is left in open windows


def test_whole_table(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()] + [(-1, None), (-2, ""), (-3, "long text " * 9000)]
    docs = spark.createDataFrame([(*r, 1, b"x") for r in rows], "doc_id long, text string, start int, ids binary").repartition(3)
    out = packing.pack(docs, PATH).collect()
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(PATH)
    want = {k: np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for k, t in rows}
    for r in out:
        assert r.ids == want[r.doc_id][r.start:r.start + r.length].tobytes() and r.doc_tokens == len(want[r.doc_id]) and zlib.crc32(r.ids) >= 0
    fills = verify([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in out], {k: len(v) for k, v in want.items()}, 1024)
    assert sum(f < 1024 for f in fills) <= 3 * 10


def test_null_and_repeated_keys_and_no_rows(spark):
    schema = "doc_id long, text string"
    out = packing.pack(spark.createDataFrame([(None, "a"), (None, "a"), (1, "b"), (1, "b")], schema), PATH).collect()
    assert sorted(str(r.doc_id) for r in out for _ in range(r.length)) == ["1"] * 4 + ["None"] * 4
    assert packing.pack(spark.createDataFrame([], schema), PATH).count() == 0
