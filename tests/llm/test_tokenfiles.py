import zlib

import numpy as np
import pytest

from cohortline.llm import rans, tokenfiles
from cohortline.llm.tokens import default_path
from cohortline.session import scratch_path

PATH = default_path("byte_bpe_50k.json")


def test_round_trip():
    r = np.random.default_rng(2)
    ids = np.minimum(r.zipf(1.3, 3 * rans.BLOCK), 70_000).astype("<u4")
    table = rans.Frequencies.of_counts(*np.unique(ids, return_counts=True))
    assert table.scaled.sum() == 1 << rans.BITS
    coded = [(*x, rans.BLOCK) for x in rans.encode(ids.reshape(3, -1), table)]
    short = np.concatenate([ids[:100], np.full(12, table.filler)])
    coded += [(*x, 100) for x in rans.encode(short[None, :], table)]
    back = rans.decode(coded, table)
    assert (np.concatenate(back[:3]) == ids).all() and (back[3] == ids[:100]).all()
    p = table.scaled[table.index[ids]] / (1 << rans.BITS)
    assert sum(len(s) for s, _, _ in coded[:3]) * 8 < -np.log2(p.astype(float)).sum() * 1.001 + 3 * 32 * rans.LANES


def test_one_id():
    ids = np.full(rans.BLOCK, 7, dtype="<u4")
    table = rans.Frequencies.of_counts(np.array([7]), np.array([5]))
    assert (rans.decode([(*rans.encode(ids[None, :], table)[0], rans.BLOCK)], table)[0] == ids).all()


def test_joined_crc():
    for a, b in ((b"", b"x"), (b"hello ", b"world" * 99), (b"a" * 5000, b"")):
        assert rans.join_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def brute(rows):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(PATH)
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_equals_brute_force(spark, data):
    rows = [(r.doc_id * 3, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rows += [(None, "one"), (1, None), (2, ""), (4, "<|endoftext|> x " * 30_000), (5, "a" * 9000)]
    path = scratch_path(spark, "store")
    tokenfiles.write(spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, key string, part int"), path, PATH)
    got = [tuple(r) for r in tokenfiles.digest(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == brute(rows)


def test_repeated_keys_and_damage(spark):
    rows = [(1, "b b"), (1, "a"), (1, "a"), (0, "c")]
    path = scratch_path(spark, "store")
    tokenfiles.write(spark.createDataFrame(rows, "doc_id long, text string"), path, PATH)
    got = sorted((tuple(r) for r in tokenfiles.digest(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [0, 1, 1, 1] and [r[1] for r in got] == list(np.cumsum([0, *(r[2] for r in got[:-1])]))
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in brute(rows))
    blocks = spark.read.parquet(f"{path}/blocks").toPandas()
    blocks["crc32"] += 1
    other = scratch_path(spark, "store")
    spark.createDataFrame(blocks, spark.read.parquet(f"{path}/blocks").schema).write.parquet(f"{other}/blocks")
    spark.read.parquet(f"{path}/frequencies").write.parquet(f"{other}/frequencies")
    with pytest.raises(Exception, match="damaged"):
        tokenfiles.read(spark, other).collect()


def test_no_rows(spark):
    path = scratch_path(spark, "store")
    tokenfiles.write(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert tokenfiles.digest(spark, path).count() == 0
