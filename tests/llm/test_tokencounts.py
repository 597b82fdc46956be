import numpy as np
import pytest

from cohortline.llm import tokencounts
from cohortline.llm.tokens import default_path

PATH = default_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def random_texts(n=1500):
    r = np.random.default_rng(5)
    sets = ["ab ", "the ing er▁ ", "aeiou nrst\n", " \t.,;!?-_", "0123456789 ", "éàüßñ ó", "日本語中文字 ", "😀‍👍 x", "Ⅷﬁ①é \x00\x7f", "<s></s><unk> "]
    out = []
    for _ in range(n):
        chars = "".join(r.choice(sets, int(r.integers(1, 4)))) + "etaoin "
        out.append("".join(r.choice(list(chars), int(r.integers(0, 60)))))
    return out


FIXED = [None, "", " ", "  ", "a", " a ", "a" * 300, " " * 100, "x" + " " * 35 + "the", "a  b   c    d", "▁▁a▁b", "▁", "\n\n", "hello\nworld\n", "<s>hi</s>",
         "the the  the", " ." * 40, "!" * 70, "日本語のテキスト" * 9]


def test_equals_library_on_random_texts(model):
    machine = tokencounts.load(PATH)
    for t in [*random_texts(), *(x for x in FIXED if x)]:
        assert machine.count(" " + t.replace("▁", " ") if t else "") == len(model.encode(t)), t


def test_chunks_compose(spark, model):
    texts = FIXED + random_texts(80) + [" ".join(random_texts(200))]
    rows = [(i % 40 if i % 9 else None, t, 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long")
    for chunk in (1, 3, 50, 1 << 16):
        got = [tuple(r) for r in tokencounts.counted(docs, PATH, chunk=chunk).collect()]
        want = [(k, len((t or "").encode()), len(model.encode(t or ""))) for k, t, _ in rows]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_given_texts(spark, data, model):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in tokencounts.counted(docs, PATH).collect()}
    assert got == {r.doc_id: len(model.encode(r.text)) for r in docs.collect()}


def test_no_rows(spark):
    assert tokencounts.counted(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
