import numpy as np
import pyarrow.parquet as pq
import pytest

from cohortline.llm import tokens

PATH = tokens.default_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def check(model, texts):
    for text, ids in zip(texts, tokens.encode(PATH, iter(texts)), strict=True):
        assert ids.tolist() == model.encode(text or "", add_special_tokens=False).ids, text


def test_given_texts(model, data):
    check(model, pq.read_table(f"{data}/documents.parquet", columns=["text"])["text"].to_pylist())


def test_odd_texts(model):
    r = np.random.default_rng(3)
    sets = ["ab  ", " \n\t\x0b\x0c\r\x1c\x1f\x85\xa0 　a", "it's we'll I'd 'S ", "é ñ 日本 語 x", "12 3½Ⅷ ²", "!?.,  ;<|endoftext|> ", "😀‍ a"]
    texts = ["".join(r.choice(list(sets[i % 7] + sets[int(r.integers(0, 7))]), int(r.integers(0, 40)))) for i in range(3000)]
    check(model, [None, "", " ", "  ", " a", "a ", "<|endoftext|>", " <|endoftext|> x", "a<|endoftext|>b c", *texts])


def test_long_texts(model, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_UNITS", 50)
    r = np.random.default_rng(4)
    words = " ".join("w" * int(n) + str(n * 7 % 97) for n in r.integers(1, 9, 9000))
    texts = [words * 5, "a" * 30_000 + " b", "x  y " * 60_000]
    check(model, texts)
    assert ["".join(tokens.parts(t, 1000)) for t in texts] == texts and ["".join(tokens.units(t)) for t in texts] == texts
