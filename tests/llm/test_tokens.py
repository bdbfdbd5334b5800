import random

import pytest

pytest.importorskip("tiktoken")
from sieveworks.llm import tokens as T

PIECES = ["word", " word", "  ", "\n", "\t", " ", "’s", "'s", "don't", "123", " 4", "…", "!!", " ?", "한국어", " 독성", "ü", "<|endoftext|>", "é́", "　", "\xa0", "x" * 40, "\r\n\r\n", "😀"]


def plain(texts):
    return [list(x) for x in T._load(T.vocabulary_path())[0].encode_ordinary_batch(texts, num_threads=1)]


@pytest.mark.parametrize("leaf", [2, 3, 5, 16, 64])
def test_tree_gives_the_ids_of_the_whole_text(leaf):
    rng = random.Random(leaf)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["", " ", "a" * 300, " " * 500, "ab" * 20 + " " * 300 + "c"]
    tree = T.Tree(T.vocabulary_path(), leaf)
    got = [x.tolist() for x in tree.encode(texts)]
    assert got == plain(texts)
    assert [T.decode(x, T.vocabulary_path()) for x in got] == texts


def test_same_ids_as_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as P

    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(9)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    assert [x.ids for x in t.encode_batch(texts, add_special_tokens=False)] == [x.tolist() for x in T.Tree(T.vocabulary_path(), 8).encode(texts)]


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b")], "id long, text string").withColumnRenamed("id", "ids")
    rows = {r["record_id"]: r["ids"] for r in T.encoded(df, "ids", "text").collect()}
    assert rows[1] == rows[2] == [] and rows[3] == plain(["a b"])[0]
    assert T.encoded(df.limit(0), "ids", "text").count() == 0
