"""Ids against the public library on odd texts and real documents."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casewright.llm.encode import MatrixBPE, encode_column

VOCAB = "/opt/tokenizers/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary file")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCAB)
    library.encode_special_tokens = True
    coder = MatrixBPE(*MatrixBPE.arrays(VOCAB))

    def mine(texts):
        offsets, ids = coder.encode(texts)
        return [ids[offsets[k] : offsets[k + 1]].tolist() for k in range(len(texts))]

    return mine, lambda texts: [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_odd_texts(both):
    mine, theirs = both
    texts = [None, "", " ", "\n\n", "<|endoftext|>", "a" * 5000, " " * 3000 + "x", "the" * 900, "x　 y\r\n\tz", "😀‍👩é", "it's we'LL 'tis", "0123456789" * 50, "中文字符，测试", "a\x00b"]
    assert mine(texts) == theirs(texts)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=300))
def test_any_text(both, text):
    mine, theirs = both
    assert mine([text]) == theirs([text])


def test_column(spark, both):
    rows = [(1, "a b", "x"), (2, None, "y"), (3, "", None), (None, "a b", "x"), (1, "a b", "x")]
    out = encode_column(spark.createDataFrame(rows, "doc_id long, text string, ids string"), "doc_id", "text", VOCAB)
    ids = both[1](["a b"])[0]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, ids), (2, []), (3, []), (None, ids), (1, ids)], key=repr)
    assert encode_column(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", VOCAB).count() == 0
    with pytest.raises(FileNotFoundError):
        encode_column(out.withColumnRenamed("doc_id", "k").selectExpr("k", "'x' t"), "k", "t", "/nowhere/else.json")
