from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from quern.llm import packing
from tests.llm.rough import SCHEMA, rough_rows
from tokenizers import Tokenizer

END = "<|endoftext|>"
TEXTS = [
    f"a {END} b",
    f"{END}{END}",
    f" {END} \n {END}x <|endoftext <|endoftext|",
    *(r[1] for r in rough_rows() if r[1]),
]
SPACES = ["a" + " " * 1_200_000 + "b", "\n" * 1_200_000, f"{END}" + " \t" * 600_000 + END]


def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("texts", [TEXTS, SPACES], ids=["added tokens", "long white space"])
def test_ids_are_those_of_tokenizers(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    whole = [
        np.array([*reference().encode(t, add_special_tokens=False).ids, 1], dtype="<u4") for t in texts
    ]
    got = [0] * len(texts)
    for p in packing.pack(docs).collect():
        ids = whole[p.doc_id]
        assert p.doc_tokens == len(ids)
        assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        got[p.doc_id] += p.length
    assert got == [len(ids) for ids in whole]


def test_added_token_is_one_id():
    encode = packing.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert encode(f"a {END} b") == [64, 220, 50256, 275]
