from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from quern.llm import packing
from tests.llm.rough import no_documents, rough_documents, small_documents
from tokenizers import Tokenizer


def check(docs, length=2048):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack(docs, length=length).collect()
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= length
    wanted, got = Counter(), Counter()
    by_key = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        by_key[r.doc_id].append(ids)
        wanted[r.doc_id, len(ids)] += len(ids)
    for p in pieces:
        got[p.doc_id, p.doc_tokens] += p.length
        crcs = {
            zlib.crc32(ids[p.start : p.start + p.length].tobytes())
            for ids in by_key[p.doc_id]
            if len(ids) == p.doc_tokens
        }
        assert p.ids_crc32 in crcs
    assert got == wanted
    return sequences


def test_small_table(spark):
    sequences = check(small_documents(spark))
    filled = sum(n for parts in sequences.values() for _, n in parts)
    assert filled >= 0.98 * 2048 * (len(sequences) - 1)


def test_rough_rows(spark):
    check(rough_documents(spark), length=64)


def test_empty_table(spark):
    assert packing.pack(no_documents(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_first_fit_places_every_token_once(lengths):
    packed = packing.first_fit(lengths, room=64)
    got = defaultdict(list)
    for pieces in packed:
        assert 0 < sum(p[2] for p in pieces) <= 64
        for item, start, length in pieces:
            got[item].append((start, length))
    for item, whole in enumerate(lengths):
        at = 0
        for start, length in sorted(got[item]):
            assert start == at
            at += length
        assert at == whole


def test_tree_finds_the_first_room():
    rng = np.random.default_rng(7)
    rooms, plain = packing.Rooms(37, 50), [50] * 37
    for need in rng.integers(1, 51, 60).tolist():
        if max(plain) < need:
            continue
        first = next(i for i, r in enumerate(plain) if r >= need)
        assert rooms.first_with(need) == first
        rooms.take(first, need)
        plain[first] -= need
