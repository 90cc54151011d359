"""Packing documents into sequences: first-fit decreasing on a tournament tree.

Documents are tokenised where they are read. A document longer than a sequence is cut
into full sequences, which need no packing; the shorter rests are. Rests are dealt into
randomised groups of even size, and each group is packed on its own: in decreasing
length, each rest goes to the first open sequence with room. A tournament tree over the
sequences' free room, each node the larger of its two children, finds that sequence in
a logarithmic number of steps. Last, a group's emptiest sequences are dissolved and
their pieces cut to fill the room that is left in the others.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import documents, runs, text_of
from tokenizers import Tokenizer

#: Tokens of a sequence, and the id that ends every document.
LENGTH = 2048
END = 1

#: Documents of a group, on average. A group's rests take at most 8 KB each.
GROUP_DOCS = 2048

#: Room of fewer tokens is left as it is rather than filled with a cut piece.
LEAST_CUT = 16

#: White space of so many characters or more is left to ``tokenizers``: ``tiktoken``'s
#: pattern runs out of stack at about a million.
LONG_SPACE = 100_000
_LONG_SPACE = re.compile(rf"\s{{{LONG_SPACE}}}")

#: Keys travel as strings, which keep long ones exact beside nulls.
PIECES = (
    "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


def encoder(path: str, added: dict[str, int] | None = None) -> tiktoken.Encoding:
    """Byte-level BPE over the ranks in ``path``; ``added`` strings are one token each."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added or {}
    )


def encoding(path: str) -> Callable[[str], list[int]]:
    """The ids of a text as ``tokenizers`` makes them without added special tokens.

    ``path`` is that of the ranks; the tokenizer's ``.json`` lies beside it. The strings
    of its added tokens are one token each wherever they stand in a text.
    """
    vocabulary = path.removesuffix(".tiktoken") + ".json"
    with open(vocabulary, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    whole = Tokenizer.from_file(vocabulary)
    plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens)
    fast = encoder(path, {t["content"]: t["id"] for t in tokens})

    def ids(text: str) -> list[int]:
        if not plain or len(text) >= LONG_SPACE and _LONG_SPACE.search(text):
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode(text, allowed_special="all")

    return ids


class Rooms:
    """Free room of sequences, as a tournament tree of maxima."""

    def __init__(self, count: int, room: int) -> None:
        self.base = 1 << max(0, (count - 1).bit_length())
        self.tree = [room] * (2 * self.base)

    def first_with(self, need: int) -> int:
        """The first sequence with ``need`` or more tokens of room."""
        tree, node = self.tree, 1
        while node < self.base:
            node *= 2
            if tree[node] < need:
                node += 1
        return node - self.base

    def take(self, sequence: int, used: int) -> int:
        """Use room of ``sequence``; returns what was left before."""
        tree, node = self.tree, sequence + self.base
        left = tree[node]
        tree[node] = left - used
        while node > 1:
            node //= 2
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
        return left


def first_fit(lengths: list[int], room: int = LENGTH) -> list[list[list[int]]]:
    """Sequences as lists of ``[item, start, length]``; items may be cut to fill room.

    Every token of every item lies in exactly one piece. At most one sequence is left
    with more than ``LEAST_CUT`` tokens of room unless the others have none to give.
    """
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    rooms, packed = Rooms(len(lengths), room), []
    for item in order:
        sequence = rooms.first_with(lengths[item])
        if sequence == len(packed):
            packed.append([])
        rooms.take(sequence, lengths[item])
        packed[sequence].append([item, 0, lengths[item]])
    free = [room - sum(p[2] for p in pieces) for pieces in packed]
    gaps = sorted(range(len(packed)), key=lambda s: (free[s], s))
    while len(gaps) > 1:
        emptiest = gaps[-1]
        usable = [s for s in gaps[:-1] if free[s] >= LEAST_CUT]
        if room - free[emptiest] > sum(free[s] for s in usable):
            break
        gaps.pop()
        moving, packed[emptiest] = packed[emptiest], []
        for target in reversed(usable):
            while moving and free[target]:
                item, start, length = moving.pop()
                part = min(length, free[target])
                packed[target].append([item, start, part])
                free[target] -= part
                if part < length:
                    moving.append([item, start + part, length - part])
        gaps.sort(key=lambda s: (free[s], s))
    return [pieces for pieces in packed if pieces]


def _tokenised(path: str, room: int, groups: int):
    """Pieces of documents: full ones without ids, rests with theirs and a group."""

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path)
        row = 0
        for frame in frames:
            out = []
            for key, text, group in zip(frame["doc_id"], frame["text"], frame["group"]):
                ids = np.array([*encode(text), END], dtype="<u4")
                n = len(ids)
                # Rows with one and the same key and text are still dealt out evenly.
                group = (int(group) + row * 0x9E3779B1) % groups
                row += 1
                full = n - n % room
                for start in range(0, full, room):
                    crc = zlib.crc32(ids[start : start + room].tobytes())
                    out.append((key, group, start, room, crc, n, b""))
                if full < n:
                    rest = ids[full:].astype("<u2" if ids.max() < 1 << 16 else "<u4")
                    out.append((key, group, full, n - full, -1, n, rest.tobytes()))
            names = ["doc_id", "group", "start", "length", "crc", "doc_tokens", "ids"]
            yield pd.DataFrame(out, columns=names)

    return over


def _packer(room: int):
    def step(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(
            ["doc_id", "start", "doc_tokens", "ids"], na_position="first", kind="stable"
        ).reset_index(drop=True)
        rests = np.flatnonzero(part["crc"].to_numpy() < 0)
        fulls = np.flatnonzero(part["crc"].to_numpy() >= 0)
        keys, ids = part["doc_id"].tolist(), part["ids"].tolist()
        starts, sizes = part["start"].tolist(), part["doc_tokens"].tolist()
        lengths, crcs = part["length"].tolist(), part["crc"].tolist()
        first = int(part["group"].iloc[0]) << 40
        out = []
        for number, i in enumerate(fulls.tolist()):
            out.append((keys[i], starts[i], lengths[i], crcs[i], sizes[i], first + (1 << 39) + number, 0))
        for number, pieces in enumerate(first_fit([lengths[i] for i in rests], room)):
            offset = 0
            for item, start, length in pieces:
                i = int(rests[item])
                width = "<u2" if len(ids[i]) == 2 * lengths[i] else "<u4"
                own = np.frombuffer(ids[i], dtype=width)[start : start + length].astype("<u4")
                out.append(
                    (keys[i], starts[i] + start, length, zlib.crc32(own.tobytes()), sizes[i], first + number, offset)
                )
                offset += length
        return pd.DataFrame(out, columns=[f.split()[0] for f in PIECES.split(", ")])

    return runs(["group"], step)


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    ranks: str | None = None,
    group_docs: int = GROUP_DOCS,
) -> DataFrame:
    """The pieces of all rows of ``docs`` in sequences of at most ``length`` tokens.

    One row per piece: ``doc_id`` (the row's ``key``), ``start`` (its document's tokens
    before it), ``length``, ``ids_crc32`` (of its ids as little-endian 32-bit
    integers), ``doc_tokens``, ``sequence_id`` and ``offset`` there. Every document ends
    with the id 1, so a null or empty text is one piece of one token. Rows with equal or
    null keys are documents of their own. Very long texts are cut as they are read; only
    their last rest is packed. An empty table gives an empty result.

    Ids are those of ``tokenizers`` with ``add_special_tokens=False``, those of the added
    tokens' strings included.

    ``ranks`` is the vocabulary's ``.tiktoken`` file, at a path that every executor has,
    with the tokenizer's ``.json`` beside it.
    """
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    groups = max(1, -(-docs.count() // group_docs))
    rows = docs.select(
        F.col(key).cast("string").alias("doc_id"),
        text_of(text).alias("text"),
        F.pmod(F.xxhash64(F.col(key), F.length(text_of(text))), F.lit(groups)).alias("group"),
    )
    pieces = rows.mapInPandas(
        _tokenised(path, length, groups),
        "doc_id string, group long, start long, length long, crc long, doc_tokens long, ids binary",
    )
    return (
        pieces.repartition("group")
        .sortWithinPartitions("group")
        .mapInPandas(_packer(length), PIECES)
        .withColumn("doc_id", F.col("doc_id").cast(docs.schema[key].dataType))
    )


def op3_pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return pack(documents(spark, folder))


QUERIES = {"op3_pack_sequences": op3_pack_sequences}
SQL: dict[str, str] = {}
