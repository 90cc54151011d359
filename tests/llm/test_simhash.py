from __future__ import annotations

import re

import numpy as np
import xxhash
from quern.llm import simhash
from tests.llm.rough import no_documents, rough_documents, small_documents


def fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", lower) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: list[int], bits: int = 2) -> list[int]:
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= bits:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [fingerprint(r["text"]) for r in rows]
    groups = components(prints)
    smallest = {}
    for r, g in zip(rows, groups):
        if r["doc_id"] is not None:
            smallest[g] = min(smallest.get(g, r["doc_id"]), r["doc_id"])
    wanted = sorted(
        ((r["doc_id"], f"{p:016x}", smallest.get(g)) for r, p, g in zip(rows, prints, groups)), key=repr
    )
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr) == wanted
    return groups


def test_small_table(spark):
    check(small_documents(spark))


def test_rough_rows(spark):
    docs = rough_documents(spark)
    groups = check(docs)
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(groups))


def test_empty_table(spark):
    assert simhash.near_duplicates(no_documents(spark)).count() == 0
    assert simhash.one_per_group(no_documents(spark)).count() == 0


def test_links_connect_what_all_pairs_would(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 6, dtype=np.int64)
    prints = set(centres.tolist())
    for c in centres.tolist():
        for _ in range(150):  # chains of small steps away from a centre
            at = c
            for bit in rng.integers(0, 63, rng.integers(1, 6)).tolist():
                at ^= 1 << bit
                prints.add(at)
    prints = sorted(prints)
    table = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(5)
    wanted = components([p & (1 << 64) - 1 for p in prints])
    for chunk in (16, 4096):
        links = simhash.links(table, chunk=chunk).collect()
        place = {p: i for i, p in enumerate(prints)}
        assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in links)
        root = list(range(len(prints)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for r in links:
            x, y = find(place[r.a]), find(place[r.b])
            root[max(x, y)] = min(x, y)
        assert [find(i) for i in range(len(prints))] == wanted
        # Never all pairs of a group: a forest for each pair of chunks.
        assert len(links) < 40 * len(prints)
