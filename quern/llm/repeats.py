"""Repeated passages, found with suffix arrays over shards of anchored contexts.

A byte is removed if some ``window``-byte string that covers it also starts elsewhere.
Sorting every suffix of every text against all others is not possible shard by shard,
so strings are first brought together by anchors:

1. Every window contains an anchor, the ``GRAM``-byte string with the smallest hash
   in it, and equal windows have equal anchors at equal offsets (winnowing). Anchors
   are counted; one that occurs once rules out every window around it.
2. An anchor's context is all bytes that windows containing it can cover. Where a
   whole context occurs twice, all of its windows do. This settles most copies.
3. The remaining distinct contexts go to shards by anchor. A shard builds suffix arrays
   of the texts after the anchors and, reversed, before them, as strings of 8-byte
   symbols: ranks of one symbol are refined to ranks of 2, 4, ... symbols, within
   groups that are still tied only (Larsson and Sadakane). Kasai's scan gives the
   common prefixes of neighbours, run down all contexts side by side. A window with
   ``o`` bytes before the anchor then occurs in two contexts if they are in one class
   both after the anchor, to depth ``window - o``, and before it, to depth ``o``.
4. The contexts of a very frequent anchor are dealt to several shards. A shard sends one
   digest for each distinct window of such an anchor to a merge, which sorts the
   digests of each bucket and finds those of other shards by binary search.

Each step is exact; hashes (64 bits twice over, or 128) only decide what meets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import ROW, dealt, documents, rows_in_structs, runs, text_of
from quern.sources import write_through

#: Bytes of a repeated string, and of an anchor.
WINDOW = 200
GRAM = 32

#: Contexts of one anchor that one shard takes, and contexts sorted at a time.
PER_SHARD = 50_000
SORTED = 16_000

#: Digests of a bucket of the merge, on average.
PER_BUCKET = 5_000

#: Bytes hashed at a time, and rows that tasks gather before they pass them on.
_BLOCK = 1 << 19
_ROWS = 50_000
_MARKS = 1_000_000

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base, and of its inverse, modulo 2^64."""
    if not _POWERS:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(_BLOCK + 4 * WINDOW + 4096, base, dtype=np.uint64)
            row[0] = 1
            _POWERS[name] = np.cumprod(row)
    return _POWERS["up"], _POWERS["down"]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each position; up to a block of ``data``."""
    up, down = _powers()
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    out = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def _sliding(best, values: np.ndarray, width: int) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        values = best(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return best(values[:-rest], values[rest:]) if rest else values


def anchor_blocks(
    text: bytes, window: int = WINDOW, gram: int = GRAM
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and hashes of the anchors of ``text``, in order, a block at a time.

    A position is an anchor if its hash is the smallest of some window around it; equal
    smallest hashes are all anchors, so the choice depends on a window's bytes alone.
    """
    width = window - gram + 1
    last = len(text) - window  # of the windows
    at, mark = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for low in range(0, last + 1, _BLOCK):
        high = min(last + 1, low + _BLOCK)  # windows from low to high
        data = np.frombuffer(text, np.uint8, high - 1 + window - low, low)
        hashes = gram_hashes(data, gram)
        least = _sliding(np.minimum, hashes, width)
        edge = np.zeros(width - 1, dtype=np.uint64)
        most = _sliding(np.maximum, np.concatenate([edge, least, edge]), width)
        own = np.flatnonzero(hashes == most)
        at, mark = np.concatenate([at, own + low]), np.concatenate([mark, hashes[own]])
        if low:  # the end of one block's windows is the start of the next one's
            at, first = np.unique(at, return_index=True)
            mark = mark[first]
        done = len(at) if high > last else int(np.searchsorted(at, high))
        yield at[:done], mark[:done]
        at, mark = at[done:], mark[done:]


def anchors(text: bytes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all anchors of ``text``."""
    found = [*anchor_blocks(text, window, gram)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def placed_contexts(
    text: bytes, window: int = WINDOW, gram: int = GRAM
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors' hashes, contexts' hashes, first and last position and number, a block at a time.

    Equal contexts that follow each other within a window, as in text that repeats a few
    bytes, are one entry: the stretches they cover are one. So a text of one letter has
    hardly more entries than any other.
    """
    digest, side = xxhash.xxh3_64_intdigest, window - gram
    for at, mark in anchor_blocks(text, window, gram):
        if not len(at):
            continue
        context = np.fromiter(
            (digest(text[max(0, p - side) : p + window], min(p, side)) for p in at.tolist()),
            np.uint64,
            len(at),
        )
        order = np.lexsort((at, context, mark))
        at, mark, context = at[order], mark[order], context[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (mark[1:] != mark[:-1]) | (context[1:] != context[:-1]) | (np.diff(at) > window)
        first = np.flatnonzero(new)
        number = np.diff(first, append=len(at))
        yield mark[first], context[first], at[first], at[first + number - 1], number


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of the rows of ``symbols``, each a string of its own.

    Suffix ``row * width + column``; a suffix that ends first comes first. Suffixes that
    are equal to their ends stay in groups of one rank.
    """
    rows, width = symbols.shape
    flat = symbols.ravel()
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    heads = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    start = np.maximum.accumulate(np.where(heads, np.arange(len(flat)), 0))
    rank = np.empty(len(flat), dtype=np.int64)
    rank[order] = start + 1
    column = np.tile(np.arange(width), rows)
    tied = np.arange(len(flat))
    depth = 1
    while True:
        alone = np.concatenate([heads, [True]])
        tied = tied[~(alone[:-1] & alone[1:])]  # groups of one are in place
        if not len(tied) or depth >= width:
            return order
        own = order[tied]
        beyond = column[own] + depth < width
        after = np.where(beyond, rank[np.where(beyond, own + depth, 0)], 0)
        key = rank[own] * (len(flat) + 1) + after
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[tied] = own
        heads = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.maximum.accumulate(np.where(heads, tied, 0))
        rank[own] = start + 1
        depth *= 2


def common_prefixes(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Symbols that each suffix shares with the one before it in ``order`` (Kasai).

    From one column to the next a common prefix shrinks by at most one symbol, so each
    row's scan goes on from there; all rows are scanned side by side.
    """
    rows, width = symbols.shape
    flat = symbols.ravel()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    out = np.zeros(len(order), dtype=np.int64)
    shared = np.zeros(rows, dtype=np.int64)
    for column in range(width):
        own = np.arange(rows) * width + column
        at = place[own]
        before = order[np.maximum(at - 1, 0)]
        room = np.minimum(width - column, width - before % width)
        shared = np.where(at > 0, np.minimum(np.maximum(shared - 1, 0), room), 0)
        going = np.flatnonzero((at > 0) & (shared < room))
        while len(going):
            equal = flat[own[going] + shared[going]] == flat[before[going] + shared[going]]
            going = going[equal]
            shared[going] += 1
            going = going[shared[going] < room[going]]
        out[at] = shared
    return out


def depths(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix, and the bytes each shares with the one before."""
    symbols = texts.view(">u8").astype(np.uint64)
    width = symbols.shape[1]
    order = suffix_order(symbols)
    shared = common_prefixes(symbols, order)
    whole = np.flatnonzero(order % width == 0)
    rows = order[whole] // width
    # Between neighbours among whole rows: the least of all suffixes in between.
    bounds = np.concatenate([[0], whole[:-1] + 1])
    common = np.minimum.reduceat(shared[: whole[-1] + 1], bounds)
    common[0] = 0
    out = 8 * common
    part = np.flatnonzero(common < width)
    part = part[part > 0]
    differ = symbols[rows[part], common[part]] ^ symbols[rows[part - 1], common[part]]
    # Whole bytes equal before the first that differs.
    level = np.zeros(len(part), dtype=np.int64)
    for byte in range(1, 8):
        level += differ < (np.uint64(1) << np.uint64(64 - 8 * byte))
    out[part] += level
    out[0] = 0
    return rows, out


def _classes(rows: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """A number for each row, equal for rows that agree to ``depth`` bytes."""
    out = np.empty(len(rows), dtype=np.int64)
    out[rows] = np.cumsum(shared < depth)
    return out


def repeated_windows(
    left: np.ndarray, right: np.ndarray, bodies: list[bytes], window: int, gram: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each offset: the offset, contexts with such a window, and its class in each.

    ``bodies`` are contexts of ``left`` bytes, the anchor, and ``right`` bytes.
    """
    side = window - gram
    pad = lambda n: -(-n // 8) * 8
    after = np.zeros((len(bodies), pad(window)), dtype=np.uint8)
    before = np.zeros((len(bodies), pad(side)), dtype=np.uint8)
    for i, (l, body) in enumerate(zip(left.tolist(), bodies)):
        data = np.frombuffer(body, np.uint8)
        after[i, : len(data) - l] = data[l:]
        before[i, :l] = data[:l][::-1]
    after_rows, after_shared = depths(after)
    before_rows, before_shared = depths(before)
    for o in range(side + 1):
        have = np.flatnonzero((left >= o) & (right >= side - o))
        if len(have):
            a = _classes(after_rows, after_shared, window - o)
            b = _classes(before_rows, before_shared, o) if o else np.zeros(len(left), np.int64)
            yield o, have, (a * (len(left) + 1) + b)[have]


def _counted(window: int, gram: int):
    """Anchor hashes of texts with their number, added up per batch."""

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def table(marks: list[np.ndarray], times: list[np.ndarray]) -> pd.DataFrame:
            values, at = np.unique(np.concatenate(marks), return_inverse=True)
            count = np.bincount(at, np.concatenate(times), len(values))
            return pd.DataFrame({"h": values.view(np.int64), "c": count.astype(np.int64)})

        for frame in frames:
            marks, times, rows = [], [], 0
            for text, copies in zip(frame["text"], frame["copies"]):
                for _, mark in anchor_blocks(text.encode(), window, gram):
                    own, number = np.unique(mark, return_counts=True)
                    marks.append(own)
                    times.append(number * copies)
                    rows += len(own)
                    if rows > _MARKS:
                        yield table(marks, times)
                        marks, times, rows = [], [], 0
            if marks:
                yield table(marks, times)

    return over


def _placed(window: int, gram: int):
    """Anchors of texts: hash, hash of the context, first and last position of a run."""

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def table(parts: list[tuple]) -> pd.DataFrame:
            n = [len(p[3]) for p in parts]
            whole = lambda i: np.concatenate([p[i] for p in parts])
            each = lambda i: np.repeat(np.array([p[i] for p in parts]), n)
            return pd.DataFrame(
                {
                    "h": whole(3).view(np.int64),
                    "context": whole(4).view(np.int64),
                    "tid": each(0),
                    "size": each(1),
                    "pos": whole(5),
                    "last": whole(6),
                    "copies": each(2) * whole(7),
                }
            )

        for frame in frames:
            parts, rows = [], 0
            for tid, size, text, copies in zip(
                frame["tid"].tolist(), frame["size"].tolist(), frame["text"], frame["copies"].tolist()
            ):
                for found in placed_contexts(text.encode(), window, gram):
                    parts.append((tid, size, copies, *found))
                    rows += len(found[0])
                    if rows > _ROWS:
                        yield table(parts)
                        parts, rows = [], 0
            if parts:
                yield table(parts)

    return over


def _bodies(window: int, gram: int):
    """The bytes of the listed contexts of each text."""

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        side = window - gram
        lists = ["h", "context", "once", "shards", "pos"]

        def table(parts: list[tuple], bodies: list[bytes]) -> pd.DataFrame:
            columns = {c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(lists)}
            at = columns.pop("pos")
            columns["before"] = np.minimum(at, side)
            return pd.DataFrame({**columns, "body": bodies})

        for frame in frames:
            parts, bodies = [], []
            for row in zip(frame["text"], *(frame[c] for c in lists)):
                body = row[0].encode()
                for low in range(0, len(row[-1]), _ROWS):
                    part = [c[low : low + _ROWS] for c in row[1:]]
                    bodies += [body[max(0, p - side) : p + window] for p in part[-1].tolist()]
                    parts.append(part)
                    if len(bodies) > _ROWS:
                        yield table(parts, bodies)
                        parts, bodies = [], []
            if parts:
                yield table(parts, bodies)

    return over


def _sorted_shards(window: int, gram: int, at_once: int):
    """Suffix arrays of contexts, whole shards at a time.

    Yields ``(h, context, lo, hi)``: windows found twice cover the bytes from ``lo``
    before the anchor to ``hi`` after its start. For an anchor with several shards also
    ``digest`` rows: for each distinct window its digest and, where it occurs once,
    its context and offset.
    """

    names = ["h", "context", "lo", "hi", "digest"]

    def shard(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        left = part["before"].to_numpy(dtype=np.int64)
        bodies = part["body"].tolist()
        right = np.array([len(b) for b in bodies], dtype=np.int64) - left - gram
        once = part["once"].to_numpy(dtype=bool)
        spread = part["shards"].to_numpy() > 1
        h, context = part["h"].to_numpy(), part["context"].to_numpy()
        lo = np.full(len(part), -1, dtype=np.int64)
        hi = np.full(len(part), -1, dtype=np.int64)
        for o, have, key in repeated_windows(left, right, bodies, window, gram):
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            heads = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            alone = heads & np.concatenate([heads[1:], [True]])
            twice = have[order[~alone]]
            lo[twice] = np.maximum(lo[twice], o)
            hi[twice] = np.maximum(hi[twice], window - o)
            first = have[order[heads]]
            first = first[spread[first]]
            for low in range(0, len(first), _ROWS):
                # With its place around the anchor: a window is also in other contexts.
                some = first[low : low + _ROWS]
                starts = (left[some] - o).tolist()
                marks = [
                    xxhash.xxh3_128_digest(b"%d %d " % (h[i], o) + bodies[i][a : a + window])
                    for i, a in zip(some.tolist(), starts)
                ]
                told = {"h": h[some], "context": context[some], "lo": o, "hi": -1, "digest": marks}
                yield pd.DataFrame(told)[names]
        found = np.flatnonzero((lo >= 0) & once)
        out = pd.DataFrame({"h": h[found], "context": context[found], "lo": lo[found], "hi": hi[found]})
        out["digest"] = None
        yield out

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame()
        for frame in frames:
            kept = pd.concat([kept, frame], ignore_index=True)
            # The last shard may go on in the next batch.
            while len(kept) >= at_once:
                last = (kept["h"] == kept["h"].iloc[-1]) & (kept["sub"] == kept["sub"].iloc[-1])
                whole = len(kept) - int(last.sum())
                if not whole:
                    break
                yield from shard(kept.iloc[:whole].reset_index(drop=True))
                kept = kept.iloc[whole:].reset_index(drop=True)
        if len(kept):
            yield from shard(kept)

    return over


def _merge(part: pd.DataFrame) -> pd.DataFrame:
    """Digests that several shards have, found by binary search."""
    both = np.frombuffer(b"".join(part["digest"].tolist()), dtype=">u8").reshape(-1, 2)
    order = np.lexsort((both[:, 1], both[:, 0]))
    first = both[order, 0].astype(np.uint64)
    low = np.searchsorted(first, both[:, 0].astype(np.uint64), "left")
    high = np.searchsorted(first, both[:, 0].astype(np.uint64), "right")
    twice = np.zeros(len(part), dtype=bool)
    for i in np.flatnonzero(high - low > 1).tolist():
        same = both[order[low[i] : high[i]], 1] == both[i, 1]
        twice[i] = int(same.sum()) > 1
    return part.loc[twice, ["h", "context", "lo"]]


def covered(texts: DataFrame, window: int, gram: int, per_shard: int) -> DataFrame:
    """``(tid, size, lo, hi)``: stretches of texts whose bytes are to be removed.

    ``texts``: distinct ``(tid, size, text, copies)``. Stretches overlap.
    """
    side = window - gram
    # What has been added up by a join's key is written before the join: then the join is
    # a plain one, and Spark can split the rows of a key that very many texts have.
    counts = write_through(
        texts.mapInPandas(_counted(window, gram), "h long, c long")
        .groupBy("h")
        .agg(F.sum("c").alias("c"))
        .filter(F.col("c") > 1)
        .select("h")
    )
    placed = texts.mapInPandas(
        _placed(window, gram),
        "h long, context long, tid long, size int, pos int, last int, copies long",
    )
    found = write_through(placed.join(counts, "h"))
    contexts = write_through(
        found.groupBy("h", "context").agg(
            F.sum("copies").alias("copies"),
            F.min(F.struct("tid", "size", "pos")).alias("at"),
        )
    )
    once = F.col("copies") == 1
    open_anchors = write_through(
        contexts.groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"), F.max(once).alias("any"))
        .filter((F.col("n") > 1) & F.col("any"))
        .select("h", F.ceil(F.col("n") / per_shard).cast("int").alias("shards"))
    )
    wanted = (
        contexts.join(open_anchors, "h")
        .groupBy(F.col("at.tid").alias("tid"), F.col("at.size").alias("size"))
        .agg(F.collect_list(F.struct("at.pos", "h", "context", once.alias("once"), "shards")).alias("wanted"))
    )
    bodies = (
        texts.select("tid", "size", "text")
        .join(wanted, ["tid", "size"])
        .select("text", *(F.col(f"wanted.{c}") for c in ("h", "context", "once", "shards", "pos")))
        .mapInPandas(
            _bodies(window, gram),
            "h long, context long, once boolean, shards int, before int, body binary",
        )
        .withColumn("sub", F.pmod(F.xxhash64("context"), F.col("shards")).cast("int"))
    )
    sorted_ = write_through(
        dealt(bodies, "h", "sub")
        .sortWithinPartitions("h", "sub")
        .mapInPandas(
            _sorted_shards(window, gram, SORTED),
            "h long, context long, lo int, hi int, digest binary",
        )
    )
    digests = sorted_.filter(F.col("digest").isNotNull())
    buckets = max(1, digests.count() // PER_BUCKET)
    merged = (
        digests.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInPandas(runs(["bucket"], _merge), "h long, context long, lo int")
        .select("h", "context", "lo", (window - F.col("lo")).alias("hi"))
    )
    partly = (
        sorted_.filter(F.col("digest").isNull())
        .select("h", "context", "lo", "hi")
        .unionByName(merged)
        .groupBy("h", "context")
        .agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    wholly = contexts.filter(~once).select(
        "h", "context", F.lit(side).alias("lo"), F.lit(window).alias("hi")
    )
    known = write_through(
        partly.join(wholly, ["h", "context"], "left_anti").unionByName(wholly)
    )
    return found.join(known, ["h", "context"]).select(
        "tid",
        "size",
        F.greatest(F.lit(0), F.col("pos") - F.col("lo")).alias("lo"),
        F.least("size", F.col("last") + F.col("hi")).alias("hi"),
    )


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What is left of texts without the stretches listed.

    ``kept``: the characters that are left; where a removal cuts one in two, its
    remaining bytes go too. ``kept_sha256`` is of the bytes as they are.
    """
    for frame in frames:
        out = []
        columns = (frame[c] for c in ("tid", "size", "text", "lo", "hi"))
        for tid, size, text, lows, highs in zip(*columns):
            body, kept, end, spans, gone = text.encode(), [], 0, 0, 0
            for low, high in zip(lows.tolist(), highs.tolist()):  # in order
                if low > end or not spans:
                    kept.append(body[end:low])
                    spans += 1
                    gone += high - low
                    end = high
                elif high > end:
                    gone += high - end
                    end = high
            kept.append(body[end:])
            digest = hashlib.sha256(b"".join(kept)).hexdigest()
            left = "".join(piece.decode("utf-8", "ignore") for piece in kept)
            out.append((tid, size, gone, spans, digest, left))
        yield pd.DataFrame(
            out, columns=["tid", "size", "n_removed", "n_spans", "kept_sha256", "kept"]
        )


def without_repeats(
    docs: DataFrame,
    text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    per_shard: int = PER_SHARD,
) -> DataFrame:
    """``(tid, size, n_removed, n_spans, kept_sha256, kept)`` of texts that lose bytes.

    Texts are told apart by a hash and their length (``tid``, ``size``; see
    :func:`text_key`); ``kept`` is what stays. Equal texts are one row here,
    and lose every byte that a window covers. A text shorter than ``window`` loses none.
    """
    keyed = docs.select(*text_key(text), text_of(text).alias("text"))
    texts = write_through(
        keyed.filter(F.col("size") >= window)
        .groupBy("tid", "size")
        .agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    )
    cuts = (
        covered(texts, window, gram, per_shard)
        .filter(F.col("hi") - F.col("lo") >= window)
        .groupBy("tid", "size")
        .agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("cuts"))
        .select("tid", "size", "cuts.lo", "cuts.hi")
    )
    return (
        texts.select("tid", "size", "text")
        .join(cuts, ["tid", "size"])
        .mapInPandas(
            _cut,
            "tid long, size int, n_removed long, n_spans long, kept_sha256 string, kept string",
        )
    )


def text_key(text: str = "text"):
    body = text_of(text)
    return F.xxhash64(body).alias("tid"), F.octet_length(body).alias("size")


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(<key>, n_bytes, n_removed, n_spans, kept_sha256)`` of every row of ``docs``.

    A null text is empty. Rows with equal or null keys are returned as they come, and
    rows with equal texts of ``WINDOW`` bytes or more repeat each other. An empty table
    gives an empty result. A very long text takes memory for a few copies of its bytes,
    however its bytes repeat.
    """
    changed = write_through(
        without_repeats(docs, text).select(
            "tid", "size", "n_removed", "n_spans", F.col("kept_sha256").alias("sha")
        )
    )
    rows = docs.select(
        F.col(key).alias("_k"), *text_key(text), F.sha2(text_of(text).cast("binary"), 256).alias("own")
    )
    return rows.join(changed, ["tid", "size"], "left").select(
        F.col("_k").alias(key),
        F.col("size").cast("long").alias("n_bytes"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("sha", "own").alias("kept_sha256"),
    )


def without_repeats_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, their texts without repeated bytes; other columns unchanged.

    Every row stays, if with an empty text.
    """
    names = docs.columns
    changed = write_through(without_repeats(docs, text).select("tid", "size", "kept"))
    rows = docs.select(rows_in_structs(docs), *text_key(text))
    joined = rows.join(changed, ["tid", "size"], "left")
    own = F.when(F.col("kept").isNull(), F.col(f"{ROW}.`{text}`")).otherwise(F.col("kept"))
    return joined.select(
        *(own.alias(c) if c == text else F.col(f"{ROW}.`{c}`").alias(c) for c in names)
    )


def op10_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that repeat for 200 bytes or more."""
    return removals(documents(spark, folder))


QUERIES = {"op10_repeated_passages": op10_repeated_passages}
SQL = {
    "op10_repeated_passages": """
WITH bodies AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), windows AS (
  SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS m
  FROM (SELECT r, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM bodies)
), twice AS (
  SELECT r, i FROM windows WHERE m IN (SELECT m FROM windows GROUP BY m HAVING count(*) > 1)
), starts AS (
  SELECT r, i,
         CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS s
  FROM twice
), runs AS (
  SELECT r, i, sum(s) OVER (PARTITION BY r ORDER BY i) AS run FROM starts
), spans AS (
  SELECT r, min(i) AS low, max(i) + 200 AS high FROM runs GROUP BY r, run
), gaps AS (
  SELECT r, low, high, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS before FROM spans
), cut AS (
  SELECT r, any_value(doc_id) AS doc_id, any_value(x) AS x, sum(high - low) AS gone, count(*) AS n,
         string_agg(substr(x, 2 * before + 1, 2 * (low - before)), '' ORDER BY low)
           || substr(any_value(x), 2 * max(high) + 1) AS kept
  FROM gaps JOIN bodies USING (r)
  GROUP BY r
)
SELECT b.doc_id, CAST(len(b.x) // 2 AS BIGINT) AS n_bytes,
       CAST(coalesce(c.gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(c.n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(c.kept, b.x))) AS kept_sha256
FROM bodies b LEFT JOIN cut c USING (r)
"""
}
