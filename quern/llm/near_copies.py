"""Near copies by SimHash: found through a table of pivots, verified on their shingle sets.

Two texts are linked where the sets of their five-word shingles have a similarity of 0.8
or more; linked texts form groups. At 0.8 two SimHash fingerprints differ in some 15 % of
their bits, so operator 1's 64 bits in blocks, of which some are sure to agree, would find
all pairs or lose links. This stage takes more bits and nearer pivots:

1. Texts with equal shingle sets are one set from here on, however many there are. Sets are
   told apart by 128-bit digests, and numbered.
2. A set's fingerprint has 512 bits, each the majority of one bit of its shingles' hashes.
3. The distances of every fingerprint to fixed reference fingerprints (pivots) are computed
   once. A bit weighs as much as its majority, so bits that a small edit can turn count
   little. Pivots are in 48 groups of 64 and their 64 complements; the nearest of each group
   is the set's row of the pivot table.
4. Sets whose rows agree in one of 64 pairs of groups, and whose fingerprints differ in at
   most 36 of their first 128 bits, are candidates. What the candidates of a key
   connect is passed on as links to its smallest set, and the links' components are clusters.
5. Within a cluster the sets themselves are compared. Pairs that are connected already are
   passed over, and those with sizes or fingerprints too far apart. A link is always exact.

In simulated pairs at exactly 0.8 at most 0.0002 had no pair of groups in common; by
calculation 36 bits miss 0.00005 more, of texts with five shingles 0.0035. Distances to
pivots differ too little between any two sets to discard pairs by the triangle inequality
at this similarity, as operator 1 does at two bits; here the table proposes them.

Texts are cut into shingles once, and those of candidates again; elsewhere they are known by
a digest. Keys and clusters of many sets are cut into chunks, and each pair of chunks is a
piece of work of its own, so no task holds more than two chunks of one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import components, dealt, runs, text_of
from quern.llm.simhash import _forest, grouped, one_of_each
from quern.sources import write_through

#: Words of a shingle, the similarity of linked sets, and the bits between candidates, of
#: the first 128.
WORDS = 5
SIMILARITY = 0.8
MAX_BITS = 36

#: 64-bit words of a fingerprint.
PRINT = 8

#: Groups of pivots, those of a group (as many complements beside them), and pairs of groups.
GROUPS = 48
PIVOTS = 64
PAIRS = 64

#: Sets of a key, and of a cluster, that are compared at a time, and the latter's bytes.
KEY_CHUNK = 1024
CHUNK = 256
CHUNK_BYTES = 16 << 20

#: Sets of a key up to which it is compared together with others.
FEW = 32

#: Shingles whose bits are counted at a time (in a byte), and rows of the table made at a time.
_BLOCK = 255
_ROWS = 256


def _pivots() -> np.ndarray:
    """The pivots of all groups in columns, bits as 1 and -1."""
    digests = [
        xxhash.xxh64_intdigest(f"pivot {i}", w) for i in range(GROUPS * PIVOTS) for w in range(PRINT)
    ]
    bits = np.unpackbits(np.array(digests, dtype=np.uint64).view(np.uint8))
    return 2 * bits.reshape(-1, 64 * PRINT).T.astype(np.float32) - 1


def _group_pairs() -> list[tuple[int, int]]:
    """Pairs of groups, different ones, each group in about as many."""
    steps = range(1, GROUPS)
    every = [(x, x + s) for s in steps for x in range(GROUPS - s)]
    every.sort(key=lambda p: xxhash.xxh64_intdigest(f"pair {p[0]} {p[1]}", 0))
    used, out = [0] * GROUPS, []
    while len(out) < PAIRS:
        pair = min(every, key=lambda p: used[p[0]] + used[p[1]])
        every.remove(pair)
        out.append(pair)
        used[pair[0]] += 1
        used[pair[1]] += 1
    return out


_PIVOTS = _pivots()
GROUP_PAIRS = _group_pairs()


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted, distinct hashes of a text's shingles; one of all its words if they are few."""
    tokens = text.encode().lower().split()  # bytes: only A-Z change, ASCII spaces split
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(tokens) < words:
        return np.array([digest(join(tokens), 42)], dtype=np.uint64)
    rows = zip(*(tokens[i:] for i in range(words)))
    return np.unique(np.fromiter((digest(join(s), 42) for s in rows), dtype=np.uint64))


def _hash_words(hashes: np.ndarray) -> np.ndarray:
    """Each hash, and more words mixed from it (splitmix64), in a row."""
    z = hashes[:, None] + np.arange(PRINT, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    z[:, 0] = hashes
    return z


def majorities(hashes: np.ndarray) -> np.ndarray:
    """For each bit, how many more of the hashes have it set than not."""
    counts = np.zeros(64 * PRINT, dtype=np.int64)
    for low in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(_hash_words(hashes[low : low + _BLOCK]).view(np.uint8), axis=1)
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return 2 * counts - len(hashes)


def nearest(sums: np.ndarray) -> np.ndarray:
    """Rows of the pivot table: in each group the nearest pivot's number, twice, odd if it
    is not the complement. ``sums`` are majorities, a set in a row.

    A bit's weight in the distance is its majority's size. So the distance to a pivot is
    half of what the product with it (bits as 1 and -1) falls short of all weights, and the
    largest product, in size, belongs to the nearest pivot or complement.
    """
    out = np.empty((len(sums), GROUPS), dtype=np.int8)
    for low in range(0, len(sums), _ROWS):
        products = (sums[low : low + _ROWS].astype(np.float32) @ _PIVOTS).reshape(-1, GROUPS, PIVOTS)
        first = np.abs(products).argmax(axis=2)
        found = np.take_along_axis(products, first[:, :, None], axis=2)[:, :, 0]
        out[low : low + _ROWS] = 2 * first + (found > 0)
    return out


def _sketches(text: str, words: int):
    @F.pandas_udf("digest binary, high long, low long, row array<byte>")
    def of(texts: pd.Series) -> pd.DataFrame:
        digests, sums = [], np.zeros((len(texts), 64 * PRINT), dtype=np.int32)
        for n, t in enumerate(texts):
            hashes = shingles(t, words)
            digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            sums[n] = majorities(hashes)
        prints = np.packbits(sums[:, :128] > 0, axis=1).view(np.int64)
        return pd.DataFrame(
            {"digest": digests, "high": prints[:, 0], "low": prints[:, 1], "row": list(nearest(sums))}
        )

    return of(text_of(text))


def text_digest(text: str) -> Column:
    """128 bits of a text; a null one is empty."""
    return F.unhex(F.md5(text_of(text).cast("binary")))


def sketched(docs: DataFrame, key: str, text: str, words: int) -> tuple[DataFrame, DataFrame]:
    """``(digest, mark)`` of texts, and their sets ``(digest, sid, first, mark, high, low, row)``.

    ``mark`` is the digest of a text, of a set that of a text of its first row. ``sid`` is a
    set's number and ``first`` its smallest key, ``high`` and ``low`` are the first 128 bits of
    its fingerprint and ``row`` is its row of the pivot table.
    """
    rows = docs.select(F.col(key).alias("id"), text_digest(text).alias("mark"), _sketches(text, words).alias("s"))
    own = write_through(rows.select("id", "mark", "s.*"))
    sets = own.groupBy("digest").agg(
        F.min("id").alias("first"),
        F.min(F.struct(F.col("id").isNull(), "id", "mark"))["mark"].alias("mark"),
        *(F.first(c).alias(c) for c in ("high", "low", "row")),
    )
    numbered = write_through(sets.withColumn("sid", F.monotonically_increasing_id()))
    return own.select("digest", "mark").distinct(), numbered


def _sets(words: int):
    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, words).tobytes() for t in texts])

    return of(F.col("text"))


def _in_chunks(rows: DataFrame, key: str, chunks: DataFrame) -> DataFrame:
    """``rows`` by pairs ``(i, j)`` of their key's chunks; ``side`` tells the two apart.

    A key that ``chunks`` does not name is one chunk.
    """
    mine = F.pmod(F.xxhash64(F.lit("chunk"), "sid"), F.col("chunks")).cast("int")
    return (
        rows.join(chunks, key, "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            *rows.columns,
            F.least("mine", "other").alias("i"),
            F.greatest("mine", "other").alias("j"),
            (F.col("mine") < F.col("other")).cast("int").alias("side"),
        )
    )


def _compared(work: DataFrame, key: str, over: Callable) -> DataFrame:
    return (
        dealt(work, key, "i", "j")
        .sortWithinPartitions(key, "i", "j", "sid")
        .mapInPandas(over, "a long, b long")
    )


def _prints(part: pd.DataFrame) -> np.ndarray:
    return np.stack([part["high"].to_numpy(), part["low"].to_numpy()]).view(np.uint64)


def _close(part: pd.DataFrame, bits: int) -> np.ndarray:
    """Which rows' fingerprints are within ``bits``, and of two chunks if there are two."""
    high, low = _prints(part)
    near = np.bitwise_count(high[:, None] ^ high[None, :])
    near += np.bitwise_count(low[:, None] ^ low[None, :])
    near = near <= bits
    if part["i"].iloc[0] != part["j"].iloc[0]:
        side = part["side"].to_numpy()
        near &= side[:, None] != side[None, :]
    np.fill_diagonal(near, False)
    return near


def _root(root: list[int] | dict[int, int], x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _near_few(part: pd.DataFrame, ends: np.ndarray, few: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Pairs within ``bits`` of the rows ``few``, whose keys go on to ``ends``."""
    high, low = _prints(part)
    side, one = part["side"].to_numpy(), (part["i"] == part["j"]).to_numpy()
    pairs = []
    for step in range(1, FEW):
        few = few[few + step < ends[few]]
        if not len(few):
            break
        other = few + step
        near = np.bitwise_count(high[few] ^ high[other]) + np.bitwise_count(low[few] ^ low[other]) <= bits
        near &= one[few] | (side[few] != side[other])
        pairs += zip(few[near].tolist(), other[near].tolist())
    return pairs


def _stars(pairs: list[tuple[int, int]]) -> np.ndarray:
    """What ``pairs`` connect, each number linked to the smallest one."""
    root = {x: x for pair in pairs for x in pair}
    for a, b in pairs:
        x, y = _root(root, a), _root(root, b)
        root[max(x, y)] = min(x, y)
    out = [(_root(root, x), x) for x in root]
    return np.array([pair for pair in out if pair[0] != pair[1]], dtype=np.int64).reshape(-1, 2)


def _candidates_of(bits: int):
    """For mapInPandas over rows sorted by key and number: links that connect a key's candidates.

    They go to the smallest number, so that a group found by many keys gets few different links.
    """

    def step(part: pd.DataFrame) -> pd.DataFrame:
        new = np.ones(len(part), dtype=bool)
        keys = part[["key", "i", "j"]].to_numpy()
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        starts = np.flatnonzero(new)
        sizes = np.diff(starts, append=len(part))
        ends = np.repeat(starts + sizes, sizes)
        found = _near_few(part, ends, np.flatnonzero(np.repeat(sizes <= FEW, sizes)), bits)
        for low, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
            near = _close(part.iloc[low : low + n], bits)
            found += [(low + a, low + b) for a, b in _forest(near)]
        ids, linked = part["sid"].to_numpy(), _stars(found)
        return pd.DataFrame({"a": ids[linked[:, 0]], "b": ids[linked[:, 1]]})

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for frame in frames:
            if not len(frame):
                continue
            kept = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            keys = kept[["key", "i", "j"]].to_numpy()
            last = int((keys != keys[-1]).any(axis=1).sum())  # sorted: the last key's first row
            if last:
                yield step(kept.iloc[:last].reset_index(drop=True))
                kept = kept.iloc[last:].reset_index(drop=True)
        if kept is not None:
            yield step(kept)

    return over


def _verified_of(bits: int, similarity: float):
    def step(part: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(s, dtype=np.uint64) for s in part["set"]]
        sizes = np.array([len(s) for s in sets])
        near = _close(part, bits)
        near &= np.minimum.outer(sizes, sizes) >= similarity * np.maximum.outer(sizes, sizes) - 1e-9
        root = list(range(len(sets)))
        ids, out = part["sid"].tolist(), []
        for a, b in np.argwhere(np.triu(near)).tolist():
            x, y = _root(root, a), _root(root, b)
            if x == y:
                continue
            common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if common >= similarity * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                root[y] = x
                out.append((ids[a], ids[b]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return runs(["root", "i", "j"], step)


def keyed(prints: DataFrame) -> DataFrame:
    """``(key, sid, high, low)``: each set by its keys, a key for each pair of groups."""
    keys = [
        F.lit(n * 4 * PIVOTS * PIVOTS) + F.get("row", F.lit(x)).cast("int") * (2 * PIVOTS) + F.get("row", F.lit(y))
        for n, (x, y) in enumerate(GROUP_PAIRS)
    ]
    return prints.select(F.explode(F.array(*keys)).alias("key"), "sid", "high", "low")


def contracted(found: DataFrame) -> DataFrame:
    """Fewer ``(a, b)`` that connect what ``found (a, b)`` connects.

    A set is linked once, to the smallest ``a`` that any of its keys has, and that one to the
    others, which are the same few for all sets of a group.
    """
    found = write_through(found.distinct())
    least = found.groupBy("b").agg(F.min("a").alias("m"))
    others = found.join(least, "b").filter(F.col("a") != F.col("m")).select("m", "a").distinct()
    return least.select(F.col("m").alias("a"), "b").unionByName(others.toDF("a", "b"))


def links(
    docs: DataFrame,
    prints: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    max_bits: int = MAX_BITS,
    chunk: int = CHUNK,
) -> DataFrame:
    """``(a, b)``: verified links between sets, by number, of :func:`sketched` ``docs``.

    They connect what all candidate pairs of that similarity would connect.
    """
    cells = keyed(prints)
    large = write_through(  # so that the join with it can split a large key
        cells.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > KEY_CHUNK)
        .select("key", F.ceil(F.col("n") / KEY_CHUNK).cast("int").alias("chunks"))
    )
    candidates = _compared(_in_chunks(cells, "key", large), "key", _candidates_of(max_bits))
    clusters = write_through(components(contracted(candidates)).withColumnRenamed("node", "sid"))
    members = write_through(clusters.join(prints.select("sid", "high", "low", "first", "mark"), "sid"))
    # Mostly one row a set by now; the aggregate also holds for many repeated rows.
    texts = (
        docs.select(F.col(key).alias("id"), text_of(text).alias("text"), text_digest(text).alias("mark"))
        .join(members, "mark")
        .filter(F.col("id").eqNullSafe(F.col("first")))
        .groupBy("sid", "root", "high", "low")
        .agg(F.min("text").alias("text"))
    )
    sets = write_through(texts.select("sid", "root", "high", "low", _sets(words).alias("set")))
    by_bytes = F.ceil(F.sum(F.length("set")) / CHUNK_BYTES)
    parts = write_through(
        sets.groupBy("root").agg(
            F.greatest(F.ceil(F.count(F.lit(1)) / chunk), by_bytes).cast("int").alias("chunks")
        )
    )
    return _compared(_in_chunks(sets, "root", parts), "root", _verified_of(max_bits, similarity))


def one_per_group(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    max_bits: int = MAX_BITS,
    chunk: int = CHUNK,
) -> DataFrame:
    """The rows of ``docs`` less near copies: one row of each group stays.

    It is the row with the group's smallest key; of several rows with that key, the
    smallest row by its text and then its other columns. The columns are unchanged. Texts
    without words are copies of each other; a text of fewer than ``words`` words has one
    shingle, the whole sequence. An empty table gives an empty result.
    """
    marks, prints = sketched(docs, key, text, words)
    found = links(docs, prints, key, text, words, similarity, max_bits, chunk)
    groups = grouped(prints.select(F.col("first").alias("id"), F.col("sid").alias("fp")), linked=found)
    # By text, so that no text is cut into shingles to find its group.
    named = prints.select("digest", F.col("sid").alias("fp")).join(groups, "fp").drop("fp")
    of_text = marks.join(named, "digest").select(F.col("mark").alias("fp"), "root", "component")
    return one_of_each(docs, write_through(of_text), text_digest(text).alias("fp"), key, text)
