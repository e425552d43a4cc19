"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``2 r`` bits apart share a variant at most ``r`` bits from each.
So every distinct fingerprint stands for all its variants within ``r`` flipped bits, the
variants are shuffled, and fingerprints that meet in a variant are linked.

A 64-bit fingerprint has 2081 variants within two bits. They are dealt by their leading
bits: a fingerprint is sent once to each variant prefix it reaches (56 of 1024 prefixes
with ten bits), and the task of a prefix enumerates the variants below it, sorts them and
links those that collide. What is shuffled is thus 56 rows a fingerprint and not 2081;
the variants that meet are exactly the same. Prefixes that hold too many fingerprints (a
large group of near copies) are cut by further bits until they fit.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.llm.common import hot_join, materialize, runs, ship
from cohortlens.llm.components import connected_components, local_roots

BITS = 64
MAX_ROWS = 50_000  # fingerprints that one prefix task takes
MAX_VARIANTS = 1 << 22  # variants enumerated at a time inside a task
FIRST_BITS, MORE_BITS = 10, 6


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of a whole text as an unsigned 64-bit number (no words: 0)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 65536):  # bounded memory for very long texts
        spans = zip(starts[i:i + 65536], ends[min(shingle, len(words)) - 1 + i:][:65536])
        h = np.array([digest(line[s:e], seed) for s, e in spans], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = 4, seed: int = 42) -> Column:
    """The fingerprint as a signed long column."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64)
            yield pd.Series(fps.view(np.int64))

    return run(text)


@functools.lru_cache(maxsize=64)
def _masks(bits: int, most: int) -> list[tuple[int, int]]:
    """(mask, number of set bits) of every mask of ``bits`` bits with at most ``most`` set."""
    return [(sum(1 << i for i in c), k) for k in range(most + 1) for c in itertools.combinations(range(bits), k)]


def _deal(rows: DataFrame, done: int, more: int, radius: int) -> DataFrame:
    """Send each (prefix, fp, left) on to the prefixes ``more`` bits longer that its
    variants reach; ``left`` is how many bits may still be flipped below the prefix."""
    masks = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(k).alias("k")) for m, k in _masks(more, radius)])
    own = F.shiftrightunsigned("fp", BITS - done - more).bitwiseAND(F.lit((1 << more) - 1))
    return (rows.select("fp", "left", F.shiftleft("prefix", more).alias("prefix"), own.alias("own"),
                        F.explode(F.filter(masks, lambda x: x["k"] <= F.col("left"))).alias("x"))
            .select((F.col("prefix").bitwiseOR(F.col("own").bitwiseXOR(F.col("x.m")))).alias("prefix"), "fp",
                    (F.col("left") - F.col("x.k")).alias("left")))


def _variants(y: np.ndarray, left: np.ndarray, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All variants of the low ``bits`` of ``y`` within ``left`` flips, and whose they are."""
    zs, ids = [], []
    for k in range(radius + 1):
        masks = np.array([m for m, _ in _masks(bits, k)], dtype=np.uint64)
        at = np.flatnonzero(left == k)
        if len(at):
            zs.append((y[at, None] ^ masks).ravel())
            ids.append(np.repeat(at, len(masks)))
    return np.concatenate(zs), np.concatenate(ids)


def _size(left: np.ndarray, bits: int) -> int:
    return sum(int(c) * sum(math.comb(bits, i) for i in range(k + 1)) for k, c in enumerate(np.bincount(left)))


def _colliding(fps: np.ndarray, left: np.ndarray, bits: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (as indices) between fingerprints that share a variant below one prefix, in
    pieces of at most MAX_VARIANTS variants: larger sets are cut by the next four bits."""
    if len(fps) < 2:
        return
    if bits > 8 and _size(left, bits) > MAX_VARIANTS:
        cut = 4
        part = (fps >> np.uint64(bits - cut)) & np.uint64((1 << cut) - 1)
        for v in range(1 << cut):
            rest = left - np.bitwise_count(part ^ np.uint64(v)).astype(left.dtype)
            at = np.flatnonzero(rest >= 0)
            for a, b in _colliding(fps[at], rest[at], bits - cut, radius):
                yield at[a], at[b]
        return
    y = fps & np.uint64((1 << bits) - 1)
    z, ids = _variants(y, left, bits, radius)
    s = np.sort(z)
    shared = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(shared):
        return
    at = np.minimum(np.searchsorted(shared, z), len(shared) - 1)
    hit = shared[at] == z
    group, ids = at[hit], ids[hit]
    order = np.lexsort((ids, group))
    group, ids = group[order], ids[order]
    first = np.r_[True, group[1:] != group[:-1]]
    head = ids[np.flatnonzero(first)][np.cumsum(first) - 1]
    pairs = np.unique(np.stack([head, ids], 1)[head != ids], axis=0)
    yield pairs[:, 0], pairs[:, 1]


def _match(bits: int, radius: int):
    """Per prefix: the links of its fingerprints, cut down to one link a fingerprint."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        fps, left = pdf["fp"].to_numpy().view(np.uint64), pdf["left"].to_numpy()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y in _colliding(fps, left, bits, radius):
            near = np.bitwise_count(fps[x] ^ fps[y]) <= 2 * radius  # verify
            a.append(x[near])
            b.append(y[near])
        root = local_roots(len(fps), np.concatenate(a), np.concatenate(b))
        on = np.flatnonzero(root != np.arange(len(fps)))
        return pd.DataFrame({"a": fps[on].view(np.int64), "b": fps[root[on]].view(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(batches, "prefix"):
            yield links(pdf)

    return run


def fingerprint_links(fps: DataFrame, max_bits: int = 4, max_rows: int = MAX_ROWS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column ``fp``) at most
    ``max_bits`` (even) apart: not every pair, but the same components.

    All fingerprints that meet in one variant are within ``max_bits`` of each other, so a
    star to one of them keeps every connection and no group is expanded into pairs.
    """
    if max_bits % 2 or not 0 < max_bits <= 8:
        raise ValueError("max_bits must be 2, 4, 6 or 8")
    radius, n = max_bits // 2, fps.count()
    bits = FIRST_BITS
    while bits < 40 and n * len(_masks(bits, radius)) > max_rows * (1 << bits):
        bits += 1
    rows = _deal(fps.select("fp", F.lit(0).cast("long").alias("prefix"), F.lit(radius).alias("left")), 0, bits, radius)
    out = None
    while True:
        hot = None
        if bits + MORE_BITS < BITS:
            hot = rows.groupBy("prefix").count().where(F.col("count") > max_rows).select("prefix")
            hot = materialize(hot, "hot-prefixes")
            if hot.isEmpty():
                hot = None
        fit = rows if hot is None else rows.join(hot, "prefix", "left_anti")
        links = fit.repartition("prefix").sortWithinPartitions("prefix").mapInPandas(
            _match(BITS - bits, radius), "a long, b long")
        out = links if out is None else out.union(links)
        if hot is None:
            return out
        rows = _deal(rows.join(hot, "prefix", "left_semi"), bits, MORE_BITS, radius)
        bits += MORE_BITS


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42,
                   max_bits: int = 4) -> DataFrame:
    """(id, tkey, fp, root, component_id) of every row: xxhash64 of the text, fingerprint as a
    signed long, the smallest fingerprint and the smallest id reachable.

    Words are runs of non-white-space after lower-casing A-Z; shingles of ``shingle`` words
    count as often as they occur (fewer words: the whole sequence). A fingerprint bit is set
    if it is set in over half of the shingles' XXH64. NULL, empty and word-less texts have
    fingerprint zero and are linked like any other. Links are ``max_bits`` or fewer differing
    bits. Rows with a NULL id are grouped too but never name a component (NULL if no row of
    the component has an id). Repeated rows and ids keep one result row each. An empty
    table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = materialize(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tkey"),
                                   fingerprint_column(F.col(text_col), shingle, seed).alias("fp")), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("low")), "fingerprint-classes")
    comps = connected_components(fingerprint_links(classes, max_bits))
    linked = classes.join(comps.withColumnRenamed("node", "fp"), "fp")
    lows = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    linked = hot_join(linked.select("fp", "root"), lows.withColumn("r", F.col("root")), "root").select("fp", F.col("r").alias("root"), "component_id")
    named = classes.join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id"))
    return hot_join(rows, named.withColumn("f", F.col("fp")), "fp").select(
        F.col("id").alias(id_col), "tkey", F.col("f").alias("fp"), "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The documents of which none of the same SimHash group has a smaller id, one of each
    group, with the columns of ``docs``. A row without an id stays only if no row of its
    group has one; of repeated rows one stays."""
    groups = simhash_groups(docs, id_col, text_col, shingle, max_bits=max_bits)
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("tkey").alias("t"))).alias("k")
    keep = materialize(groups.groupBy("root").agg(first).select(
        F.xxhash64("k.id").alias("__k"), F.col("k.t").alias("__t"), F.col("k.id").alias("__i")), "simhash-kept")
    # both steps deal the texts by the same two keys: one shuffle
    df = docs.withColumns({"__k": F.xxhash64(id_col), "__t": F.xxhash64(text_col)})
    same = (df["__k"] == keep["__k"]) & (df["__t"] == keep["__t"]) & df[id_col].eqNullSafe(keep["__i"])
    return df.join(keep, same, "left_semi").dropDuplicates(["__k", "__t"]).select(*docs.columns)
