"""Packing documents into sequences of bounded length by fitted patterns.

Lengths are a small histogram whatever the corpus. All patterns of up to three lengths that
fill a sequence are enumerated, non-negative least squares finds how often to repeat each
so that together they use up the histogram, the counts are rounded, and what remains is
packed best-fit. All of that is on the histogram; the cluster then ranks the pieces of each
length and looks up their place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.llm.common import materialize, rows_per_bucket, ship
from cohortlens.llm.running import running_before, spread
from cohortlens.llm.tokens import encoder

UNITS = 512  # lengths are rounded up to a capacity / UNITS for the patterns
DEPTH = 3  # documents in a pattern


def document_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document: its ids and ``end_id``, cut
    into pieces of ``capacity`` ids only if there are more. A NULL text is empty; every
    document has at least its end id. Repeated rows give repeated pieces."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for pdf in batches:
            out: list[tuple] = []
            for doc, none, text in zip(pdf["doc_id"].tolist(), pdf["none"], pdf["text"]):
                ids = np.append(enc.ids(text), end_id).astype("<u4")
                doc = None if none else doc
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at:at + capacity]
                    out.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
            doc_ids = pd.array([x[0] for x in out], dtype="Int64")
            yield pd.DataFrame([x[1:] for x in out], columns=["piece", "start", "length", "ids_crc32"]).assign(doc_id=doc_ids)

    ship(docs.sparkSession)
    doc = F.col(id_col).cast("long")  # NULLs go beside: pandas would make the ids floats
    return docs.select(F.coalesce(doc, F.lit(0)).alias("doc_id"), doc.isNull().alias("none"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def patterns(units: int = UNITS, depth: int = DEPTH) -> np.ndarray:
    """All non-increasing tuples of 1 to ``depth`` units that sum to ``units``, padded with 0."""
    found: list[tuple[int, ...]] = []

    def grow(parts: tuple[int, ...], left: int) -> None:
        if not left:
            found.append(parts + (0,) * (depth - len(parts)))
            return
        room = depth - len(parts)
        if room:
            for u in range(min(left, parts[-1] if parts else left), -(-left // room) - 1, -1):
                grow((*parts, u), left - u)

    grow((), units)
    return np.array(found)


def fit(pats: np.ndarray, hist: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Non-negative least squares: repeat counts x >= 0 with least |A x - hist|, where column p
    of A counts the units of pattern p (accelerated projected gradient)."""
    units = len(hist) - 1
    used = lambda x: np.bincount(pats.ravel(), np.repeat(x, pats.shape[1]), units + 1) * (np.arange(units + 1) > 0)
    back = lambda r: np.where(pats > 0, r[pats], 0).sum(1)
    v = np.ones(len(pats))
    for _ in range(20):
        v = back(used(v / np.linalg.norm(v)))
    x = y = np.zeros(len(pats))
    step, t = 1 / np.linalg.norm(v) / 1.02, 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(used(y) - hist))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / t_new * (new - x), t_new
    return x


def plan(hist: np.ndarray, units: int = UNITS, depth: int = DEPTH) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Where the pieces go: rows (length, from, to, sequence, each, place): of the pieces of one
    length, number ``r`` in from <= r < to goes to sequence ``sequence + (r - from) // each`` at
    place ``place + (r - from) % each``. ``hist[n]`` is how many pieces have length n. Also the
    number of sequences. Exact whatever the fit finds: it only decides what is left over."""
    capacity = len(hist) - 1
    left = hist.astype(np.int64).copy()
    taken = np.zeros_like(left)
    rows: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def put(n: int, count: int, seq: int, each: int, place: int) -> None:
        rows.append((n, int(taken[n]), int(taken[n]) + count, seq, each, place))
        taken[n] += count
        left[n] -= count

    unit = -(-np.arange(capacity + 1) * units // capacity)
    by_unit = np.bincount(unit, left, units + 1)
    pats = patterns(units, depth)
    pats = pats[((by_unit[pats] > 0) | (pats == 0)).all(1)]
    if len(pats):
        x = np.rint(fit(pats, by_unit)).astype(np.int64)
        members = [np.flatnonzero(unit == u)[::-1] for u in range(units + 1)]
        for p in np.argsort(-x, kind="stable"):
            parts = pats[p][pats[p] > 0]
            kinds, need = np.unique(parts, return_counts=True)
            count = int(min([x[p], *[by_unit[u] // k for u, k in zip(kinds, need)]]))
            if count <= 0:
                continue
            for place, u in enumerate(parts):
                todo, seq = count, sequences
                for n in members[u]:
                    some = int(min(todo, left[n]))
                    if some:
                        put(int(n), some, seq, 1, place)
                        todo, seq = todo - some, seq + some
                by_unit[u] -= count
            sequences += count
    # the rest, best-fit decreasing in bulk: sequences of the same free space are one group
    groups: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # by free space: [first sequence, count, places]
    for n in range(capacity, 0, -1):
        while left[n]:
            free = next((r for r in range(n, capacity) if groups[r]), None)
            if free is None:
                each = capacity // n
                count = max(1, int(left[n]) // each)
                group = [sequences, count, 0]
                sequences, free = sequences + count, capacity
            else:
                group = groups[free].pop()
                each = free // n
            full = int(left[n]) // each
            if not full:  # fewer than fit into one sequence
                each, full = int(left[n]), 1
            use = min(full, group[1])
            if use < group[1]:
                groups[free].append([group[0] + use, group[1] - use, group[2]])
            put(n, use * each, group[0], each, group[2])
            if free - each * n:
                groups[free - each * n].append([group[0], use, group[2] + each])
    return rows, sequences


def pack(pieces: DataFrame, capacity: int = 2048, key: Column | None = None) -> DataFrame:
    """All columns of ``pieces`` (needs ``length``, 1 to ``capacity``) plus sequence_id and
    offset: no sequence holds more than ``capacity``, and its pieces lie gapless from 0.

    ``key`` spreads pieces of one length evenly and orders them; equal rows are interchangeable. Only the
    histogram (``capacity`` numbers) reaches the driver, and the table of places that comes
    back is bounded by the patterns and the histogram, so it is broadcast. A length that many
    pieces share is ranked in buckets. Columns named sequence_id or offset are replaced. An
    empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    key = F.xxhash64(*pieces.columns) if key is None else key
    hist = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        if r["length"] is None or not 0 < r["length"] <= capacity:
            raise ValueError(f"a piece of length {r['length']}")
        hist[r["length"]] = r["count"]
    total = int(hist.sum())
    places, _ = plan(hist)
    per = rows_per_bucket(total)
    sizes = spark.createDataFrame([(n, -(-int(c) // per)) for n, c in enumerate(hist) if c] or [(0, 0)], "length long, __subs long")
    table = spark.createDataFrame(places or [(0, 0, 0, 0, 0, 0)], "__n long, __from long, __to long, __seq long, __each long, __place long")
    df = pieces.withColumn("length", F.col("length").cast("long")).withColumn("__key", key)
    df = df.join(F.broadcast(sizes), "length")
    h31 = F.shiftrightunsigned(F.xxhash64("__key"), 33)
    df = df.withColumn("__bucket", spread(h31, F.col("__subs")))
    df = running_before(df, "length", "__bucket", [h31, F.col("__key")], {"__rank": F.lit(1).cast("long")})
    df = df.join(F.broadcast(table), (F.col("length") == F.col("__n")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
    step = F.col("__rank") - F.col("__from")
    df = df.withColumns({"sequence_id": F.col("__seq") + F.floor(step / F.col("__each")).cast("long"),
                         "__spot": F.col("__place") + step % F.col("__each")})
    before = Window.partitionBy("sequence_id").orderBy("__spot").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return df.select(*pieces.columns, "sequence_id", "offset")


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The pieces of all documents with their sequence and offset; texts are tokenized once."""
    return pack(materialize(document_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
