"""Exact top-k by inner product over an impact-ordered index, score at a time.

Rows are dealt to blocks. In a block every dimension's values are quantised to a few levels;
the rows of one level are a posting segment with its lowest and highest value. For a
query, a segment's impact is the most it can add to a score. Segments are taken by
descending impact, over all dimensions together; a row's bound is the impact of its
segments taken so far plus, for dimensions not reached yet, the most that is left there.
Rows whose bound falls below a proven k-th score are out. When few are left, or
the segments are used up, these possible members are scored exactly.

Every row of dense vectors has a posting in every dimension, so the postings are stored by
row (the number of its segment in each dimension): taking segments then is one table
lookup for each posting of the rows that are still in.

Blocks stand on shelves, more on one the larger the table, and queries travel to a shelf in
packs. A query's own best scores so far prove more with every block of the shelf.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.llm.common import materialize, runs, ship

BLOCK_ROWS = 4096
LEVELS = 32
ROUNDS = 5  # times that bounds are looked at while the segments are taken
SEEDS = 2048  # rows whose exact scores give the first proven k-th score
SHELVES = 256  # up to so many blocks each stands alone; beyond, a shelf holds several
SHELF_BYTES = 64 << 20  # of vectors and postings on one shelf
PACK_BYTES = 8192  # of queries that travel as one row
UNPROVEN = np.iinfo(np.int64).min


def quantised(vec: Column, scale: int) -> Column:
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest of 2, 4 and 8 bytes that holds them all."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return x.astype(next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def widened(data: bytes, rows: int, dims: int, kind: str) -> np.ndarray:
    """The matrix of ``rows`` rows behind the bytes; the width of a number follows from their length."""
    return np.frombuffer(data, f"<{kind}{len(data) // (rows * dims)}").reshape(rows, dims).astype(np.int64)


def build_block(ids: np.ndarray, vecs: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Ids, vectors, postings (each row's segment number in each dimension) and segment table
    (size, lowest and highest value by dimension and level) of one block, as bytes."""
    n, dims = vecs.shape
    post, table = np.empty((n, dims), np.int64), np.zeros((3, dims, LEVELS), np.int64)
    for d in range(dims):
        v = vecs[:, d]
        low, high = int(v.min()), int(v.max())
        level = (v - low) * LEVELS // (high - low + 1)
        post[:, d] = d * LEVELS + level
        table[0, d] = np.bincount(level, minlength=LEVELS)
        table[1, d], table[2, d] = high, low
        np.minimum.at(table[1, d], level, v)
        np.maximum.at(table[2, d], level, v)
    post = post.astype("<u2" if dims * LEVELS <= 1 << 16 else "<u4")
    return ids.astype("<i8").tobytes(), small(vecs).tobytes(), post.tobytes(), table.astype("<i8").tobytes()


class Block:
    """A block's index as read by a query task."""

    def __init__(self, a: bytes, b: bytes, c: bytes, d: bytes):
        self.ids = np.frombuffer(a, "<i8")
        self.sizes, self.low, self.high = np.frombuffer(d, "<i8").reshape(3, -1, LEVELS)
        self.vecs = widened(b, len(self.ids), len(self.sizes), "i")
        self.post = widened(c, len(self.ids), len(self.sizes), "u")

    def search(self, own: int, q: np.ndarray, k: int, proven: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of this block's rows among the ``k`` best of the query, without its
        own row; none whose score is below ``proven``, a score that k rows are known to reach."""
        n, dims = self.vecs.shape
        alive = None
        if proven is not None and n > 64:
            nothing = UNPROVEN
            most = np.where(self.sizes > 0, np.maximum(self.low * q[:, None], self.high * q[:, None]), nothing)
            least = np.where(self.sizes > 0, most, np.iinfo(np.int64).max).min(1)
            segments = np.flatnonzero(self.sizes)
            impact = (most - least[:, None]).ravel()[segments]
            segments = segments[np.argsort(-impact, kind="stable")]
            upto = np.cumsum(self.sizes.ravel()[segments])
            left, at = most.copy(), 0
            for cut in np.searchsorted(upto, n * dims * np.arange(1, ROUNDS) // ROUNDS):
                left.ravel()[segments[at:cut]] = nothing
                at = cut
                rest = left.max(1)  # the most that a dimension not reached yet can add
                rest = np.where(rest == nothing, least, rest)
                if rest.sum() >= proven:
                    continue  # even a row of which nothing was taken could still be in
                bound = np.where(left == nothing, most, rest[:, None]).ravel()
                rows = self.post if alive is None else self.post[alive]
                upper = np.take(bound, rows, mode="clip").sum(1)
                alive = np.flatnonzero(upper >= proven) if alive is None else alive[upper >= proven]
                if len(alive) <= max(16, n // 128):
                    break
        alive = np.flatnonzero(self.ids != own) if alive is None else alive[self.ids[alive] != own]
        scores = self.vecs[alive] @ q
        if proven is not None:
            alive, scores = alive[scores >= proven], scores[scores >= proven]
        best = np.lexsort((self.ids[alive], -scores))[:k]
        return self.ids[alive[best]], scores[best]


def _matrix(vecs: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.int64) for v in vecs])


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in runs(batches, "block"):
        a, b, c, d = build_block(pdf["id"].to_numpy(), _matrix(pdf["vec"]))
        yield pd.DataFrame({"block": [pdf["block"].iloc[0]], "a": [a], "b": [b], "c": [c], "d": [d]})


def _seeded(seeds: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Adds to each query the k-th best exact score among the seed rows (NULL: too few)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at:at + 512].copy()
                proven = np.full(len(part), UNPROVEN)
                for dim, rows in part.groupby("dim").indices.items():
                    ids, vecs = seeds.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim), np.int64)))
                    if len(ids) > k:
                        q = _matrix(part["vec"].iloc[rows])
                        s = (q.astype(float) @ vecs.T.astype(float)).astype(np.int64) if np.abs(q).max() < 1 << 20 and np.abs(
                            vecs).max() < 1 << 20 else q @ vecs.T
                        s[part["id"].to_numpy()[rows][:, None] == ids] = UNPROVEN
                        proven[rows] = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
                part["proven"] = proven
                yield part

    return run


def _better(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of two lists of (ids, scores); ties go to the smaller id."""
    ids, scores = np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]])
    best = np.lexsort((ids, -scores))[:k]
    return ids[best], scores[best]


def search_shelf(shelf: list[tuple], ids: np.ndarray, vecs: np.ndarray, proven: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query of a pack, (ids, scores) of the shelf's rows that are among its ``k`` best
    there and reach its proven score. Blocks are opened one at a time."""
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
    for parts in shelf:
        block = Block(*parts)
        for i, own in enumerate(ids):
            score = max(proven[i], best[i][1][-1] if len(best[i][1]) == k else UNPROVEN)
            best[i] = _better(best[i], block.search(own, vecs[i], k, None if score == UNPROVEN else score), k)
    return best


def _search(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, shelf = None, []
        for pdf in batches:
            for at, role, a, b, c, d in zip(*[pdf[x] for x in ("shelf", "role", "a", "b", "c", "d")]):
                if at != number:
                    number, shelf = at, []
                if role == 0:
                    shelf.append((a, b, c, d))
                    continue
                ids = np.frombuffer(a, "<i8")
                if not shelf:
                    continue
                dims = len(shelf[0][3]) // (24 * LEVELS)
                found = search_shelf(shelf, ids, widened(b, len(ids), dims, "i"), np.frombuffer(c, "<i8"), k)
                yield pd.DataFrame({"query_id": np.repeat(ids, [len(f[0]) for f in found]),
                                    "vec_id": np.concatenate([f[0] for f in found]), "score": np.concatenate([f[1] for f in found])})

    return run


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Queries of one vector length in rows of some: ids, vectors and proven scores as bytes."""
    for pdf in batches:
        out = []
        for (dim, shelves), part in pdf.groupby(["dim", "shelves"]):
            n = max(1, PACK_BYTES // (16 + 2 * dim))
            for at in range(0, len(part), n):
                p = part.iloc[at:at + n]
                out.append((dim, shelves, p["id"].to_numpy("<i8").tobytes(), small(_matrix(p["vec"])).tobytes(),
                            p["proven"].to_numpy("<i8").tobytes()))
        if out:
            yield pd.DataFrame(out, columns=["dim", "shelves", "a", "b", "c"])


def shelf_blocks(dims: int, blocks: int, block_rows: int) -> int:
    """Blocks on one shelf: one while there are few, at most what ``SHELF_BYTES`` hold."""
    return max(1, min(-(-blocks // SHELVES), SHELF_BYTES // (block_rows * dims * 4)))


def top_k(rows: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding",
          block_rows: int = BLOCK_ROWS, seed_rows: int = SEEDS) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row where ``is_query`` holds, the ``k`` other
    rows (all, if fewer) with the highest inner product of the vectors' components times
    ``scale`` rounded down; ties go to the smaller id.

    Exact: ``seed_rows`` rows only give the first proven score. Vectors that are NULL, empty or hold NULL
    or non-finite components, and rows without an id, take no part; a zero vector does.
    Vectors meet only those of their own length. Repeated rows of one id count as one, the
    smallest vector of several. Components must stay below 2^23 in size for whole scores to
    fit. Input columns other than the two named are not read, so their names never clash. An
    empty table gives no rows. The queries are sent to every shelf of blocks, a stated query
    set against all rows: a shelf holds ``SHELF_BYTES`` at most, and one row carries a pack of
    queries, so what is shuffled is queries x shelves, packed, and ``k`` rows of each.
    """
    spark = rows.sparkSession
    ship(spark)
    v = F.col(vec_col)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.withColumn("__q", F.coalesce(is_query, F.lit(False))).where(fine & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), quantised(v, scale).alias("vec"), "__q")
    rows = rows.groupBy("id").agg(F.min("vec").alias("vec"), F.max("__q").alias("is_query"))
    rows = materialize(rows.withColumn("dim", F.size("vec")), "topk-rows")
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each vector length
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    counts = [(r["dim"], -(-r["n"] // block_rows)) for r in sizes]
    per = [shelf_blocks(dim, blocks, block_rows) for dim, blocks in counts]
    dims = spark.createDataFrame([(d, b, p, -(-b // p)) for (d, b), p in zip(counts, per)], "dim int, blocks long, per long, shelves long")
    n_blocks, n_shelves = sum(b for _, b in counts), sum(-(-b // p) for (_, b), p in zip(counts, per))
    rows = rows.join(F.broadcast(dims), "dim")
    number = F.shiftright(F.shiftrightunsigned(F.xxhash64("id"), 33) * F.col("blocks"), 31)
    block = F.shiftleft(F.col("dim").cast("long"), 32)
    index = (rows.select((block + number).alias("block"), "id", "vec").repartition(n_blocks, "block").sortWithinPartitions("block")
             .mapInPandas(_index, "block long, a binary, b binary, c binary, d binary"))
    index = materialize(index, "topk-index")
    total = sum(r["n"] for r in sizes)
    u = F.shiftrightunsigned(F.xxhash64("id", F.lit(1)), 11) / F.lit(float(1 << 53))
    sample = rows.where(u <= min(1.0, seed_rows / total)).select("id", "vec", "dim").limit(2 * seed_rows).toPandas()
    seeds = {int(dim): (g["id"].to_numpy(), _matrix(g["vec"])) for dim, g in sample.groupby("dim")}
    queries = rows.where("is_query").select("id", "vec", "dim", "shelves").mapInPandas(
        _seeded(seeds, k), "id long, vec array<long>, dim int, shelves long, proven long")
    packs = queries.mapInPandas(_packed, "dim int, shelves long, a binary, b binary, c binary")
    place = F.shiftleft(F.col("dim").cast("long"), 32)
    asked = packs.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shelves") - 1))).select(
        (place + F.col("s")).alias("shelf"), F.lit(1).alias("role"), "a", "b", "c", F.lit(None).cast("binary").alias("d"))
    number = F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    shelved = index.withColumn("dim", F.shiftright("block", 32).cast("int")).join(F.broadcast(dims), "dim").select(
        (place + F.floor(number / F.col("per"))).alias("shelf"), F.lit(0).alias("role"), "a", "b", "c", "d")
    found = shelved.unionByName(asked).repartition(4 * n_shelves, "shelf").sortWithinPartitions("shelf", "role").mapInPandas(
        _search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
