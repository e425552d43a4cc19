"""Near-duplicate embeddings by an inverted multi-index.

Every unit vector is cut in two halves, each half has its own k-means codebook, and the
pairs of nearest centroids are the cells of a product grid. A vector lies in one cell and
visits, by multi-sequence traversal, the nearest other cells: those whose border is close
enough that a neighbour at the similarity threshold may lie behind it with the target
recall. Candidates that meet in a cell are verified by exact cosine in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import hot_join, materialize, runs, ship
from cohortlens.llm.components import connected_components, local_roots

CLOSE = 0.15  # the radius is this at least: unit vectors nearer than it (cosine 0.989) always meet
SAMPLE = 20_000  # vectors the codebooks and the search radius are fitted on
MOST_CENTROIDS = 256
QUERIES = 512  # vectors of the sample whose true neighbours are searched among all
BINS = 2000  # of border distances, up to 2
BLOCK = 2048  # vectors of a cell on each side of one comparison task


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """``k`` centroids (fewer, if there are fewer distinct rows) by Lloyd's iterations."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        size = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


@dataclass(frozen=True)
class Grid:
    """The two codebooks, the dimension at which vectors are cut, and the search radius."""

    first: np.ndarray
    second: np.ndarray
    radius: float

    def borders(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half: the nearest centroid of every row, and the distance from the row to
        the border between that centroid's region and each other region (0 for its own)."""
        out, at = [], self.first.shape[1]
        for half, c in ((x[:, :at], self.first), (x[:, at:], self.second)):
            d = (half * half).sum(1)[:, None] + (c * c).sum(1) - 2 * half @ c.T
            near = np.argmin(d, axis=1)
            apart = np.sqrt(np.maximum((c * c).sum(1)[:, None] + (c * c).sum(1) - 2 * c @ c.T, 0))[near]
            gap = (d - d[np.arange(len(d)), near][:, None]) / np.where(apart > 0, 2 * apart, 1)
            gap[np.arange(len(d)), near] = 0
            out.append((near, np.maximum(gap, 0)))
        return out

    def cells(self, x: np.ndarray) -> np.ndarray:
        (a, _), (b, _) = self.borders(x)
        return a * len(self.second) + b

    def visits(self, x: np.ndarray) -> list[list[int]]:
        """The cells every row visits, its own first, then by the distance to their borders."""
        (_, g1), (_, g2) = self.borders(x)
        o1, o2 = np.argsort(g1, axis=1, kind="stable"), np.argsort(g2, axis=1, kind="stable")
        s1, s2 = np.take_along_axis(g1, o1, 1) ** 2, np.take_along_axis(g2, o2, 1) ** 2
        limit, width = self.radius ** 2, len(self.second)
        return [_multi_sequence(a, b, p, q, limit, width) for a, b, p, q in
                zip(s1.tolist(), s2.tolist(), o1.tolist(), o2.tolist())]


def _multi_sequence(a: list[float], b: list[float], p: list[int], q: list[int], limit: float, width: int) -> list[int]:
    """Cells (p[i], q[j]) in ascending order of a[i] + b[j], up to ``limit``; a and b ascend."""
    heap, found = [(a[0] + b[0], 0, 0)], []
    while heap:
        cost, i, j = heapq.heappop(heap)
        if cost > limit:
            break
        found.append(p[i] * width + q[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return found


def fit_grid(sample: np.ndarray, centroids: int, threshold: float, recall: float, seed: int = 0) -> Grid:
    """Codebooks from unit vectors, and the radius within which ``recall`` of all neighbours
    at exactly the threshold (the hardest ones) are found: measured on random neighbours
    of the sample."""
    half = max(1, sample.shape[1] // 2)
    grid = Grid(kmeans(sample[:, :half], centroids), kmeans(sample[:, half:], centroids), 0.0)
    rng = np.random.default_rng(seed)
    x = sample[rng.integers(0, len(sample), 8192)]
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(1)[:, None] * x
    side /= np.maximum(np.linalg.norm(side, axis=1), 1e-30)[:, None]
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold ** 2)) * side
    (_, g1), (_, g2) = grid.borders(x)
    (a, _), (b, _) = grid.borders(y)
    rows = np.arange(len(x))
    need = np.sqrt(g1[rows, a] ** 2 + g2[rows, b] ** 2)
    return Grid(grid.first, grid.second, max(CLOSE, float(np.quantile(need, recall))))


def border_distances(grid: Grid, queries: np.ndarray, x: np.ndarray, threshold: float, pairs: np.ndarray | None = None) -> np.ndarray:
    """How far each query has to look (the distance to the border of the other's cell) to meet its neighbours among ``x``:
    one number for each pair of unit vectors from ``threshold`` on that are not nearer than ``CLOSE`` (those
    always meet). ``pairs`` masks which may be compared at all."""
    cos = queries @ x.T
    hit = (cos >= threshold) & (2 - 2 * cos > CLOSE ** 2)
    q, k = np.nonzero(hit if pairs is None else hit & pairs)
    (_, g1), (_, g2) = grid.borders(queries)
    (a, _), (b, _) = grid.borders(x)
    return np.sqrt(g1[q, a[k]] ** 2 + g2[q, b[k]] ** 2)


def _searched(grid: Grid, dims: int, threshold: float, queries: pd.DataFrame):
    """Histogram of the border distances between the queries and all vectors of a task."""
    q = _vectors(queries, dims)
    q /= np.linalg.norm(q, axis=1)[:, None]
    labels, lengths = queries["label"].to_numpy(), queries["vec"].map(len).to_numpy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BINS, np.int64)
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at:at + BLOCK]
                x = _vectors(part, dims)
                x /= np.linalg.norm(x, axis=1)[:, None]
                same = (labels[:, None] == part["label"].to_numpy()) & (lengths[:, None] == part["vec"].map(len).to_numpy())
                far = border_distances(grid, q, x, threshold, same)
                total += np.bincount(np.minimum((far * (BINS / 2)).astype(np.int64), BINS - 1), minlength=BINS)
        on = np.flatnonzero(total)
        yield pd.DataFrame({"bin": on, "n": total[on]})

    return run


def radius_for(histogram: np.ndarray, recall: float) -> float:
    """The smallest radius (a bin's upper end) within which ``recall`` of the counted pairs are; 0 without any."""
    upto = np.cumsum(histogram)
    return float(np.searchsorted(upto, recall * upto[-1]) + 1) * 2 / BINS if upto[-1] else 0.0


def _vectors(pdf: pd.DataFrame, dims: int) -> np.ndarray:
    """The rows' vectors in double precision, shorter ones padded with zeros."""
    out = np.zeros((len(pdf), dims))
    for i, v in enumerate(pdf["vec"]):
        out[i, :len(v)] = v
    return out


def _deal(grid: Grid, dims: int):
    """One row for each cell a vector lies in or visits. Of two cells only the one with the
    smaller number sends its vectors to the other, so a pair meets once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at:at + 1000]
                x = _vectors(part, dims)
                visits = grid.visits(x / np.linalg.norm(x, axis=1)[:, None])
                visits = [[v[0], *[c for c in v[1:] if c > v[0]]] for v in visits]
                n = [len(v) for v in visits]
                out = part.iloc[np.repeat(np.arange(len(part)), n)].reset_index(drop=True)
                out["cell"] = np.concatenate(visits).astype(np.int64)
                out["home"] = np.concatenate([np.arange(k) == 0 for k in n])
                yield out

    return run


def _compare(dims: int, threshold: float):
    """Links inside one block of a cell: for every vector how many it has (copies counted), and
    a spanning forest of them."""

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _vectors(pdf, dims)
        norm, cid, copies = np.linalg.norm(x, axis=1), pdf["cid"].to_numpy(), pdf["copies"].to_numpy()
        here = np.flatnonzero(pdf["member"].to_numpy())
        seek = np.flatnonzero(pdf["seeker"].to_numpy())
        home = pdf["home"].to_numpy()
        links, a, b = np.zeros(len(pdf), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(seek), BLOCK):
            s = seek[i:i + BLOCK]
            for j in range(0, len(here), BLOCK):
                h = here[j:j + BLOCK]
                cos = (x[s] @ x[h].T) / np.outer(norm[s], norm[h])
                # two vectors at home in this cell meet twice: the smaller number seeks
                hit = (cos >= threshold) & ~(home[s][:, None] & (cid[s][:, None] >= cid[h]))
                links[s] += hit @ copies[h]
                links[h] += copies[s] @ hit
                p, q = np.nonzero(hit)
                a.append(s[p])
                b.append(h[q])
        # the same vector may be here twice, as a member and as a seeker
        first = {c: k for k, c in reversed(list(enumerate(cid.tolist())))}
        same = np.array([first[c] for c in cid.tolist()], dtype=np.int64)
        root = local_roots(len(pdf), np.concatenate(a + [np.arange(len(pdf))]), np.concatenate(b + [same]))
        on = np.flatnonzero((links > 0) | (cid != cid[root]))
        return pd.DataFrame({"cid": cid[on], "links": links[on], "root": cid[root[on]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(batches, "label", "dim", "cell", "mblock", "sblock"):
            if pdf["member"].any() and pdf["seeker"].any():
                yield block(pdf)

    return run


def near_duplicates(rows: DataFrame, threshold: float = 0.93, recall: float = 0.999, sample_rows: int = SAMPLE,
                    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id) of every row.

    Vectors with the same non-null label and length are linked when their cosine reaches
    ``threshold``. n_links is the number of other rows linked directly, component_id the
    smallest id reachable (its own at least). Vectors that are NULL, empty, zero or hold NULL or
    non-finite components, or have no label, link with nothing. Equal vectors are one class:
    all linked with each other, compared with others once. Rows with a NULL id count as
    links and never name a component. Repeated rows are separate rows. An empty table gives
    an empty result. No pair below the threshold is linked; ``recall`` is aimed at for pairs
    right at it, closer ones are found more surely, those nearer than ``CLOSE`` always. Codebooks are fitted on about
    ``sample_rows`` classes; the radius on random neighbours of those and on all true neighbours of ``QUERIES`` vectors, searched
    among all in blocks. Every vector is indexed. Crowded cells are cut into blocks.
    """
    spark = rows.sparkSession
    ship(spark)
    v, label = F.col(vec_col), F.col(label_col)
    fine = (v.isNotNull() & label.isNotNull() & F.exists(v, lambda x: x != 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.select(F.col(id_col).alias("id"), F.when(F.coalesce(fine, F.lit(False)), v).alias("vec"), label.alias("label"))
    ok, rest = rows.where("vec is not null"), rows.where("vec is null")
    classes = ok.groupBy("label", "vec").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("low"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    head = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims"), F.approx_count_distinct("label").alias("labels")).first()
    n, dims = head["n"], head["dims"] or 1
    u = F.shiftrightunsigned(F.xxhash64("label", "vec"), 11) / F.lit(float(1 << 53))
    sample = classes.where(u <= F.lit(min(1.0, sample_rows / max(n, 1)))).select("vec").limit(2 * sample_rows)
    named = None
    if n:
        x = _vectors(sample.toPandas(), dims)
        x = x[np.lexsort(x.T)] if len(x) else np.eye(1, dims)
        x /= np.linalg.norm(x, axis=1)[:, None]
        # about 128 vectors of a label in a cell, as long as the sample supports that many centroids
        centroids = int(min(MOST_CENTROIDS, max(2, round(np.sqrt(n / (128 * max(1, head["labels"])))))))
        grid = fit_grid(x, centroids, threshold, recall)
        # real neighbours may differ in few dimensions and cross borders more often than random ones: the radius serves both
        queries = classes.select("label", "vec", F.xxhash64("label", "vec").alias("h")).orderBy("h").limit(QUERIES).drop("h").toPandas()
        seen = classes.select("label", "vec").mapInPandas(_searched(grid, dims, threshold, queries), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
        histogram = np.zeros(BINS, np.int64)
        for r in seen.collect():  # BINS rows at most
            histogram[r["bin"]] = r["n"]
        grid = Grid(grid.first, grid.second, max(grid.radius, radius_for(histogram, recall)))
        dealt = classes.withColumn("dim", F.size("vec")).select("label", "dim", "cid", "copies", "vec").mapInPandas(
            _deal(grid, dims), classes.select("label", F.lit(1).alias("dim"), "cid", "copies", "vec").schema.add("cell", "long").add("home", "boolean"))
        dealt = materialize(dealt, "vector-cells")
        cells = dealt.groupBy("label", "dim", "cell").agg(
            F.ceil(F.count_if("home") / BLOCK).cast("int").alias("mblocks"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("sblocks"))
        split = materialize(cells.where("mblocks > 1 or sblocks > 1"), "crowded-cells")
        d = dealt.join(split, ["label", "dim", "cell"], "left").fillna(1, ["mblocks", "sblocks"])
        h = F.shiftrightunsigned(F.xxhash64("cid"), 33)
        mine = {"m": F.shiftright(h * F.col("mblocks"), 31).cast("int"), "s": F.shiftright(h * F.col("sblocks"), 31).cast("int")}
        keys = ["label", "dim", "cell", "mblock", "sblock"]
        plain = d.where("mblocks = 1 and sblocks = 1").withColumns(
            {"mblock": F.lit(0), "sblock": F.lit(0), "member": F.col("home"), "seeker": F.lit(True)})
        crowded = d.where("mblocks > 1 or sblocks > 1")
        members = crowded.where("home").withColumns({"mblock": mine["m"], "sblock": F.explode(F.sequence(F.lit(0), F.col("sblocks") - 1)),
                                                     "member": F.lit(True), "seeker": F.lit(False)})
        seekers = crowded.withColumns({"sblock": mine["s"], "mblock": F.explode(F.sequence(F.lit(0), F.col("mblocks") - 1)),
                                       "member": F.lit(False), "seeker": F.lit(True)})
        cols = [*keys, "cid", "copies", "vec", "home", "member", "seeker"]
        work = plain.select(cols).unionByName(members.select(cols)).unionByName(seekers.select(cols))
        found = materialize(work.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(
            _compare(dims, threshold), "cid long, links long, root long"), "vector-links")
        comps = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
        linked = classes.select("cid", "low").join(comps.withColumnRenamed("node", "cid"), "cid")
        lows = linked.groupBy("root").agg(F.min("low").alias("component_id"))
        linked = hot_join(linked.select("cid", "root"), lows, "root").select("cid", "component_id")
        n_links = found.groupBy("cid").agg(F.sum("links").alias("links"))
        named = (classes.join(n_links, "cid", "left").join(linked.withColumn("in", F.lit(True)), "cid", "left")
                 .select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                         F.when(F.col("in"), F.col("component_id")).otherwise(F.col("low")).alias("component_id")))
    alone = rest.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if named is None:
        return alone
    named = materialize(named.withColumn("h", F.xxhash64("label", "vec")), "vector-classes")
    got = ok.withColumn("h", F.xxhash64("label", "vec")).join(named, ["h", "label", "vec"])
    return got.select(F.col("id").alias(id_col), "n_links", "component_id").unionByName(alone)
