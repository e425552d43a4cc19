"""Periodic runs of words: seeds on diagonals, extended once each.

A run is a stretch of words that repeats with a smallest period q at least ``min_periods``
times over ``min_length`` words or more and cannot be extended. The words of a run agree
with those q further on, so two copies of a k-gram lie q apart in it, where k is the least
overlap that the limits guarantee. k-grams of each document are indexed for classes of lags
``lo..hi``, every class with its own guaranteed k >= hi. As k is no shorter than the lag,
the next copy of a run's k-gram is exactly one smallest period away, so only neighbouring
occurrences have to be paired (a shorter lag would make the whole run's period shorter).

Each pair is a seed on the diagonal of its lag. A table holds how far each lag is covered,
so that the many seeds of one run are extended once; k-grams are compared by exact ranks
(prefix doubling), never by hashes alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import ship

RUNS = "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"
Reword = Callable[[int | None, list[bytes]], list[bytes]]
_BATCH = 512  # documents given back at a time


def lag_classes(n: int, min_length: int, min_periods: int) -> list[tuple[int, int, int]]:
    """(lowest lag, highest lag, guaranteed overlap) of the periods that ``n`` words can hold."""
    k = min(max(min_length - q, (min_periods - 1) * q) for q in range(1, min_length + 1))
    out, lo = [], 1
    while lo * min_periods <= n:
        out.append((lo, k, k))
        lo, k = k + 1, (min_periods - 1) * (k + 1)
    return out


def _may_repeat(ids: np.ndarray, k: int) -> bool:
    """False only if all k-grams (k a power of two or more) differ: equal ones have equal hashes."""
    h, p = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    while 2 * p <= k:
        h = (h[:-p] ^ h[:-p] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + h[p:]
        p *= 2
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of the pairs (a, b)."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]


def _extended(ids: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The widest first..last+1 around ``at`` whose words equal those ``lag`` further on."""
    last, step = at, 64
    while last + lag < len(ids):
        end = min(last + step, len(ids) - lag)
        differ = np.flatnonzero(ids[last:end] != ids[last + lag:end + lag])
        if len(differ):
            last += int(differ[0])
            break
        last, step = end, 2 * step
    first, step = at, 64
    while first:
        begin = max(0, first - step)
        differ = np.flatnonzero(ids[begin:first] != ids[begin + lag:first + lag])
        if len(differ):
            first = begin + int(differ[-1]) + 1
            break
        first, step = begin, 2 * step
    return first, last


def find_runs(words: list[bytes], min_length: int = 24, min_periods: int = 3) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of words, by start, then period."""
    if min_periods < 3 or min_length < 3:
        raise ValueError("runs need three periods and three words at least")
    n, index = len(words), {}
    classes = lag_classes(n, min_length, min_periods) if n >= min_length else []
    if not classes:
        return []
    ids = np.array([index.setdefault(w, len(index)) for w in words], dtype=np.int64)
    if len(index) == n or not _may_repeat(ids.astype(np.uint64), classes[0][2]):
        return []
    out, rank, p, covered = [], ids, 1, {}
    for lo, hi, k in classes:
        while 2 * p <= k and p < len(rank):
            rank, p = _paired(rank[:-p], rank[p:]), 2 * p
        if k >= n or int(rank.max()) == len(rank) - 1:
            break  # all p-grams differ, and so do longer ones
        grams = _paired(rank[:n - k + 1], rank[k - p:k - p + n - k + 1])
        order = np.argsort(grams, kind="stable")
        lag = np.diff(order)
        seed = (grams[order[1:]] == grams[order[:-1]]) & (lag >= lo) & (lag <= hi)
        at, lag = order[:-1][seed], lag[seed]
        by = np.lexsort((at, lag))
        at, lag = at[by], lag[by]
        # seeds next to each other on a diagonal: the first stands for them
        lead = np.ones(len(at), bool)
        lead[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
        for i, q in zip(at[lead].tolist(), lag[lead].tolist()):
            if i < covered.get(q, 0):
                continue
            first, covered[q] = _extended(ids, i, q)
            length = covered[q] - first + q
            if length >= max(min_length, min_periods * q):
                out.append((first, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside of every run but for its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def _over(min_length: int, min_periods: int, reword: Reword | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), _BATCH):
                part, rows = pdf.iloc[k:k + _BATCH], []
                for i, text in zip(part["id"], part["text"]):
                    words = text.encode("utf-8", "surrogatepass").split()  # bytes: only ASCII white space separates
                    if reword:
                        words = reword(None if pd.isna(i) else int(i), words)
                    runs = find_runs(words, min_length, min_periods)
                    kept = b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass")
                    rows.append((len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], kept))
                yield pd.DataFrame(rows, columns=["n_words", "runs", "text"], index=part.index).assign(id=part["id"])[["id", "n_words", "runs", "text"]]

    return run


def periodic_runs(docs: DataFrame, min_length: int = 24, min_periods: int = 3, id_col: str = "doc_id", text_col: str = "text",
                  reword: Reword | None = None) -> DataFrame:
    """One row per row of ``docs``: its id, n_words, runs (array of start, length, period in words,
    by start, then period) and the text with each run cut down to its first period, words
    joined by one space.

    Documents never meet, so nothing is shuffled and a group of copies costs what its rows do;
    a document's memory is a few numbers per word. Words are separated by ASCII white space and
    compared by their bytes. A NULL, empty or blank text has no words, no runs and the empty
    text; NULL and repeated ids and repeated rows each keep their row. Runs may overlap; ties do
    not arise (a start and a period name one run). An empty table gives an empty result; only the
    two named columns are read, so others never clash. ``reword(id, words)`` may replace the
    words before the search.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(_over(min_length, min_periods, reword), RUNS)


def strongest(runs: str = "runs"):
    """The run with the greatest exact length / period (ties: smallest start, then period), NULL if none."""
    def better(a, b):
        ra, rb = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(a["start"].isNull() | (rb > ra), b).otherwise(a)  # in order of start and period, the first of ties stays

    nothing = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, nothing, better)
