"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of one to three characters are hashed to a fixed number of features. Document
frequencies are counted over all labelled training documents on the cluster; the weights
are fitted on a bounded sample of them by follow-the-regularised-leader with an elastic
net, and a temperature on a part of the sample kept aside calibrates the scores.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.llm.common import materialize, ship

DIM_BITS = 15
DIM = 1 << DIM_BITS
GRAMS = 3
CHUNK = 1 << 17  # characters hashed at a time, so memory does not grow with a text
UNDETERMINED = "und"
ENOUGH = 120  # n-grams from which on a text is judged to be in none of the learned languages
MOST_LANGS = 2000  # a dense weight table of so many has 256 MB
LEAST_TEXTS = 20  # of a language, however many there are
RARE = 0.001  # features in a smaller share of the training documents, and without weights, are unknown
UNKNOWN = 0.08  # a text may have this share of unknown n-grams, or more where clean texts have


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def counts(text: str | None) -> np.ndarray | None:
    """How often each feature occurs in a whole text; None if it has no letter.

    Lower-cased; every run of other characters than letters is one blank, and the text
    begins and ends with one, so word starts and ends are n-grams too.
    """
    if not text:
        return None
    total, found, held = None, False, np.array([32], np.uint32)
    low = text.lower()
    for at in range(0, len(low), CHUNK):
        codes = np.frombuffer(low[at:at + CHUNK].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        is_letter = _letters()[codes]
        found = found or bool(is_letter.any())
        codes = np.where(is_letter, codes, 32).astype(np.uint32)
        last = at + CHUNK >= len(low)
        codes = np.concatenate([held, codes, np.array([32] * last, np.uint32)])
        keep = np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]
        codes = codes[keep]
        tail = codes[-(GRAMS - 1):]
        codes, hashes = codes * np.uint32(0x9E3779B1), []
        h = np.zeros(len(codes), np.uint32)
        for n in range(1, GRAMS + 1):
            if len(codes) < n:
                break
            h = h[:len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1:] + np.uint32(n)
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            # an n-gram that lies in what was held back was counted with the chunk before
            new = max(0, len(held) - n + 1) if at else 0
            hashes.append((mixed >> np.uint32(32 - DIM_BITS))[new:])
        got = np.bincount(np.concatenate(hashes), minlength=DIM)
        total, held = got if total is None else total + got, tail
    return total if found else None


@dataclass(frozen=True)
class Model:
    """Languages, IDF of every feature, the features with weights, those, bias, temperature,
    the known features, the largest share of unknown n-grams that fits each language."""

    langs: list[str]
    idf: np.ndarray
    features: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    known: np.ndarray
    limits: np.ndarray

    def dense(self) -> np.ndarray:
        w = np.zeros((DIM, len(self.langs)), np.float32)
        w[self.features] = self.weights
        return w


def tf_idf(features: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(count) * idf[features]
    return x / (np.linalg.norm(x) or 1.0)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = 1.0, beta: float = 1.0,
         l1: float = 1e-3, l2: float = 1e-3, epochs: int = 4) -> np.ndarray:
    """Weights (DIM + 1 rows, the last one the bias) by per-coordinate FTRL-proximal steps;
    ``rows`` are (features, values, class). Weights whose gradient sum stays below ``l1``
    are exactly zero."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))
    rng = np.random.default_rng(0)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            f, x, y = rows[k]
            f, x = np.append(f, DIM), np.append(x, 1.0)
            zi, ni = z[f], n[f]
            w = weights(zi, ni)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            z[f] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[f] = ni + g * g
    return weights(z, n)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores with the smallest log loss on documents not trained on. The
    true class counts as (n + 1) / (n + 2) sure, so that no errors among n do not mean certainty."""
    if not len(y) or scores.shape[1] < 2:
        return 1.0
    sure = np.full(scores.shape, 1 / (len(y) + 2) / (scores.shape[1] - 1))
    sure[np.arange(len(y)), y] = (len(y) + 1) / (len(y) + 2)
    grid = np.geomspace(0.02, 20, 121)
    loss = [-(sure * np.log(np.maximum(_softmax(scores / t), 1e-300))).sum(1).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def unknown_limits(shares: np.ndarray, y: np.ndarray, classes: int) -> np.ndarray:
    """The largest share of unknown n-grams that fits each language: twice what 99% of its documents
    not trained on have, ``UNKNOWN`` at least. All of them count where a language has none, and
    without any everything fits."""
    twice = lambda x: max(UNKNOWN, 2 * float(np.quantile(x, 0.99)))
    if not len(shares):
        return np.ones(classes)
    return np.array([twice(shares[y == k] if (y == k).any() else shares) for k in range(classes)])


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One task's document frequencies (at most DIM rows), and at feature -1 its documents."""
    df, n = np.zeros(DIM, np.int64), 0
    for pdf in batches:
        for text in pdf["text"]:
            c = counts(text)
            if c is not None:
                df += c > 0
                n += 1
    at = np.flatnonzero(df)
    yield pd.DataFrame({"feature": np.r_[-1, at].astype(np.int32), "n": np.r_[n, df[at]]})


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for lang, text in zip(pdf["lang"], pdf["text"]):
            c = counts(text)
            if c is not None:
                at = np.flatnonzero(c)
                out.append((lang, at.astype("<u2").tobytes(), c[at].astype("<u4").tobytes()))
        yield pd.DataFrame(out, columns=["lang", "features", "counts"])


def sample_texts(rows: DataFrame, sample_rows: int, least: int = LEAST_TEXTS) -> tuple[list[str], DataFrame]:
    """All languages of ``rows`` (lang, text), and of each the different texts with the smallest hashes: an equal share of
    ``sample_rows``, ``least`` at least, or all it has. How often a text is repeated makes no difference."""
    keyed = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 11))
    keys = materialize(keyed.select("lang", "h").distinct(), "text-hashes")
    number = {r["lang"]: r["n"] for r in keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(MOST_LANGS + 1).collect()}
    if len(number) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages to learn: the weights of all would not fit into a task")
    share = max(least, -(-sample_rows // max(1, len(number))))
    # about four times the share by hash before any ranking, so that no language is sorted as a whole
    rate = F.create_map(*[x for k, n in number.items() for x in (F.lit(k), F.lit(int(min(1.0, 4 * share / n) * (1 << 53))))]) if number else F.create_map()
    near = keys.where(F.col("h") <= F.try_element_at(rate, F.col("lang"))) if number else keys
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = near.withColumn("k", rank).where(F.col("k") <= share).select("lang", "h")  # share rows a language: bounded
    return list(number), keyed.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")


def train(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", sample_rows: int = 2000) -> Model | None:
    """Fit on the rows where ``learn`` holds, with text and a language; None if there are none.

    Every language is learned (more than ``MOST_LANGS`` raise a ValueError). The weights are fitted on a bounded sample of
    different texts, about ``sample_rows`` in equal shares for all languages, but ``LEAST_TEXTS`` of each. Document
    frequencies cover every training document. Texts without a letter teach nothing.
    """
    ship(docs.sparkSession)
    rows = docs.where(learn).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    names, sample = sample_texts(rows, sample_rows)
    if not names:
        return None
    freq = rows.select("text").mapInPandas(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    freq = freq.toPandas()  # DIM + 1 rows at most
    n_docs = int(freq.loc[freq["feature"] == -1, "n"].sum())
    df = np.zeros(DIM)
    seen = freq[freq["feature"] >= 0]
    df[seen["feature"].to_numpy()] = seen["n"].to_numpy()
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    data = sample.mapInPandas(_features, "lang string, features binary, counts binary").toPandas()
    data = data.sort_values(["lang", "features", "counts"])  # the same order whatever the tasks' order
    fit, kept, times = [], [], []
    for k, (lang, f, c) in enumerate(zip(data["lang"], data["features"], data["counts"])):
        f = np.frombuffer(f, "<u2").astype(np.int64)
        row = (f, tf_idf(f, np.frombuffer(c, "<u4"), idf), names.index(lang))
        if k % 5 == 4:
            kept.append(row)
            times.append(np.frombuffer(c, "<u4"))
        else:
            fit.append(row)
    w = ftrl(fit, len(names))
    scores = np.array([x @ w[f] + w[DIM] for f, x, _ in kept]).reshape(len(kept), len(names))
    y = np.array([y for *_, y in kept], dtype=np.int64)
    t = temperature(scores, y)
    weighted = w[:DIM].any(1)
    used = np.flatnonzero(weighted)
    # a document kept aside does not make its own features known
    shares = [float(c @ ~(weighted[f] | (df[f] - 1 > RARE * n_docs))) / c.sum() for (f, *_), c in zip(kept, times)]
    judged = np.array([c.sum() >= ENOUGH for c in times], dtype=bool)
    limits = unknown_limits(np.array(shares)[judged], y[judged], len(names))
    return Model(names, idf.astype(np.float32), used.astype(np.int32), w[used].astype(np.float32), w[DIM].astype(np.float32), t,
                 weighted | (df > RARE * n_docs), limits)


def _fits(model: Model, best: int, c: np.ndarray) -> bool:
    """Whether a text's share of unknown n-grams is one that texts of the language have, or it is too short to tell."""
    total = int(c.sum())
    return total < ENOUGH or int(c[~model.known].sum()) <= model.limits[best] * total


def _fits_but_for_a_word(model: Model, best: int, text: str) -> bool:
    """The same without the longest word (a key, a name, an address), which by itself is too short to tell."""
    word = max(text.split(), key=len)
    own, rest = counts(word), counts(text.replace(word, " ", 1))
    return (own is None or int(own.sum()) < ENOUGH) and (rest is None or _fits(model, best, rest))


def _predict(model: Model, texts: pd.Series, w: np.ndarray) -> pd.DataFrame:
    langs, scores, fits = [], [], []
    for text in texts:
        c = counts(text)
        if c is None:
            langs.append(UNDETERMINED)
            scores.append(0.0)
            fits.append(False)
            continue
        at = np.flatnonzero(c)
        p = _softmax((tf_idf(at, c[at], model.idf) @ w[at] + model.bias).astype(np.float64) / model.temperature)
        best = int(np.argmax(p))
        langs.append(model.langs[best])
        scores.append(float(p.max()))
        fits.append(_fits(model, best, c) or _fits_but_for_a_word(model, best, text))
    return pd.DataFrame({"lang": langs, "score": scores, "fits": fits})


def predict(model: Model | None, text: Column) -> Column:
    """Struct (lang, score, fits): the most probable learned language, its calibrated probability,
    and whether the text fits it: false where ``ENOUGH`` n-grams or more have too large a share that
    no learned language has, also when the longest word (of fewer than ``ENOUGH``) is left out. ``und`` with score 0, and no fit, if the text is NULL or has no
    letter, or nothing was learned."""
    if model is None:
        return F.struct(F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("score"), F.lit(False).alias("fits"))

    @F.pandas_udf("lang string, score double, fits boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w = model.dense()
        for texts in batches:
            yield _predict(model, texts, w)

    return run.asNondeterministic()(text)  # so that a filter on the result does not run it a second time


def held_out(doc_id: Column) -> Column:
    """Whether a document must not be learned from: CRC-32 of its id as text, mod 3, is 1 (a
    NULL id is not held out, and not learned from either)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, sample_rows: int = 2000) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, lang) plus held_out, lang_pred and score (columns
    of those names are replaced). Predictions read the text alone. An empty table gives an
    empty result, repeated rows repeated results."""
    model = train(docs, docs["doc_id"].isNotNull() & ~held_out(docs["doc_id"]), sample_rows=sample_rows)
    got = docs.drop("held_out", "lang_pred", "score").withColumn("__p", predict(model, F.col("text")))
    return got.withColumns({"held_out": held_out(F.col("doc_id")), "lang_pred": F.col("__p.lang"), "score": F.col("__p.score")}).drop("__p")
