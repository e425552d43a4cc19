"""Phrase collocations by counting quotient filters of packed word-id n-grams.

1. Each task cuts its documents into chunks: the words' places in a dictionary of the chunk, with
   marks where a phrase may not go on, and that dictionary with its counts. Dictionaries
   are summed; words rarer than ``min_count`` cannot be part of a candidate (a phrase is no
   more frequent than its words), the others get ids without gaps. Ids go back to the
   chunks that use them, so no dictionary is ever broadcast or collected.
2. Each task counts the phrases of 2 to ``max_words`` frequent words of its chunks in a counting quotient filter
   (``quotient.py``) and hands it on cut by quotient. Filters of one range of quotients are merged
   across tasks. The permutation spreads phrases evenly, and however frequent one is, each
   filter has it once: there are no hot ranges. With many filters the merge goes in
   rounds: each takes the next bits of the quotient and merges up to ``2 ** fan_bits`` filters.
3. Frequent phrases look up the counts of their parts, are scored at their weakest cut, dropped where a
   longer candidate explains them, and ranked within their language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.llm import quotient as Q
from cohortlens.llm.common import materialize, rows_per_bucket, runs, ship
from cohortlens.llm.running import running_before

CHUNK = 1 << 20  # words of a chunk; a longer document is one chunk
FILTER = 1 << 21  # phrases that a filter counts before it is handed on, or one chunk's if more
SHARD = 1 << 21  # phrases, repeated ones included, for which a range of quotients is laid out
BREAK = -1
CHUNKS = "chunk long, place int, lang string, word string, n long, ids binary"
IDS = ["i1", "i2", "i3", "i4"]


@dataclass(frozen=True)
class Phrases:
    """``share``: a candidate goes if a longer one around it has so many percent of its occurrences or more.
    ``unit`` is the score of a phrase whose parts never occur without it, twice."""

    min_count: int = 30
    max_words: int = 4
    share: int = 80
    unit: int = 2_000_000
    top: int = 2000
    fan_bits: int = 10

    def __post_init__(self) -> None:
        if not 2 <= self.max_words <= 4 or min(self.min_count, self.share, self.unit, self.top, self.fan_bits) < 1:
            raise ValueError("phrases have two to four words; all limits are positive")


_TO_BREAK = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")


def tokens(text: str) -> list[bytes]:
    """The lower-cased (A-Z) words of a text, with b"\\n" where a piece ends."""
    data = text.encode("utf-8", "surrogatepass").lower().translate(_TO_BREAK).replace(b"\n", b" \n ")
    return [w for w in data.split(b" ") if w]


def squeezed(places: list[int]) -> bytes:
    """Places of a dictionary in little space: the bytes of equal weight stand together, most of the upper ones are zero."""
    planes = np.array(places, dtype="<i4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").reshape(-1)


def _chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    base, seq = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, 0
    index, places = {}, []

    def out() -> Iterator[pd.DataFrame]:
        ids = np.array(places, dtype="<i4")
        n = np.bincount(ids[ids >= 0], minlength=len(index))
        chunk = base + seq
        for k in range(0, len(index), 50_000):
            keys = list(index)[k:k + 50_000]
            yield pd.DataFrame({"chunk": chunk, "place": np.arange(k, k + len(keys), dtype=np.int32), "lang": [x[0] for x in keys],
                                "word": [x[1].decode("utf-8", "surrogatepass") for x in keys], "n": n[k:k + len(keys)].astype(np.int64), "ids": None})
        yield pd.DataFrame({"chunk": [chunk], "place": [BREAK], "lang": [None], "word": [None], "n": [None], "ids": [squeezed(places)]})

    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"]):
            places += [BREAK if w == b"\n" else index.setdefault((lang, w), len(index)) for w in tokens(text)]
            places.append(BREAK)
            if len(places) >= CHUNK:
                yield from out()
                seq, index, places = seq + 1, {}, []
    if index:
        yield from out()


def grams(ids: np.ndarray, most: int) -> list[np.ndarray]:
    """Four columns of word ids, 0 where a phrase has ended, of all phrases of 2 to ``most`` words
    in ``ids`` (0: a rare word or the end of a piece)."""
    cols: list[list[np.ndarray]] = [[], [], [], []]
    for k in range(2, min(most, len(ids)) + 1):
        parts = [ids[j:len(ids) - k + 1 + j] for j in range(k)]
        whole = np.logical_and.reduce([p > 0 for p in parts])
        for j in range(4):
            cols[j].append(parts[j][whole] if j < k else np.zeros(int(whole.sum()), np.int64))
    return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]


def _filters(most: int, width: int, bits: int):
    """Filters, cut by the first ``bits`` bits of the quotient, of the phrases in the chunks of a task. The rows come sorted by
    chunk and place, the chunk's own row first."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, number, part = [], 0, 0, TaskContext.get().partitionId()

        def out() -> pd.DataFrame:
            x = tuple(np.concatenate([h[i] for h in held]) for i in (0, 1))
            blocks = Q.split(*Q.counted(x), 4 * width, bits)
            return pd.DataFrame({"prefix": [p for p, _ in blocks], "filter": (part << 20) + number, "block": [b for _, b in blocks]})

        for pdf in runs(batches, "chunk"):
            places = unsqueezed(pdf["ids"].iloc[0])
            ids = np.zeros(int(places.max(initial=-1)) + 2, np.int64)  # the last entry is that of a break
            ids[pdf["place"].to_numpy()[1:]] = pdf["id"].to_numpy()[1:]
            found = Q.pack(grams(ids[places], most), width)
            held.append(found)
            size += len(found[0])
            if size >= FILTER:
                yield out()
                held, size, number = [], 0, number + 1
        if size:
            yield out()

    return run


def _merged(width: int, done: int, more: int, least: int | None):
    """Sums the filters of each range of quotients (``done`` bits), sorted by it and by group. They are
    cut by ``more`` further bits, or at the end (``least``) give the phrases that are frequent enough."""
    bits = 4 * width - done

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(batches, "prefix", "filter"):
            prefix, number = int(pdf["prefix"].iloc[0]), int(pdf["filter"].iloc[0])
            parts = [Q.decode(b, prefix, bits) for b in pdf["block"]]
            x, n = Q.counted(tuple(np.concatenate([p[0][i] for p in parts]) for i in (0, 1)), np.concatenate([p[1] for p in parts]))
            if least is None:
                blocks = Q.split(x, n, 4 * width, done + more)
                yield pd.DataFrame({"prefix": [p for p, _ in blocks], "filter": number, "block": [b for _, b in blocks]})
            else:
                often = n >= least
                yield pd.DataFrame(dict(zip(IDS, Q.unpack((x[0][often], x[1][often]), width)), a=n[often]))

    return run


def rounds(filters: int, shards: int, fan_bits: int) -> list[int]:
    """Bits of the quotient that each round of merging takes: together enough for ``shards``, in rounds of at most
    ``fan_bits``, and as many rounds as ``filters`` need when each merges ``2 ** fan_bits`` of them."""
    bits = max(0, shards - 1).bit_length()
    n = max(1, -(-bits // fan_bits), -(-max(0, filters - 1).bit_length() // fan_bits))
    return [bits * (k + 1) // n - bits * k // n for k in range(n)]


def count_phrases(chunks: DataFrame, vocabulary: DataFrame, n_ids: int, n_words: int, p: Phrases) -> DataFrame:
    """(i1, i2, i3, i4, a) of all phrases of two words or more that occur ``min_count`` times, written to the shared folder."""
    width = max(1, n_ids.bit_length())
    if width > Q.MAX_WIDTH:
        raise ValueError(f"{n_ids} frequent words: more than {Q.MAX_WIDTH} bits for a word")
    ids = chunks.where("place >= 0").join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).select("chunk", "place", F.lit(None).cast("binary").alias("ids"), "id")
    rows = chunks.where("place < 0").select("chunk", "place", "ids", F.lit(0).cast("long").alias("id")).unionByName(ids)
    rows = rows.repartition("chunk").sortWithinPartitions("chunk", "place")
    total = n_words * (p.max_words - 1)
    steps = rounds(-(-total // FILTER), min(-(-total // SHARD), 1 << 4 * width), p.fan_bits)
    found, done = rows.mapInPandas(_filters(p.max_words, width, steps[0]), "prefix long, filter long, block binary"), 0
    for k, more in enumerate(steps):
        done += more
        last = k == len(steps) - 1
        # a group of filters for each round but the last; a filter's number says nothing about its content
        group = F.lit(0).cast("long") if last else F.expr(f"pmod(xxhash64(filter), {1 << p.fan_bits * (len(steps) - 1 - k)})")
        found = found.withColumn("filter", group).repartition("prefix", "filter").sortWithinPartitions("prefix", "filter")
        found = found.mapInPandas(_merged(width, done, 0 if last else steps[k + 1], p.min_count if last else None),
                                  ", ".join(f"{c} long" for c in [*IDS, "a"]) if last else "prefix long, filter long, block binary")
        if not last:
            found = materialize(found, "phrase-filters")
    return materialize(found, "phrase-counts")


def _part(first: int, last: int) -> list[Column]:
    """Ids of the words first..last of a phrase, filled up with 0."""
    return [(F.col(IDS[first + j]) if first + j <= last else F.lit(0).cast("long")) for j in range(4)]


def _named(ids: list[Column], **more: Column) -> Column:
    return F.struct(*[c.alias(f"p{j}") for j, c in enumerate(ids)], *[c.alias(k) for k, c in more.items()])


def size_of() -> Column:
    """Number of words of a phrase."""
    return 2 + (F.col("i3") > 0).cast("int") + (F.col("i4") > 0).cast("int")


def scored(counts: DataFrame, vocabulary: DataFrame, p: Phrases) -> DataFrame:
    """Every candidate with l, r and score at its weakest cut (ties: the earliest)."""
    zero = F.lit(0).cast("long").alias
    every = counts.select(*IDS, "a").unionByName(vocabulary.select(F.col("id").alias("i1"), zero("i2"), zero("i3"), zero("i4"), F.col("f").alias("a")))
    every = every.select(*[F.col(c).alias(f"p{j}") for j, c in enumerate(IDS)], F.col("a").alias("f"))
    parts = F.array(*[F.when(size_of() == n, F.array(*[_named(_part(*at), cut=F.lit(k), side=F.lit(s)) for k in range(1, n)
                                                       for s, at in ((0, (0, k - 1)), (1, (k, n - 1)))])) for n in range(2, p.max_words + 1)])
    asked = counts.select(*IDS, "a", F.explode(F.flatten(F.filter(parts, lambda x: x.isNotNull()))).alias("x")).select(*IDS, "a", "x.*")
    # a word that is part of many phrases is one hot key: both sides are dealt for this join alone, so it can be split
    got = asked.join(every, [f"p{j}" for j in range(4)])
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f")))
    cuts = got.groupBy(*IDS, "a", "cut").agg(side(0).alias("l"), side(1).alias("r"))
    exact = F.expr(f"cast(a as decimal(38,0)) * {p.unit} div cast(l + r as decimal(38,0))").cast("long")
    best = cuts.groupBy(*IDS, "a").agg(F.min(F.struct(exact.alias("score"), "cut", "l", "r")).alias("m"))
    return best.select(*IDS, "a", "m.l", "m.r", "m.score")


def explained(counts: DataFrame, p: Phrases) -> DataFrame:
    """Candidates that lie in a longer one which has ``share`` percent of their occurrences."""
    inner = F.array(*[F.when(size_of() == n, F.array(*[_named(_part(i, i + k - 1)) for k in range(2, n) for i in range(n - k + 1)]))
                      for n in range(3, p.max_words + 1)])
    rows = counts.where("i3 > 0").select("a", F.explode(F.flatten(F.filter(inner, lambda x: x.isNotNull()))).alias("x"))
    most = rows.groupBy(*[F.col(f"x.p{j}").alias(IDS[j]) for j in range(4)]).agg(F.max("a").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    return counts.join(most, IDS).where(wide("longer") * 100 >= wide("a") * p.share).select(*IDS)


def collocations(docs: DataFrame, p: Phrases = Phrases(), lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of every language.

    Words are lower-cased (A-Z), pieces end at ``.,;:!?`` and line ends, phrases stay within a piece and a
    document. NULL languages are ``und``, together with that value itself; NULL, empty and word-less texts have no words, and
    repeated rows count as often as they occur. Ids are not used. Counts are exact over all documents and whole
    texts; ties of score and count go by the phrase's bytes. No candidates, or an empty table, give an empty result.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chunks = materialize(rows.mapInPandas(_chunked, CHUNKS), "phrase-chunks")
    words = chunks.where("place >= 0").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    often = materialize(words.where(F.col("f") >= p.min_count), "phrase-words")
    totals = materialize(chunks.where("place >= 0").groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    n_ids, n_words = often.count(), totals.agg(F.sum("n")).first()[0] or 0
    buckets = -(-max(1, n_ids) // rows_per_bucket(n_ids))
    numbered = running_before(often.withColumn("b", F.pmod(F.xxhash64("lang", "word"), F.lit(buckets))), None, "b", [F.col("lang"), F.col("word")],
                              {"before": F.lit(1).cast("long")})
    vocabulary = materialize(numbered.select((F.col("before") + 1).alias("id"), "lang", "word", "f"), "phrase-vocabulary")
    counts = count_phrases(chunks, vocabulary, n_ids, n_words, p)
    kept = scored(counts, vocabulary, p).join(explained(counts, p), IDS, "left_anti")
    lang = vocabulary.select(F.col("id").alias("i1"), "lang")
    kept = materialize(kept.join(lang, "i1"), "phrase-scores")
    # at most unit / 2 + 1 scores a language; phrases below the score that fills the top are out
    down = Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    scores = kept.groupBy("lang", "score").agg(F.count("*").alias("k")).withColumn("above", F.coalesce(F.sum("k").over(down), F.lit(0)))
    cut = scores.where(F.col("above") < p.top).groupBy("lang").agg(F.min("score").alias("least"))
    near = materialize(kept.join(cut, "lang").where("score >= least").drop("least"), "phrase-top")
    salts = max(1, near.count() // 100_000)
    word = F.explode(F.filter(F.array(*[F.struct(F.lit(j).alias("at"), F.col(c).alias("id")) for j, c in enumerate(IDS)]), lambda x: x["id"] > 0))
    spelled = near.select("*", word.alias("x")).select("*", "x.*").join(vocabulary.select("id", "word"), "id")
    spelled = spelled.groupBy(*IDS, "lang", "a", "l", "r", "score").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    spelled = spelled.withColumn("phrase", F.array_join(F.col("w.word"), " "))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    ranked = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= p.top)
    if salts > 1:
        spelled = ranked(spelled.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))), "lang", "salt").drop("rank", "salt")
    return ranked(spelled, "lang").join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
