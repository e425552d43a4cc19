"""Line dedup by pairwise alignment: blocks of lines that an earlier document already has.

Every line with words is hashed, and so are the smallest runs of lines with at least
``min_words`` words from each line on and up to each line.

1. Two documents meet in a rare line (one that at most ``rare`` documents hold), whichever they are.
   A frequent line or run is owned by the earliest document that holds it and pairs every later one
   with that owner, so nothing is capped, and a passage in thousands of documents gives thousands of
   pairs and not millions.
2. Before any text travels, the words of all lines that a pair shares are summed from rows of
   (document, line hash), looked up from the side with fewer shared lines. A pair that shares
   fewer than ``min_words`` words is done: no alignment could reach them.
3. The whole line sequences of the other pairs are aligned like a patience diff: lines that occur
   once in both are anchors, the longest chain of anchors in the order of both is kept, and what
   lies between two anchors is aligned in the same way. Where the aligned lines have at least
   ``min_words`` words together, every aligned block is deleted from the later document, however
   short, so scattered edits do not save the text between them. Each pair is a row of its
   own: the pairs of one document are spread over tasks, only their blocks come together.

Beyond the alignment, a run that has ``min_words`` words by itself and is owned by an earlier
document is deleted wherever it stands (moved or repeated).
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import materialize, ship

MIN_WORDS = 30
RARE = 8  # documents that may hold a line for all of them to be paired: 28 pairs a line at most

# first is -1 in the row that holds a document's whole sequence of lines; n is how often a document has a line (in
# the row of its first place, 0 in those of later ones and of runs of several lines)
WINDOWS = "doc long, tkey long, first int, last int, w1 long, w2 long, run boolean, n int, words int, lines binary"
LINE = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("words", "<u4")])
BLOCKS = "doc long, tkey long, first int, last int, doc_id long"
MERGED = "doc long, tkey long, blocks array<struct<first:int,last:int,doc_id:long>>"
_ROWS = 100_000  # rows given back at a time


def windows(lines: list[str], min_words: int) -> list[tuple[int, int]]:
    """The smallest runs (first, last) of at least ``min_words`` words that begin with each
    line, and those that end with each line. Blank lines neither begin nor end a run."""
    words = [len(x.split()) for x in lines]
    upto = np.concatenate([[0], np.cumsum(words)])
    found: set[tuple[int, int]] = set()
    # forward: the first line at which the total is reached; backward: the last line to begin from
    ends = np.searchsorted(upto, upto[:-1] + min_words, side="left") - 1
    begins = np.searchsorted(upto, upto[1:] - min_words, side="right") - 1
    for i, n in enumerate(words):
        if n and ends[i] < len(lines):
            found.add((i, int(ends[i])))
        if n and upto[i + 1] >= min_words:
            found.add((int(begins[i]), i))
    return sorted(found)


def _hash(lines: list[str]) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest("\n".join(lines).encode("utf-8", "surrogatepass"))
    return h >> 64, h & (1 << 64) - 1


def _rows_of(doc, tkey, text: str, min_words: int) -> Iterator[tuple]:
    lines = [x.strip() for x in text.split("\n")]
    hashes, words = [_hash([x]) for x in lines], [len(x.split()) for x in lines]
    yield doc, tkey, -1, -1, 0, 0, False, 0, 0, np.array([(*h, n) for h, n in zip(hashes, words)], dtype=LINE).tobytes()
    left = Counter(hashes)  # popped with a line's first place
    for i, n in enumerate(words):
        if n:
            yield doc, tkey, i, i, *hashes[i], n >= min_words, left.pop(hashes[i], 0), n, None
    for i, j in windows(lines, min_words):
        if i < j:
            yield doc, tkey, i, j, *_hash(lines[i:j + 1]), True, 0, 0, None


def _windows(min_words: int):
    cols = [c.split()[0] for c in WINDOWS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for pdf in batches for d in zip(pdf["doc"], pdf["tkey"], pdf["text"]) for r in _rows_of(*d, min_words))
        while out := list(islice(rows, _ROWS)):
            got = np.array([x[4:6] for x in out], dtype=np.uint64).reshape(-1, 2).view(np.int64)
            frame = pd.DataFrame([x[:4] + x[6:] for x in out], columns=cols[:4] + cols[6:])
            yield frame.assign(w1=got[:, 0], w2=got[:, 1])[cols]

    return run


def chain(places: list[int]) -> list[int]:
    """Indices of a longest strictly ascending subsequence."""
    tails, at, back = [], [], []
    for k, p in enumerate(places):
        i = bisect_left(tails, p)
        tails[i:i + 1] = [p]
        at[i:i + 1] = [k]
        back.append(at[i - 1] if i else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def merged(blocks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint blocks in order; those that overlap become one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(blocks):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _sequence(lines: bytes) -> tuple[list[tuple[int, int]], list[int]]:
    """The hashes of a document's lines and their numbers of words."""
    got = np.frombuffer(lines, LINE)
    return list(zip(got["h1"].tolist(), got["h2"].tolist())), got["words"].tolist()


def matched(mine: list, words: list[int], theirs: list) -> list[tuple[int, int]]:
    """(line, line of the other) of a patience alignment of two whole sequences, ascending in
    both; ``words`` of mine, as lines without words are no anchors."""
    out, todo = [], [(0, len(mine), 0, len(theirs))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and mine[a] == theirs[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and mine[b - 1] == theirs[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        at, places = defaultdict(list), defaultdict(list)
        for k in range(a, b):
            if words[k]:
                at[mine[k]].append(k)
        for k in range(c, d):
            if theirs[k] in at:
                places[theirs[k]].append(k)
        anchors = [(at[x][0], q[0]) for x, q in places.items() if len(at[x]) == len(q) == 1]
        # nothing occurs once in both: the first of mine with the first of theirs, and so on
        anchors = sorted(anchors or [m for x, q in places.items() for m in zip(at[x], q)])
        anchors = [anchors[k] for k in chain([q for _, q in anchors])]
        out += anchors
        if anchors:
            todo += [(i + 1, j, p + 1, q) for (i, p), (j, q) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)])]
    return sorted(out)


def aligned_blocks(mine: list, words: list[int], theirs: list, min_words: int) -> list[tuple[int, int]]:
    """Blocks (first, last) of aligned lines that are neighbours in both documents, without the
    blank lines at their ends; none if all of them together have fewer than ``min_words`` words."""
    pairs = matched(mine, words, theirs)
    if sum(words[k] for k, _ in pairs) < min_words:
        return []
    blocks, at = [], None
    for k, q in pairs:
        near, at = at == (k - 1, q - 1), (k, q)
        if near and blocks:
            blocks[-1].append(k)
        else:
            blocks.append([k])
    full = ([k for k in ks if words[k]] for ks in blocks)
    return [(ks[0], ks[-1]) for ks in full if ks]


def _aligned(min_words: int):
    """The common blocks of each pair of documents."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for doc, tkey, other, mine, theirs in zip(*[pdf[c].tolist() for c in ("doc", "tkey", "odoc", "lines", "olines")]):
                found = aligned_blocks(*_sequence(mine), _sequence(theirs)[0], min_words)
                out += [(doc, tkey, first, last, other) for first, last in found]
            yield pd.DataFrame(out, columns=["doc", "tkey", "first", "last", "doc_id"])

    return run


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All blocks of a document in one row, those of each other document merged. The rows come sorted by both."""
    rows = (r for pdf in batches for r in zip(*[pdf[c].tolist() for c in ("doc", "tkey", "doc_id", "first", "last")]))
    whole = ((*key, [{"first": a, "last": b, "doc_id": other} for other, part in groupby(mine, key=lambda r: r[2])
                     for a, b in merged([r[3:] for r in part])]) for key, mine in groupby(rows, key=lambda r: r[:2]))
    while out := list(islice(whole, 1000)):
        yield pd.DataFrame(out, columns=["doc", "tkey", "blocks"])


def meeting_pairs(hits: DataFrame, rare: int) -> DataFrame:
    """(doc, tkey, odoc, okey) of the later and the earlier document of every pair to look at: an owner with each
    later holder, and all holders of a rare line with each other."""
    owned = hits.where("doc > odoc").select("doc", "tkey", "odoc", "okey")
    few = hits.where((F.col("n") > 0) & (F.col("holders") <= rare)).groupBy("w1", "w2").agg(F.collect_set(F.struct("doc", "tkey")).alias("d"))
    one = few.select("d", F.explode("d").alias("x"))
    met = one.select("x.*", F.explode(F.filter("d", lambda y: y["doc"] < F.col("x.doc"))).alias("y"))
    return owned.union(met.select("doc", "tkey", "y.doc", "y.tkey")).distinct()


def sharing_pairs(pairs: DataFrame, hits: DataFrame, min_words: int) -> DataFrame:
    """The pairs whose common lines have ``min_words`` words; a line counts as often as both documents have it."""
    lines = materialize(hits.where("n > 0").select("doc", "tkey", "w1", "w2", "n", "words"), "shared-lines")
    sizes = materialize(lines.groupBy("doc", "tkey").agg(F.count("*").alias("size")), "shared-sizes")
    size = lambda doc, key, name: sizes.withColumnsRenamed({"doc": doc, "tkey": key, "size": name})
    sized = pairs.join(size("doc", "tkey", "mine"), ["doc", "tkey"]).join(size("odoc", "okey", "theirs"), ["odoc", "okey"])
    # each pair is looked up from the document with fewer such lines: a long one is not sent to everybody who has its title
    small = F.col("mine") <= F.col("theirs")
    pick = lambda a, b, name: F.when(small, F.col(a)).otherwise(F.col(b)).alias(name)
    asked = sized.select("doc", "tkey", "odoc", "okey", pick("doc", "odoc", "sdoc"), pick("tkey", "okey", "skey"),
                         pick("odoc", "doc", "ldoc"), pick("okey", "tkey", "lkey"))
    asked = asked.join(lines.withColumnsRenamed({"doc": "sdoc", "tkey": "skey", "n": "sn"}), ["sdoc", "skey"])
    both = asked.join(lines.drop("words").withColumnsRenamed({"doc": "ldoc", "tkey": "lkey", "n": "ln"}), ["ldoc", "lkey", "w1", "w2"])
    words = both.groupBy("doc", "tkey", "odoc", "okey").agg(F.sum(F.least("sn", "ln").cast("long") * F.col("words")).alias("common"))
    return words.where(F.col("common") >= min_words).drop("common")


def common_blocks(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE) -> DataFrame:
    """(doc, tkey, blocks) of every document that repeats lines of an earlier one: blocks of
    line numbers and the document they were aligned with. tkey is the text's xxhash64."""
    ship(docs.sparkSession)
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("tkey"), F.col(text_col).alias("text"))
    every = materialize(texts.mapInPandas(_windows(min_words), WINDOWS), "line-runs")
    found = every.where("first >= 0").drop("lines")
    owners = found.groupBy("w1", "w2").agg(F.min(F.struct("doc", "tkey")).alias("o"), F.max("doc").alias("high"),
                                           F.sum((F.col("n") > 0).cast("long")).alias("holders")).where(F.col("high") > F.col("o.doc"))
    owners = owners.select("w1", "w2", F.col("o.doc").alias("odoc"), F.col("o.tkey").alias("okey"), "holders")
    hits = materialize(found.join(owners, ["w1", "w2"]), "line-hits")
    pairs = materialize(meeting_pairs(hits, rare), "document-pairs")
    pairs = materialize(sharing_pairs(pairs, hits, min_words), "sharing-pairs")
    keys, okeys = ["doc", "tkey"], ["odoc", "okey"]
    sequences = materialize(every.where("first < 0").select(*keys, "lines").dropDuplicates(keys), "line-sequences")
    # the owner of a frequent passage is in many pairs: both sides are dealt for each join alone, so its partition can be split
    theirs = sequences.select(F.col("doc").alias("odoc"), F.col("tkey").alias("okey"), F.col("lines").alias("olines"))
    aligned = pairs.join(sequences, keys).join(theirs, okeys).mapInPandas(_aligned(min_words), BLOCKS)
    runs = hits.where(F.col("run") & (F.col("doc") > F.col("odoc"))).select(*keys, "first", "last", F.col("odoc").alias("doc_id"))
    blocks = aligned.unionByName(runs).repartition(*keys).sortWithinPartitions(*keys, "doc_id")
    return blocks.mapInPandas(_together, MERGED)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE) -> DataFrame:
    """All columns of ``docs``, the text without its aligned common blocks, plus __blocks (array,
    NULL if none), __lines and __deleted (line counts) and __empty: every line with words is gone.

    "Earlier" is the smaller id. Lines are compared without surrounding white space; other
    lines keep their bytes. A deleted line is always still held by an earlier document.
    ``rare``: rows that may hold a line for all their documents to be paired with each other.
    NULL, empty and word-less texts and NULL ids are left alone. Rows of one id are never
    compared with each other; repeated rows get the same result each. Lines stay where all
    that is aligned with one other document has fewer than ``min_words`` words, so headers and
    short phrases of clean documents do. An empty table gives an empty result.
    """
    blocks = materialize(common_blocks(docs, min_words, id_col, text_col, rare), "line-blocks")
    blocks = blocks.select(F.col("doc").alias("__doc"), F.col("tkey").alias("__tkey"), F.col("blocks").alias("__blocks"))
    # always dealt by document, so the plan is the same at every size and only this small side is held in memory
    df = docs.join(blocks.hint("shuffle_hash"), (F.col(id_col) == F.col("__doc")) & (F.xxhash64(text_col) == F.col("__tkey")), "left")
    lines = F.split(text_col, "\n", -1)
    gone = lambda k: F.exists("__blocks", lambda b: (k >= b["first"]) & (k <= b["last"]))
    left = F.filter(lines, lambda x, k: ~gone(k))
    df = df.withColumn("__left", F.when(F.col("__blocks").isNotNull(), left))
    count = F.coalesce(F.size(lines), F.lit(0))
    df = df.withColumns({"__lines": F.when(F.col(text_col).isNull(), 0).otherwise(count),
                         "__deleted": F.when(F.col("__left").isNull(), 0).otherwise(count - F.size("__left"))})
    text = F.when(F.col("__left").isNull(), F.col(text_col)).otherwise(F.array_join("__left", "\n"))
    df = df.withColumn("__empty", F.col("__left").isNotNull() & ~F.coalesce(text.rlike(r"[^\s]"), F.lit(False)))
    return df.withColumn(text_col, text).drop("__doc", "__tkey", "__left")
