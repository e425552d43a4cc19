"""Sharding along a Hilbert curve over quantised metadata (DataFrame functions only).

Each metadata column is cut into ``2**bits`` quantile steps, a row's steps are a cell of a
small grid, and the cells are visited in Hilbert order. Cutting that order into runs gives
files whose rows are close in every dimension, so a filter on any of the columns skips
most files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from cohortlens.llm.common import materialize, rows_per_bucket
from cohortlens.llm.running import running_before, spread

BITS = 4  # steps per dimension as a power of two: 16


def text_steps(df: DataFrame, name: str, steps: int) -> DataFrame:
    """(name, __step) of every different non-null text of a column: which ``steps``-th of the rows its middle row lies in,
    in order of the whole texts. Rows are counted per text first and only those counts are ordered."""
    counts = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("__n"))
    counts = materialize(counts.repartitionByRange(name).withColumn("__part", F.spark_partition_id()), "shard-texts")
    total = counts.agg(F.sum("__n")).first()[0] or 1
    ranked = running_before(counts, None, "__part", [F.col(name)], {"__before": F.col("__n")})
    return materialize(ranked.select(name, F.expr(f"cast((2 * __before + __n) * {steps} div {2 * total} as int)").alias("__step")), "shard-steps")


def hilbert_index(coords: Column, dims: int, bits: int) -> Column:
    """Position on the Hilbert curve of ``dims`` dimensions of an array of ints below
    ``2**bits`` (Skilling's transform, as array functions)."""
    n, top = dims, 1 << (bits - 1)
    qs = [top >> k for k in range(bits - 1)]
    steps = [F.struct(F.lit(q).alias("q"), F.lit(q - 1).alias("p"), F.lit(i).alias("i")) for q in qs for i in range(n)]

    def untwist(x: Column, s: Column) -> Column:
        t = x[0].bitwiseXOR(F.get(x, s["i"])).bitwiseAND(s["p"])
        return F.when(F.get(x, s["i"]).bitwiseAND(s["q"]) != 0,
                      F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(s["p"])).otherwise(v))).otherwise(
                      F.transform(x, lambda v, j: F.when((j == 0) | (j == s["i"]), v.bitwiseXOR(t)).otherwise(v)))

    if not qs:  # one bit: the Gray code alone
        x = coords
    else:
        x = F.aggregate(F.array(*steps), coords, untwist)
    gray = F.transform(x, lambda v, j: F.aggregate(F.slice(x, F.lit(1), j + 1), F.lit(0), lambda a, b: a.bitwiseXOR(b)))
    if qs:
        turn = F.aggregate(F.array(*[F.lit(q) for q in qs]), F.lit(0), lambda t, q: F.when(
            F.get(gray, F.lit(n - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        gray = F.transform(gray, lambda v: v.bitwiseXOR(turn))
    spots = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(1 << b).alias("b")) for b in reversed(range(bits)) for i in range(n)])
    return F.aggregate(spots, F.lit(0).cast("long"), lambda a, s: a * 2 + F.when(
        F.get(gray, s["i"]).bitwiseAND(s["b"]) != 0, 1).otherwise(0))


def hilbert_shards(df: DataFrame, dims: dict[str, Column], key: Column, size: Column, n_shards: int = 8,
                   bits: int = BITS, law: str = "rows") -> DataFrame:
    """All columns of ``df`` plus hilbert (long), shard (int) and slot (long).

    ``dims`` are texts or numeric expressions, each cut into steps of about equal row counts, NULL in the lowest step;
    ``key`` is a non-null long that spreads rows evenly inside a cell. ``law`` is "rows" (shard counts at most one
    apart) or "bytes" (shards end as near as whole rows allow to equal totals of ``size``, a
    positive long). A cell with many rows (a hot source) is cut into buckets by ``key``; only
    per-bucket counts are ordered globally. Rows that are equal in everything are
    interchangeable. Columns of ``df`` named hilbert, shard or slot are replaced. An empty
    table gives an empty result.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law must be rows or bytes")
    steps, names = 1 << bits, [f"__d{i}" for i in range(len(dims))]
    df = df.drop("hilbert", "shard", "slot").withColumns(
        {**dict(zip(names, dims.values())), "__size": size, "__key": key})
    texts = [c for c in names if isinstance(df.schema[c].dataType, StringType)]
    cuts_at = [k / steps for k in range(1, steps)]
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.sum("__size").alias("bytes"),
                   *[F.percentile_approx(c, cuts_at, 10000).alias(c) for c in names if c not in texts]).first()  # one row of bounded size
    n, total = stats["n"], stats["bytes"] or 0
    for c in texts:
        df = df.join(text_steps(df, c, steps), c, "left").drop(c).withColumn(c, F.coalesce("__step", F.lit(0))).drop("__step")
    step = {c: F.col(c) if c in texts else sum([F.when(F.col(c) > F.lit(v), 1).otherwise(0) for v in stats[c] or []], F.lit(0)) for c in names}
    cell = F.lit(0)
    for c in names:
        cell = cell * steps + step[c]
    df = df.withColumn("__cell", cell.cast("int")).drop(*names)
    axes = F.array(*[F.shiftright("__cell", bits * (len(names) - 1 - i)).bitwiseAND(steps - 1) for i in range(len(names))])
    # at most 2 ** (bits * dims) cells, whatever the input: bounded, so broadcast
    cells = df.groupBy("__cell").agg(F.count(F.lit(1)).alias("__rows")).select(
        "__cell", hilbert_index(axes, len(names), bits).alias("hilbert"),
        F.ceil(F.col("__rows") / F.lit(rows_per_bucket(n))).cast("long").alias("__subs"))
    h = F.shiftrightunsigned(F.xxhash64("__key"), 33)
    df = df.join(F.broadcast(cells), "__cell").withColumn(
        "__bucket", F.shiftleft("hilbert", 32) + spread(h, F.col("__subs")))
    order = [h, F.col("__key"), F.col("__size")]
    df = running_before(df, None, "__bucket", order, {"__rank": F.lit(1).cast("long"), "__bytes": F.col("__size")})
    rank = F.col("__rank")
    if law == "rows":
        df = df.withColumn("shard", F.expr(f"__rank * {n_shards} div {max(n, 1)}").cast("int"))
        first = F.expr(f"(cast(shard as bigint) * {n} + {n_shards - 1}) div {n_shards}")
        df = df.withColumn("slot", rank - first)
    else:
        mid = (F.col("__bytes") * 2 + F.col("__size")).cast("decimal(38,0)") * n_shards / (2 * max(total, 1))
        df = df.withColumn("shard", F.least(F.floor(mid), F.lit(n_shards - 1)).cast("int"))
        firsts = df.groupBy("shard").agg(F.min("__rank").alias("__first"))  # n_shards rows
        df = df.join(F.broadcast(firsts), "shard").withColumn("slot", rank - F.col("__first"))
    return df.drop("__cell", "__subs", "__bucket", "__rank", "__bytes", "__size", "__key", "__first")


def document_shards(docs: DataFrame, n_shards: int = 8, law: str = "rows") -> DataFrame:
    """``hilbert_shards`` of documents by source, language and length: all columns of ``docs``
    (needs doc_id, text, source, lang) plus hilbert, shard and slot. NULLs sort lowest; a
    NULL text has no bytes."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    dims = {"source": F.col("source"), "lang": F.col("lang"), "size": size.cast("double")}
    return hilbert_shards(docs, dims, F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit(""))), size, n_shards, law=law)


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, law: str = "rows") -> None:
    """Write the documents as ``shard=k`` folders of Parquet, in curve order inside a shard, so
    the row-group statistics of every dimension are narrow."""
    (document_shards(docs, n_shards, law).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
