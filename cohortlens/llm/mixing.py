"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every source shuffles its documents; a document's virtual finish time is its source's
cumulative words divided by the source's target. All documents, sorted by finish time and
cut at the total budget, are the mix: each source is served in proportion to its target
at every point of the order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.llm.common import materialize, n_words, rows_per_bucket
from cohortlens.llm.running import running_before, spread

STEPS = 16384  # finish-time steps per unit, for finding the cut


@dataclass(frozen=True)
class Mix:
    """Parameters of a mix: ``weights`` go to the sources by code point (NULL last), again
    from the start when they run out; the mix has ``share`` times all words, and no source
    gives more than ``repeats`` times its own."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    repeats: int = 2
    seed: str = "mix"


def source_targets(rows: DataFrame, mix: Mix) -> DataFrame:
    """(source, __no, __docs, __source_size, __target) of every source, from rows (source, size).

    A source whose share by weight is above ``repeats`` times its size gets just that; the
    excess goes to the others by weight until none is above. Sorted by the fill level at
    which a source is full, the full ones come first, so one pass of running sums finds the
    level. One row per source: the windows below never see documents.
    """
    w, n = mix.weights, len(mix.weights)
    s = rows.groupBy("source").agg(F.sum("size").alias("__source_size"), F.count(F.lit(1)).alias("__docs"))
    s = s.withColumn("__no", F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("__w", F.element_at(F.array(*[F.lit(x).cast("long") for x in w]), F.pmod(F.col("__no") - 1, F.lit(n)) + 1))
    whole = Window.partitionBy()
    before = whole.orderBy(F.col("__source_size") / F.col("__w"), "__no").rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("__source_size") * mix.repeats
    s = s.withColumns({"__all": F.sum("__source_size").over(whole), "__allw": F.sum("__w").over(whole),
                       "__c": F.coalesce(F.sum(cap).over(before), F.lit(0)), "__u": F.coalesce(F.sum("__w").over(before), F.lit(0))})
    budget = F.col("__all") * F.lit(mix.share)
    s = s.withColumn("__full", cap * (F.col("__allw") - F.col("__u")) <= F.col("__w") * (budget - F.col("__c")))
    full_c = F.sum(F.when(F.col("__full"), cap).otherwise(0)).over(whole)
    open_w = F.sum(F.when(F.col("__full"), 0).otherwise(F.col("__w"))).over(whole)
    s = s.withColumns({"__fc": full_c, "__ow": open_w})
    share = F.col("__w") * (budget - F.col("__fc")) / F.col("__ow")
    return s.select("source", "__no", "__docs", "__source_size",
                    F.when(F.col("__full"), cap.cast("double")).otherwise(share).alias("__target"))


def _finish(df: DataFrame, targets: DataFrame, mix: Mix, per_bucket: int) -> DataFrame:
    """Adds __no, __source_size, __target and __before: the words of the source's documents that
    come earlier in its shuffled order."""
    key = F.md5(F.concat(F.coalesce(F.col("__id").cast("string"), F.lit("")), F.lit(f":{mix.seed}")).cast("binary"))
    h31 = F.shiftright(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), 1)
    df = df.join(targets.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    df = df.withColumn("__shuffle", key).withColumn(
        "__bucket", spread(h31, F.ceil(F.col("__docs") / F.lit(per_bucket)).cast("long")))
    order = [F.col("__shuffle"), F.col("__id"), F.col("__size"), F.col("__tie")]
    return running_before(df, "__no", "__bucket", order, {"__before": F.col("__size")}).drop("__bucket", "__docs")


def _spot(copy: int) -> Column:
    """Place of the row's ``copy``-th serving in the global order."""
    words = F.col("__before") + F.col("__size") + F.col("__source_size") * copy
    return F.struct((words / F.col("__target")).alias("t"), F.col("__no").alias("no"), F.col("__shuffle").alias("k"),
                    F.col("__id").alias("id"), F.col("__size").alias("n"), F.col("__tie").alias("x"))


def weighted_fair_mix(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text",
                      source_col: str = "source", rows: DataFrame | None = None) -> DataFrame:
    """All columns of ``docs`` plus __size, __source_size, __target and __copies: how often the
    mix takes the document (0 to ``repeats``).

    A document's size is its number of words. Whole documents are taken, in order of finish
    time, until the next one would pass the budget; so a source ends within a document of
    its target. Ties go by source, shuffle key, id, size and text. Documents without words
    are never taken. A second serving comes after the source's first is over. The order
    depends on the rows alone, so reruns agree. NULL sources are one source, NULL ids one
    id; repeated rows are separate documents. An empty table gives an empty result.
    ``rows`` may hold a saved narrow form (id, source, size, tie) of the same documents.
    """
    if rows is None:
        rows = materialize(narrow(docs, id_col, text_col, source_col), "mix-sizes")
    targets = materialize(source_targets(rows.select("source", F.col("__size").alias("size")), mix), "mix-targets")
    head = targets.agg(F.sum("__source_size").alias("words"), F.sum("__docs").alias("docs")).first()
    budget, per_bucket = (head["words"] or 0) * mix.share, rows_per_bucket(head["docs"] or 0)
    # the cut: one total per finish-time step, then the running total inside the step that holds it
    served = _finish(rows.where("__size > 0"), targets, mix, per_bucket).select(
        F.explode(F.array(*[_spot(e) for e in range(mix.repeats)])).alias("spot"), F.col("__size").alias("n"))
    step = F.least(F.floor(F.col("spot.t") * STEPS), F.lit(2 * STEPS)).cast("long")
    served = materialize(served.withColumn("step", step), "mix-order")
    steps = served.groupBy("step").agg(F.sum("n").alias("n"))  # 2 * STEPS + 1 rows at most
    upto = F.sum("n").over(Window.partitionBy().orderBy("step"))
    past = steps.select("step", "n", upto.alias("upto")).where(F.col("upto") > F.lit(budget)).orderBy("step").first()
    cut = None
    if past is not None:
        inside = Window.partitionBy("step").orderBy("spot").rowsBetween(Window.unboundedPreceding, 0)
        cut = (served.where(F.col("step") == past["step"]).select("spot", F.sum("n").over(inside).alias("upto"))
               .where(F.col("upto") + F.lit(past["upto"] - past["n"]) > F.lit(budget)).agg(F.min("spot").alias("cut"))
               .first()["cut"])
    whole = docs.withColumns({"__id": F.col(id_col), "source": F.col(source_col), "__size": n_words(F.col(text_col)),
                              "__tie": F.xxhash64(text_col)}) if docs is not None else rows
    out = _finish(whole, targets, mix, per_bucket)
    if cut is None:
        taken = F.lit(mix.repeats)
    else:
        kinds = served.schema["spot"].dataType.fields
        bound = F.struct(*[F.lit(cut[f.name]).cast(f.dataType).alias(f.name) for f in kinds])
        taken = sum([(_spot(e) < bound).cast("int") for e in range(mix.repeats)], F.lit(0))
    return out.withColumn("__copies", F.when(F.col("__size") > 0, taken).otherwise(0)).drop("__before", "__shuffle", "__no", "__tie")


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What the mix is decided on: id, source, number of words and a text hash for ties."""
    return docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("__size"),
                       F.xxhash64(text_col).alias("__tie"))


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``; one taken twice is there twice."""
    cols = docs.columns
    out = weighted_fair_mix(docs, mix).where("__copies > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*cols)
