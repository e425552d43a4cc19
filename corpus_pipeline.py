"""A training-data pipeline over ``documents``: language ID, line dedup, SimHash near-dedup,
mixing sources to target weights, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents. ``run`` applies them one after the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.llm.common import materialize
from cohortlens.llm.langid import held_out, predict, train
from cohortlens.llm.line_dedup import dedup_lines
from cohortlens.llm.mixing import Mix, mixed_documents
from cohortlens.llm.packing import packed_documents
from cohortlens.llm.queries import tokenizer_path
from cohortlens.llm.simhash import keep_one

def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages: texts that are NULL or have no letter go, and those
    long enough to judge that fit no learned language. Short texts stay, and where no document
    has a language to learn from all texts with letters do."""
    model = train(docs, docs["doc_id"].isNotNull() & ~held_out(docs["doc_id"]))
    if model is None:
        return docs.where(docs["text"].rlike(r"\p{L}"))
    got = docs.withColumn("__p", predict(model, docs["text"]))
    return got.where("__p.fits").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one has; a document of which
    nothing is left goes. n_chars follows the text."""
    got = dedup_lines(docs).where(~F.col("__empty"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        got = got.withColumn("n_chars", F.when(F.col("__deleted") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return got.select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of every SimHash group."""
    return keep_one(docs, shingle=4, max_bits=4)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: weights 5, 2, 1 repeating, 150% of all words, twice at most."""
    return mixed_documents(docs, Mix(weights=(5, 2, 1), share=1.5, repeats=2))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens."""
    return packed_documents(docs, tokenizer_path(), capacity=2048, end_id=0)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup),
          ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # fingerprints, tokens and a trained model are beyond SQL: tested against brute force
