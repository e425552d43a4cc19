"""Registered queries ``opN_<name>`` of the operators in this subpackage, each over its
whole table, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.llm.common import crc32_of, materialize, read, utf8_bytes
from cohortlens.llm.embedding_dups import near_duplicates
from cohortlens.llm.langid import identify
from cohortlens.llm.line_dedup import dedup_lines
from cohortlens.llm.mixing import Mix, narrow, weighted_fair_mix
from cohortlens.llm.packing import packed_documents
from cohortlens.llm.records import read_records, write_records
from cohortlens.llm.sharding import hilbert_shards
from cohortlens.llm.simhash import simhash_groups
from cohortlens.llm import text_queries
from cohortlens.llm.topk import top_k
from cohortlens.llm.urls import fit, judge
from cohortlens.sources.sinks import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings of one label at cosine 0.93 or more."""
    got = near_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), threshold=0.93)
    return got.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents: 4-word shingles, at most 4 differing bits."""
    g = simhash_groups(read(spark, sf_dir, "documents", "doc_id", "text"), shingle=4, max_bits=4)
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of equal row counts along a Hilbert curve over source,
    language and size."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    rows = materialize(docs.select("doc_id", (utf8_bytes(docs["text"]) + 1).alias("size"), crc32_of(docs["text"]).alias("text_crc32"),
                                   "source", "lang"), "shard-rows")  # the text itself is read once and never shuffled
    dims = {"source": rows["source"], "lang": rows["lang"], "size": rows["size"].cast("double")}
    out = hilbert_shards(rows, dims, F.xxhash64("doc_id", "text_crc32"), rows["size"], n_shards=8, law="rows")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other rows of every embedding whose id is divisible by 50, by integer inner product."""
    rows = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return top_k(rows, rows["vec_id"] % 50 == 0, k=5, scale=256)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the blocks of lines that an earlier document already has."""
    got = dedup_lines(read(spark, sf_dir, "documents", "doc_id", "text"))
    from_docs = F.array_sort(F.array_distinct(F.transform(F.coalesce("__blocks", F.array().cast(
        "array<struct<first:int,last:int,doc_id:long>>")), lambda b: b["doc_id"])))
    return got.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__deleted").alias("n_deleted"),
                      F.col("__empty").alias("removed"), from_docs.alias("duplicate_of"), "text")


def op6_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source: weights 5, 2, 1 repeating, 150% of all words, no source
    above twice its size."""
    rows = materialize(narrow(read(spark, sf_dir, "documents", "doc_id", "text", "source")), "mix-rows")
    out = weighted_fair_mix(None, Mix(weights=(5, 2, 1), share=1.5, repeats=2), rows=rows)
    return out.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
                      F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens, each ended by id 0."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return packed_documents(docs, tokenizer_path(), capacity=2048, end_id=0)


# host and path of a url, and what is to be done with it
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url, by rule or by the model trained on the labelled url table."""
    got = judge(read(spark, sf_dir, "pages", "page_id", "url"), URL_RULES, fit(spark))
    return got.select("page_id", "host", "path", "rule", "verdict", "score")


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token records, each ended by id 2, written and read back."""
    path = scratch_path(spark, "token-records")
    write_records(read(spark, sf_dir, "documents", "doc_id", "text"), path, tokenizer_path(), end_id=2)
    return read_records(spark, path)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every whole document; documents held out are never learned from."""
    got = identify(read(spark, sf_dir, "documents", "doc_id", "text", "lang"), sample_rows=2000)
    return got.select("doc_id", "held_out", "lang_pred", "score")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_embedding_dups, op2_simhash, op3_hilbert_sharding, op4_exact_topk, op5_line_dedup, op6_fair_mixing, op7_packing,
                                     op8_url_filter, op9_token_records, op10_language_id)} | text_queries.queries()


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix') AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS ss, row_number() OVER (ORDER BY source ASC NULLS LAST) AS no FROM d GROUP BY source),
w AS (SELECT *, CASE (no - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
-- resharing: sources above twice their size are held there and the rest shared again
r(step, held) AS (
  SELECT 0, CAST([] AS BIGINT[])
  UNION ALL
  SELECT step + 1, (
    SELECT coalesce(list(w.no ORDER BY w.no), CAST([] AS BIGINT[])) FROM w
    WHERE list_contains(r.held, w.no) OR 2 * w.ss * (SELECT sum(v.w) FROM w v WHERE NOT list_contains(r.held, v.no))
      <= w.w * ((SELECT sum(v.ss) * 1.5 FROM w v) - (SELECT coalesce(sum(2 * v.ss), 0) FROM w v WHERE list_contains(r.held, v.no))))
  FROM r WHERE step <= (SELECT count(*) FROM w)),
held AS (SELECT held FROM r ORDER BY step DESC LIMIT 1),
t AS (
  SELECT w.source, w.ss, w.no, CASE WHEN list_contains(held, w.no) THEN CAST(2 * w.ss AS DOUBLE)
    ELSE w.w * ((SELECT sum(v.ss) * 1.5 FROM w v) - (SELECT coalesce(sum(2 * v.ss), 0) FROM w v, held WHERE list_contains(held.held, v.no)))
         / (SELECT sum(v.w) FROM w v, held WHERE NOT list_contains(held.held, v.no)) END AS target
  FROM w, held),
f AS (
  SELECT d.doc_id, d.size, d.k, t.no, t.ss, t.target,
         sum(d.size) OVER (PARTITION BY t.no ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT f.*, e, sum(size) OVER (ORDER BY (upto + ss * e) / target, no, k, doc_id, size ROWS UNBOUNDED PRECEDING) AS served
  FROM f, (VALUES (0), (1)) copies(e) WHERE size > 0),
taken AS (
  SELECT doc_id, sum(size) AS n FROM c WHERE served <= (SELECT sum(ss) * 1.5 FROM s) GROUP BY doc_id)
SELECT f.doc_id, f.size, f.ss AS source_size, CAST(f.target AS DOUBLE) AS target, CAST(coalesce(taken.n, 0) AS BIGINT) AS taken
FROM f LEFT JOIN taken USING (doc_id)
"""


OP1_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (
  SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a)
SELECT e.vec_id, (SELECT count(*) FROM p WHERE p.a = e.vec_id) AS n_links,
       least(e.vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = e.vec_id), e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = e.vec_id), e.vec_id)) AS kept
FROM e
"""


OP4_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dups": OP1_SQL, "op4_exact_topk": OP4_SQL, "op6_fair_mixing": OP6_SQL} | text_queries.oracle_sql()
