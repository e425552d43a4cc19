"""Registered queries of the operators on runs, phrases and personal data, each over all
``documents``, and their DuckDB SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.llm.common import read
from cohortlens.llm.periodic import periodic_runs, strongest
from cohortlens.llm.personal_data import IBAN_LENGTHS, MISLEADING, find_personal_data, iban_pattern, listed
from cohortlens.llm.phrases import Phrases, collocations


def with_planted_run(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten, from a place on repeated with a short period (both by the id's CRC-32)."""
    n, h = len(words), 1 if doc_id is None else zlib.crc32(b"%d" % doc_id)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, one in ten with a planted run: 24 words and three periods at least."""
    got = periodic_runs(read(spark, sf_dir, "documents", "doc_id", "text"), min_length=24, min_periods=3, reword=with_planted_run)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    got = got.select("id", F.size("runs").cast("long").alias("n_runs"), strongest("runs").alias("best"), F.sha2("text", 256).alias("collapsed"),
                     F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("digest"))
    return got.select(F.col("id").alias("doc_id"), "n_runs", "best.start", "best.length", "best.period",
                      F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.col("digest").alias("runs_sha256"),
                      F.col("collapsed").alias("collapsed_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of 2 to 4 words of every language, from 30 occurrences on, in all documents."""
    return collocations(read(spark, sf_dir, "documents", "lang", "text"), Phrases(min_count=30, max_words=4, share=80, unit=2_000_000, top=2000))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and places of the four base kinds, and all spans."""
    got = find_personal_data(read(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "__spans")
    number = lambda kind: F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("__spans", lambda s: s["base"])
    return got.select("doc_id", *[number(k) for k in ("email", "ip", "card", "phone")], F.sha2(listed(base), 256).alias("base_sha256"),
                      listed(F.col("__spans")).alias("spans"))


OP11_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(b AS BIGINT))) AS t),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) END AS h
  FROM documents, crc),
g AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM g),
z AS (
  SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w
  FROM p),
words AS (SELECT rid, unnest(range(n)) AS i, unnest(w) AS word FROM z),
grams AS (
  SELECT rid, i, string_agg(word, ' ') OVER win AS gram, count(*) OVER win AS k FROM words
  WINDOW win AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)),
lags AS (
  SELECT a.rid, b.i - a.i AS q, a.i FROM grams a JOIN grams b ON a.rid = b.rid AND a.gram = b.gram AND a.i < b.i
  WHERE a.k = 16 AND b.k = 16),
islands AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS isle FROM lags),
stretches AS (SELECT rid, q, min(i) AS s, count(*) + 15 + q AS len FROM islands GROUP BY rid, q, isle HAVING count(*) + 15 + q >= greatest(24, 3 * q)),
runs AS (
  SELECT * FROM stretches x WHERE NOT EXISTS (
    SELECT 1 FROM stretches y WHERE y.rid = x.rid AND y.q < x.q AND y.s <= x.s AND y.s + y.len >= x.s + x.len)),
best AS (
  SELECT rid, s, len, q FROM runs x WHERE NOT EXISTS (
    SELECT 1 FROM runs y WHERE y.rid = x.rid AND (y.len * x.q > x.len * y.q OR (y.len * x.q = x.len * y.q AND (y.s, y.q) < (x.s, x.q))))),
listed AS (
  SELECT rid, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY rid),
gone AS (SELECT DISTINCT w.rid, w.i FROM words w JOIN runs r ON w.rid = r.rid AND w.i >= r.s + r.q AND w.i < r.s + r.len),
kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM words w WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.rid = w.rid AND gone.i = w.i)
  GROUP BY rid)
SELECT z.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(len AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
  CAST(1000 * len // q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM z LEFT JOIN best USING (rid) LEFT JOIN listed USING (rid) LEFT JOIN kept USING (rid)
"""


OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM w, (VALUES (1), (2), (3), (4)) ks(k)),
f AS (SELECT lang, k, g, CAST(count(*) AS BIGINT) AS a FROM g GROUP BY lang, k, g),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 30),
cuts AS (SELECT lang, k, g, a, unnest(range(1, k)) AS cut FROM c),
s AS (
  SELECT c.lang, c.k, c.g, c.a, cut, x.a AS l, y.a AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (x.a + y.a) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:cut] JOIN f y ON y.lang = c.lang AND y.g = c.g[cut + 1:]),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS pick FROM s),
sub AS (
  SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: g[i:i + m - 1])))) AS g FROM c),
m AS (SELECT lang, g, max(a) AS longer FROM sub GROUP BY lang, g),
t AS (
  SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN m ON m.lang = b.lang AND m.g = b.g
  WHERE pick = 1 AND (longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * b.a)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""


# the patterns of the contract as they stand; the added kinds have no others
OP13_SQL = r"""
WITH kinds(kind, no, pattern, fitting) AS (VALUES
  ('email', 1, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', ''),
  ('ip', 2, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)', ''),
  ('card', 3, '[0-9]([\x20-]?[0-9])+', ''),
  ('phone', 4, '\+[0-9][\x20().0-9-]+[0-9]', ''),
  ('iban', 5, '@IBAN@', 'iban|bank|konto|account|cuenta|compte'),
  ('local_phone', 6, '[(]?[0-9]{2,5}[)]?(?:[ /-]{1,2}[0-9]{2,5}){1,4}', '\btel\b|telefon|phone|\bcall\b|mobil|\bfax\b'),
  ('spelled_email', 7, '[A-Za-z0-9._%+-]+ ?[(\[]at[)\]] ?[A-Za-z0-9-]+(?: ?[(\[]dot[)\]] ?[A-Za-z0-9-]+)+', 'mail|contact|kontakt|correo|courriel|write')),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT rid, kind, no, fitting, regexp_extract_all(text, pattern) AS hits, string_split_regex(text, pattern) AS gaps FROM d, kinds),
r AS (SELECT rid, kind, no, fitting, gaps, unnest(hits) AS hit, unnest(range(len(hits))) AS i FROM m),
p AS (
  SELECT *, CAST(sum(length(gaps[i + 1])) OVER w + coalesce(sum(length(hit)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s,
    right(gaps[i + 1], 40) AS bef, left(gaps[i + 2], 20) AS aft, regexp_replace(hit, '[^0-9]', '', 'g') AS dig, replace(hit, ' ', '') AS packed
  FROM r WINDOW w AS (PARTITION BY rid, kind ORDER BY i)),
good AS (
  SELECT *, s + length(hit) AS e, lower(bef || chr(10) || aft) AS near FROM p WHERE CASE kind
    WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda x: coalesce(TRY_CAST(x AS HUGEINT), 999) > 255)) = 0
    WHEN 'card' THEN length(dig) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(dig)), lambda k:
      CASE WHEN (length(dig) - k) % 2 = 1 THEN CAST(dig[k + 1] AS INTEGER)
           ELSE CASE WHEN CAST(dig[k + 1] AS INTEGER) >= 5 THEN 2 * CAST(dig[k + 1] AS INTEGER) - 9 ELSE 2 * CAST(dig[k + 1] AS INTEGER) END END)) % 10 = 0
    WHEN 'phone' THEN length(dig) BETWEEN 9 AND 15
    WHEN 'iban' THEN list_reduce(list_transform(string_split(packed[5:] || packed[:4], ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda a, c: CASE WHEN c >= 65 THEN (a * 100 + c - 55) % 97 ELSE (a * 10 + c - 48) % 97 END, CAST(0 AS BIGINT)) = 1
    WHEN 'local_phone' THEN length(dig) BETWEEN 7 AND 12
    ELSE TRUE END),
more AS (
  SELECT * FROM good x WHERE no > 4
    AND (kind = 'spelled_email' OR NOT (regexp_matches(bef, '[A-Za-z0-9+.,/-]\z') OR regexp_matches(aft, '\A[A-Za-z0-9]')))
    AND CASE kind WHEN 'iban' THEN 7 WHEN 'local_phone' THEN 2 ELSE 6 END + CASE WHEN regexp_matches(near, fitting) THEN 4 ELSE 0 END
      - CASE WHEN regexp_matches(near, '@MISLEADING@') THEN 3 ELSE 0 END >= 5
    AND NOT EXISTS (SELECT 1 FROM good b WHERE b.rid = x.rid AND b.no <= 4 AND b.e > x.s AND b.s < x.e)),
spans AS (SELECT rid, no, kind, s, e FROM good WHERE no <= 4 UNION ALL SELECT rid, no, kind, s, e FROM more),
l AS (
  SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY no, s) AS every,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY no, s) FILTER (no <= 4) AS base,
    count(*) FILTER (no = 1) AS a, count(*) FILTER (no = 2) AS b, count(*) FILTER (no = 3) AS c, count(*) FILTER (no = 4) AS p
  FROM spans GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_email, coalesce(b, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN l USING (rid)
""".replace("@IBAN@", iban_pattern(IBAN_LENGTHS)).replace("@MISLEADING@", MISLEADING)


def queries() -> dict:
    return {f.__name__: f for f in (op11_periodic_runs, op12_collocations, op13_personal_data)}


def oracle_sql() -> dict[str, str]:
    return {"op11_periodic_runs": OP11_SQL, "op12_collocations": OP12_SQL, "op13_personal_data": OP13_SQL}
