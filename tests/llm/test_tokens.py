import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brute import crc_ids
from cohortlens.llm import packing, records
from cohortlens.llm.packing import fit, pack, patterns, plan
from cohortlens.llm.queries import op7_packing, op9_token_records, tokenizer_path
from cohortlens.llm.tokens import REMEMBERED, Encoder, _Memory, encoder

TOKENIZER = Tokenizer.from_file(tokenizer_path())


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


# --- token ids


def test_ids_are_the_library_s(spark, odd):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [r[1] for r in odd]
    texts += ["Hello WORLD!! it's don't 'tis ''s ab'c x<|endoftext|>y <|ENDOFTEXT|> 12ab 3.5", "éclair É ​w",
              "日本語 テスト。 ½ ² x2 हिन्दी İstanbul ǅ ßẞ ﬁ Å", " \t\n", "'re 'S 't'll word.'s a.'b c'.", "ΟΔΟΣ Σ", "a\x1cb\x85c\xa0d e　f"]
    enc = encoder(tokenizer_path())
    assert enc.wordwise
    for t in texts:
        assert enc.ids(t).tolist() == ids_of(t)


def test_ids_of_random_characters():
    rng = random.Random(3)
    chars = "aAbZé'.,!?-_<|>\u0301 \n\t\x0b\x1f\xa0ßΣσİ1２٣日\u200d\U0001f600"
    enc = Encoder(tokenizer_path())
    for _ in range(1500):
        t = "".join(rng.choice(chars) for _ in range(rng.randrange(1, 14)))
        assert enc.ids(t).tolist() == ids_of(t), repr(t)


def test_other_tokenizers_take_the_full_path():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, full = Encoder(path), Tokenizer.from_file(path)
    assert not enc.wordwise
    for t in ("Hello  World  it's\n\n x", "", "ÄÖ <|endoftext|>"):
        assert enc.ids(t).tolist() == full.encode(t, add_special_tokens=False).ids


def test_memory_is_bounded():
    m = _Memory(lambda w: w * 2)
    for i in range(2 * REMEMBERED + 10):
        assert m[i] == 2 * i
    assert len(m) + len(m.old) <= 2 * REMEMBERED


# --- packing


def check_packed(rows, docs, capacity=2048, end_id=0):
    want = []
    for i, text in docs:
        ids = ids_of(text) + [end_id]
        want += [(str(i), k, at, len(ids[at:at + capacity]), crc_ids(ids[at:at + capacity])) for k, at in enumerate(range(0, len(ids), capacity))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r["length"] for r in rows)


def test_whole_table(spark):
    path = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    n, total = check_packed(op7_packing(spark, path).collect(), docs)
    assert n <= -(-total // 2048) * 1.03 + 1


def test_odd_rows(spark, odd, docs_dir, extra_columns):
    d = docs_dir(odd, extra_columns)
    check_packed(op7_packing(spark, d).collect(), [r[:2] for r in odd])
    assert op7_packing(spark, docs_dir([])).count() == 0


def test_patterns_are_all_partitions():
    got = {tuple(sorted(int(x) for x in p if x)) for p in patterns(12, 3)}
    assert got == {tuple(sorted(x for x in (a, b, 12 - a - b) if x)) for a in range(13) for b in range(13 - a) if 12 - a - b >= 0 and a + b <= 12}
    assert len(got) == len(patterns(12, 3))


def test_fit_uses_up_a_histogram_made_of_patterns():
    pats = patterns(16, 3)
    x = np.zeros(len(pats))
    x[[1, 7, 12]] = [50, 20, 70]
    hist = np.bincount(pats.ravel(), np.repeat(x, 3), 17) * (np.arange(17) > 0)
    got = fit(pats, hist, rounds=3000)
    assert (got >= 0).all()
    left = hist - np.bincount(pats.ravel(), np.repeat(got, 3), 17) * (np.arange(17) > 0)
    assert np.abs(left).max() < 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once_and_fills_sequences(seed):
    rng = np.random.default_rng(seed)
    capacity = 256
    hist = np.zeros(capacity + 1, np.int64)
    kinds = rng.integers(1, capacity + 1, [1, 5, 50, 250, 250, 3][seed])
    np.add.at(hist, kinds, rng.integers(1, [1, 3, 40, 400, 4000, 100000][seed], len(kinds), endpoint=True))
    rows, sequences = plan(hist, units=64)
    used, fill = np.zeros_like(hist), {}
    for n, start, stop, seq, each, place in rows:
        assert start == used[n]
        used[n] += stop - start
        full, rest = divmod(stop - start, each)
        for s, c in [(seq, each)] * (full > 0) + ([(seq + full, rest)] if rest else []):
            fill.setdefault(s, 0)
            fill[s] += c * n
    assert (used == hist).all()
    assert all(v <= capacity for v in fill.values())
    tokens = int((hist * np.arange(capacity + 1)).sum())
    large = int(hist[capacity // 2 + 1:].sum())
    assert sequences <= max(-(-tokens // capacity), large) * 1.1 + 2


def test_pack_many_short_pieces_of_one_length(spark):
    pieces = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(3).cast("long").alias("length"), F.lit("x").alias("sequence_id"))
    rows = pack(pieces, 100).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r["offset"])
    assert len(rows) == 5000 and all(sorted(v) == list(range(0, 3 * len(v), 3)) for v in by.values())
    assert len(by) == -(-5000 // 33)
    with pytest.raises(ValueError):
        pack(pieces.withColumn("length", F.lit(101)), 100)


# --- records


def check_records(rows, docs, end_id=2):
    docs = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [r[0] for r in docs]
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    want = sorted((str(i), len(ids_of(t)) + 1, crc_ids(ids_of(t) + [end_id])) for i, t in docs)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_records_of_a_whole_table(spark):
    path = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    check_records(op9_token_records(spark, path).collect(), docs)


def test_records_of_odd_rows(spark, odd, docs_dir, extra_columns):
    check_records(op9_token_records(spark, docs_dir(odd, extra_columns)).collect(), [r[:2] for r in odd])
    assert op9_token_records(spark, docs_dir([])).count() == 0


def test_files_index_and_shuffled_reads(spark, make_docs, tmp_path):
    docs = [(i, f"document number {i} " * (i % 5), "en", "a") for i in range(300)]
    path = str(tmp_path / "rec")
    manifest = records.write_records(make_docs(docs), path, tokenizer_path(), files=4)
    assert manifest.agg(F.sum("n_docs")).first()[0] == 300 and manifest.count() == 4
    names = sorted(p.name for p in (tmp_path / "rec").iterdir() if p.name.endswith(("rec", "idx")))
    assert len(names) == 8 and not [n for n in names if n.startswith("_attempt")]
    got = records.shuffled_records(spark, path, seed=1).collect()
    assert [r["doc_id"] for r in got] != sorted(r["doc_id"] for r in got)
    assert sorted((r["doc_id"], list(r["ids"])) for r in got) == [(i, ids_of(t) + [2]) for i, t, *_ in docs]


@pytest.mark.parametrize("at", [3, 9, 14, -2])
def test_a_damaged_file_is_noticed(spark, make_docs, tmp_path, at):
    path = str(tmp_path / "rec")
    records.write_records(make_docs([(1, "some words here", "en", "a")]), path, tokenizer_path(), files=1)
    file = next(p for p in (tmp_path / "rec").iterdir() if p.suffix == ".rec")
    data = bytearray(file.read_bytes())
    data[at] ^= 1
    file.write_bytes(bytes(data))
    with pytest.raises(Exception, match="checksum|cut off"):
        records.read_records(spark, path).collect()


def test_writing_the_same_file_twice_replaces_it(spark, make_docs, tmp_path):
    docs = make_docs([(i, f"text {i}", "en", "a") for i in range(20)])
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for path in (a, b):
        records.write_records(docs, path, tokenizer_path(), files=2)
    read = lambda p: {f.name: f.read_bytes() for f in p.iterdir() if f.suffix in (".rec", ".idx")}
    assert read(tmp_path / "a") == read(tmp_path / "b")


def test_checksums_are_masked():
    assert records.masked(b"") != 0 and records.frame(b"x")[8:12] != b"\0" * 4
    assert packing.UNITS <= 2048
