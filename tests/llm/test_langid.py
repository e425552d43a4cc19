import numpy as np
import pytest
import zlib
from pyspark.sql import functions as F

from cohortlens.llm import langid as L
from cohortlens.llm.queries import op10_language_id


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.001"
    rows = op10_language_id(spark, path).join(spark.read.parquet(f"{path}/documents.parquet"), "doc_id").collect()
    assert len(rows) == 200
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 40 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark, odd, docs_dir, extra_columns):
    rows = op10_language_id(spark, docs_dir(odd, extra_columns)).collect()
    assert len(rows) == len(odd)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for i in (2, 3, 4, 5) for r in by[i])
    assert {r["lang_pred"] for i in (1, 6, 8) for r in by[i]} <= {"en", "de", "fr"}
    assert not any(r["held_out"] for r in by[None])


def test_nothing_to_learn_from(spark, docs_dir):
    assert op10_language_id(spark, docs_dir([])).count() == 0
    rows = op10_language_id(spark, docs_dir([(1, "words", None, "a"), (2, None, "en", "a")])).collect()
    assert [(r["lang_pred"], r["score"]) for r in rows] == [("und", 0.0)] * 2


def test_held_out_documents_teach_nothing(spark, docs_dir):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1]
    free = [i for i in range(200) if i not in held]
    docs = [(i, "the cat and the hat", "en", "a") for i in free[:40]] + [(i, "le chat et le chapeau", "fr", "a") for i in free[40:80]]
    docs += [(i, "die katze und der hut", "de", "a") for i in held[:40]]
    rows = op10_language_id(spark, docs_dir(docs)).collect()
    assert {r["lang_pred"] for r in rows} <= {"en", "fr"}
    assert all(r["lang_pred"] == ("en" if r["doc_id"] in free[:40] else "fr") for r in rows if not r["held_out"])


def test_one_language(spark, docs_dir):
    rows = op10_language_id(spark, docs_dir([(i, f"hello {i}", "en", "a") for i in range(20)])).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("en", 1.0)}


def test_counts_do_not_depend_on_the_piece_size(monkeypatch):
    text = "Hello wörld 12 ab. " * 40 + "  x"
    whole = L.counts(text)
    for size in (1, 2, 7, 50):
        monkeypatch.setattr(L, "CHUNK", size)
        assert (L.counts(text) == whole).all(), size
    assert L.counts("12 !!") is None and L.counts("") is None and L.counts(None) is None


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(0)
    rows = []
    for k in range(300):
        y = k % 3
        f = np.unique(np.r_[rng.integers(100 * y, 100 * y + 20, 5), rng.integers(5000, 9000, 5)])
        rows.append((f, np.full(len(f), len(f) ** -0.5), y))
    dense, sparse = L.ftrl(rows, 3, l1=0.0), L.ftrl(rows, 3, l1=0.3)
    assert (sparse != 0).sum() < (dense != 0).sum() / 2
    assert np.mean([np.argmax(x @ sparse[f] + sparse[L.DIM]) == y for f, x, y in rows]) > 0.95


def test_temperature_is_right_on_average():
    rng = np.random.default_rng(1)
    true = rng.standard_normal((4000, 4)) * 2
    y = np.array([rng.choice(4, p=L._softmax(s)) for s in true])
    t = L.temperature(true * 5, y)
    assert t == pytest.approx(5, rel=0.15)
    p = L._softmax(true * 5 / t)
    assert p.max(1).mean() == pytest.approx((p.argmax(1) == y).mean(), abs=0.03)


def test_sample_is_bounded_and_frequencies_are_not(spark, make_docs):
    docs = make_docs([(i, f"the cat number {chr(97 + i % 26) * 3}", "en" if i % 2 else "de", "a") for i in range(400)])
    model = L.train(docs, F.lit(True), sample_rows=40)
    assert model.langs == ["de", "en"]
    assert model.idf.min() == pytest.approx(1.0, abs=1e-6)  # in all 400 documents, not only in the sample


def test_every_language_is_learned(spark, make_docs, monkeypatch):
    letters = "abcdefghijklmnopqrst"
    word = lambda k: letters[k % 20] + letters[k // 20] + letters[(k * 7) % 20]
    docs = make_docs([(k * 30 + i, f"{word(k)} {word(k)}{i} {letters[i % 20]}{word(k)}", f"lang{k:03d}", "a") for k in range(300) for i in range(30)])
    model = L.train(docs, F.lit(True), sample_rows=2000)
    assert model.langs == [f"lang{k:03d}" for k in range(300)]
    got = docs.where("doc_id % 30 = 0").select("lang", L.predict(model, F.col("text")).alias("p")).where("lang = p.lang").count()
    assert got > 285
    monkeypatch.setattr(L, "MOST_LANGS", 299)
    with pytest.raises(ValueError, match="299 languages"):
        L.train(docs, F.lit(True))


@pytest.mark.parametrize("seed", range(6))
def test_a_language_of_a_few_copied_texts_is_learned(spark, make_docs, seed):
    """20,000 rows of ten texts: all of them are in the sample, whatever their hashes."""
    copied = [f"кот {seed} и {k} шляпа {chr(0x430 + k)}{chr(0x440 - k)}" for k in range(10)]
    docs = make_docs([(i, f"the cat number {i * 31 % 977} sat on hat {seed}", "en", "a") for i in range(3000)])
    more = spark.range(20_000).select(F.col("id").alias("doc_id"), F.get(F.array(*map(F.lit, copied)), F.col("id") % 10).alias("text"), F.lit("ru").alias("lang"))
    docs = docs.select("doc_id", "text", "lang").unionByName(more)
    model = L.train(docs, F.lit(True), sample_rows=2000)
    assert model.langs == ["en", "ru"]
    assert more.dropDuplicates(["text"]).select(L.predict(model, F.col("text")).alias("p")).where("p.lang = 'ru'").count() == 10


def test_the_sample_has_the_smallest_hashes_of_different_texts(spark, make_docs):
    docs = make_docs([(i, f"text {i % 500}", "en", "a") for i in range(2000)] + [(i, f"mot {i % 7}", "fr", "a") for i in range(700)])
    names, sample = L.sample_texts(docs.select("lang", "text"), 100, least=5)
    rows = [tuple(r) for r in sample.collect()]
    assert names == ["en", "fr"] and len(rows) == len(set(rows)) == 57 and sum(r[0] == "fr" for r in rows) == 7
    order = docs.where("lang = 'en'").select("text").distinct().orderBy(F.shiftrightunsigned(F.xxhash64("text"), 11)).limit(50)
    assert {r["text"] for r in order.collect()} == {t for lang, t in rows if lang == "en"}


def plain_counts(text):
    """Counts of hashed n-grams, one n-gram after the other."""
    padded = [32]
    for c in text.lower():
        code = ord(c) if c.isalpha() else 32
        if code != 32 or padded[-1] != 32:
            padded.append(code)
    if padded[-1] != 32:
        padded.append(32)
    out, m = {}, 1 << 32
    for n in range(1, 4):
        for i in range(len(padded) - n + 1):
            h = 0
            for k, code in enumerate(padded[i:i + n]):
                h = (h * 0x01000193 + code * 0x9E3779B1 + k + 1) % m
            at = ((h ^ h >> 15) * 0x85EBCA6B % m) >> 17
            out[at] = out.get(at, 0) + 1
    return out


def test_predictions_against_a_plain_computation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    model = L.train(docs, F.lit(True), sample_rows=80)
    weight = {int(f): model.weights[k].astype(float) for k, f in enumerate(model.features)}
    for text, got in docs.select("text", L.predict(model, F.col("text")).alias("p")).collect():
        if not any(c.isalpha() for c in text):
            assert got["lang"] == "und"
            continue
        x = {f: np.log1p(n) * float(model.idf[f]) for f, n in plain_counts(text).items()}
        norm = sum(v * v for v in x.values()) ** 0.5
        score = [float(model.bias[k]) + sum(v / norm * weight[f][k] for f, v in x.items() if f in weight) for k in range(len(model.langs))]
        e = [np.exp((s - max(score)) / model.temperature) for s in score]
        assert got["lang"] == model.langs[int(np.argmax(score))] and got["score"] == pytest.approx(max(e) / sum(e), abs=1e-4)
