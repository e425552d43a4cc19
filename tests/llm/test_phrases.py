import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from brute import lower_ascii
from cohortlens.llm import phrases as P
from cohortlens.llm.text_queries import op12_collocations


def plain(docs, p):
    """The definition, phrase by phrase."""
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower_ascii(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    cand = {x: a for x, a in f.items() if 2 <= len(x[1]) <= p.max_words and a >= p.min_count}
    longer = collections.Counter()
    for (lang, h), b in cand.items():
        for k in range(2, len(h)):
            for i in range(len(h) - k + 1):
                longer[lang, h[i:i + k]] = max(b, longer[lang, h[i:i + k]])
    out = collections.defaultdict(list)
    for (lang, g), a in cand.items():
        score, cut = min((p.unit * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g)))
        if 100 * longer[lang, g] < p.share * a:
            out[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:cut]], f[lang, g[cut:]]))
    return sorted((lang, k + 1, g.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for k, (s, a, g, l, r) in enumerate(sorted(rows)[:p.top]))


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def prose(seed, n_docs=150):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)] + ["Über", "ÜBER", "é", "x\x1cy", "\U0001f600"]
    sets = [" ".join(rng.choice(vocabulary) for _ in range(k)) for k in (2, 3, 3, 4, 4, 6)]
    docs = []
    for i in range(n_docs):
        parts = [rng.choice(sets) if rng.random() < 0.5 else rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]
        text = "".join(p.upper() * (rng.random() < 0.1) or p + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r\n"]) for p in parts)
        docs.append((i, text, rng.choice(["en", "en", "en", "de", None, "und", ""]), "s"))
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_against_the_definition(make_docs, seed):
    docs = prose(seed)
    p = P.Phrases(min_count=8, top=40)
    want = plain(docs, p)
    assert len(want) > 50 and got(P.collocations(make_docs(docs), p)) == want


def test_merging_in_rounds_changes_nothing(make_docs, monkeypatch):
    """One filter for every few phrases, merged two at a time: the same counts."""
    docs, p = prose(9), P.Phrases(min_count=5, top=100, fan_bits=1)
    want = plain(docs, p)
    real = P.rounds
    monkeypatch.setattr(P, "rounds", lambda filters, shards, fan: real(8, 8, fan))
    assert real(8, 8, 1) == [1, 1, 1] and got(P.collocations(make_docs(docs).repartition(6), p)) == want


def test_rounds_cover_filters_and_shards():
    assert P.rounds(0, 0, 10) == [0] and P.rounds(1, 1, 10) == [0] and P.rounds(30, 64, 10) == [6]
    for filters, shards in ((5000, 8), (3, 5000), (2_000_000, 4_000_000), (1025, 1)):
        steps = P.rounds(filters, shards, 10)
        assert 1 << sum(steps) >= shards and 1 << 10 * len(steps) >= filters and max(steps) <= 10


def test_odd_rows(spark, odd, docs_dir, extra_columns, make_docs):
    p = P.Phrases(min_count=2, top=50)
    assert got(P.collocations(make_docs(odd, extra_columns), p)) == plain(odd, p)
    assert got(op12_collocations(spark, docs_dir(odd, extra_columns))) == plain(odd, P.Phrases())
    assert got(op12_collocations(spark, docs_dir([]))) == []
    assert got(op12_collocations(spark, docs_dir([(1, None, None, None), (2, " .,", "en", "a")]))) == []


def test_repeated_rows_count_and_ties_go_by_bytes(make_docs):
    docs = [(1, "zz yy. Ää b. aa bb", "en", "a")] * 3
    assert [r[2] for r in got(P.collocations(make_docs(docs), P.Phrases(min_count=3)))] == ["aa bb", "zz yy", "Ää b"]


def test_ids_have_no_gaps_and_fit(make_docs):
    with pytest.raises(ValueError):
        P.Phrases(max_words=5)
    with pytest.raises(ValueError):
        P.Phrases(min_count=0)


def test_scores_are_exact_beyond_64_bits(spark):
    big = 7 * 10 ** 17
    vocabulary = spark.createDataFrame([(1, "en", "a", big + 1), (2, "en", "b", big + 2)], "id long, lang string, word string, f long")
    counts = spark.createDataFrame([(1, 2, 0, 0, big)], "i1 long, i2 long, i3 long, i4 long, a long")
    row = P.scored(counts, vocabulary, P.Phrases()).first()
    assert (row["l"], row["r"], row["score"]) == (big + 1, big + 2, 2_000_000 * big // (2 * big + 3))


def test_tokens():
    assert P.tokens("Ab\tcD, e\r\nÄ") == [b"ab", b"cd", b"\n", b"e", b"\n", b"\n", "Ä".encode()]
    assert P.tokens("") == [] and P.tokens(" . ") == [b"\n"]


def test_places_come_back():
    for places in ([], [P.BREAK], [0, 1, 70_000, P.BREAK, 1 << 24]):
        assert P.unsqueezed(P.squeezed(places)).tolist() == places
