import random

import pytest

from brute import words
from cohortlens.llm.periodic import collapsed, find_runs, lag_classes, periodic_runs
from cohortlens.llm.text_queries import op11_periodic_runs


def plain_runs(w, m=24, e=3):
    """Every maximal stretch of every lag, less those that a smaller period explains."""
    found = []
    for q in range(1, len(w) // e + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(m, e * q):
                found.append((s, i - s + q, q))
            i += 1
    return sorted((r for r in found if not any(o[2] < r[2] and o[0] <= r[0] and sum(o[:2]) >= sum(r[:2]) for o in found)), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(40))
def test_against_every_lag(seed):
    rng = random.Random(seed)
    for _ in range(25):
        letters, w = [b"a", b"b", b"c", b"d"][:rng.randrange(1, 5)], []
        while len(w) < rng.randrange(0, 300):
            block = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 8, 16, 17, 20, 35, 40, 71]))]
            w += (block * rng.randrange(1, 8))[:rng.randrange(1, 200)]
        m, e = rng.choice([(24, 3), (24, 3), (10, 3), (12, 4), (3, 3)])
        assert find_runs(w, m, e) == plain_runs(w, m, e)


def test_the_next_copy_of_a_seed_is_a_period_away_in_every_class():
    for m, e in ((24, 3), (10, 3), (50, 5), (3, 3)):
        classes = lag_classes(5000, m, e)
        assert classes[0][0] == 1 and all(a[1] + 1 == b[0] for a, b in zip(classes, classes[1:])) and classes[-1][1] >= 5000 // e
        for lo, hi, k in classes:
            assert k >= hi and all(max(m - q, (e - 1) * q) >= k for q in range(lo, hi + 1))


def test_very_long_texts_extend_each_run_once():
    rng = random.Random(5)
    block = [b"%d" % rng.randrange(10 ** 9) for _ in range(1000)]
    assert find_runs([b"x"] * 300_000) == [(0, 300_000, 1)]
    assert find_runs(block * 200) == [(0, 200_000, 1000)]
    assert find_runs([b"%d" % rng.randrange(10 ** 9) for _ in range(100_000)]) == []


def test_collapsed_keeps_the_first_period_of_every_run():
    w = [b"a", b"b"] * 12 + [b"c"] * 24
    assert find_runs(w) == [(0, 24, 2), (24, 24, 1)]
    assert collapsed(w, find_runs(w)) == [b"a", b"b", b"c"]
    assert collapsed(w[:10], []) == w[:10]


def test_limits_below_three_are_refused():
    with pytest.raises(ValueError):
        find_runs([], min_periods=2)


def test_odd_rows(spark, odd, docs_dir, extra_columns, make_docs):
    got = periodic_runs(make_docs(odd, extra_columns)).collect()
    text = {(r["id"], r["text"], r["n_words"]) for r in got}
    assert len(got) == len(odd) and text == {(i, " ".join(words(t)), len(words(t))) for i, t, *_ in odd if not i == 6} | {
        (r["id"], r["text"], r["n_words"]) for r in got if r["id"] == 6}
    rows = op11_periodic_runs(spark, docs_dir(odd, extra_columns)).collect()
    assert len(rows) == len(odd) and all(len(r["runs_sha256"]) == len(r["collapsed_sha256"]) == 64 for r in rows)
    assert all((r["n_runs"] == 0) == (r["start"] is None) for r in rows)
    assert op11_periodic_runs(spark, docs_dir([])).count() == 0


def test_the_strongest_run_and_its_ties(spark, docs_dir):
    a = " ".join(["a b c d"] * 8)  # 32 words, period 4
    b = " ".join(f"p{k}" for k in range(12))
    docs = [(1, f"{a} x {a.upper()}", "en", "s"), (2, " ".join([b] * 3), "en", "s"), (3, b, "en", "s")]
    rows = {r["doc_id"]: r for r in op11_periodic_runs(spark, docs_dir(docs)).collect()}
    assert tuple(rows[1])[1:6] == (2, 0, 32, 4, 8000)
    assert tuple(rows[2])[1:6] == (1, 0, 36, 12, 3000)
    assert tuple(rows[3])[1:6] == (0, None, None, None, None)
