import random

import pytest

from cohortlens.llm import line_dedup as D
from cohortlens.llm.queries import op5_line_dedup


def sentence(rng, n):
    return " ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(n))


def texts(spark, path):
    return {r["doc_id"]: r["text"] for r in op5_line_dedup(spark, path).collect()}


def test_scattered_edits_do_not_save_the_lines_between(spark, docs_dir):
    """Every fourth line of a near copy is another one: no unbroken run has 30 words."""
    rng = random.Random(1)
    lines = [sentence(rng, 8) for _ in range(40)]
    copies = [[sentence(rng, 8) if k % 4 == edit else x for k, x in enumerate(lines)] for edit in (0, 2)]
    own = [[x for x in copy if x not in lines] for copy in copies]
    got = texts(spark, docs_dir([(i, "\n".join(x), "en", "a") for i, x in enumerate([lines, *copies])]))
    assert got == {0: "\n".join(lines), 1: "\n".join(own[0]), 2: "\n".join(own[1])}


def test_the_word_minimum_is_that_of_the_pair(spark, docs_dir):
    rng = random.Random(2)
    shared = [sentence(rng, 10) for _ in range(3)]
    parts = lambda n: "\n".join(x for k in range(n) for x in (sentence(rng, 5), shared[k]))
    first, few, enough = parts(3), parts(2), parts(3)
    got = texts(spark, docs_dir([(1, first, "en", "a"), (2, few, "en", "a"), (3, enough, "en", "a")]))
    assert got[1] == first and got[2] == few  # 20 words in common
    assert got[3] == "\n".join(x for x in enough.split("\n") if x not in shared)  # 30


def test_short_lines_out_of_order_stay_and_long_runs_go(spark, docs_dir):
    """The alignment decides on scattered lines; an unbroken run of 30 words goes wherever it stands."""
    rng = random.Random(3)
    x, y, moved = sentence(rng, 40), sentence(rng, 9), sentence(rng, 31)
    docs = [(1, f"{y}\n{x}\nown\n{moved}", "en", "a"), (2, f"{moved}\nmine\n{x}\n{y}", "en", "a")]
    assert texts(spark, docs_dir(docs))[2] == f"mine\n{y}"


@pytest.mark.parametrize("seed", range(20))
def test_matched_is_a_common_subsequence(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abcdefghijklmnop"[:rng.randrange(2, 17)]) for _ in range(rng.randrange(0, 40))] for _ in range(2))
    got = D.matched(a, [1] * len(a), b)
    assert all(a[k] == b[q] for k, q in got)
    assert all(k < m and q < n for (k, q), (m, n) in zip(got, got[1:]))
    assert D.matched(a, [1] * len(a), a) == [(k, k) for k in range(len(a))]


def test_blocks_are_neighbours_in_both_without_blank_ends():
    mine, theirs = list("ab_cXd_"), list("ab_cYYd_")
    words = [0 if x == "_" else 1 for x in mine]
    assert D.aligned_blocks(mine, words, theirs, 4) == [(0, 3), (5, 5)]
    assert D.aligned_blocks(mine, words, theirs, 5) == []


def test_documents_meet_although_others_own_every_line(spark, docs_dir):
    """Twelve earlier documents have one of the twelve shared lines each; the two that share all of them are paired."""
    rng = random.Random(4)
    shared = [sentence(rng, 5) for _ in range(12)]
    mixed = lambda: "\n".join(x for s in shared for x in (sentence(rng, 6), s))
    docs = [(i, f"{sentence(rng, 9)}\n{s}", "en", "a") for i, s in enumerate(shared)] + [(50, mixed(), "en", "a"), (60, mixed(), "en", "a")]
    got = texts(spark, docs_dir(docs))
    assert got[50] == docs[-2][1]
    assert got[60] == "\n".join(x for x in docs[-1][1].split("\n") if x not in shared)


def test_a_heading_moves_no_sequences(spark, make_docs):
    """One line in all documents, the first of them very long: no pair shares enough words, so none is aligned."""
    rng = random.Random(5)
    long = "\n".join(["Contents", *[sentence(rng, 3) for _ in range(5000)]])
    docs = make_docs([(0, long, "en", "a")] + [(i, f"Contents\n{sentence(rng, 12)}", "en", "a") for i in range(1, 400)])
    seen = {}
    real = D.sharing_pairs

    def watch(pairs, hits, min_words):
        seen["asked"], out = pairs.count(), real(pairs, hits, min_words)
        seen["looked up"], seen["left"] = hits.where("n > 0").count(), out.count()
        return out

    D.sharing_pairs = watch
    try:
        assert D.dedup_lines(docs).where("__deleted > 0").count() == 0
    finally:
        D.sharing_pairs = real
    assert seen == {"asked": 399, "looked up": 400, "left": 0}  # 400 rows of one line hash, not 399 times 5001 lines
