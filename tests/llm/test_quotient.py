import numpy as np
import pytest

from cohortlens.llm import quotient as Q


@pytest.mark.parametrize("width", [1, 2, 3, 7, 8, 15, 16, 17, 20, 31])
@pytest.mark.parametrize("m", [1, 2, 5, 100, 5000])
def test_nothing_is_lost(width, m):
    rng = np.random.default_rng(width * m)
    ids = [rng.integers(0, 1 << width, m) for _ in range(4)]
    x = Q.pack(ids, width)
    assert all((a == b).all() for a, b in zip(Q.unpack(x, width), ids))
    y, n = Q.counted(x)
    grams, want = np.unique(np.stack(ids), axis=1, return_counts=True)
    assert sorted(zip(*[c.tolist() for c in Q.unpack(y, width)], n.tolist())) == sorted(zip(*grams.tolist(), want.tolist()))
    n = n * rng.choice([1, 1, 1, 254, 255, 256, 10 ** 12], len(n))
    for prefix in (b for b in (0, 1, 2, 4, 10) if b <= 4 * width):
        blocks = Q.split(y, n, 4 * width, prefix)
        back = [Q.decode(b, p, 4 * width - prefix) for p, b in blocks]
        assert all((np.concatenate([g[0][i] for g in back]) == y[i]).all() for i in (0, 1))
        assert (np.concatenate([g[1] for g in back]) == n).all()


def test_counts_of_filters_add_up():
    x = Q.pack([np.array([1, 2, 1]), np.array([3, 3, 3]), np.zeros(3, int), np.zeros(3, int)], 20)
    y, n = Q.counted(x)
    z, m = Q.counted((np.concatenate([y[0], y[0]]), np.concatenate([y[1], y[1]])), np.concatenate([n, 7 * n]))
    assert sorted(zip(Q.unpack(z, 20)[0].tolist(), m.tolist())) == [(1, 16), (2, 8)]


def test_a_filter_is_smaller_than_its_numbers():
    rng = np.random.default_rng(1)
    x, n = Q.counted(Q.pack([rng.integers(1, 1 << 15, 100_000) for _ in range(4)], 15))
    assert len(Q.encode(x, n, 60)) < 6.5 * len(n)  # 60 bits and a count in less than 6.5 bytes
