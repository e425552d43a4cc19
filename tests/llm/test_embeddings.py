import numpy as np
import pandas as pd
import pytest

from brute import components
from cohortlens.llm import embedding_dups as E
from cohortlens.llm import topk as K
from cohortlens.llm.queries import op1_embedding_dups, op4_exact_topk

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, rank string"


def write(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).coalesce(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def usable(v, zero=False):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and (zero or any(x != 0 for x in v))


def brute_dups(rows, threshold=0.93):
    n, links = len(rows), []
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if la is not None and la == lb and usable(a) and usable(b) and len(a) == len(b):
                x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links.append((i, j))
    comp, deg = components(n, links), [0] * n
    for i, j in links:
        deg[i] += 1
        deg[j] += 1
    low = {}
    for k, c in enumerate(comp):
        if rows[k][0] is not None:
            low[c] = min(low.get(c, rows[k][0]), rows[k][0])
    return sorted(((rows[k][0], deg[k], low.get(comp[k]), rows[k][0] == low.get(comp[k])) for k in range(n)), key=str)


def got_dups(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def clusters(n=400, dims=16, labels=3, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, dims))
    rows = []
    for i in range(n):
        v = base[rng.integers(len(base))] + rng.standard_normal(dims) * rng.choice([0.0, 0.02, 0.1, 0.25])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(labels))))
    return rows


ODD = [(1, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0], 1), (3, [1.0, 0.01, 0.0], 2), (4, [1.0, 0.01, 0.0], None),
       (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 0.0], 1), (9, [float("nan"), 1.0, 0.0], 1), (10, [float("inf"), 0.0, 0.0], 1),
       (None, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.0], 1), (12, [1.0, 0.02], 1), (13, [-1.0, 0.0, 0.0], 1), (50, [0.5, 0.5, 0.0], 1), (100, [0.5, 0.5, -0.0], 1)]


def test_dups_against_all_pairs(spark, tmp_path):
    rows = clusters()
    got, want = got_dups(op1_embedding_dups(spark, write(spark, tmp_path, rows))), brute_dups(rows)
    found, true = sum(r[1] for r in got), sum(r[1] for r in want)
    assert true > 400 and 0.98 * true <= found <= true
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def test_dups_of_odd_rows(spark, tmp_path):
    assert got_dups(op1_embedding_dups(spark, write(spark, tmp_path, ODD))) == brute_dups(ODD)


def test_dups_of_an_empty_table(spark, tmp_path):
    assert op1_embedding_dups(spark, write(spark, tmp_path, [])).count() == 0


def test_crowded_cells_are_cut_and_nothing_is_lost(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(12)
    rows = [(i, [float(x) for x in (centre + 0.02 * rng.standard_normal(12)).astype(np.float32)], 0) for i in range(150)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(40)]
    assert got_dups(op1_embedding_dups(spark, write(spark, tmp_path, rows))) == brute_dups(rows)


def test_traversal_is_by_distance_and_complete():
    rng = np.random.default_rng(1)
    a, b = np.sort(rng.random(9)).tolist(), np.sort(rng.random(7)).tolist()
    a[0] = b[0] = 0.0
    got = E._multi_sequence(a, b, list(range(9)), list(range(7)), 0.6, 7)
    want = {i * 7 + j for i in range(9) for j in range(7) if a[i] + b[j] <= 0.6}
    assert set(got) == want and len(got) == len(want)
    cost = [a[c // 7] + b[c % 7] for c in got]
    assert cost == sorted(cost) and got[0] == 0


def test_neighbours_lie_within_the_radius():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    grid = E.fit_grid(x[:1000], 8, 0.93, 0.99)
    side = rng.standard_normal((1000, 32))
    y = x[1000:] + 0.3 * side / np.linalg.norm(side, axis=1)[:, None]
    near = (x[1000:] * y).sum(1) / np.linalg.norm(y, axis=1) >= 0.93
    y /= np.linalg.norm(y, axis=1)[:, None]
    hit = [c in v for v, c in zip(grid.visits(x[1000:]), grid.cells(y))]
    assert np.mean(np.array(hit)[near]) > 0.97


# --- exact top-k


def brute_topk(rows, k=5):
    vec = {}
    for i, v, _ in rows:
        if i is not None and usable(v, zero=True):
            q = [int(np.floor(256 * float(np.float32(x)))) for x in v]
            vec[i] = min(vec.get(i, q), q)
    out = []
    for i, q in vec.items():
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, w)), j) for j, w in vec.items() if j != i and len(w) == len(q))[:k]
            out += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s)]
    return sorted(out)


def got_topk(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_topk_against_all_rows(spark, tmp_path):
    rows = clusters(900, 24, seed=4) + [(2000 + i, [0.25] * 24, 0) for i in range(40)] + [(5000, [0.25] * 24, 0), (5050, [0.0] * 24, 0)]
    assert got_topk(op4_exact_topk(spark, write(spark, tmp_path, rows))) == brute_topk(rows)


def test_topk_of_odd_rows(spark, tmp_path):
    assert got_topk(op4_exact_topk(spark, write(spark, tmp_path, ODD))) == brute_topk(ODD)


def test_topk_of_an_empty_table(spark, tmp_path):
    assert op4_exact_topk(spark, write(spark, tmp_path, [])).count() == 0


@pytest.mark.parametrize("block_rows,seeds", [(70, 20), (300, 2), (64, 5000)])
def test_topk_with_many_blocks(spark, block_rows, seeds):
    rows = clusters(700, 16, seed=7)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = K.top_k(df, df["vec_id"] % 50 == 0, block_rows=block_rows, seed_rows=seeds)
    assert got_topk(got) == brute_topk(rows)


@pytest.mark.parametrize("shelves", [1, 2, 3])
def test_topk_with_blocks_on_shelves(spark, monkeypatch, shelves):
    """Several blocks on a shelf, packs of a few queries, components of two and of four bytes, two vector lengths."""
    monkeypatch.setattr(K, "SHELVES", shelves)
    rows = clusters(500, 16, seed=9) + [(3000 + i, [300.0 * c for c in v], 0) for i, v, _ in clusters(120, 8, seed=3)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    assert K.shelf_blocks(16, 10, 50) == -(-10 // shelves)
    assert got_topk(K.top_k(df, df["vec_id"] % 50 == 0, block_rows=50, seed_rows=30)) == brute_topk(rows)


def test_shelves_are_bounded():
    assert K.shelf_blocks(64, 13, 4096) == 1  # a small table: blocks stand alone
    assert K.shelf_blocks(64, 10 ** 6, 4096) * 4096 * 64 * 4 <= K.SHELF_BYTES
    assert K.shelf_blocks(10 ** 6, 10 ** 6, 4096) == 1


def test_queries_travel_in_packs():
    pdf = pd.DataFrame({"id": range(1000), "vec": [np.arange(64) - i % 7 for i in range(1000)], "dim": 64, "shelves": 3, "proven": 5})
    packs = pd.concat(K._packed(iter([pdf])))
    assert len(packs) <= 1000 * (16 + 2 * 64) // K.PACK_BYTES + 2
    ids = np.concatenate([np.frombuffer(a, "<i8") for a in packs["a"]])
    back = np.concatenate([K.widened(b, len(a) // 8, 64, "i") for a, b in zip(packs["a"], packs["b"])])
    assert ids.tolist() == list(range(1000)) and (back == np.stack(pdf["vec"])).all()


@pytest.mark.parametrize("most,width", [(100, 2), (1 << 15, 4), (1 << 31, 8)])
def test_numbers_take_the_bytes_they_need(most, width):
    x = np.array([[most, -most], [0, 1]])
    assert len(K.small(x).tobytes()) == 4 * width and (K.widened(K.small(x).tobytes(), 2, 2, "i") == x).all()


def test_rows_are_left_out_only_on_proof():
    """Whatever the proven score, a block returns all rows that reach it, up to k."""
    rng = np.random.default_rng(0)
    for trial in range(60):
        n, dims = int(rng.integers(65, 400)), int(rng.integers(1, 20))
        vecs = rng.integers(-300, 300, (n, dims)) if trial % 2 else np.round(rng.standard_normal((n, dims)) ** 3 * 40).astype(np.int64)
        ids = rng.permutation(10 * n)[:n]
        block = K.Block(*K.build_block(ids, vecs))
        q = vecs[0] if trial % 3 else rng.integers(-200, 200, dims)
        scores = vecs @ q
        others = ids != ids[0]
        proven = int(np.sort(scores[others])[-5 - trial % 4])
        got = block.search(int(ids[0]), q, 5, proven)
        want = sorted((-s, i) for s, i in zip(scores[others], ids[others]) if s >= proven)[:5]
        assert list(zip((-got[1]).tolist(), got[0].tolist())) == [(int(s), int(i)) for s, i in want]


@pytest.mark.parametrize("inner", [3, 6])
@pytest.mark.parametrize("centroids", [16, 64, 256])
def test_recall_where_vectors_differ_in_few_dimensions(inner, centroids):
    """The radius from true neighbours of some vectors finds those of others."""
    rng = np.random.default_rng(inner)
    x = rng.standard_normal((6000, inner)) @ rng.standard_normal((inner, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    grid = E.fit_grid(x, centroids, 0.93, 0.999)
    far = E.border_distances(grid, x[:E.QUERIES], x, 0.93)
    hist = np.bincount(np.minimum((far * (E.BINS / 2)).astype(int), E.BINS - 1), minlength=E.BINS)
    radius = max(grid.radius, E.radius_for(hist, 0.999))
    others = E.border_distances(grid, x[3000:3000 + E.QUERIES], x, 0.93)
    assert len(others) > 1000 and (others <= radius).mean() >= 0.99


def test_all_links_of_a_flat_cloud(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 3)) @ rng.standard_normal((3, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in E.near_duplicates(df, sample_rows=700).collect()}
    want = (x @ x.T >= 0.93).sum(1) - 1
    assert sum(got.values()) >= 0.99 * want.sum() and all(got[i] <= want[i] for i in got)


def test_radius_of_a_histogram():
    h = np.zeros(E.BINS, int)
    assert E.radius_for(h, 0.99) == 0
    h[10], h[500] = 99, 1
    assert E.radius_for(h, 0.99) == pytest.approx(11 * 2 / E.BINS) and E.radius_for(h, 0.999) == pytest.approx(501 * 2 / E.BINS)
