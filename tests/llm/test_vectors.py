"""Exact search and vector near-duplicates against full matrices."""

import time

import numpy as np
import pytest

from tessera.llm import embed_dedup, topk

VECTORS = "vec_id bigint, embedding array<float>, label int, score double, part int, pivot int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0.5, 1, 2) for i, v in rows], VECTORS)


BAD = [(900, None), (901, [1.0, None, 2.0]), (902, [float("nan"), 1.0, 1.0]), (903, [float("inf"), 0.0, 0.0]), (950, None)]


def clustered(n=300, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = [(i, (centres[i % 12] + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.3])).astype(np.float32).tolist()) for i in range(n)]
    return rows + [(500 + i, rows[3][1]) for i in range(40)]


def brute_topk(rows, k=5):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("cells", [64, 3])
def test_search(spark, monkeypatch, cells):
    monkeypatch.setattr(topk, "LEAST_CELLS", cells)
    monkeypatch.setattr(topk, "QUERIES_PER_CELL", 3)
    monkeypatch.setattr(topk, "TILE", 16)
    rows = clustered() + BAD + [(None, [1.0] * 6)]
    assert sorted(map(tuple, topk.search(table(spark, rows)).collect())) == brute_topk(rows)


def test_search_with_repeated_ids(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0])]
    got = sorted(map(tuple, topk.search(table(spark, rows)).collect()))
    assert got == [(50, 1, 7, 65536), (50, 1, 7, 65536), (50, 2, 7, 65536), (50, 2, 7, 65536), (50, 3, 50, 0), (50, 3, 50, 0)]


def test_best_of_tiles_with_many_ties(monkeypatch):
    monkeypatch.setattr(topk, "TILE", 7)
    monkeypatch.setattr(topk, "QUERY_TILE", 3)
    rng = np.random.default_rng(5)
    for kind in (1, 2**29):
        rows, ids, number = rng.integers(-1, 2, (60, 2)) * kind, rng.permutation(60), np.arange(60) + 100
        got = topk.best_of_tiles(number[:10], rows[:10], ids, number, rows, 5)
        for q in range(10):
            want = sorted((-int(sum(int(a) * int(b) for a, b in zip(rows[q], rows[j]))), int(ids[j])) for j in range(60) if j != q)[:5]
            mine = got[0] == number[q]
            assert mine.sum() == 5 and [(-s, i) for s, i in want] == sorted(zip(got[2][mine].tolist(), got[1][mine].tolist()), key=lambda x: (-x[0], x[1]))


def test_search_with_large_numbers_and_few_rows(spark):
    rows = [(0, [5e6, -5e6]), (50, [4e6, 3.0]), (51, [-5e6, 5.0])]  # beyond doubles
    assert sorted(map(tuple, topk.search(table(spark, rows)).collect())) == brute_topk([(i, [float(np.float32(x)) for x in v]) for i, v in rows])
    rows = [(0, [1e8, 0.0]), (50, [0.0, 1e8]), (51, [0.0, 0.0])]  # sums that could pass 64 bits
    assert sorted(map(tuple, topk.search(table(spark, rows)).collect())) == brute_topk([(i, [float(np.float32(x)) for x in v]) for i, v in rows])
    assert topk.search(table(spark, [])).collect() == []
    assert topk.search(table(spark, [(0, [1.0])])).collect() == []



def brute_links(rows, threshold=0.95):
    width = max((len(v) for _, v in rows if v is not None), default=0)
    usable = {n for n, (_, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    m = np.array([[*(v if n in usable else []), *[0.0] * (width - (len(v) if n in usable else 0))] for n, (_, v) in enumerate(rows)], float).reshape(len(rows), width)
    unit = m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None]
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    label = list(range(len(rows)))
    while True:
        new = [min([label[n], *(label[j] for j in np.flatnonzero(linked[n]))]) for n in range(len(rows))]
        if new == label:
            break
        label = new
    out = []
    for n, (i, _) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if label[j] == label[n]]
        out.append((i, int(linked[n].sum()), min(group), i == min(group)))
    return sorted(out)


@pytest.mark.parametrize("block,direct", [(4096, 1 << 20), (20, 16)])
def test_near_duplicates(spark, monkeypatch, block, direct):
    monkeypatch.setattr(embed_dedup, "DIRECT", direct)
    rows = clustered() + [(904, [0.0] * 6), (905, []), (906, [1.0, 2.0])] + [(i, v) for i, v in BAD]
    got = sorted(map(tuple, embed_dedup.near_duplicates(table(spark, rows), block=block).collect()))
    assert got == brute_links(rows)


def test_near_duplicates_of_nothing(spark):
    assert embed_dedup.near_duplicates(table(spark, [])).collect() == []
    assert [tuple(r) for r in embed_dedup.near_duplicates(table(spark, [(1, None), (2, [0.0])])).orderBy("vec_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("seed", range(4))
def test_dual_traversal(seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, 8))
    points = embed_dedup._normal(np.concatenate([centres[rng.integers(0, 30, 200)] + rng.normal(size=(200, 8)) * s for s in (0.01, 0.1, 0.4)]))
    ids, weights = np.arange(600), rng.integers(1, 4, 600)
    old, embed_dedup.DIRECT = embed_dedup.DIRECT, 64
    try:
        halves = [embed_dedup.Tree.build(points[a : a + 300], ids[a : a + 300], weights[a : a + 300]) for a in (0, 300)]
        links, edges = {}, []
        for i, j in ((0, 0), (0, 1), (1, 1)):
            found, more = embed_dedup.dual_traversal(halves[i], halves[j], i == j)
            edges += more
            for k, v in found.items():
                links[k] = links.get(k, 0) + v
    finally:
        embed_dedup.DIRECT = old
    linked = points @ points.T >= 0.95
    np.fill_diagonal(linked, False)
    assert [links.get(i, 0) for i in range(600)] == (linked @ weights).tolist()

    def roots(pairs):
        up = list(range(600))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        return [find(i) for i in range(600)]

    assert roots(edges) == roots(zip(*np.nonzero(linked)))


def test_near_duplicates_moves_vectors_a_fixed_number_of_times(spark):
    """Blocks of one table meet without being written for every pair of blocks."""
    moved = lambda: sum(e.totalShuffleWrite() for e in [spark._jsc.sc().statusStore().executorList(True).apply(0)])
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(3000, 64)).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(vectors.tolist())] + [(3000, [-0.0] + [1.0] * 63), (3001, [0.0] + [1.0] * 63)]
    before = moved()
    got = sorted(map(tuple, embed_dedup.near_duplicates(table(spark, rows), block=60).collect()))
    assert moved() - before < 6 * vectors.nbytes
    assert got == brute_links(rows)


def test_unclustered_blocks_cost_about_one_product():
    """Where nodes exclude nothing, a pair of blocks takes less time than its cosines in double precision do twice."""
    rng = np.random.default_rng(8)
    points = embed_dedup._normal(rng.normal(size=(8192, 64)))
    points[5000:5040] = points[:40]
    ids, weights = np.arange(8192), np.ones(8192, np.int64)
    a, b = (embed_dedup.Tree.build(points[k : k + 4096], ids[k : k + 4096], weights[k : k + 4096]) for k in (0, 4096))

    def seconds(run):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            run()
            took.append(time.perf_counter() - began)
        return min(took)

    links, edges = embed_dedup.dual_traversal(a, b, False)
    assert links == {i: 1 for i in [*range(40), *range(5000, 5040)]} and {(max(e), min(e)) for e in edges} == {(5000 + i, i) for i in range(40)}
    assert seconds(lambda: embed_dedup.dual_traversal(a, b, False)) < 2 * seconds(lambda: np.nonzero(a.points @ b.points.T >= 0.95))


@pytest.mark.parametrize("few,most", [(0, 512), (1 << 30, 1), (3, 2)])
def test_links_of_tiles_with_few_and_many(monkeypatch, few, most):
    monkeypatch.setattr(embed_dedup, "FEW", few)
    monkeypatch.setattr(embed_dedup, "MOST", most)
    monkeypatch.setattr(embed_dedup, "TILE", 16)
    test_dual_traversal(7)
