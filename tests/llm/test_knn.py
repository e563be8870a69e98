"""Exact search against all pairs: repeated ids, copies, ties, nulls, shards of any size."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cuespark.llm import knn

RNG = random.Random(11)
KIND = "vec_id bigint, embedding array<float>, rank int, v string, leaf int, score double"


def frame(spark, data):
    return spark.createDataFrame([(i, v, 1, "x", 3, 0.5) for i, v in data], KIND).repartition(3)


def brute(data, k=5, every=50):
    own = []
    for i, v in data:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            own.append((i, np.floor(256 * np.array(np.array(v, np.float32), float)).astype(int).tolist()))
    out = []
    for a, (q, x) in enumerate(own):
        if q % every == 0:
            best = sorted((-sum(s * t for s, t in zip(x, y, strict=False)), i) for b, (i, y) in enumerate(own) if a != b)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_repeated_ids_copies_and_nulls(spark):
    data = [(k, [RNG.choice([-0.5, 0.0, 0.25, 0.3]) for _ in range(4)]) for k in range(120)]
    data += [(50, [0.5, 0.5, 0.5, 0.5]), (50, [0.5, 0.5, 0.5, 0.5]), (1, [0.3, 0.3, 0.3, 0.3]), (1, [9.0, 9.0, 9.0, 9.0])]  # ids again, with equal and other vectors
    data += [(k, [1.0, 1.0, 1.0, 1.0]) for k in range(300, 380)]  # copies, some of them asked for
    data += [(250, None), (251, [None, 1.0]), (252, [float("nan")]), (253, [float("inf"), 1.0]), (None, [1.0] * 4), (400, []), (450, [1.0])]
    for size in (4096, 30):
        assert rows(knn.top_k(frame(spark, data), shard_rows=size)) == brute(data)


def test_few_rows(spark):
    few = [(0, [1.0]), (1, [2.0]), (1, [2.0]), (1, [3.0])]
    assert rows(knn.top_k(frame(spark, few))) == brute(few) and len(brute(few)) == 3
    assert knn.top_k(frame(spark, few).limit(0)).count() == 0
    assert rows(knn.top_k(frame(spark, few[1:]))) == []


def test_shards_are_left_out(spark, monkeypatch):
    """Clusters far apart: a query's block goes to few shards, with the same results; blocks and salts of any size."""
    centres = [[RNG.uniform(-4, 4) for _ in range(6)] for _ in range(12)]
    data = [(k, [x + RNG.gauss(0, 0.1) for x in RNG.choice(centres)]) for k in range(900)]
    for name, value in (("BLOCK_QUERIES", 3), ("VISIT_BLOCKS", 2), ("LEAF_ROWS", 8)):
        monkeypatch.setattr(knn, name, value)
    assert rows(knn.top_k(frame(spark, data), every=10, shard_rows=60)) == brute(data, every=10)
    own = np.floor(256 * np.array([v for _, v in data], np.float32).astype(float)).astype(int)
    coarse = knn.Coarse(own, 15)
    leaf = coarse.place(own)
    assert coarse.leaves == 15 and np.bincount(leaf).max() <= 2.5 * np.bincount(leaf).mean()
    low, high = (np.array([f(own[leaf == x], 0) for x in range(15)]) for f in (np.min, np.max))
    kth = np.sort(own[:50] @ own.T, 1)[:, -6]
    assert (knn.box_bounds(own[:50], low, high) >= kth[:, None]).mean() < 0.6
    assert (knn.box_bounds(own[:50], low, high)[np.arange(50)[:, None], leaf[None, :]] >= own[:50] @ own.T).all()


def test_large_numbers_stay_exact():
    own = np.array([[1 << 40, 1], [1 << 40, 2], [-(1 << 62), 5]])
    tree = knn.Tree.build(np.array([3, 4, 5]), own, 1)
    got = tree.search(np.array([[1 << 12, 3]]), 2, np.array([knn.LONG[0]]))[0]
    assert got == [((1 << 52) + 6, 4, False), ((1 << 52) + 3, 3, False)]
    assert tree.search(np.array([[-(1 << 62), 0]]), 1, np.array([knn.LONG[0]]))[0] == [(knn.LONG[1], 5, False)]


@pytest.mark.parametrize("parts", [[[1, 2], [3, 4]], [[1], [], [2, 3]], []])
def test_matrix(parts):
    width = max(map(len, parts), default=0)
    assert knn.matrix(pa.array(parts, pa.list_(pa.int64()))).tolist() == [p + [0] * (width - len(p)) for p in parts]
