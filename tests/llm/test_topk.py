import random

import numpy as np

from quernstone.llm import topk
from tests.llm.helpers import save


def brute(rows, k=5):
    ok = []
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            ok.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    for q, a in {(i, tuple(v)) for i, v in ok if i % 50 == 0}:
        found = sorted(((-sum(x * y for x, y in zip(a, b)), j) for j, b in ok if j != q and len(b) == len(a)))[:k]
        out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def answers(spark, rows, folder):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as shard", "3 as dim", "4 as v")
    return sorted(tuple(r) for r in topk.op6_kd_top_k(spark, save(df, folder, "embeddings")).collect())


def test_equals_brute_force(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    rows = [(i, [round(r.gauss(0, 1), 1) for _ in range(6)]) for i in range(400)]
    rows += [(500, [0.0] * 6), (550, [1.0] * 6), (551, [1.0] * 6), (551, [1.0] * 6), (600, None), (650, []), (700, [None] * 6), (750, [float("nan")] * 6), (800, [float("inf")] * 6), (None, [1.0] * 6), (850, [1.0, 2.0])]
    assert answers(spark, rows, tmp_path / "one") == brute(rows)
    monkeypatch.setattr(topk, "SHARD", 37)
    monkeypatch.setattr(topk, "BLOCK", 3)
    assert answers(spark, rows, tmp_path / "many") == brute(rows)


def test_large_components_are_exact(spark, tmp_path):
    rows = [(i, [2.0**20 + i * 128, -(2.0**19) + i * 64]) for i in range(0, 200, 10)]
    assert answers(spark, rows, tmp_path) == brute(rows)


def test_few_and_no_rows(spark, tmp_path):
    assert answers(spark, [], tmp_path / "a") == []
    assert answers(spark, [(0, [1.0])], tmp_path / "b") == []
    assert answers(spark, [(0, [1.0]), (3, [2.0])], tmp_path / "c") == [(0, 1, 3, 256 * 512)]


def test_boxes_are_tight_and_bound_scores():
    r = np.random.default_rng(1)
    rows = r.integers(-50, 50, (700, 4)).astype(float)
    tree = topk.Tree(np.arange(700), rows)
    q = r.integers(-50, 50, 4).astype(float)
    for (i, j), lo, hi in zip(tree.part, tree.low, tree.high):
        own = tree.rows[i:j]
        assert (own.min(0) == lo).all() and (own.max(0) == hi).all()
        assert (own @ q).max() <= np.maximum(q, 0) @ hi + np.minimum(q, 0) @ lo
