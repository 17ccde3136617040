import math

import numpy as np

from tessella.llm import balltree


def brute(rows, k=5):
    ok = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in ok:
        if q % 50 == 0:
            s = sorted(((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])))
            out |= {(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])}
    return out


def run(spark, rows):
    v = balltree.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    return balltree.top_k(v.where("id % 50 = 0"), v).collect()


def test_equals_brute_force_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(900)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2050, [1.0, 2.0]), (2051, [3.0, 4.0]), (2100, []), (2150, [0.0] * 8)]
    got = run(spark, rows)
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_large_components_and_empty(spark):
    rows = [(0, [1e6, -2e6]), (1, [3e6, 1e6]), (2, [-1e6, 5e6])]
    assert {tuple(r) for r in run(spark, rows)} == brute(rows)
    assert run(spark, []) == []


def test_tree_prunes():
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.integers(-5, 5, (500, 4)) + c for c in ([1000, 0, 0, 0], [-1000, 0, 0, 0])])
    tree = balltree.BallTree(np.arange(1000), v)
    best = []
    tree.search(v[0], 0, 5, best)
    assert all(-i < 500 for _, i in best)
