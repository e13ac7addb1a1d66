from __future__ import annotations

import numpy as np
import pytest

from orewright.llm import vecdedup

SCHEMA = "vec_id long, embedding array<float>, label int, n long"


def slow(rows, threshold=0.9):
    unit = {}
    for k, (_, v) in enumerate(rows):
        if v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, dtype=np.float32).astype(np.float64)
        unit[k] = x / np.linalg.norm(x)
    near = {k: {j for j in unit if j != k and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= threshold} for k in unit}
    out, seen = {}, {}
    for k in range(len(rows)):
        if k in seen:
            continue
        group, todo = set(), [k]
        while todo:
            i = todo.pop()
            if i not in group:
                group.add(i)
                todo += near.get(i, ())
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            seen[i] = min(ids, default=None)
    for k, (d, _) in enumerate(rows):
        out[k] = (d, len(near.get(k, ())), seen[k], d is not None and d == seen[k])
    return sorted(out.values(), key=str)


def case(n=700, dim=16, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    near = np.repeat(x[: n // 8], 3, axis=0) + rng.normal(size=(n // 8 * 3, dim)) * 0.15
    blob = x[0] + rng.normal(size=(60, dim)) * 0.05
    rows = [(int(k), v.astype(np.float32).tolist()) for k, v in enumerate(np.concatenate([x, near, blob]))]
    rows += [(10_000 + k, rows[5][1]) for k in range(40)] + [(5, rows[5][1]), (None, rows[5][1]), (None, rows[9][1])]
    rows += [(20_000, None), (20_001, [0.0] * dim), (20_002, [float("nan")] * dim), (20_003, [None] * dim), (20_004, []), (20_005, [1.0, 2.0]), (20_006, [2.0, 4.0]), (20_007, [float("inf")] + [1.0] * (dim - 1)), (20_008, [1.0, 2.0, 3.0])]
    return rows


@pytest.mark.parametrize("shard_rows", [200, 4096])
def test_matches_brute_force(spark, shard_rows):
    rows = case()
    df = spark.createDataFrame([(d, v, 1, 2) for d, v in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, vecdedup.near_duplicates(df, plan=vecdedup.Plan(shard_rows=shard_rows, least_recall=0.99)).collect()), key=str)
    want = slow(rows)
    assert len(got) == len(want)
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(sorted(got, key=lambda r: str(r[0])), sorted(want, key=lambda r: str(r[0]))) if g[0] is not None and g[0] != 5)
    if shard_rows == 4096:
        assert got == want


def test_empty_and_single(spark):
    assert vecdedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    one = vecdedup.near_duplicates(spark.createDataFrame([(3, [1.0, 0.0], 0, 0)], SCHEMA)).collect()
    assert [tuple(r) for r in one] == [(3, 0, 3, True)]


def test_pruned_graph_reaches_every_vector():
    rng = np.random.default_rng(0)
    x = vecdedup.unit(np.concatenate([rng.normal(size=(300, 8)), np.eye(8)[0] + rng.normal(size=(100, 8)) * 1e-3]))
    edges = vecdedup.connect(x, vecdedup.build(x, vecdedup.Plan()), 0)
    assert vecdedup._reach(edges, 0).all()


def many(n, dim, groups, seed):
    """Vectors with groups of two to six near ones, and their true links."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    near = [x[g] + rng.normal(size=(int(rng.integers(1, 6)), dim)) * rng.choice([0.1, 0.2, 0.3]) for g in range(groups)]
    x = np.concatenate([x, *near]).astype(np.float32)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    counts = np.concatenate([((u[a : a + 1000] @ u.T >= 0.9).sum(axis=1) - 1) for a in range(0, len(u), 1000)])
    return x, counts


def frame(spark, x):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": [v.tolist() for v in x]}), "vec_id long, embedding array<float>").repartition(8)


def test_thousands_of_links_over_many_shards(spark):
    x, want = many(9000, 24, 2500, 3)
    df, recall = vecdedup.audited(frame(spark, x), plan=vecdedup.Plan(shard_rows=512, flat_centroids=16))
    got = {r.vec_id: r.n_links for r in df.collect()}
    total = sum(got[k] for k in range(len(x)))
    assert all(got[k] <= want[k] for k in range(len(x))) and want.sum() > 8000
    assert recall >= 0.99 and total >= 0.99 * want.sum()
    asked = [k for k in range(0, len(x), 50) if want[k]]
    assert sum(got[k] for k in asked) >= 0.99 * sum(want[k] for k in asked)


def test_a_hot_cluster_is_split_and_counted_exactly(spark):
    rng = np.random.default_rng(9)
    blob = rng.normal(size=16) + rng.normal(size=(5000, 16)) * 0.02
    x = np.concatenate([blob, rng.normal(size=(1000, 16))]).astype(np.float32)
    got = {r.vec_id: r for r in vecdedup.near_duplicates(frame(spark, x), plan=vecdedup.Plan(split_rows=1024, tile_rows=700)).collect()}
    assert all(got[k].n_links == 4999 and got[k].component_id == 0 for k in range(5000))


def test_a_plan_that_fails_says_so(spark):
    x, _ = many(3000, 16, 900, 5)
    weak = vecdedup.Plan(shard_rows=20, overlap=1, beam=2, degree=1, candidates=2, attempts=1, least_recall=0.999)
    with pytest.raises(vecdedup.LowRecall):
        vecdedup.near_duplicates(frame(spark, x), plan=weak)


def test_two_levels_of_centroids_name_near_ones():
    rng = np.random.default_rng(2)
    x = vecdedup.unit(rng.normal(size=(6000, 8))).astype(np.float32)
    c = vecdedup.Centroids(x, 300, 64)
    every = np.concatenate(c.parts)
    best = np.argmax(x @ every.T, axis=1)
    assert c.n == len(every) and np.mean([b in row for b, row in zip(best, c.nearest(x, 3))]) > 0.95
