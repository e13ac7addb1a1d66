from __future__ import annotations

import random

import pytest

from orewright.llm import nearcopies

from .test_pipeline import grams


def families(n_families: int, n_each: int):
    """(id, text, family): two groups of close texts a family, at 0.799 across, but for one pair at 0.811; and texts like none."""
    rng, rows, pairs = random.Random(17), [], []
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10))
    for f in range(n_families):
        base = [word() for _ in range(138)]

        def text(*changes, base=base):
            own = list(base)
            for at, w in changes:
                own[at] = w
            return " ".join(own)

        mine, at = word(), len(rows)
        rows += [(f * 10_000 + 2 * k, text((20, word()), (40, word())), f) for k in range(n_each)]
        rows += [(f * 10_000 + 2 * k + 1, text((70, word())), f) for k in range(n_each)]
        rows += [(f * 10_000 + 9_000, text((20, mine), (40, word()), (1, word())), f), (f * 10_000 + 9_001, text((20, mine), (70, word()), (136, word())), f)]
        pairs.append((rows[at : at + n_each], rows[at + n_each : -2], rows[-2], rows[-1]))
    rows += [(900_000 + k, " ".join(word() for _ in range(50)), None) for k in range(20)]
    rng.shuffle(rows)
    return rows, pairs


def jaccard(a, b):
    a, b = grams(a[1]), grams(b[1])
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("tile_rows", [4096, 64])
def test_the_one_link_between_two_groups_is_found(spark, tile_rows):
    """Nearly all candidate pairs across the groups fail; the one that holds is among hundreds that look closer."""
    rows, pairs = families(4, 700)
    for left, right, x, y in pairs:
        assert jaccard(x, y) >= 0.8 and all(jaccard(x, r) >= 0.8 and jaccard(y, r) < 0.8 for r in left[:40])
        assert all(jaccard(y, r) >= 0.8 and jaccard(x, r) < 0.8 for r in right[:40]) and all(jaccard(a, b) < 0.8 for a, b in zip(left, right))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    plan = nearcopies.Plan(tile_rows=tile_rows)
    got = sorted(r.doc_id for r in nearcopies.keep_one(df, plan=plan).collect())
    assert got == [f * 10_000 for f in range(4)] + [900_000 + k for k in range(20)]


def test_tiles_link_all_that_hold_and_nothing_else(spark):
    """Sets at all similarities, in one tile each and as visitors: the same groups as by brute force over the candidates."""
    import numpy as np
    import pyarrow as pa

    rng, plan = np.random.default_rng(3), nearcopies.Plan(radius=128)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(40, 60), replace=False), rng.integers(0, 1 << 63, rng.integers(0, 6), dtype=np.uint64)])) for _ in range(150)]
    both = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    size = np.array([len(s) for s in sets])
    like = both / (size[:, None] + size[None] - both)

    def groups(pairs):
        label = list(range(150))
        for a, b in pairs:
            if (x := label[a]) != (y := label[b]):
                label = [min(x, y) if v in (x, y) else v for v in label]
        return label

    for guests in (0, 90):
        guest = np.arange(150) >= 150 - guests
        want = groups([(a, b) for a in range(150) for b in range(a) if like[a, b] >= 0.8 - 1e-9 and not (guest[a] and guest[b])])
        columns = [np.zeros(150, dtype=np.int64), np.zeros(150, dtype=np.int32), guest, np.arange(150), rng.integers(0, 1 << 62, 150), rng.integers(0, 1 << 62, 150), size.astype(np.int32), np.arange(150)]
        batch = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([s.tobytes() for s in sets])], names=[*nearcopies._ROW, "members"])
        for step in (7, 150):
            found = [p for b in nearcopies._settle(plan)(batch.slice(k, step) for k in range(0, 150, step)) for p in zip(*map(pa.Array.to_pylist, b.columns))]
            assert groups(found) == want and len(found) == 150 - len(set(want)) and 2 < len(set(want)) < 140
