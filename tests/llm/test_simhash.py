from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from orewright.llm import simhash
from orewright.llm.common import Scratch
from orewright.llm.components import components

SCHEMA = "doc_id long, text string, fp string, root long"


def slow_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    prints = [slow_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                label[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(n=120):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        words = [rng.choice(["ab", "Cd", "éf", "gh", "ij", "kl"]) for _ in range(rng.choice([1, 2, 3, 4, 60, 200]))]
        rows.append((i * 7 % 1000, " ".join(words)))
    rows += [(5000 + k, rows[k][1] + " zz") for k in range(0, n, 3)] + [(6000 + k, rows[k][1]) for k in range(0, n, 5)]
    rows += [(7000, None), (7001, ""), (7002, " \t\n"), (None, "ab"), (None, None), rows[0], rows[0]]
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(3)
    got = simhash.near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
    assert sorted(map(tuple, got), key=str) == slow_components(rows)


def test_keep_one_is_one_row_a_component(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in slow_components(rows)}
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0


@pytest.mark.parametrize("tile_rows", [16, 4096])
def test_links_of_crowded_tiles(spark, tile_rows):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 12, dtype=np.int64)
    fps = {int(b) for b in base} | {int(b ^ (1 << int(p)) ^ (1 << int(q))) for b in base for p, q in rng.integers(0, 62, (40, 2))}
    fps |= {int(x) for x in rng.integers(-(2**63), 2**63 - 1, 300)}
    fps = sorted(fps)
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and label[a] > label[b]:
                    label[a], changed = label[b], True
    got = simhash.link_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp long"), Scratch(spark), tile_rows=tile_rows, guest_rows=4 * tile_rows)
    found = {r.fp: r.root for r in got.collect()}
    assert {f: found.get(f, f) for f in fps} == label


def test_components_of_chain_star_and_repeats(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (100, 101), (101, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long").repartition(4), Scratch(spark)).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}
