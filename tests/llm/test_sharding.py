from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest

from orewright.llm import sharding
from orewright.llm.common import Scratch, dense_rank_in
from pyspark.sql import functions as F


def check(rows, got, shards=8):
    assert len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    sizes = [counts[s] for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("hot", [0, 400])
def test_groups_stay_together_and_sizes_even(spark, hot):
    rng = random.Random(hot)
    rows, k = [], 0
    for g in range(300):
        text = f"text {g} é"
        for _ in range(rng.choice([1, 1, 1, 2, 3, 6])):
            rows.append((k, text, 7))
            k += 1
    rows += [(k + i, "hot", 7) for i in range(hot)] + [(k + hot + 1, None, 7), (k + hot + 2, None, 7), (None, "", 7), (None, "", 7), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(3)
    got = sharding.shard_documents(df).collect()
    check(rows, got)
    by = dict((r[0], r[1]) for r in rows)
    for r in got:
        if r.doc_id is not None:
            raw = (by[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    where = defaultdict(set)
    for r in got:
        if r.doc_id is not None and by[r.doc_id] not in (None, "hot"):
            where[by[r.doc_id]].add(r.shard)
    several = [t for t, n in Counter(r[1] for r in rows).items() if n > 1 and t in where]
    assert sum(len(where[t]) == 1 for t in several) > 0.8 * len(several)


def test_links_cut_fewer_edges_than_hashing(spark):
    rng = random.Random(1)
    rows = [(k, f"t{k}") for k in range(400)]
    pairs = [(a, rng.choice([b for b in range(400) if b % 20 == a % 20])) for a in range(400) for _ in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.shard for r in sharding.shard_documents(df, links=spark.createDataFrame([*pairs, (5, 5), (6, 9999)], "x long, y long"), plan=sharding.Plan(rounds=10)).collect()}
    assert max(Counter(got.values()).values()) == 50
    assert sum(got[a] != got[b] for a, b in pairs) < 0.7 * len(pairs)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_rows(spark, n):
    rows = [(k, "same") for k in range(n)]
    check(rows, sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_more_linked_rows_than_room(spark):
    rows = [(k, "ab"[k % 2]) for k in range(101)]
    check(rows, sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_dense_rank_over_many_buckets(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("k"))
    got = dense_rank_in(df, F.col("k"), [F.col("id")], "n", rows_per_bucket=50).collect()
    for k in range(3):
        assert sorted(r.n for r in got if r.k == k) == list(range(sum(r.k == k for r in got)))


def test_every_pair_that_fits_stays_whole(spark):
    rows = [(k, f"pair {k // 2}" if k < 240 else f"single {k}") for k in range(2400)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    check(rows, got)
    where = {r.doc_id: r.shard for r in got}
    assert sum(where[k] != where[k + 1] for k in range(0, 240, 2)) == 0
