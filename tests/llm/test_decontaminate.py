from __future__ import annotations

import hashlib
import random
import re

import pytest

from orewright.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items):
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for item, x in items:
            iw = words(x)
            for k in range(max(1, len(iw) - 9) if iw else 0):
                p = iw[k : k + 10]
                for i in range(len(w) - len(p) + 1):
                    if w[i : i + len(p)] == p:
                        hit.update(range(i, i + len(p)))
                        if item is not None:
                            found.add(str(item))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=str)


def case():
    rng = random.Random(5)
    vocab = ["a", "the", "Été", "x1", "of", "b2c", "naïve", "zz", "q"]
    say = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", " - "]) for _ in range(n))
    items = [(k, say(rng.choice([3, 9, 10, 11, 30]))) for k in range(25)] + [(30, ""), (31, None), (32, " .-"), (None, say(12)), (3, say(14)), (40, "q")]
    docs = [(k, say(rng.choice([0, 1, 5, 80, 300]))) for k in range(40)]
    docs += [(100 + k, say(20) + (items[k][1] or "").upper().replace("É", "É") + say(20)) for k in range(25)] + [(200, None), (201, ""), (202, "qq" * 5000), (None, "the q"), (0, docs[3][1])]
    docs += [(300, " ".join(words(items[4][1]) * 400))]
    return docs, items


@pytest.mark.parametrize("block_bytes", [200, 8 << 20])
def test_matches_brute_force(spark, block_bytes):
    docs, items = case()
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, items int").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(df, bench, block_bytes=block_bytes).collect()
    assert sorted(map(tuple, got), key=str) == slow(docs, items)


def test_long_items_only_and_many_lanes(spark):
    rng = random.Random(6)
    docs = [(k, " ".join(rng.choice("abcdefgh") for _ in range(3000))) for k in range(6)]
    items = [(k, " ".join(docs[k][1].split()[100 * k : 100 * k + 25])) for k in range(6)]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == slow(docs, items)


def test_clean_keeps_columns_and_empty_tables(spark):
    docs, items = case()
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in slow(docs, items) if not r[5]), key=str)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(df, none).count() == len(docs)
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
