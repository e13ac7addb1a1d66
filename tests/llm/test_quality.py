from __future__ import annotations

import random
import zlib

import numpy as np

from orewright.llm import quality


def corpus(n=400):
    rng = random.Random(8)
    docs, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice("abcdeéfg") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(20, 120))]
        good = k % 4 > 0
        text = " ".join(words) + "." if good else " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in words)
        docs.append((k, text, "en"))
        labels.append((k, int(good)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")


def held(d):
    return zlib.crc32(str(d).encode()) % 5 == 0


def test_held_out_accuracy_and_brute_force_votes(spark):
    docs, labels = corpus()
    df, lab = frames(spark, docs, labels)
    got = {r.doc_id: r for r in quality.classify(df, lab).collect()}
    assert all(r.held_out == held(d) for d, r in got.items())
    out = [d for d in got if held(d)]
    assert np.mean([got[d].predicted == labels[d][1] for d in out]) > 0.97
    model = quality.fit(df, lab)
    assert len(model.labels) == sum(not held(d) for d, _, _ in docs)
    for d, t, _ in docs[:25]:
        v = model.latent(*quality.features(t.encode()))
        sims = model.vectors @ (v / np.linalg.norm(v))
        top = np.argsort(-sims)[: model.plan.neighbours]
        w = np.maximum(sims[top].astype(float), 0) ** model.plan.sharpness
        assert abs(got[d].score - (w * model.labels[top]).sum() / w.sum()) < 1e-3


def test_held_out_labels_and_other_columns_change_nothing(spark):
    docs, labels = corpus(160)
    df, lab = frames(spark, docs, labels)
    turned = [(d, 1 - q if held(d) else q) for d, q in labels]
    a = {r.doc_id: r.score for r in quality.classify(df, lab).collect()}
    b = {r.doc_id: r.score for r in quality.classify(df, spark.createDataFrame(turned, lab.schema)).collect()}
    assert a == b


def test_odd_rows(spark):
    docs, labels = corpus(80)
    docs += [(900, None, None), (901, "", None), (None, "abc abd", None), (0, docs[0][1], "x"), (902, "é" * 100_000, None), (903, "a", None)]
    df, lab = frames(spark, docs, [*labels, (1, 0), (None, 1), (2, None)])
    rows = quality.classify(df, lab).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    kept = quality.keep_good(df, lab)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in rows)
    assert {r.score for r in quality.classify(df, lab.limit(0)).collect()} == {1.0}
    assert quality.classify(df.limit(0), lab).count() == 0
