from __future__ import annotations

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
spm = pytest.importorskip("sentencepiece")

from orewright.llm import pieces, pii, quality  # noqa: E402

from .test_decontaminate import words  # noqa: E402
from .test_simhash import slow_components  # noqa: E402


def tables(tmp):
    rng = random.Random(31)
    say = lambda n: " ".join("".join(rng.choice(("th", "er", "on", "é", "in", "sta", "po")) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    docs, labels, bench = [], [], [(k, say(12)) for k in range(5)]
    for k in range(150):
        text = say(rng.randrange(15, 90)).capitalize() + "."
        if k % 6 == 0:
            text = "### ".join(text.split()) + " $$$"
        if k % 6 == 1:
            text += f" jo.{k}@example.com or +49 30 555 {1000 + k}"
        if k % 6 == 2:
            text += " " + bench[k % 5][1].replace("t", "T") + " end"
        docs.append((k, text, "en", "s", len(text)))
        labels.append((k, int(k % 6 > 0), 0))
    docs += [(1000 + k, docs[k][1], "en", "s", docs[k][4]) for k in range(0, 150, 4)] + [docs[3], (None, docs[3][1], "en", "s", 1), (2000, None, None, None, None), (2001, "", None, None, 0)]
    return docs, labels, bench


def test_rows_equal_a_plain_version(spark, tmp_path):
    docs, labels, bench = tables(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}.parquet")
    judge = quality.fit(read("documents"), read("labels"))
    import numpy as np

    kept = [d for d in docs if judge.scores(np.stack([judge.latent(*quality.features((d[1] or "").encode()))]))[0] >= 0.3]
    names = {c for _, _, c in slow_components([(d[0], d[1]) for d in kept])}
    kept = list({d[0]: d for d in kept if d[0] in names}.values())
    grams = {tuple(w[i : i + 10]) for _, t in bench for w in [words(t)] for i in range(max(1, len(w) - 9))}
    kept = [d for d in kept if not any(tuple(w[i : i + 10]) in grams for w in [words(d[1])] for i in range(len(w) - 9))]
    library, want = spm.SentencePieceProcessor(model_file=pieces.MODEL), []
    for d, t, lang, source, n in kept:
        new = pii.redacted(t, pii.spans(t, pii.model())[1]) if t else t
        want.append((d, new, lang, source, n if new == t else len(new), library.encode(new or "")))
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "text", "lang", "source", "n_chars", "ids").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert 40 < len(got) < 120 and any("[EMAIL]" in (r[1] or "") for r in got)


def test_stages_keep_the_columns(spark, tmp_path):
    docs, labels, bench = tables(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame(docs, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df.limit(0), str(tmp_path)).dtypes == df.dtypes
    assert stage(spark, df.limit(0), str(tmp_path)).count() == 0


def grams(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_near_copies_go_and_others_stay(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(3, 9)))
    rows = []
    for k in range(160):
        own = [word() for _ in range(rng.randrange(60, 400))]
        rows.append((k, " ".join(own)))
        copy, share = list(own), (0.02, 0.03, 0.08)[k % 3]
        for i in rng.sample(range(len(copy)), max(1, int(share * len(copy)))):
            copy[i] = word()
        rows.append((1000 + k, " ".join(copy)))
    like = {k: len(grams(a) & grams(b)) / len(grams(a) | grams(b)) for (k, a), (_, b) in zip(rows[::2], rows[1::2])}
    assert sum(0.8 <= x < 0.95 for x in like.values()) > 50 and sum(x < 0.8 for x in like.values()) > 50
    df = spark.createDataFrame([*rows, (None, None), (3000, ""), (3001, " ")], "doc_id long, text string").repartition(3)
    got = [r.doc_id for r in corpus_pipeline.simhash_stage(spark, df, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and {k for k, _ in rows[::2]} <= set(got) and set(got) & {None, 3000, 3001} == {3000}
    assert all(1000 + k in got for k, x in like.items() if x < 0.8)
    near = [k for k, x in like.items() if x >= 0.8]
    assert sum(1000 + k not in got for k in near) >= 0.97 * len(near)
