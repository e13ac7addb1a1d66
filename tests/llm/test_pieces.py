from __future__ import annotations

import itertools
import os
import random
import zlib

import numpy as np
import pytest

from orewright.llm import pieces

spm = pytest.importorskip("sentencepiece")
if not os.path.exists(pieces.MODEL):
    pytest.skip("no model file", allow_module_level=True)

TEXTS = ["", "a", " ", "  Hello world\n\nñ 😀 <s> </s>   x", "aaaaaaaaaa" * 30, "\t\r\n", "x" * 3000 + " " + "ab" * 2000, "日本語のテキスト" * 40, "é", "thhebleou ndanha, ereation.", "\u0000 ​", "http://a.b/c?d=e&f=%20", "0123456789 " * 20, "ÀÉÎõü ßœ"]


@pytest.fixture(scope="module")
def model():
    return pieces.Model.load()


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=pieces.MODEL)


def noise(n=300):
    rng = random.Random(2)
    syllables = ["th", "er", "on", "an", "re", "tion", "ing", "É", "ç", "ß", "a", "the", "0", "9", ".", ",", "\n", " ", " ", "_", "{", "}", "😀", "中", "X", "I", "!!", "|"]
    return ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 200))) for _ in range(n)]


def test_ids_equal_the_library(model, library):
    texts = TEXTS + noise()
    for t, got in zip(texts, pieces.Encoder(model).encode(texts)):
        assert got.tolist() == library.encode(t), t[:80]


def test_every_piece_and_pairs_of_pieces(model, library):
    rng = random.Random(4)
    words = [t.replace(pieces.MARK, " ") for t in model.by_text]
    texts = words[::7] + ["".join(rng.sample(words, 2)) for _ in range(3000)]
    for t, got in zip(texts, pieces.Encoder(model).encode(texts)):
        assert got.tolist() == library.encode(t), t


def test_round_trip_and_decode(model, library):
    texts = TEXTS + noise(100)
    for t, ids in zip(texts, pieces.Encoder(model).encode(texts)):
        assert pieces.decode(model, ids) == t
        assert library.decode(ids.tolist()) == t


def test_unigram_scores_are_maximal():
    rng = random.Random(1)
    texts = ["<unk>", *"abc", "ab", "bc", "abc", "ca", "aab", "cab", "bca"]
    scores = np.array([0.0, *[-rng.random() * 4 - 1 for _ in texts[1:]]], dtype=np.float32)
    usable = np.array([False] + [True] * (len(texts) - 1))
    model = pieces.Model(texts, scores, usable, np.full(256, -1), [t.encode() for t in texts], 0, True, False)
    encoder, low = pieces.Encoder(model), float(scores[1:].min()) - 10

    def best(w):
        top = -np.inf
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(w)]
            parts = [w[a:b] for a, b in zip(at, at[1:])]
            s = sum(scores[model.by_text[p]] if p in model.by_text else low if len(p) == 1 else -np.inf for p in parts)
            top = max(top, s)
        return top

    words = ["".join(rng.choice("abcx") for _ in range(n)) for n in (1, 2, 5, 8) for _ in range(12)]
    for w in words:
        for ids in (encoder.encode([w])[0], encoder._alone(w)):
            assert np.isclose(sum(low if k == 0 else scores[k] for k in ids), best(w), atol=1e-4)
            assert len("".join("?" if k == 0 else texts[k] for k in ids)) == len(w)


def test_tables(spark, library):
    rows = [(k, t, "old") for k, t in enumerate([*TEXTS, None, TEXTS[3]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(2)
    out = pieces.decode_table(pieces.encode_table(df)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert list(r.ids) == library.encode(r.text or "") and r.decoded == (r.text or "")
    for r in pieces.round_trip(df).collect():
        t = rows[r.doc_id][1] or ""
        ids = library.encode(t)
        assert (r.n_pieces, r.exact) == (len(ids), True)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<i4").tobytes()) and r.decoded_crc32 == zlib.crc32(t.encode())
    assert pieces.round_trip(df.limit(0)).count() == 0
