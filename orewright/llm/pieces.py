"""SentencePiece encoding and decoding with a batched numpy Viterbi.

Words (a run of word marks and what follows up to the next mark) of equal length form a matrix and advance together, one
character at a time. At each place, hashes of all substrings that end there, taken from prefix sums, probe the sorted keys
of the pieces; vectorised maxima over the candidates store backpointers, which are then followed from the ends.

* Unigram models: the score of a candidate is its own plus the best of the place where it starts.
* BPE models: the best path is the one that the model's merges lead to. It is the only path on which every two
  neighbouring pieces are stable, that is, merging their joint characters gives just these two again. So a candidate counts
  only if it is stable after the piece that ends where it starts, and the result equals merging by rank exactly. Stability
  is tested for whole arrays of pairs, by replaying both pieces' merges side by side.

Words are first cut where no piece can span two neighbouring characters, such as before most punctuation; parts that still
have over ``_LONG`` characters are merged (or searched) one by one, with the same result. Characters without a piece become byte pieces.

The tables are as large as the vocabulary, whatever the data. Defined cases: null and empty texts have no pieces and decode
to the empty text; a text is given back exactly unless it holds U+2581, which the format itself reads as a space; repeated rows
are each encoded; an empty table gives an empty table; a column with the result's name is replaced, all others stay.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import tidy

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_BASE, _M64 = 0x9E3779B97F4A7C15, (1 << 64) - 1
_LONG, _CELLS = 512, 1 << 19
_WORDS_KEPT, _PARTS_KEPT = 200_000, 300_000
_MARKED, _TOLD = 21, 20
_NONE = -np.inf


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * _BASE + ord(c) + 1) & _M64
    return h


@dataclass
class Model:
    """A model as arrays; ids -1 mean none."""

    texts: list[str]
    scores: np.ndarray
    usable: np.ndarray  # normal pieces
    byte_ids: np.ndarray  # (256,)
    raw: list[bytes]  # what each id decodes to
    unknown: int
    unigram: bool
    prefix: bool

    def __post_init__(self):
        self.by_text = {t: k for k, t in enumerate(self.texts) if self.usable[k]}
        ids = np.array(sorted(self.by_text.values()), dtype=np.int64)
        keys = np.array([_hash(self.texts[k]) for k in ids], dtype=np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], ids[order]
        self.marked = np.zeros(1 << _MARKED, dtype=bool)
        self.marked[self.keys >> np.uint64(64 - _MARKED)] = True
        self.lengths = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.longest = int(self.lengths[ids].max(initial=1))
        self.spans = {t[k : k + 2] for t in self.by_text for k in range(len(t) - 1)}
        self.power = np.array([pow(_BASE, k, 1 << 64) for k in range(2 * self.longest + 2)], dtype=np.uint64)
        self.hash = np.zeros(len(self.texts), dtype=np.uint64)
        self.hash[self.key_ids] = self.keys
        if not self.unigram:
            self._replay()
        sizes = np.array([len(r) for r in self.raw], dtype=np.int64)
        self.raw_start, self.raw_size = np.cumsum(sizes) - sizes, sizes
        self.raw_bytes = np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        self.key = zlib.crc32(self.keys.tobytes() + self.scores.tobytes())

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("told_pairs", "told")}

    @classmethod
    def load(cls, path: str = MODEL) -> Model:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or m.trainer_spec.treat_whitespace_as_suffix or any(p.type == 4 for p in m.pieces):
            raise ValueError("only models with the identity normaliser, prefixed word marks and no user-defined pieces")
        texts = [p.piece for p in m.pieces]
        byte_ids = np.full(256, -1)
        raw = [b"" if p.type == 3 else p.piece.encode() for p in m.pieces]
        for k, p in enumerate(m.pieces):
            if p.type == 6:
                byte_ids[int(p.piece[3:5], 16)] = k
                raw[k] = bytes([int(p.piece[3:5], 16)])
        unknown = next((k for k, p in enumerate(m.pieces) if p.type == 2), 0)
        raw[unknown] = " ⁇ ".encode()
        usable = np.array([p.type == 1 for p in m.pieces])
        if any(re.search(f"[^{MARK}]{MARK}", t) for t, u in zip(texts, usable) if u):
            raise ValueError("a piece spans words")
        return cls(texts, np.array([p.score for p in m.pieces], dtype=np.float32), usable, byte_ids, raw, unknown, m.trainer_spec.model_type == 1, m.normalizer_spec.add_dummy_prefix)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids by hash, -1 where there is none. A bit map of the keys' high bits turns most others away."""
        out = np.full(len(h), -1, dtype=np.int64)
        maybe = np.flatnonzero(self.marked[h >> np.uint64(64 - _MARKED)])
        g = h[maybe]
        at = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
        out[maybe] = np.where(self.keys[at] == g, self.key_ids[at], -1)
        return out

    def merge(self, text: str, told: list | None = None) -> list[str]:
        """Merges by rank: the best score first, of equals the leftmost. told: gets (score, first, last) after each merge."""
        n, live = len(text), list(text)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) >= 0 and (k := self.by_text.get(live[i] + live[j])) is not None:
                heapq.heappush(queue, (-float(self.scores[k]), i, live[i] + live[j]))

        for i in range(n - 1):
            offer(i)
        last = n - 1
        while queue:
            score, i, joint = heapq.heappop(queue)
            if not live[i] or (j := after[i]) < 0 or live[i] + live[j] != joint:
                continue
            live[i], live[j], after[i] = joint, "", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            else:
                last = i
            if told is not None:
                told.append((-score, live[0], live[last]))
            offer(before[i])
            offer(i)
        return [s for s in live if s]

    def _replay(self) -> None:
        """For each piece the scores of the merges that make it, and its first and last part after each number of merges."""
        steps = self.longest + 1
        n = len(self.texts)
        self.step = np.full((n, steps), _NONE, dtype=np.float32)
        self.left, self.right = np.full((n, steps), -1, dtype=np.int32), np.full((n, steps), -1, dtype=np.int32)
        for text, k in self.by_text.items():
            told: list[tuple[float, str, str]] = []
            if self.merge(text, told) != [text]:
                self.usable[k] = False  # no merges lead to it
                continue
            for i, (score, _, _) in enumerate(told):
                self.step[k, i] = score
            for i, (a, b) in enumerate([(text[0], text[-1]), *((x, y) for _, x, y in told)]):
                self.left[k, i], self.right[k, i] = self.by_text.get(a, -1), self.by_text.get(b, -1)

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As ``replayed``; remembers answers in a table of fixed size."""
        if "told" not in self.__dict__:
            self.told_pairs, self.told = np.full(1 << _TOLD, -1, dtype=np.int64), np.zeros(1 << _TOLD, dtype=bool)
        pair = a * len(self.texts) + b
        slot = (pair.astype(np.uint64) * np.uint64(_BASE) >> np.uint64(64 - _TOLD)).astype(np.int64)
        new = np.flatnonzero(self.told_pairs[slot] != pair)
        out = self.told[slot]
        if len(new):
            some, at, back = np.unique(pair[new], return_index=True, return_inverse=True)
            ok = self.replayed(a[new][at], b[new][at])
            out[new] = ok[back]
            self.told_pairs[slot[new][at]], self.told[slot[new][at]] = some, ok
        return out

    def replayed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of a and b together gives a and b again."""
        ok = np.ones(len(a), dtype=bool)
        on, i, j = np.arange(len(a)), np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
        while len(on):
            x, y = a[on], b[on]
            r, l = self.right[x, i], self.left[y, j]
            joint = self.find(self.hash[r] * self.power[self.lengths[l]] + self.hash[l])
            cross = np.where((joint >= 0) & (r >= 0) & (l >= 0), self.scores[joint], _NONE)
            p, q = self.step[x, i], self.step[y, j]
            broken = (cross > p) & (cross >= q)
            ok[on[broken]] = False
            go = ~broken & ((p > _NONE) | (q > _NONE))
            first = p >= q
            on, i, j = on[go], (i + first)[go], (j + ~first)[go]
        return ok


class _Store:
    """Strings and their ids, in flat arrays that double when they are full."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(1 << 12, dtype=np.int32), np.zeros(1 << 10, dtype=np.int64), np.zeros(1 << 10, dtype=np.int32)
        self.used = 0

    def _room(self, name: str, n: int) -> np.ndarray:
        old = getattr(self, name)
        if len(old) < n:
            setattr(self, name, np.concatenate([old, np.zeros(max(n, 2 * len(old)) - len(old), dtype=old.dtype)]))
        return getattr(self, name)

    def add(self, names: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        n, more = len(self.at), len(names)
        self.at.update(zip(names, range(n, n + more)))
        self._room("start", n + more)[n : n + more] = self.used + np.cumsum(sizes) - sizes
        self._room("size", n + more)[n : n + more] = sizes
        self._room("flat", self.used + len(flat))[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def numbers(self, names: list[str]) -> np.ndarray:
        return np.fromiter(map(self.at.__getitem__, names), dtype=np.int64, count=len(names))

    def ids(self, k: np.ndarray) -> np.ndarray:
        size = self.size[k].astype(np.int64)
        return self.flat[np.arange(int(size.sum())) + np.repeat(self.start[k] - (np.cumsum(size) - size), size)]


class Encoder:
    """Encodes lists of texts; keeps the words and parts of words that it has seen, up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.known, self.parts = _Store(), _Store()

    def words(self, text: str) -> list[str]:
        return _WORDS.findall((MARK if self.model.prefix else "") + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known.at) > _WORDS_KEPT:
            self.known = _Store()
        if len(self.parts.at) > _PARTS_KEPT:
            self.parts = _Store()
        each, known = [self.words(t) for t in texts], self.known.at
        if new := list({w for words in each for w in words if w not in known}):
            self._learn(new)
        return [self.known.ids(self.known.numbers(words)) for words in each]

    def _learn(self, words: list[str]) -> None:
        """Cuts new words where no piece spans two neighbouring characters; parts of a length that are new go together."""
        spans, cuts, counts = self.model.spans, [], []
        for w in words:
            before, begin = len(cuts), 0
            for k in range(1, len(w)):
                if w[k - 1 : k + 1] not in spans:
                    cuts.append(w[begin:k])
                    begin = k
            cuts.append(w[begin:])
            counts.append(len(cuts) - before)
        by: dict[int, list[str]] = {}
        for p in {p for p in cuts if p not in self.parts.at}:
            by.setdefault(len(p), []).append(p)
        for length, some in sorted(by.items()):
            if length > _LONG:
                found = [self._alone(p) for p in some]
                self.parts.add(some, np.concatenate(found), np.array([len(x) for x in found], dtype=np.int64))
                continue
            n = max(1, min(8192, _CELLS // length))
            for k in range(0, len(some), n):
                self.parts.add(some[k : k + n], *self.viterbi(some[k : k + n]))
        k = self.parts.numbers(cuts)
        begin = np.cumsum(counts) - counts
        self.known.add(words, self.parts.ids(k), np.add.reduceat(self.parts.size[k], begin))

    def _bytes(self, char: str) -> list[int]:
        ids = [int(self.model.byte_ids[b]) for b in char.encode()]
        return ids if min(ids) >= 0 else [self.model.unknown]

    def _alone(self, text: str) -> np.ndarray:
        m = self.model
        if not m.unigram:
            return np.array([k for s in m.merge(text) for k in ([m.by_text[s]] if s in m.by_text else self._bytes(s))], dtype=np.int32)
        low = float(m.scores[m.key_ids].min()) - 10
        best, back = [0.0] + [_NONE] * len(text), [0] * (len(text) + 1)
        for i in range(1, len(text) + 1):
            for n in range(1, min(i, m.longest) + 1):
                k = m.by_text.get(text[i - n : i])
                score = m.scores[k] if k is not None else low if n == 1 else _NONE
                if best[i - n] + score > best[i]:
                    best[i], back[i] = best[i - n] + float(score), n
        out, i = [], len(text)
        while i:
            s = text[i - back[i] : i]
            out.append([m.by_text[s]] if s in m.by_text else self._bytes(s))
            i -= back[i]
        return np.array([k for x in reversed(out) for k in x], dtype=np.int32)

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, one after the other, and how many each word has."""
        m, n, length = self.model, len(words), len(words[0])
        code = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(n, length)
        sums = np.zeros((n, length + 1), dtype=np.uint64)
        for i in range(length):
            sums[:, i + 1] = sums[:, i] * np.uint64(_BASE) + code[:, i] + np.uint64(1)
        best = np.full((n, length + 1), _NONE)
        best[:, 0] = 0
        last = np.full((n, length + 1), -2, dtype=np.int64)  # the piece that ends here; -1: bytes; -2: none
        low = float(m.scores[m.key_ids].min()) - 10
        for i in range(1, length + 1):
            single = np.full(n, -1)
            for size in range(1, min(i, m.longest) + 1):
                piece = m.find(sums[:, i] - sums[:, i - size] * m.power[size])
                if size == 1:
                    single = piece
                fits = np.flatnonzero((piece >= 0) & m.usable[piece] & (last[:, i - size] > -2) if i > size else (piece >= 0) & m.usable[piece])
                if not len(fits):
                    continue
                if m.unigram:
                    score = best[fits, i - size] + m.scores[piece[fits]]
                else:
                    previous = last[fits, i - size] if i > size else np.full(len(fits), -1)
                    ok = previous < 0
                    ok[~ok] = m.stable(previous[~ok], piece[fits][~ok])
                    fits = fits[ok]
                    score = np.full(len(fits), float(size))
                better = score > best[fits, i]
                best[fits[better], i], last[fits[better], i] = score[better], piece[fits[better]]
            bare = np.flatnonzero(single < 0)
            if len(bare):
                score = best[bare, i - 1] + low if m.unigram else np.zeros(len(bare))
                better = score > best[bare, i]
                best[bare[better], i], last[bare[better], i] = score[better], -1
        at, steps = np.full(n, length), []
        while (on := np.flatnonzero(at > 0)).size:
            piece = last[on, at[on]]
            steps.append((on, at[on], piece))
            at[on] -= np.where(piece >= 0, m.lengths[piece], 1)
        row, end, piece = (np.concatenate(x) for x in zip(*steps))
        order = np.lexsort((end, row))
        row, end, piece = row[order], end[order], piece[order]
        bare = np.flatnonzero(piece < 0)
        if len(bare):
            raw = [self._bytes(words[r][e - 1]) for r, e in zip(row[bare].tolist(), end[bare].tolist())]
            times = np.ones(len(piece), dtype=np.int64)
            times[bare] = [len(x) for x in raw]
            row, piece = np.repeat(row, times), np.repeat(piece, times)
            piece[piece < 0] = np.concatenate([np.array(x) for x in raw])
        return piece.astype(np.int32), np.bincount(row, minlength=n)


def decode(model: Model, ids: np.ndarray) -> str:
    size = model.raw_size[ids]
    shift = np.cumsum(size) - size
    raw = model.raw_bytes[np.arange(int(size.sum())) + np.repeat(model.raw_start[ids] - shift, size)].tobytes()
    text = raw.decode("utf-8", errors="replace").replace(MARK, " ")
    return text[1:] if model.prefix and text[:1] == " " else text


_ENCODERS: dict[int, Encoder] = {}


def shared(key: int, sent) -> Encoder:
    """This worker's encoder for the broadcast model: there is one model, and what it has learnt serves later tasks too."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(sent.value)
    return _ENCODERS[key]


def _pieces_of(texts: list[str | None], piece: int = 1 << 21) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= piece:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_table(docs: DataFrame, text: str = "text", name: str = "ids", model_path: str = MODEL) -> DataFrame:
    """All columns of ``docs`` and the ids (array<int>) of every row's text. An older column of that name is replaced."""
    model = Model.load(model_path)
    key, sent = model.key, docs.sparkSession.sparkContext.broadcast(model)  # as large as the vocabulary
    keep = [c for c in docs.columns if c != name]
    flat = docs.select(docs[text].cast("string").alias("__text"), *[docs[c] for c in keep])
    schema = T.StructType([*flat.drop("__text").schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(key, sent)
        for batch in batches:
            at = 0
            for texts in _pieces_of(batch.column(0).to_pylist()):
                ids = encoder.encode(texts)
                cut = np.cumsum([0, *(len(x) for x in ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(ids)))
                part = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], lists], names=[*batch.schema.names[1:], name])

    return flat.mapInArrow(tidy(run), schema)


def decode_table(table: DataFrame, ids: str = "ids", name: str = "decoded", model_path: str = MODEL) -> DataFrame:
    """All columns of ``table`` and the text of the ids (null and empty ids: the empty text)."""
    sent = table.sparkSession.sparkContext.broadcast(Model.load(model_path))
    keep = [c for c in table.columns if c != name]
    flat = table.select(table[ids].alias("__ids"), *[table[c] for c in keep])
    schema = T.StructType([*flat.drop("__ids").schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = [decode(model, np.array(x or [], dtype=np.int64)) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*batch.schema.names[1:], name])

    return flat.mapInArrow(tidy(run), schema)


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model_path: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian int32), decoded_crc32 (of the UTF-8) and exact, by encoding
    and decoding every whole text."""
    model = Model.load(model_path)
    key, sent = model.key, docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(docs[text].cast("string").alias("text"), docs[doc_id].alias("doc_id"))
    schema = T.StructType([*narrow.drop("text").schema.fields, *T.StructType.fromDDL("n_pieces long, ids_crc32 long, decoded_crc32 long, exact boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(key, sent)
        for batch in batches:
            rows: list[tuple] = []
            for texts in _pieces_of(batch.column(0).to_pylist()):
                for t, ids in zip(texts, encoder.encode(texts)):
                    back = decode(encoder.model, ids)
                    rows.append((len(ids), zlib.crc32(ids.astype("<i4").tobytes()), zlib.crc32(back.encode()), back == t))
            n, a, b, same = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(same, pa.bool_())], names=[f.name for f in schema])

    return narrow.mapInArrow(tidy(run), schema)
