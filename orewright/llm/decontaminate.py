"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of every benchmark item (the whole item where it is shorter).
Texts become arrays of word numbers: bytes are classed with a lookup table, words hashed by prefix sums, and hashes
looked up in the benchmark's vocabulary. Patterns of each length have a table of the shift that every two-word block
allows, so most positions are skipped; where the shift is nought, the hash of the last words picks a bucket, and the
words are compared one by one, then as bytes. All documents of a piece are searched together: the word stream is cut
into lanes that advance in step.

The benchmark is broadcast in blocks of at most ``block_bytes`` of text. One block is the usual case; more blocks are
searched in one pass each over the documents and their hits united, so its size has no limit.

Defined cases: a null or wordless text has no words and no hits; a null, empty or wordless item has no windows; an item
with a null id marks words but isn't counted or listed; repeated item ids count once; repeated documents are each
reported; a long text is searched whole, in memory of about twenty times its bytes. Other columns are ignored by ``contamination`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, pick, tidy, utf8

_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_PIECE, _BLOCK = 1 << 20, 1 << 17
_LANE = 192
_TABLE = 1 << 18


class _Powers:
    """base ** i and its inverse modulo 2 ** 64, as far as needed."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), None, None

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.up is None or len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, base, dtype=np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x))
        return self.up[:n], self.down[:n]


def words_of(raw: bytes, powers: _Powers, of: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of lower-cased bytes; ``of`` tells the bytes that words are made of."""
    data = np.frombuffer(raw, dtype=np.uint8)
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0, dtype=np.uint64)
    mask = np.zeros(len(data) + 2, dtype=np.int8)
    mask[1:-1] = of[data]
    edge = np.diff(mask)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h, at = np.empty(len(starts), dtype=np.uint64), 0
    while at < len(starts):  # as many words as lie in a block, one at least
        begin = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, begin + _BLOCK, side="right")))
        part = data[begin : ends[to - 1]]
        up, down = powers.to(len(part))
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        h[at:to] = (sums[ends[at:to] - begin] - sums[starts[at:to] - begin]) * down[starts[at:to] - begin]
        at = to
    return starts, ends, h ^ (h >> np.uint64(32))


class _Tables:
    """Wu-Manber tables for patterns of one length."""

    def __init__(self, patterns: np.ndarray, numbers: np.ndarray):
        self.length = patterns.shape[1]
        self.block, self.suffix = min(2, self.length), min(4, self.length)
        self.shift = np.full(_TABLE, self.length - self.block + 1, dtype=np.int64)
        for end in range(self.block - 1, self.length):
            np.minimum.at(self.shift, self._block_hash(patterns, end), self.length - 1 - end)
        key = self._suffix_hash(patterns)
        order = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[order], return_index=True)
        self.first = np.append(first, len(key))
        self.patterns, self.numbers = patterns[order], numbers[order]

    def _block_hash(self, rows: np.ndarray, end: int) -> np.ndarray:
        h = rows[:, end].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if self.block == 2:
            h ^= (rows[:, end - 1].astype(np.uint64) + np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (h >> np.uint64(46)).astype(np.int64)

    def _suffix_hash(self, rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), dtype=np.uint64)
        for k in range(self.length - self.suffix, self.length):
            h = (h ^ rows[:, k].astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(28)
        return h

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start positions and pattern numbers of all occurrences."""
        none = np.zeros(0, dtype=np.int64)
        if len(words) < self.length:
            return none, none
        at = np.arange(self.length - 1, len(words), _LANE)
        stop = np.minimum(at + _LANE, len(words))
        found = []
        while len(at):
            h = words[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            if self.block == 2:
                h ^= (words[at - 1].astype(np.uint64) + np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)
            step = self.shift[(h >> np.uint64(46)).astype(np.int64)]
            if (hit := at[step == 0]).size:
                found.append(hit)
            at = at + np.maximum(step, 1)
            if not (on := at < stop).all():
                at, stop = at[on], stop[on]
        if not found:
            return none, none
        starts = np.concatenate(found) - (self.length - 1)
        rows = words[starts[:, None] + np.arange(self.length)]
        key = self._suffix_hash(rows)
        bucket = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        fits = self.keys[bucket] == key
        starts, rows, bucket = starts[fits], rows[fits], bucket[fits]
        hits, numbers, nth = [none], [none], 0
        while len(starts):
            pattern = self.first[bucket] + nth
            same = (rows == self.patterns[pattern]).all(axis=1)
            hits.append(starts[same])
            numbers.append(self.numbers[pattern[same]])
            nth += 1
            more = self.first[bucket] + nth < self.first[bucket + 1]
            starts, rows, bucket = starts[more], rows[more], bucket[more]
        return np.concatenate(hits), np.concatenate(numbers)


class Patterns:
    """All windows of a list of (item_id, text): made on the driver, sent to the workers."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = 10):
        split = [(item, [w for w in bytes(b if _WORD[b] else 32 for b in text.lower()).split()]) for item, text in items]
        self.words = sorted({w for _, words in split for w in words})
        self.base, hashes = 0x5851F42D4C957F2D, None
        while hashes is None or len(np.unique(hashes)) < len(self.words):
            self.base += 2
            hashes = words_of(b" ".join(self.words), _Powers(self.base))[2]
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], (order + 1).astype(np.int32)
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        number = {w: k + 1 for k, w in enumerate(self.words)}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, words in split:
            ids = [number[w] for w in words]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[k : k + window]), set()).update([] if item is None else [item])
        self.owners = [sorted(x) for x in owners.values()]
        self.windows = list(owners)
        self.tables = []
        for length in sorted({len(p) for p in self.windows}):
            mine = [k for k, p in enumerate(self.windows) if len(p) == length]
            self.tables.append(_Tables(np.array([self.windows[k] for k in mine], dtype=np.int32), np.array(mine)))

    def numbers_of(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), dtype=np.int32)
        if len(self.hashes):
            maybe = np.flatnonzero(self.seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            out[maybe] = np.where(self.hashes[at] == h[maybe], self.number[at], 0)
        return out

    def scan(self, texts: list[bytes], powers: _Powers) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each text its word count, the hit word positions, and the numbers of the patterns found."""
        raw = b"\x00".join(texts).lower()
        starts, ends, h = words_of(raw, powers)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        first = np.searchsorted(starts, bounds)  # of each text, in words
        words = np.zeros(len(starts) + len(texts), dtype=np.int32)  # a nought between texts
        text_of = np.repeat(np.arange(len(texts)), np.diff(first))
        place = np.arange(len(starts)) + text_of
        words[place] = self.numbers_of(h)
        hits, numbers = (np.concatenate(x) for x in zip(*(t.search(words) for t in self.tables))) if self.tables else (np.zeros(0, int), np.zeros(0, int))
        own = np.searchsorted(first + np.arange(len(first)), hits, side="right") - 1
        lengths = np.array([len(w) for w in self.windows], dtype=np.int64)
        out, by = [], np.argsort(own, kind="stable")
        cut = np.searchsorted(own[by], np.arange(len(texts) + 1))
        for k in range(len(texts)):
            mine = by[cut[k] : cut[k + 1]]
            n = int(first[k + 1] - first[k])
            cover = np.zeros(n + 1, dtype=np.int64)
            told = []
            for start, number in zip((hits[mine] - k).tolist(), numbers[mine].tolist()):
                if all(raw[starts[start + i] : ends[start + i]] == self.words[w - 1] for i, w in enumerate(self.windows[number])):
                    told.append(number)
                    cover[start - first[k]] += 1
                    cover[start - first[k] + lengths[number]] -= 1
            out.append((n, np.flatnonzero(np.cumsum(cover)[:n] > 0), np.unique(np.array(told, dtype=np.int64))))
        return out


def _searcher(patterns: Patterns, full: bool):
    """full: also gives the hit positions, for union with other blocks."""

    def pieces(column) -> Iterator[list[bytes]]:
        held, size = [], 0
        for t in utf8(column):
            held.append(t or b"")
            size += len(held[-1])
            if size >= _PIECE:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers(patterns.base)
        for batch in batches:
            n, hit, items, where = [], [], [], []
            for texts in pieces(batch.column(0)):
                for words, places, found in patterns.scan(texts, powers):
                    n.append(words)
                    hit.append(len(places))
                    items.append(sorted({i for p in found.tolist() for i in patterns.owners[p]}))
                    where.append(places.tolist() if full else None)
            arrays = [*batch.columns[1:], pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(where, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[1:], "n_words", "n_hit", "items", "places"])

    return run


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    held, size = [], 0
    for item, words in pick(benchmark, item=item_id, text=text).select(F.col("item").cast("string"), F.col("text").cast("string")).toLocalIterator():
        if words:
            held.append((item, words.encode()))
            size += len(held[-1][1])
            if size >= block_bytes:
                yield held
                held, size = [], 0
    if held:
        yield held


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """The ``keep`` columns of every row, and n_words, n_hit and items (sorted ids of the items found), which replace older
    columns of these names."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "n_hit", "items", "places")]
    wide = docs.select(docs[text].cast("string").alias("__text"), *[docs[c] for c in keep])
    kinds = "n_words long, n_hit long, items array<string>, places array<long>"
    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    one, two = next(blocks, []), next(blocks, None)
    if two is None:
        schema = T.StructType([*wide.drop("__text").schema.fields, *T.StructType.fromDDL(kinds).fields])
        return wide.mapInArrow(tidy(_searcher(Patterns(one, window), False)), schema).drop("places")
    scratch = Scratch(docs.sparkSession)
    base = scratch.save(wide.withColumn("__row", F.monotonically_increasing_id()))
    parts = None
    for block in [one, two, *blocks]:
        narrow = base.select("__text", "__row")
        part = scratch.save(narrow.mapInArrow(tidy(_searcher(Patterns(block, window), True)), f"__row long, {kinds}"))
        parts = part if parts is None else parts.union(part)
    united = parts.groupBy("__row").agg(F.max("n_words").alias("n_words"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return base.drop("__text").join(united, "__row").drop("__row")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    found = mark(pick(docs, doc_id=doc_id, text=text), benchmark, keep=["doc_id"], **how)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window."""
    columns = docs.columns
    flat = docs.toDF(*[f"c{k}" for k in range(len(columns))])
    found = mark(flat, benchmark, text=f"c{columns.index(text)}", **how)
    return found.where("n_hit = 0").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)])
