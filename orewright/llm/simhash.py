"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: 64 majority bits over the XXH64 (seed 42) of every word shingle. Links: every pair of distinct
fingerprints at most ``radius`` bits apart, found exactly. Tiles hold fingerprints with equal population counts in
each of four 16-bit blocks; two tiles can only hold a link if their counts differ by at most the radius in sum, so all
other tile pairs are skipped. Within a tile pair numpy compares blocks with exclusive-or and bit counts. Tiles above
``tile_rows`` are cut by hash and met piece by piece, and the visitors of a tile are dealt over parts of ``guest_rows``, so no
group has an unbounded number of rows. Each task returns a spanning forest of its links, never all pairs of a group. The work is
that of the method: visits grow with the number of tiles, a group of 65,536 from some 40 million distinct fingerprints on.

Defined cases: a null or wordless text has fingerprint zero and links with its like; equal fingerprints are one node
whatever their number; null ids take part, and a component's id is the smallest id that isn't null (null if there is
none); repeated rows are copies. Columns besides the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, Scratch, pick, tidy, utf8
from .components import components

BLOCKS, BITS = 4, 16
BASE = BITS + 1
CELLS = BASE**BLOCKS
_PIECE = 1 << 16


def fingerprint(text: bytes | None, words_each: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, unsigned."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    each = min(words_each, len(words))
    n = len(words) - each + 1
    starts, ends = starts[:n], ends[each - 1 :]
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _PIECE):
        s, e = starts[at : at + _PIECE].tolist(), ends[at : at + _PIECE].tolist()
        h = np.fromiter((digest(joined[i:j], seed) for i, j in zip(s, e)), dtype=np.uint64, count=len(s))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, words_each: int = 3, name: str = "fp") -> DataFrame:
    """The ``keep`` columns of ``docs`` and the fingerprint (long, two's complement) of every row; a column of its name goes."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    narrow = docs.select(docs[text].cast("string").alias("__text"), *[docs[c] for c in keep])
    schema = docs.select(*[docs[c] for c in keep]).schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words_each) for t in utf8(batch.column(0))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found.view(np.int64))], names=[*batch.schema.names[1:], name])

    return narrow.mapInArrow(tidy(run), schema)


def cells_of(fp: np.ndarray) -> np.ndarray:
    """(n, 4) population counts of the 16-bit blocks."""
    return np.bitwise_count(np.ascontiguousarray(fp).view(np.uint16).reshape(-1, BLOCKS)).astype(np.int64)


_POWERS = BASE ** np.arange(BLOCKS, dtype=np.int64)


def _mix(fp: np.ndarray) -> np.ndarray:
    x = fp.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _key(cell: np.ndarray, tile: np.ndarray, part: np.ndarray) -> np.ndarray:
    return (cell << 24 | tile) << 20 | part


def _deal(sizes: np.ndarray, radius: int, tile_rows: int, guest_rows: int):
    """Sends every fingerprint to its own tile (home) and, as a visitor, to each tile it could have a link in."""
    guests = np.zeros(CELLS, dtype=np.int64)
    counts_of = np.stack([np.arange(CELLS) // p % BASE for p in _POWERS], axis=1)
    steps = [d for d in product(range(-radius, radius + 1), repeat=BLOCKS) if sum(map(abs, d)) <= radius and np.dot(d, _POWERS) > 0]
    tiles = np.maximum(1, -(-sizes // tile_rows)).astype(np.int64)
    for d in steps:
        moved = counts_of + np.array(d)
        fits = ((moved >= 0) & (moved <= BITS)).all(axis=1)
        np.add.at(guests, moved[fits] @ _POWERS, sizes[fits])
    guests += np.where(tiles > 1, sizes, 0)
    parts = np.maximum(1, -(-guests // guest_rows)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            counts = cells_of(fp)
            cell = counts @ _POWERS
            mixed = _mix(fp)
            own = (mixed % tiles[cell].astype(np.uint64)).astype(np.int64)
            at = np.repeat(np.arange(len(fp)), parts[cell])  # home rows are in every part
            nth = np.arange(len(at)) - np.repeat(np.cumsum(parts[cell]) - parts[cell], parts[cell])
            keys, guests, values = [_key(cell[at], own[at], nth)], [np.zeros(len(at), dtype=bool)], [fp[at]]

            def visit(to: np.ndarray, first: np.ndarray, who: np.ndarray) -> None:
                n = tiles[to] - first
                rows = np.repeat(np.arange(len(to)), n)
                nth = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
                part = (_mix(who[rows] ^ 0x5851F42D) >> np.uint64(7)) % parts[to[rows]].astype(np.uint64)
                keys.append(_key(to[rows], first[rows] + nth, part.astype(np.int64)))
                guests.append(np.ones(len(rows), dtype=bool))
                values.append(who[rows])

            many = tiles[cell] > 1
            if many.any():
                visit(cell[many], own[many] + 1, fp[many])
            for d in steps:
                moved = counts + np.array(d)
                fits = ((moved >= 0) & (moved <= BITS)).all(axis=1)
                to = moved[fits] @ _POWERS
                lived = sizes[to] > 0
                visit(to[lived], np.zeros(int(lived.sum()), dtype=np.int64), fp[fits][lived])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(guests)), pa.array(np.concatenate(values))], names=["key", "guest", "fp"])

    return run


def _meet(radius: int):
    """Compares each tile's home rows with one another and with its visitors; rows come sorted by key, home rows first."""

    def links(forest: Forest, a: np.ndarray, b: np.ndarray, shift: int, inner: bool):
        rows = max(1, (1 << 22) // max(1, len(b)))
        for at in range(0, len(a), rows):
            near = np.bitwise_count(a[at : at + rows, None] ^ b[None, :]) <= radius
            i, j = np.nonzero(near)
            i = i + at
            if inner:
                i, j = i[i < j], j[i < j]
            yield forest.link(i, j + shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home, met, labels = None, [], False, None

        def out(found, nodes):
            high, low = (np.concatenate(x) for x in zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(nodes[high].view(np.int64)), pa.array(nodes[low].view(np.int64))], names=["u", "v"])

        def settle():
            """All home rows of the tile are here."""
            nonlocal home, met, labels
            met = True
            home = np.concatenate(home) if home else np.zeros(0, dtype=np.uint64)
            forest = Forest(np.arange(len(home)))
            found = list(links(forest, home, home, 0, True)) if len(home) > 1 and not key & (1 << 20) - 1 else []  # once, in part 0
            labels = forest.labels
            return [out(found, home)] if found else []

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            guest = batch.column(1).to_numpy(zero_copy_only=False)
            fp = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (guest[1:] != guest[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if s == e:
                    continue
                if keys[s] != key:
                    if key is not None and not met:
                        yield from settle()
                    key, home, met = keys[s], [], False
                if not guest[s]:
                    home.append(fp[s:e])
                    continue
                if not met:
                    yield from settle()
                if len(home):
                    forest = Forest(np.concatenate([labels, np.arange(len(home), len(home) + e - s)]))
                    found = list(links(forest, home, fp[s:e], len(home), False))
                    labels = forest.labels[: len(home)]
                    if any(len(h) for h, _ in found):
                        yield out(found, np.concatenate([home, fp[s:e]]))
        if key is not None and not met:
            yield from settle()

    return run


def link_fingerprints(fps: DataFrame, scratch: Scratch, radius: int = 2, tile_rows: int = 1 << 16, guest_rows: int = 1 << 19) -> DataFrame:
    """(fp, root) for every distinct fingerprint of ``fps`` (column fp, distinct) that has a link."""
    cell = sum((F.bit_count(F.shiftrightunsigned("fp", BITS * k).bitwiseAND(F.lit((1 << BITS) - 1))) * int(_POWERS[k]) for k in range(BLOCKS)), F.lit(0))
    sizes = np.zeros(CELLS, dtype=np.int64)
    for c, n in fps.groupBy(cell.alias("cell")).count().collect():  # at most 17 ** 4 rows, whatever the input
        sizes[c] = n
    dealt = fps.select("fp").mapInArrow(_deal(sizes, radius, tile_rows, guest_rows), "key long, guest boolean, fp long")
    met = dealt.repartition("key").sortWithinPartitions("key", "guest").mapInArrow(tidy(_meet(radius)), "u long, v long")
    return components(met, scratch).toDF("fp", "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_each: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp (long) and component_id of every row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    table = scratch.save(fingerprints(pick(docs, doc_id=doc_id, text=text), keep=["doc_id"], words_each=words_each))
    return _named(table, scratch, F.min("doc_id"), radius, "component_id")


def _named(table: DataFrame, scratch: Scratch, least, radius: int, name: str) -> DataFrame:
    """``table`` (with fp) and the least value of ``least`` over each row's component."""
    each = scratch.save(table.groupBy("fp").agg(least.alias("own")))
    roots = link_fingerprints(each, scratch, radius)
    linked = scratch.save(each.join(roots, "fp"))
    best = scratch.save(linked.groupBy("root").agg(F.min("own").alias("best")))  # a root with many rows can then be split
    told = linked.join(best, "root").select("fp", "best")
    names = scratch.save(each.join(told, "fp", "left").select(F.col("fp").alias("__fp"), F.coalesce("best", "own").alias(name)))
    return table.join(names, F.col("fp") == F.col("__fp")).drop("__fp")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_each: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (nulls last), the first of equal ids."""
    scratch = Scratch(docs.sparkSession)
    columns = docs.columns
    flat = docs.toDF(*[f"c{k}" for k in range(len(columns))])
    at = {c: f"c{k}" for k, c in enumerate(columns)}
    wide = scratch.save(fingerprints(flat, text=at[text], words_each=words_each).withColumn("row", F.monotonically_increasing_id()))
    table = wide.select("fp", F.struct(F.col(at[doc_id]).isNull().alias("a"), F.col(at[doc_id]).alias("b"), F.col("row").alias("c")).alias("rank"))
    each = scratch.save(table.groupBy("fp").agg(F.min("rank").alias("own")))
    roots = link_fingerprints(each, scratch, radius)
    best = each.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("r"), F.col("root").isNull().alias("single")).agg(F.min("own").alias("best"))
    kept = scratch.save(best.select(F.col("best.c").alias("row")))
    # kept rows grow with the corpus, so they are never broadcast
    return wide.join(kept.hint("merge"), "row", "left_semi").select(*[F.col(at[c]).alias(c) for c in columns])
