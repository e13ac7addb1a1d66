"""Near copies by SimHash and verified Jaccard similarity: the pipeline's near-duplicate stage.

A text is its set of shingles of ``words_each`` words. Rows with the same set are one node. The fingerprint of a node has 128
majority bits over the hashes of its shingles. At a Jaccard similarity of 0.8 a bit differs with probability 0.15: 19 of 128
expected, standard deviation 4. Population counts cannot tell such pairs apart from others among all fingerprints, so tiles
are named by minima: a node is in ``bands`` buckets, each named by ``rows`` minimum hashes of its shingles (a pair at 0.8 shares
one of 16 buckets of 4 with probability 0.9998). Within a bucket fingerprints are compared exactly, by exclusive-or and bit
counts, in tiles ordered by population count; tile pairs whose counts differ beyond ``radius`` are skipped. A link is a pair
found in this way whose sets have a Jaccard similarity of at least ``least``, counted exactly.

Nodes are joined as in Borůvka's algorithm: from each node its nearest candidate in another group is verified, and the one that
a hash of the round puts first. So a group of copies makes few pairs, never all of them. One such round goes over all buckets,
more over those that don't fit one tile, while they link. Then every bucket that still holds several groups is settled: the
sets of the nodes with candidates in other groups go to their tiles, and each pair of candidates that isn't linked by then is
verified there (``_settle``). No candidate is left out, and rows grow with nodes, not with pairs.

A bucket over ``tile_rows``, or ``tile_shingles`` in its sets, is cut into tiles by hash: in the first round each tile is for
itself; later all rows outside the bucket's largest group visit every tile. So no task holds an unbounded group, and nothing of
it goes to the driver. Verifying needs the sets of candidates only: a bit map of fixed size of their nodes filters the texts,
which aren't shuffled for it.

Defined cases: null and wordless texts have the empty set and are one node; texts below ``words_each`` words have one shingle;
an empty table gives an empty table; null and repeated ids, ties and columns of any names are allowed (see ``keep_one``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, tidy, utf8
from .components import components
from .decontaminate import _Powers, words_of


@dataclass(frozen=True)
class Plan:
    words_each: int = 5
    least: float = 0.8
    radius: int = 38
    bands: int = 16
    rows: int = 4
    tile_rows: int = 4096
    tile_shingles: int = 1 << 21


_MAP_BITS = 26  # of the bit map: 8 MB
_SMALL = 48  # buckets up to here are compared together


_INK = np.ones(256, dtype=bool)
_INK[0x20] = _INK[0x09:0x0E] = False
_POWERS = _Powers(0x5851F42D4C957F2F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(texts: list[bytes | None], words_each: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts as 64-bit hashes, text by text and sorted, and where each text's begin (and the last
    end): of neighbouring words (between white space, A-Z lower-cased)."""
    n, each = len(texts), words_each
    starts, _, words = words_of(b"\n".join(t or b"" for t in texts).lower(), _POWERS, _INK)
    first = np.searchsorted(starts, np.cumsum([0, *(len(t or b"") + 1 for t in texts)]))
    own = np.repeat(np.arange(n), np.diff(first))

    def joint(at: np.ndarray, each: int) -> np.ndarray:
        h = np.full(len(at), each, dtype=np.uint64)
        for k in range(each):
            h = (h ^ words[at + k]) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(32)
        return _mix(h)

    at = np.flatnonzero(own[each - 1 :] == own[: len(own) - each + 1]) if len(own) >= each else np.zeros(0, dtype=np.int64)
    hashes, texts_of = [joint(at, each)], [own[at]]
    for size in range(1, each):  # texts with fewer words have one shingle
        short = np.flatnonzero(np.diff(first) == size)
        hashes.append(joint(first[short], size))
        texts_of.append(short)
    h, own = np.concatenate(hashes), np.concatenate(texts_of)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.append(True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])) if len(h) else np.zeros(0, dtype=bool)
    return h[new], np.searchsorted(own[new], np.arange(n + 1))


def fingerprints(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(n, 2) 64-bit halves of the fingerprints of sets of shingles: majority bits of the hash and of a mix of it."""
    ones, sizes = np.zeros((len(first) - 1, 128), dtype=np.int64), np.diff(first)
    own = np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(found), 1 << 13):
        h = found[at : at + (1 << 13)]
        bits = np.unpackbits(np.stack([h, _mix(h ^ np.uint64(0xC2B2AE3D27D4EB4F))], axis=1).view(np.uint8), axis=1, bitorder="little")
        mine = own[at : at + (1 << 13)]
        begin = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
        ones[mine[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64)


def _salts(plan: Plan) -> np.ndarray:
    return np.random.default_rng(8).integers(1, 1 << 63, size=(2, plan.bands * plan.rows), dtype=np.uint64) | np.uint64(1)


def buckets(found: np.ndarray, first: np.ndarray, salts: np.ndarray, plan: Plan) -> np.ndarray:
    """(n, bands) names of the buckets of sets of shingles; those of the empty set mean nothing."""
    full = np.flatnonzero(np.diff(first))
    least = np.zeros((len(first) - 1, salts.shape[1]), dtype=np.uint64)
    if len(full):
        for k, (a, b) in enumerate(salts.T):
            least[full, k] = np.minimum.reduceat((found ^ a) * b, first[full])
    name = np.broadcast_to(np.arange(1, plan.bands + 1, dtype=np.uint64), (len(least), plan.bands))
    for k in range(plan.rows):
        name = _mix(name ^ least[:, k :: plan.rows])
    return name.view(np.int64)


def _groups(texts: list[bytes | None], size: int = 1 << 18) -> Iterator[list[bytes | None]]:
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t or b"") + 1
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def sketches(docs: DataFrame, text: str, plan: Plan) -> DataFrame:
    """``docs`` with node (the hash of the set of shingles), the halves fa and fb of the fingerprint, size (of the set) and
    bands (its buckets)."""
    plain, salts = docs.withColumn("__text", F.col(text).cast("string")), _salts(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            for texts in _groups(utf8(whole.column(len(whole.columns) - 1))):
                batch = whole.slice(at, len(texts))
                at += len(texts)
                found, first = shingles(texts, plan.words_each)
                nodes = [xxhash.xxh3_64_intdigest(found[a:b].tobytes()) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                fp, sizes = fingerprints(found, first).view(np.int64), np.diff(first)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(sizes, plan.bands, 0))).astype(np.int32)), pa.array(buckets(found, first, salts, plan)[sizes > 0].ravel()))
                more = [pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(fp[:, 0].copy()), pa.array(fp[:, 1].copy()), pa.array(sizes.astype(np.int32)), lists]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*batch.schema.names[:-1], "node", "fa", "fb", "size", "bands"])

    return plain.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, *T.StructType.fromDDL("node long, fa long, fb long, size int, bands array<long>").fields]))


_ROW = ("key", "tile", "guest", "node", "fa", "fb", "size", "label")


def _fits(plan: Plan, d, size_a, size_b, label_a, label_b):
    return (d <= plan.radius) & (label_a != label_b) & (np.minimum(size_a, size_b) >= plan.least * np.maximum(size_a, size_b) - 1e-9)


def _meet(plan: Plan, turn: int, all_rows: bool = False):
    """For each row of a tile the nearest candidate with another label, and the first by the round's hash: x, y, far, rank.
    With ``all_rows`` the rows themselves that have any candidate with another label.

    Rows come sorted by bucket and tile: ``_ROW``.
    """
    salt = np.uint64((turn + 1) * 0xBF58476D1CE4E5B9 % (1 << 64))

    def stir(d, key, x, y):
        """After the first round the order of candidates of similar distance varies, so that others are tried."""
        return d + ((_mix(key.view(np.uint64) ^ x ^ y ^ salt) & np.uint64(7)).astype(np.int16) if turn else 0)

    def those(rows, some):
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(v[some].view(np.int64) if v.dtype == np.uint64 else v[some]) for v in rows.values()], names=list(rows))

    def first(rows, x, y, key, d, rank):
        """Of the candidates (x, y) of every row its nearest, and its first by rank."""
        if not len(x):
            return
        node = rows["node"]
        d = stir(d, key, node[x].view(np.uint64), node[y].view(np.uint64))
        order = np.lexsort((node[y], d, x))
        near = order[np.append(True, x[order][1:] != x[order][:-1])]
        order = np.lexsort((node[y], rank[y], x))
        lead = order[np.append(True, x[order][1:] != x[order][:-1])]
        some = np.unique(np.concatenate([near, lead]))
        yield pa.RecordBatch.from_arrays([pa.array(node[x[some]]), pa.array(node[y[some]]), pa.array(d[some].astype(np.int32)), pa.array(rank[y[some]].view(np.int64))], names=["x", "y", "far", "rank"])

    def together(rows, number):
        """Small tiles, all at once: every row with the k-th row after it, as long as both are in the same tile."""
        fa, fb, size, label, guest, found = rows["fa"], rows["fb"], rows["size"], rows["label"], rows["guest"], []
        a, k = np.arange(len(number)), 0
        while len(a):
            k += 1
            a = a[a + k < len(number)]
            a = a[number[a] == number[a + k]]
            b = a + k
            d = (np.bitwise_count(fa[a] ^ fa[b]) + np.bitwise_count(fb[a] ^ fb[b])).astype(np.int16)
            good = _fits(plan, d, size[a], size[b], label[a], label[b]) & ~(guest[a] & guest[b])
            found.append((a[good], b[good], d[good]))
        x, y, d = (np.concatenate(z) for z in zip(*found)) if found else (a, a, a)
        if all_rows:
            return those(rows, np.unique(np.concatenate([x, y])))
        return first(rows, np.concatenate([x, y]), np.concatenate([y, x]), rows["key"][np.concatenate([x, y])], np.concatenate([d, d]), _mix(rows["node"].view(np.uint64) ^ salt))

    def blocks(rows):
        """One large tile: blocks of rows in the order of their population counts, each with the blocks in reach."""
        count = np.bitwise_count(rows["fa"]).astype(np.int16) + np.bitwise_count(rows["fb"])
        order = np.argsort(count, kind="stable")
        rows, count = {k: v[order] for k, v in rows.items()}, count[order]
        fa, fb, size, label, guest, node = (rows[k] for k in ("fa", "fb", "size", "label", "guest", "node"))
        rank = _mix(node.view(np.uint64) ^ salt)
        place = np.argsort(np.argsort(rank, kind="stable"), kind="stable")
        xs, ys, ds = [], [], []
        for s in range(0, len(node), 256):
            e = min(len(node), s + 256)
            lo, hi = np.searchsorted(count, count[s] - plan.radius), np.searchsorted(count, count[e - 1] + plan.radius, side="right")
            d = np.bitwise_count(fa[s:e, None] ^ fa[None, lo:hi]).astype(np.int16)
            d += np.bitwise_count(fb[s:e, None] ^ fb[None, lo:hi])
            good = _fits(plan, d, size[s:e, None], size[None, lo:hi], label[s:e, None], label[None, lo:hi]) & ~(guest[s:e, None] & guest[None, lo:hi])
            some, at = np.flatnonzero(good.any(axis=1)), np.arange(e - s)
            if all_rows:
                xs.append(some + s)
                continue
            noisy = stir(d, rows["key"][:1], node[s:e, None].view(np.uint64), node[None, lo:hi].view(np.uint64))
            far = np.where(good, noisy, 9999)
            for best in (far.argmin(axis=1), np.where(good, place[None, lo:hi], len(node)).argmin(axis=1)):
                fine = some[good[some, best[some]]]
                xs.append(fine + s), ys.append(best[fine] + lo), ds.append(d[at, best][fine])
        if all_rows:
            return those(rows, np.concatenate(xs))
        x, y, d = (np.concatenate(z) for z in (xs, ys, ds))
        return first(rows, x, y, rows["key"][x], d, rank)

    def settle(rows, number):
        """All tiles of a run of rows, each of them whole."""
        size = np.bincount(number)[number]
        small = size <= _SMALL
        yield from together({k: v[small] for k, v in rows.items()}, number[small])
        for t in np.unique(number[~small]):
            yield from blocks({k: v[number == t] for k, v in rows.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def ready(last: bool):
            """The whole tiles among what is held; the last one may go on."""
            rows = {k: np.concatenate([h[k] for h in held]) for k in _ROW}
            change = np.append(True, (rows["key"][1:] != rows["key"][:-1]) | (rows["tile"][1:] != rows["tile"][:-1]))
            number = np.cumsum(change) - 1
            cut = len(number) if last else int(np.flatnonzero(change)[-1])
            held[:] = [{k: v[cut:] for k, v in rows.items()}]
            if cut:
                some = {k: v[:cut] for k, v in rows.items()}
                some["fa"], some["fb"] = some["fa"].view(np.uint64), some["fb"].view(np.uint64)
                yield from settle(some, number[:cut])

        for batch in batches:
            if batch.num_rows:
                held.append({k: batch.column(k).to_numpy(zero_copy_only=False) for k in _ROW})
                if sum(len(h["key"]) for h in held) >= 1 << 16:
                    yield from ready(False)
        if held:
            yield from ready(True)

    return run


class _Tile:
    """The own rows of a tile with their sets; links of them and of visitors, without those that follow from other links."""

    def __init__(self, plan: Plan, rows: dict):
        self.plan, count = plan, np.bitwise_count(rows["fa"]).astype(np.int16) + np.bitwise_count(rows["fb"])
        order = np.argsort(count, kind="stable")
        self.count = count[order]
        self.node, self.fa, self.fb, self.size, self.label = (rows[k][order] for k in ("node", "fa", "fb", "size", "label"))
        self.first = np.append(0, np.cumsum(self.size.astype(np.int64)))
        self.known, self.ids = np.unique(np.concatenate([rows["members"][k] for k in order]), return_inverse=True)
        self.mark, self.moved = np.zeros(len(self.known), dtype=np.int64), {}

    def now(self, label: int) -> int:
        while label in self.moved:
            label = self.moved[label]
        return label

    def tried(self, node: int, label: int, size: int, ids: np.ndarray, others: np.ndarray) -> Iterator[tuple[int, int]]:
        """Verifies a row of ``size`` shingles, of which the tile knows ``ids``, against the own rows ``others``."""
        label = self.now(label)
        self.mark[ids] = 1
        part = np.cumsum(self.size[others].astype(np.int64)) >> 20  # some 8 MB at once
        for k in np.unique(part):
            some = others[part == k]
            some = some[self.label[some] != label]
            if not len(some):
                continue
            sizes = self.size[some].astype(np.int64)
            begin = np.append(0, np.cumsum(sizes)[:-1])
            at = np.arange(int(sizes.sum())) + np.repeat(self.first[some] - begin, sizes)
            both = np.add.reduceat(self.mark[self.ids[at]], begin)
            for y in some[both >= self.plan.least * (size + sizes - both) - 1e-9].tolist():
                old = int(self.label[y])
                if old != label:
                    yield node, int(self.node[y])
                    self.moved[old] = label
                    self.label[self.label == old] = label
        self.mark[ids] = 0

    def within(self) -> Iterator[tuple[int, int]]:
        for s in range(0, len(self.node), 256):
            e = min(len(self.node), s + 256)
            hi = np.searchsorted(self.count, self.count[e - 1] + self.plan.radius, side="right")
            d = np.bitwise_count(self.fa[s:e, None] ^ self.fa[None, s:hi]).astype(np.int16)
            d += np.bitwise_count(self.fb[s:e, None] ^ self.fb[None, s:hi])
            good = _fits(self.plan, d, self.size[s:e, None], self.size[None, s:hi], self.label[s:e, None], self.label[None, s:hi])
            for k in np.flatnonzero(good.any(axis=1)):
                x = s + k
                yield from self.tried(int(self.node[x]), int(self.label[x]), int(self.size[x]), self.ids[self.first[x] : self.first[x + 1]], x + 1 + np.flatnonzero(good[k, k + 1 :]))

    def visit(self, rows: dict) -> Iterator[tuple[int, int]]:
        for k in range(len(rows["node"])):
            d = np.bitwise_count(self.fa ^ rows["fa"][k]).astype(np.int16) + np.bitwise_count(self.fb ^ rows["fb"][k])
            others = np.flatnonzero(_fits(self.plan, d, self.size, rows["size"][k], self.label, self.now(int(rows["label"][k]))))
            if len(others):
                members = rows["members"][k]
                at = np.minimum(np.searchsorted(self.known, members), len(self.known) - 1)
                yield from self.tried(int(rows["node"][k]), int(rows["label"][k]), int(rows["size"][k]), at[self.known[at] == members], others)


def _settle(plan: Plan):
    """Links (u, v) after which every candidate pair of a tile is linked or has been verified and failed.

    Rows come sorted by bucket, tile and guest: ``_ROW`` and members. Own rows are held, visitors pass by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, tile = None, [], None

        def batch_of(found: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            if pairs := list(found):
                u, v = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        def full() -> _Tile:
            return _Tile(plan, {k: [m for h in own for m in h[k]] if k == "members" else np.concatenate([h[k] for h in own]) for k in own[0]})

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in _ROW}
            rows["fa"], rows["fb"] = rows["fa"].view(np.uint64), rows["fb"].view(np.uint64)
            rows["members"] = [np.frombuffer(m, dtype=np.uint64) for m in batch.column("members").to_pylist()]
            change = np.flatnonzero((rows["key"][1:] != rows["key"][:-1]) | (rows["tile"][1:] != rows["tile"][:-1])) + 1
            for s, e in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                if (here := (rows["key"][s], rows["tile"][s])) != at:
                    if own and tile is None:
                        yield from batch_of(full().within())
                    at, own, tile = here, [], None
                mid = s + int(np.count_nonzero(~rows["guest"][s:e]))
                if mid > s:
                    own.append({k: v[s:mid] for k, v in rows.items()})
                if mid < e and own:
                    if tile is None:
                        tile = full()
                        yield from batch_of(tile.within())
                    yield from batch_of(tile.visit({k: v[mid:e] for k, v in rows.items()}))
        if own and tile is None:
            yield from batch_of(full().within())

    return run


def _dealt(state: DataFrame, scratch: Scratch, plan: Plan, turn: int, large: bool = False) -> tuple[DataFrame, DataFrame]:
    """Every node in the tiles of its buckets, and what is known of these buckets; only buckets of several labels, and if
    ``large`` of several tiles."""
    each = state.select("node", "fa", "fb", "size", "label", F.explode("bands").alias("key"))
    shingles = F.sum(F.col("size").cast("long")).alias("s")
    if turn:
        known = each.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), shingles).groupBy("key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("labels"), F.max_by("label", "n").alias("main")).where("labels > 1")
    else:
        known = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), shingles).where("n > 1").withColumn("main", F.lit(None).cast("long"))
    tiles = F.ceil(F.greatest(F.col("n") / plan.tile_rows, F.col("s") / plan.tile_shingles)).cast("int").alias("tiles")
    known = known.select(F.col("key").alias("k"), tiles, "main")
    known = scratch.save(known.where("tiles > 1") if large else known)
    own = F.pmod(F.xxhash64("node", F.lit(turn)), F.col("tiles")).cast("int")
    visits = F.when(F.col("main").isNotNull() & (F.col("label") != F.col("main")) & (F.col("tiles") > 1), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("own"))
    placed = each.join(known, F.col("key") == F.col("k")).withColumn("own", own)
    dealt = placed.select("key", F.explode(visits).alias("tile"), "own", "node", "fa", "fb", "size", "label")
    return dealt.select("key", "tile", (F.col("tile") != F.col("own")).alias("guest"), "node", "fa", "fb", "size", "label"), known


def _sets(texts: DataFrame, nodes: DataFrame, scratch: Scratch, plan: Plan) -> DataFrame:
    """(node, members): the sets of at least all ``nodes`` as sorted 64-bit hashes, from texts (node, text)."""
    at = F.shiftrightunsigned(F.xxhash64("node"), 64 - _MAP_BITS)
    parts = nodes.select((at + 1).alias("b"))  # these functions number bits from 1
    parts = parts.groupBy(F.bitmap_bucket_number("b").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).toArrow()
    bits = np.zeros((1 << _MAP_BITS) // 8, dtype=np.uint8)  # at most 8 MB come to the driver and are sent out, however many nodes
    for part, some in zip(parts.column("part").to_pylist(), parts.column("bits").to_pylist()):
        bits[(part - 1) * 4096 : part * 4096] = np.frombuffer(some, dtype=np.uint8)
    sent = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for batch in batches:
            place = batch.column(2).to_numpy(zero_copy_only=False)
            some = batch.filter(pa.array((wanted[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1))
            nodes, at = some.column(0), 0
            for few in _groups(utf8(some.column(1))):
                found, first = shingles(few, plan.words_each)
                sets = [found[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([nodes.slice(at, len(few)), pa.array(sets, pa.binary())], names=["node", "members"])
                at += len(few)

    named = texts.select("node", "text", at.alias("at")).mapInArrow(tidy(run), "node long, members binary")
    return scratch.save(named.groupBy("node").agg(F.first("members").alias("members")))


def _verify(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                for x, y in zip(some.column(2).to_pylist(), some.column(3).to_pylist()):
                    a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    good.append(both >= plan.least * (len(a) + len(b) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["u", "v", "good"])

    return run


def links(nodes: DataFrame, texts: DataFrame, scratch: Scratch, plan: Plan = Plan()) -> DataFrame:
    """(node, root) of every node that has a link. nodes: node, fa, fb, size, bands; texts: node, text."""
    state, found, sets, turn = nodes.withColumn("label", F.col("node")), None, None, 0

    def linked(more: DataFrame) -> None:
        nonlocal found, state
        found = more if found is None else found.union(more)
        label = scratch.save(components(found, scratch).toDF("n", "root"))
        state = scratch.save(nodes.join(label, F.col("node") == F.col("n"), "left").withColumn("label", F.coalesce("root", "node")).drop("n", "root"))

    while True:
        dealt, known = _dealt(state, scratch, plan, turn, large=turn > 0)
        if known.isEmpty():
            break
        if sets is None:
            wanted = state.select("node", F.explode("bands").alias("key")).join(known, F.col("key") == F.col("k"), "left_semi").select("node").distinct()
            wanted = scratch.save(wanted)
            sets = _sets(texts, wanted, scratch, plan)
        met = dealt.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(tidy(_meet(plan, turn)), "x long, y long, far int, rank long")
        pair = met.withColumns({"u": F.least("x", "y"), "v": F.greatest("x", "y")})
        best = pair.groupBy("x").agg(F.min(F.struct("far", "u", "v")).alias("near"), F.min(F.struct("rank", "u", "v")).alias("lead"))
        best = best.select(F.explode(F.array(F.struct("near.u", "near.v"), F.struct("lead.u", "lead.v"))).alias("p"))
        pairs = scratch.save(best.select(F.col("p.u").alias("u"), F.col("p.v").alias("v")).distinct())
        a, b = sets.toDF("u", "x"), sets.toDF("v", "y")
        checked = scratch.save(pairs.join(a, "u").join(b, "v").select("u", "v", "x", "y").mapInArrow(tidy(_verify(plan)), "u long, v long, good boolean"))
        n, n_good = checked.agg(F.count(F.lit(1)), F.count_if("good")).first()
        scratch.drop(known, pairs)
        if not turn:
            nodes = scratch.save(nodes.join(wanted, "node", "left_semi"))  # all others share no bucket with any node
            state = nodes.withColumn("label", F.col("node"))
        turn += 1
        if n_good:
            linked(checked.where("good").select("u", "v"))
        if 20 * n_good < n or not n:  # only a matter of time: what is left is settled below
            break
    if sets is not None:
        dealt, known = _dealt(state, scratch, plan, turn)
        apart = dealt.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(tidy(_meet(plan, turn, all_rows=True)), dealt.schema)
        last = apart.join(sets, "node").select(*_ROW, "members").repartition("key", "tile").sortWithinPartitions("key", "tile", "guest")
        last = scratch.save(last.mapInArrow(tidy(_settle(plan)), "u long, v long"))
        scratch.drop(known)
        if not last.isEmpty():
            found = last if found is None else found.union(last)
    if found is None:
        return nodes.select("node", F.col("node").alias("root")).where(F.lit(False))
    return components(found, scratch)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plan: Plan = Plan()) -> DataFrame:
    """``docs`` with one row of each group of linked texts: the one with the smallest id (nulls last), the first of equal ids."""
    scratch = Scratch(docs.sparkSession)
    columns = docs.columns
    flat = docs.toDF(*[f"c{k}" for k in range(len(columns))])
    at = {c: f"c{k}" for k, c in enumerate(columns)}
    wide = scratch.save(sketches(flat, at[text], plan).withColumn("row", F.monotonically_increasing_id()))
    rank = F.struct(F.col(at[doc_id]).isNull().alias("a"), F.col(at[doc_id]).alias("b"), F.col("row").alias("c"))
    each = scratch.save(wide.groupBy("node").agg(F.first("fa").alias("fa"), F.first("fb").alias("fb"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.min(rank).alias("own")))
    texts = wide.select("node", F.col(at[text]).cast("string").alias("text"))
    roots = links(each.drop("own"), texts, scratch, plan)
    best = each.select("node", "own").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("r")).agg(F.min("own").alias("best"))
    kept = scratch.save(best.select(F.col("best.c").alias("row")))
    # kept rows grow with the corpus, so they are never broadcast: the texts are shuffled once at every size
    return wide.join(kept.hint("merge"), "row", "left_semi").select(*[F.col(at[c]).alias(c) for c in columns])
