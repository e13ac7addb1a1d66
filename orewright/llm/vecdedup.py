"""Embedding near-duplicates over a robust-pruned flat graph.

1. Vectors that are null, zero or hold null or non-finite parts link with nothing. Equal vectors become one node with a
   count, before anything is compared.
2. Centroids are fitted on a sample; every vector joins the ``overlap`` nearest of about n * overlap / shard_rows cluster
   shards (``max_shards`` at most: beyond that shards get larger). Many centroids are looked up over two levels. A shard
   over ``split_rows`` is cut into pieces by hash, which are met two by two in exact blocks.
3. Each shard builds a graph of its own: nearest candidates, robust pruning to ``degree`` edges, reverse edges. The
   adjacency lists of a vector are then united over its shards.
4. Each shard searches the united graph, restricted to its vectors, for every one of its vectors: a greedy beam from the
   shard's medoid, then range expansion: whatever is in range and not yet linked through has its neighbours looked at, until
   nothing new is in range. Pairs found are verified in double precision; a task returns a spanning forest of them.
5. Links are then counted exactly within each component, in blocks: a pair with a link is in one component, so counts and
   components agree. A large component is cut into tiles by hash that are met two by two.
6. The audit takes a sample of vectors that grows with the root of their number, counts their links against every vector in
   blocks, and compares, over links and over vectors with links. Below ``least_recall`` the search is run again with twice
   the overlap and beam; if ``attempts`` of them don't reach it, ``LowRecall`` is raised. ``audited`` also returns the recall.

Defined cases: links are looked for between vectors of equal length only; repeated rows are vectors of their own; null ids
take part, and a component's id is the smallest that isn't null; an empty table gives an empty table; other columns are
ignored; of equally near centroids any may be taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, Scratch, pick, tidy
from .components import components


@dataclass(frozen=True)
class Plan:
    threshold: float = 0.9
    overlap: int = 3
    shard_rows: int = 2048
    split_rows: int = 8192
    max_shards: int = 1 << 16
    sample_rows: int = 20_000
    flat_centroids: int = 1024
    degree: int = 16
    candidates: int = 48
    beam: int = 40
    alpha: float = 1.2
    tile_rows: int = 4096
    audit_rows: int = 1000
    least_recall: float = 0.95
    attempts: int = 4


class LowRecall(RuntimeError):
    """The links found fall short of the plan's recall, whatever was tried."""


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very small or large parts stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[a : a + 4096] @ c.T, axis=1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def prune(x: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning: the nearest candidate stays and drops those that it is ``alpha`` times nearer to than the vector is.

    near: (n, c) candidates by falling similarity, -1 where there is none. Gives (n, degree), -1 beyond the edges.
    """
    out = np.full((len(near), degree), -1, dtype=np.int64)
    for a in range(0, len(near), 256):
        part = near[a : a + 256]
        rows, vec = np.arange(len(part)), x[part]
        far = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ncd,nd->nc", vec, x[a : a + 256])))
        open_ = part >= 0
        for t in range(degree):
            any_ = open_.any(axis=1)
            if not any_.any():
                break
            first = np.argmax(open_, axis=1)
            out[a : a + 256][any_, t] = part[rows, first][any_]
            apart = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ncd,nd->nc", vec, vec[rows, first])))
            open_ &= alpha * apart > far
            open_[rows, first] = False
    return out


def build(x: np.ndarray, plan: Plan) -> np.ndarray:
    """(n, 2 * degree) neighbours of unit vectors within one shard, -1 beyond the edges."""
    n, c = len(x), min(plan.candidates, len(x) - 1)
    if n < 2:
        return np.full((n, 2 * plan.degree), -1, dtype=np.int64)
    near = np.empty((n, c), dtype=np.int64)
    for a in range(0, n, 512):
        sims = x[a : a + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -9
        top = np.argpartition(-sims, c - 1, axis=1)[:, :c]
        near[a : a + 512] = np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, axis=1), axis=1, kind="stable"), axis=1)
    ahead = prune(x, near, plan.degree, plan.alpha)
    src, dst = np.repeat(np.arange(n), plan.degree), ahead.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.lexsort((-np.einsum("nd,nd->n", x[src], x[dst]), dst))
    src, dst = src[order], dst[order]
    place = np.arange(len(dst)) - np.searchsorted(dst, dst)
    fits = place < plan.degree
    back = np.full((n, plan.degree), -1, dtype=np.int64)
    back[dst[fits], place[fits]] = src[fits]
    return np.concatenate([ahead, back], axis=1)


def _reach(edges: np.ndarray, start: int) -> np.ndarray:
    seen, front = np.zeros(len(edges), dtype=bool), np.array([start])
    seen[start] = True
    while len(front):
        nxt = np.unique(edges[front])
        front = nxt[(nxt >= 0) & ~seen[nxt]]
        seen[front] = True
    return seen


def connect(x: np.ndarray, edges: np.ndarray, start: int) -> np.ndarray:
    """Adds edges, nearest first, until every vector can be reached from ``start``."""
    while not (seen := _reach(edges, start)).all():
        inside, island = np.flatnonzero(seen), int(np.argmin(seen))
        host = inside[np.argmax(x[inside] @ x[island])]
        edges = np.concatenate([edges, np.full((len(edges), 1), -1)], axis=1) if edges[host, -1] >= 0 else edges
        edges[host, -1] = island
        edges[host] = np.sort(edges[host])[::-1]
    return edges


def in_range(x: np.ndarray, edges: np.ndarray, start: int, low: float, forest: Forest, beam: int, wide: int = 4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, other) whose similarity is ``low`` at least, as far as the search finds them, by blocks of queries; queries
    are all vectors. Vectors that ``forest`` has linked with the query already aren't expanded."""
    n, beam = len(x), min(beam, len(x))
    for a, e in zip([0, 64, *range(512, n, 512)], [64, 512, *range(1024, n + 512, 512)]):
        q = np.arange(a, min(n, e))
        if not len(q):
            continue
        rows, labels = np.arange(len(q)), forest.labels
        seen = np.zeros((len(q), n), dtype=bool)
        ids = np.full((len(q), beam), -1, dtype=np.int64)
        sims = np.full((len(q), beam), -9.0, dtype=x.dtype)
        done = np.ones((len(q), beam), dtype=bool)
        ids[:, 0], sims[:, 0], done[:, 0] = start, x[q] @ x[start], False
        seen[:, start] = True
        hit_q, hit_v = [rows[sims[:, 0] >= low]], [np.full(int((sims[:, 0] >= low).sum()), start)]

        def look(at: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """New (row, node) pairs met from the given ones, with similarities; each pair once."""
            r = np.repeat(at, edges.shape[1])
            v = edges[nodes].ravel()
            keep = v >= 0
            r, v = r[keep], v[keep]
            new = ~seen[r, v]
            key = np.unique(r[new] * n + v[new])
            r, v = key // n, key % n
            seen[r, v] = True
            s = np.concatenate([np.zeros(0, dtype=x.dtype), *(np.einsum("nd,nd->n", x[q[r[k : k + 65536]]], x[v[k : k + 65536]]) for k in range(0, len(r), 65536))])
            near = s >= low
            hit_q.append(r[near])
            hit_v.append(v[near])
            return r, v, s

        while True:
            best = np.argsort(np.where(done, 9, -sims), axis=1, kind="stable")[:, :wide]
            go = ~np.take_along_axis(done, best, axis=1)
            if not go.any():
                break
            at, slot = np.nonzero(go)
            nodes = ids[at, best[at, slot]]
            done[at, best[at, slot]] = True
            r, v, s = look(at, nodes)
            if not len(r):
                continue
            place = np.arange(len(r)) - np.searchsorted(r, r)
            width = int(place.max()) + 1
            more = np.full((len(q), width), -1, dtype=np.int64), np.full((len(q), width), -9.0, dtype=x.dtype), np.ones((len(q), width), dtype=bool)
            for box, value in zip(more, (v, s, False)):
                box[r, place] = value
            ids, sims, done = (np.concatenate(z, axis=1) for z in ((ids, more[0]), (sims, more[1]), (done, more[2])))
            top = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
            ids, sims, done = (np.take_along_axis(z, top, axis=1) for z in (ids, sims, done))
        front = np.concatenate(hit_q), np.concatenate(hit_v)
        while len(front[0]):  # range expansion: all in range are looked at, also those that the beam passed by
            apart = labels[q[front[0]]] != labels[front[1]]
            front, mark = (front[0][apart], front[1][apart]), len(hit_q)
            for k in range(0, len(front[0]), 1 << 14):
                look(front[0][k : k + (1 << 14)], front[1][k : k + (1 << 14)])
            front = np.concatenate([np.zeros(0, np.int64), *hit_q[mark:]]), np.concatenate([np.zeros(0, np.int64), *hit_v[mark:]])
        yield q[np.concatenate(hit_q)], np.concatenate(hit_v)


def linked(x: np.ndarray, edges: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links that the search finds among unit vectors (double precision), as row numbers."""
    small = x.astype(np.float32)
    medoid = int(np.argmax(small @ small.mean(axis=0)))
    forest, high, low = Forest(np.arange(len(x))), [], []
    for q, v in in_range(small, connect(small, edges, medoid), medoid, plan.threshold - 1e-4, forest, plan.beam):
        for k in range(0, len(q), 65536):
            i, j = q[k : k + 65536], v[k : k + 65536]
            apart = forest.labels[i] != forest.labels[j]
            i, j = i[apart], j[apart]
            sure = np.einsum("nd,nd->n", x[i], x[j]) >= plan.threshold
            h, w = forest.link(i[sure], j[sure])
            high.append(h)
            low.append(w)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *high]), np.concatenate([none, *low])


class Centroids:
    """The nearest centroids of unit vectors: all compared, or beyond ``flat`` of them by cells of a coarser set."""

    def __init__(self, sample: np.ndarray, k: int, flat: int):
        sample = sample.astype(np.float32)
        self.parts = None
        if k <= flat:
            self.all = centroids(sample, k)
        else:
            self.coarse = centroids(sample, int(np.ceil(np.sqrt(k))))
            own = np.concatenate([np.argmax(sample[a : a + 4096] @ self.coarse.T, axis=1) for a in range(0, len(sample), 4096)])
            cells = [sample[own == c] for c in range(len(self.coarse))]
            self.parts = [centroids(cell, max(1, round(k * len(cell) / len(sample)))) if len(cell) else self.coarse[c : c + 1] for c, cell in enumerate(cells)]
            self.first = np.cumsum([0, *map(len, self.parts)])
        self.n = len(self.all) if self.parts is None else int(self.first[-1])

    def nearest(self, x: np.ndarray, many: int, probes: int = 8) -> np.ndarray:
        """(n, many) numbers of the nearest centroids, ascending."""
        out = np.empty((len(x), many), dtype=np.int64)
        for a in range(0, len(x), 1024):
            some = x[a : a + 1024]
            if self.parts is None:
                out[a : a + 1024] = np.argpartition(-(some @ self.all.T), many - 1, axis=1)[:, :many]
                continue
            p = min(probes, len(self.coarse))
            cells = np.argpartition(-(some @ self.coarse.T), p - 1, axis=1)[:, :p]
            row, cell = np.repeat(np.arange(len(some)), p), cells.ravel()
            rows, names, sims = [], [], []
            for c in np.unique(cell):
                mine = row[cell == c]
                s = some[mine] @ self.parts[c].T
                rows.append(np.repeat(mine, s.shape[1]))
                names.append(np.tile(np.arange(self.first[c], self.first[c + 1]), len(mine)))
                sims.append(s.ravel())
            rows, names, sims = map(np.concatenate, (rows, names, sims))
            order = np.lexsort((-sims, rows))
            at = np.searchsorted(rows[order], np.arange(len(some)))[:, None] + np.minimum(np.arange(many), np.bincount(rows, minlength=len(some))[:, None] - 1)
            out[a : a + 1024] = names[order[at]]
        return np.sort(out, axis=1)


def _forests(vecs: DataFrame, c: Centroids, scratch: Scratch, plan: Plan) -> DataFrame:
    """(a, b): edges between node numbers, the links of a spanning forest of each shard."""
    overlap, kinds = min(plan.overlap, c.n), vecs.schema["vec"].dataType.simpleString()
    sent = vecs.sparkSession.sparkContext.broadcast(c)  # max_shards of them at most

    def assign(batches):
        found = sent.value
        for batch in batches:
            near = found.nearest(unit(_matrix(batch.column("vec"))).astype(np.float32), overlap)
            row, slot = np.nonzero(np.append(np.ones((len(near), 1), dtype=bool), near[:, 1:] != near[:, :-1], axis=1))
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(near[row, slot]), batch.column("gid").take(rows), batch.column("vec").take(rows)], names=["shard", "gid", "vec"])

    def graph(table: pa.Table) -> pa.Table:
        gid = table.column("gid").to_numpy()
        edges = build(unit(_matrix(table.column("vec"))).astype(np.float32), plan)
        own, at = np.nonzero(edges >= 0)
        cut = np.searchsorted(own, np.arange(len(gid) + 1)).astype(np.int32)
        return pa.table({"node": gid, "near": pa.ListArray.from_arrays(pa.array(cut), pa.array(gid[edges[own, at]]))})

    def search(table: pa.Table) -> pa.Table:
        gid, lists = table.column("gid").to_numpy(), table.column("near").combine_chunks()
        order = np.argsort(gid)
        own = np.repeat(np.arange(len(gid)), np.diff(lists.offsets.to_numpy()))
        to = lists.flatten().to_numpy()
        at = np.minimum(np.searchsorted(gid[order], to), len(gid) - 1)
        lives = gid[order][at] == to  # others live in another shard, which searches that edge
        pair = np.unique(own[lives] * len(gid) + order[at[lives]])
        own, to = pair // len(gid), pair % len(gid)
        place = np.arange(len(own)) - np.searchsorted(own, own)
        edges = np.full((len(gid), int(place.max(initial=0)) + 1), -1, dtype=np.int64)
        edges[own, place] = to
        high, low = linked(unit(_matrix(table.column("vec"))), edges, plan)
        return pa.table({"a": gid[high], "b": gid[low]})

    def cross(table: pa.Table) -> pa.Table:
        x, gid, side = unit(_matrix(table.column("vec"))), table.column("gid").to_numpy(), table.column("side").to_numpy()
        i, j = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        forest, high, low = Forest(np.arange(len(x))), [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for k in range(0, len(i), 256):
            r, s = np.nonzero(x[i[k : k + 256]] @ x[j].T >= plan.threshold)
            h, w = forest.link(i[r + k], j[s])
            high.append(h)
            low.append(w)
        return pa.table({"a": gid[np.concatenate(high)], "b": gid[np.concatenate(low)]})

    members = scratch.save(vecs.select("gid", "vec").mapInArrow(tidy(assign), f"shard long, gid long, vec {kinds}"))
    large = members.groupBy("shard").count().where(F.col("count") > plan.split_rows).select(F.col("shard").alias("s"), F.ceil(F.col("count") / plan.split_rows * 2).cast("int").alias("pieces"))
    large = scratch.save(large)
    cut = members.join(large, F.col("shard") == F.col("s"), "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    cut = scratch.save(cut.withColumn("piece", F.pmod(F.xxhash64("gid"), F.col("pieces")).cast("int")).drop("s"))
    lists = cut.groupBy("shard", "piece").applyInArrow(graph, "node long, near array<long>")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # one list a shard: overlap of them
    whole = cut.join(united, F.col("gid") == F.col("node")).select("shard", "piece", "gid", "vec", "near")
    found = whole.groupBy("shard", "piece").applyInArrow(search, "a long, b long")
    if not large.isEmpty():
        other = F.explode(F.filter(F.sequence(F.lit(0), F.col("pieces") - 1), lambda p: p != F.col("piece"))).alias("other")
        met = cut.where("pieces > 1").select("shard", "piece", "gid", "vec", other)
        met = met.select("shard", F.least("piece", "other").alias("p"), F.greatest("piece", "other").alias("q"), (F.col("piece") > F.col("other")).cast("int").alias("side"), "gid", "vec")
        found = found.union(met.groupBy("shard", "p", "q").applyInArrow(cross, "a long, b long"))
    found = scratch.save(found)
    scratch.drop(members, cut)
    return found


def _counts(vecs: DataFrame, roots: DataFrame, scratch: Scratch, plan: Plan) -> DataFrame:
    """(gid, n) of every node of a component: how many vectors of other nodes it links with, by exact blocks."""
    sizes = scratch.save(roots.groupBy("root").agg(F.count(F.lit(1)).alias("m")).select(F.col("root").alias("r"), F.ceil(F.col("m") / plan.tile_rows).cast("int").alias("tiles")))
    each = vecs.join(roots, F.col("gid") == F.col("node")).join(sizes, F.col("root") == F.col("r"))
    own = F.pmod(F.xxhash64("gid"), F.col("tiles")).cast("int")
    each = each.withColumn("own", own).select("root", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"), "gid", "mult", "vec")
    tiles = each.select("root", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).alias("side"), "gid", "mult", "vec")

    def near(x: np.ndarray, mult: np.ndarray, i: np.ndarray, j: np.ndarray, total: np.ndarray, both: bool) -> None:
        for k in range(0, len(i), 256):
            some = i[k : k + 256]
            hit = x[some] @ x[j].T >= plan.threshold
            if not both:
                hit &= some[:, None] != j[None, :]
            total[some] += hit @ mult[j]
            if both:
                total[j] += mult[some] @ hit

    def run(batches):
        held: list[pa.RecordBatch] = []

        def settle(last: bool):
            table = pa.Table.from_batches(held)
            root, p, q = (table.column(k).to_numpy() for k in ("root", "p", "q"))
            change = np.append(True, (root[1:] != root[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]))
            cut = len(root) if last else int(np.flatnonzero(change)[-1])
            held[:] = table.slice(cut).combine_chunks().to_batches()
            if not cut:
                return
            table, number = table.slice(0, cut), np.cumsum(change[:cut]) - 1
            x, mult, gid, side = unit(_matrix(table.column("vec"))), table.column("mult").to_numpy(), table.column("gid").to_numpy(), table.column("side").to_numpy()
            inner, total, a, k = p[:cut] == q[:cut], np.zeros(cut, dtype=np.int64), np.arange(cut), 0
            size = np.bincount(number)[number]
            a = a[(size <= 32) & inner]
            while len(a):  # small components, all at once: every row with the k-th after it
                k += 1
                a = a[a + k < cut]
                a = a[number[a] == number[a + k]]
                hit = a[np.einsum("nd,nd->n", x[a], x[a + k]) >= plan.threshold]
                total[hit] += mult[hit + k]
                total[hit + k] += mult[hit]
            for t in np.unique(number[(size > 32) | ~inner]):
                mine = np.flatnonzero(number == t)
                if inner[mine[0]]:
                    near(x, mult, mine, mine, total, False)
                else:
                    near(x, mult, mine[~side[mine]], mine[side[mine]], total, True)
            yield pa.RecordBatch.from_arrays([pa.array(gid), pa.array(total)], names=["gid", "n"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= 1 << 14:
                    yield from settle(False)
        if held:
            yield from settle(True)

    met = tiles.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q").mapInArrow(tidy(run), "gid long, n long")
    return scratch.save(met.groupBy("gid").agg(F.sum("n").alias("n")))


def audit(vecs: DataFrame, counts: DataFrame, n: int, plan: Plan) -> float:
    """The lesser of two recalls, over links and over vectors with links (the mean of their shares), for a sample of vectors that
    is counted against every vector. The sample grows with the root of the number of vectors."""
    wanted = max(plan.audit_rows, int(4 * n**0.5))
    asked = vecs.where(F.pmod(F.xxhash64("gid", F.lit(7)), F.lit(1 << 30)) < int(min(1.0, wanted / n) * (1 << 30))).select("gid", "vec").toPandas()
    if not len(asked):
        return 1.0
    ids = np.sort(asked["gid"].to_numpy())
    q = unit(np.stack(asked.sort_values("gid")["vec"].to_numpy())).T.copy()
    sent = vecs.sparkSession.sparkContext.broadcast((ids, q))

    def exact(batches):
        ids, q = sent.value
        total = np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            x, gid, mult = unit(_matrix(batch.column("vec"))), batch.column("gid").to_numpy(), batch.column("mult").to_numpy()
            for a in range(0, len(x), 1024):
                near = (x[a : a + 1024] @ q >= plan.threshold) & (gid[a : a + 1024, None] != ids[None, :])
                total += mult[a : a + 1024] @ near
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(total[some])], names=["gid", "n"])

    truth = vecs.select("vec", "gid", "mult").mapInArrow(tidy(exact), "gid long, n long").groupBy("gid").agg(F.sum("n").alias("n"))
    got = F.coalesce("got", F.lit(0))
    links, found, share = truth.join(counts.withColumnRenamed("n", "got"), "gid", "left").agg(F.sum("n"), F.sum(got), F.avg(got / F.col("n"))).first()
    return 1.0 if not links else min(found / links, share)


def near_duplicates(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", plan: Plan = Plan()) -> DataFrame:
    """vec_id, n_links, component_id and kept (vec_id = component_id) of every row."""
    return audited(table, vec_id, vector, plan)[0]


def audited(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", plan: Plan = Plan()) -> tuple[DataFrame, float]:
    """As ``near_duplicates``, with the measured recall (the least over vector lengths; 1 where nothing has links)."""
    scratch = Scratch(table.sparkSession)
    rows = pick(table, vec_id=vec_id, vec=vector)
    # NaN compares as larger than all numbers, so one pair of bounds rules out every non-finite part
    fine = F.coalesce(F.forall("vec", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0), F.lit(False))
    flagged = rows.withColumn("fine", fine)
    nodes = flagged.where("fine").groupBy("vec").agg(F.min("vec_id").alias("own"), F.count(F.lit(1)).alias("mult"))
    nodes = scratch.save(nodes.withColumn("gid", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")))
    told, recall = None, 1.0
    for dim, n in sorted(tuple(r) for r in nodes.groupBy("dim").count().collect()):
        vecs, now = nodes.where(F.col("dim") == dim).drop("dim", "own"), plan
        if n < 2:
            continue
        for attempt in range(plan.attempts):
            k = min(plan.max_shards, max(1, -(-n * now.overlap // plan.shard_rows)))
            wanted = max(plan.sample_rows, 4 * k) / n
            sample = vecs.where(F.pmod(F.xxhash64("gid", F.lit(1)), F.lit(1_000_000)) < int(min(1.0, wanted) * 1_000_000) + 1).select("vec").toPandas()
            forest = _forests(vecs, Centroids(unit(np.stack(sample["vec"].to_numpy())), min(k, len(sample)), plan.flat_centroids), scratch, now)
            roots = scratch.save(components(forest.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch))
            counts = _counts(vecs, roots, scratch, now)
            found = audit(vecs, counts, n, now)
            if found >= plan.least_recall:
                break
            now = replace(now, overlap=now.overlap * 2, beam=now.beam * 2)
        else:
            raise LowRecall(f"{found:.4f} of the links of {dim}-part vectors found after {plan.attempts} attempts; the plan asks for {plan.least_recall}")
        recall = min(recall, found)
        both = roots.join(counts, F.col("node") == F.col("gid"), "left").select("node", "root", F.col("n").alias("found"))
        told = both if told is None else told.union(both)
    if told is None:
        told = nodes.select("vec", (F.col("mult") - 1).alias("n"), F.col("own").alias("best"))
    else:
        joined = scratch.save(told.join(nodes.select("gid", "own"), F.col("node") == F.col("gid")).select("node", "root", "own", "found"))
        best = scratch.save(joined.groupBy("root").agg(F.min("own").alias("best")))  # a root with many rows can then be split
        more = scratch.save(joined.join(best, "root").select("node", "best", "found"))
        told = nodes.join(more, F.col("gid") == F.col("node"), "left").select("vec", (F.col("mult") - 1 + F.coalesce("found", F.lit(0))).alias("n"), F.coalesce("best", "own").alias("best"))
    told = scratch.save(told.withColumnRenamed("vec", "key"))
    matched = flagged.where("fine").join(told, F.col("vec") == F.col("key")).select("vec_id", F.col("n").alias("n_links"), F.col("best").alias("component_id"))
    alone = flagged.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return matched.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), recall
