"""Sharding by balanced label propagation.

Linked documents (by default those with equal texts; a link table can be added) start in shards by hash. In each round a
document looks at its neighbours' shards (two joins and combined counts) and moves to the one that holds most of them, if
that is more than its own holds, it is the document's turn (half of them, by a hash of row and round, so that two neighbours don't swap for
ever) and the quotas allow it: between two shards as many may swap as wish to in both directions, and beyond that each shard
takes linked documents while it has less than its quota, N / k; where more want in than fit, a hash lets through the share
that does. Every other pair of rounds looks only at shards with room, so that a group isn't held back by a full one. A group is linked as a star around its first row, so it has as many links as rows;
a group larger than a shard fills its shard and leaves the rest where they are.

Documents without links aren't moved: they fill what is left of each quota, so sizes come out exact. The law is ``rows``:
counts of any two shards differ by one at most.

The driver sees only counts by shard. No task gets a whole group or shard: the joins on a hot row can be split, counts are
combined before they are shuffled, and numbering works on hash buckets of bounded size.

Defined cases: null texts have size 1 (nought bytes plus 1), checksum 0 and no links; equal empty texts are a group like any
other; null and repeated ids are rows of their own; rows with equal ids and texts are interchangeable, all else is settled by
content and not by how the input is split; fewer rows than shards leave shards empty; links that name no row, or
a row and itself, do nothing; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, dense_rank_in


@dataclass(frozen=True)
class Plan:
    shards: int = 8
    rounds: int = 24  # at most; fewer when nothing is left to move
    fill: float = 0.98  # of a quota, for linked rows; the rest evens out what the hash lets through too much
    ease: float = 0.95  # of the room that a round hands out, while it is short


def star(rows: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(a, b): the first row of each key of two rows or more, and each other row; null keys have no links.

    The first rows are written before the join: it then has nothing but exchanges under it, and a hot key can be split.
    """
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by("row", F.struct("seed", "row")).alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key).alias("__k"), "a")
    return rows.join(scratch.save(first), F.col(key) == F.col("__k")).where("row <> a").select("a", F.col("row").alias("b"))


def _choice(values: list[int | float], of: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), of + 1)


def propagate(links: DataFrame, seeds: DataFrame, quota: list[int], scratch: Scratch, plan: Plan = Plan()) -> DataFrame:
    """(row, shard) for every row that ``links`` (a, b) names. seeds: (row, seed), from which all that is drawn by lot is hashed."""
    k = len(quota)
    both = scratch.save(links.where("a <> b").union(links.where("a <> b").select("b", "a")).distinct().toDF("row", "near"))
    state = seeds.join(both.select("row").distinct(), "row", "left_semi").select("row", "seed")
    state = scratch.save(state.withColumn("shard", F.pmod(F.xxhash64("seed", F.lit(3)), F.lit(k)).cast("int")))
    still = 0
    for turn in range(plan.rounds):
        held = [0] * k
        for s, n in state.groupBy("shard").count().collect():
            held[s] = n
        room = [max(0, int(q * plan.fill) - h) for q, h in zip(quota, held)]
        seen = both.join(state.select(F.col("row").alias("r"), F.col("shard").alias("to")), F.col("near") == F.col("r")).groupBy("row", "to").agg(F.count(F.lit(1)).alias("n"))
        fits = F.lit(turn % 4 < 2) | (F.col("to") == F.col("shard")) | (_choice(room, F.col("to")) > 0)
        own = seen.join(state.withColumnRenamed("row", "r"), F.col("row") == F.col("r")).withColumn("open", fits)
        best = own.groupBy("row", "seed", "shard").agg(F.max(F.when(F.col("open"), F.struct("n", F.pmod(F.col("to") + F.lit(turn), F.lit(k)).alias("tie"), "to"))).alias("top"), F.sum(F.when(F.col("to") == F.col("shard"), F.col("n")).otherwise(0)).alias("here"))
        its_turn = F.pmod(F.xxhash64("seed", F.lit(5 + 1000 * turn)), F.lit(2)) == 0
        wish = scratch.save(best.select("row", "seed", "shard", F.when(F.col("top.n") > F.col("here"), F.col("top.to")).alias("want")).withColumn("to", F.when(its_turn, F.col("want"))))
        asked = [[0] * k for _ in range(k)]
        for i, j, n in wish.where("to is not null").groupBy("shard", "to").count().collect():
            asked[i][j] = n
        if turn % 4 < 2 and not any(map(any, asked)) and wish.where("want is not null").isEmpty():
            scratch.drop(wish)
            break  # no wish is left, whoever's turn it is
        share = []
        for i in range(k):
            for j in range(k):
                swaps = min(asked[i][j], asked[j][i])
                left = sum(asked[x][j] - min(asked[x][j], asked[j][x]) for x in range(k))
                rest = (asked[i][j] - swaps) * min(1.0, plan.ease * room[j] / left if left > room[j] else 1.0)
                share.append((swaps + rest) / asked[i][j] if asked[i][j] else 0.0)
        still = 0 if any(map(any, asked)) and any(share) else still + 1
        if still == 8:
            scratch.drop(wish)
            break  # the wishes that are left don't fit the quotas
        lucky = F.pmod(F.xxhash64("seed", F.lit(100 + turn)), F.lit(1 << 20)) < _choice(share, F.col("shard") * k + F.col("to")) * float(1 << 20)
        moved = scratch.save(wish.select("row", "seed", F.when(F.col("to").isNotNull() & lucky, F.col("to")).otherwise(F.col("shard")).alias("shard")))
        scratch.drop(state, wish)
        state = moved
    scratch.drop(both)
    return state.select("row", "shard")


def place(rows: DataFrame, links: DataFrame, scratch: Scratch, plan: Plan = Plan()) -> DataFrame:
    """``rows`` (with a unique long ``row`` and a ``seed``) and the shard of each; counts at most one apart."""
    k, total = plan.shards, rows.count()
    links = scratch.save(links)
    linked = propagate(links, rows.select("row", "seed"), [total // k] * k, scratch, plan)
    held = [0] * k
    for s, n in linked.groupBy("shard").count().collect():
        held[s] = n
    more = sorted(range(k), key=lambda s: (-held[s], s))[: total % k]
    quota = [total // k + (s in more) for s in range(k)]
    over = [max(0, h - q) for h, q in zip(held, quota)]
    free = rows.join(linked, "row", "left_anti").select("row", "seed")
    stay = linked
    if any(over):
        full = linked.where(F.col("shard").isin([s for s in range(k) if over[s]])).join(rows.select("row", "seed"), "row")
        ranked = scratch.save(dense_rank_in(full, F.col("shard"), [F.xxhash64("seed", F.lit(9)), F.col("seed"), F.col("row")], "rank"))
        out = ranked.where(F.col("rank") < _choice(over, F.col("shard"))).select("row", "seed")
        stay, free = linked.join(out, "row", "left_anti"), free.union(out)
    free = dense_rank_in(free, F.lit(0), [F.col("seed"), F.col("row")], "rank", rows=total)
    at, place_of = 0, F.lit(k - 1)
    bounds = []
    for s in range(k):
        at += quota[s] - min(held[s], quota[s])
        bounds.append(at)
    for s in reversed(range(k - 1)):
        place_of = F.when(F.col("rank") < bounds[s], F.lit(s)).otherwise(place_of)
    settled = scratch.save(stay.select("row", "shard").union(free.select("row", place_of.alias("shard"))))
    return rows.join(settled, "row")


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", links: DataFrame | None = None, plan: Plan = Plan()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    links: further links, as (src, dst) of document ids.
    """
    scratch = Scratch(docs.sparkSession)
    raw = F.coalesce(docs[text].cast("string"), F.lit(""))
    narrow = docs.select(docs[doc_id].alias("doc_id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), F.md5(docs[text].cast("string").cast("binary")).alias("key"))
    # the seed comes from the content, so that shards don't depend on how the input is split; row numbers only tell equal rows apart
    rows = scratch.save(narrow.withColumns({"row": F.monotonically_increasing_id(), "seed": F.xxhash64("doc_id", "key", "size")}))
    edges = star(rows.select("row", "seed", "key"), "key", scratch)
    if links is not None:
        ids = rows.where("doc_id is not null").select("row", "doc_id")
        a, b = ids.toDF("a", "src"), ids.toDF("b", "dst")
        edges = edges.union(links.toDF("src", "dst").join(a, "src").join(b, "dst").select("a", "b"))
    placed = scratch.save(place(rows.drop("key"), edges, scratch, plan))
    slotted = dense_rank_in(placed, F.col("shard"), [F.col("seed"), F.col("row")], "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def cut_share(rows: DataFrame, links: DataFrame) -> float:
    """The share of ``links`` (a, b) whose ends are in different shards of ``rows`` (row, shard)."""
    a, b = rows.select(F.col("row").alias("a"), F.col("shard").alias("x")), rows.select(F.col("row").alias("b"), F.col("shard").alias("y"))
    found = links.join(a, "a").join(b, "b").agg(F.avg((F.col("x") != F.col("y")).cast("double"))).first()[0]
    return found or 0.0
