"""Operator 10: shards by balanced label propagation.

Documents of equal text are linked. A cell is what is alike for propagation:
the documents of one text that start in one shard. Rounds of Spark joins move
cells towards the shard where most of their text is, ties to the shard that a
hash of the text prefers, so all cells of a text choose alike. Wishes for a
shard beyond its quota are granted in part, chosen by hash; a full shard takes
no more, and its suitors turn to the next best. A text with a third of all
rows is 24 cells of a seventy-second each, so no key is hot. Rounds end when no cell
wishes to move, or after ``ROUNDS``, which may leave groups cut.

Documents without a link cost nothing to move. They even the shards out
afterwards: a shard above its due gives its surplus, unlinked rows first, to
those below, by ranks that are sums over bounded bucket counts. So row counts
differ by one at most (the law ``rows``), and slots have no gaps.

What reaches the driver: counts by shard and pairs of shards, no rows.

Defined results: a null text counts as empty, of size 8, and all empty texts
are linked; null and repeated doc_ids are rows like any other; an empty table
gives no rows; very long texts count whole, by size and hash; ties go by hashes of the
text and of the row; further columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import discard, written
from .common import table

SHARDS, ROUNDS, FILL = 24, 12, 0.98
PER_BUCKET, MAX_BROADCAST_ROWS = 50_000, 1_000_000


def _share(*parts: Column) -> Column:
    """A hash as a number from 0 to 1."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 20)) / float(1 << 20)


def _of(values, index: Column, kind: str) -> Column:
    return F.get(F.array(*(F.lit(v).cast(kind) for v in values)), index)


def grants(load: list[int], wishes: dict[tuple[int, int], int], most: float) -> list[float]:
    """The part of the wishes for each shard that keeps all loads within ``most``."""
    n = len(load)
    part = [1.0] * n
    for _ in range(50):
        out = [sum(v * part[b] for (a, b), v in wishes.items() if a == s) for s in range(n)]
        asked = [sum(v for (_, b), v in wishes.items() if b == s) for s in range(n)]
        new = [min(part[s], max(0.0, most - load[s] + out[s]) / asked[s]) if asked[s] else 1.0 for s in range(n)]
        if max(abs(x - y) for x, y in zip(new, part, strict=True)) < 1e-3:
            return new
        part = new
    return part


def propagate(cells: DataFrame, total: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Labels for ``cells`` (key, init, n), the linked ones only: (key, init, label, n)."""
    state = written(cells.select("key", "init", F.col("init").alias("label"), "n"), "cells")
    most = FILL * total / shards
    for turn in range(rounds):
        load = [0] * shards
        for label, n in state.groupBy("label").agg(F.sum("n")).collect():
            load[label] = n
        free = [x < most - 1 for x in load]
        votes = state.groupBy("key", "label").agg(F.sum("n").alias("votes")).select(F.col("key").alias("k"), F.col("label").alias("target"), "votes")
        # of equally liked shards one with room comes first, else cells in a full one would wait for the rest
        liking = F.struct("votes", _of(free, F.col("target"), "boolean").alias("free"), _share(F.col("k"), F.col("target")).alias("tie"), "target")
        seen = state.join(votes, state["key"] == votes["k"]).where((F.col("target") == F.col("label")) | _of(free, F.col("target"), "boolean"))
        wish = seen.groupBy("key", "init", "label", "n").agg(F.max(liking)["target"].alias("wish"), F.sum("votes").alias("all"))
        wish = written(wish.select("key", "init", "label", "n", "wish", "all"), "wishes")
        wishes = {(a, b): n for a, b, n in wish.where("wish <> label").groupBy("label", "wish").agg(F.sum("n")).collect()}
        if not wishes:
            return state
        part = grants(load, wishes, most)
        # texts that would fill much of a shard are granted cell by cell
        apart = F.when(F.col("all") > most / 8, F.col("init")).otherwise(F.lit(-1))
        go = (F.col("wish") != F.col("label")) & (_share(F.col("key"), apart, F.col("wish"), F.lit(turn)) < _of(part, F.col("wish"), "double"))
        before, state = state, written(wish.select("key", "init", F.when(go, F.col("wish")).otherwise(F.col("label")).alias("label"), "n"), "cells")
        discard(before)
        discard(wish)
    return state


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, linked) for every row."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.unhex(F.md5(t)).alias("key"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows.withColumn("init", F.pmod(F.xxhash64("row", "doc_id"), F.lit(shards)).cast("int")), "rows")
    total = rows.count()
    cells = rows.groupBy("key", "init").agg(F.count("*").alias("n"))
    many = cells.groupBy("key").agg(F.sum("n").alias("all")).where("all > 1").select(F.col("key").alias("k"))
    labels = propagate(cells.join(many, F.col("key") == F.col("k"), "left_semi"), total, shards, rounds)
    at = labels.select(F.col("key").alias("k"), F.col("init").alias("i"), "label")
    buckets = -(-total // (shards * PER_BUCKET)) or 1
    linked = F.col("label").isNotNull()
    placed = rows.join(at, (rows["key"] == at["k"]) & (rows["init"] == at["i"]), "left")
    placed = written(placed.select("doc_id", "size", "text_crc32", "row", linked.alias("linked"), F.coalesce("label", "init").alias("label"), F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int").alias("bucket")), "placed")

    counts = placed.groupBy("label", "linked", "bucket").agg(F.count("*").alias("n"))
    load = [0] * shards
    for label, n in counts.groupBy("label").agg(F.sum("n")).collect():
        load[label] = n
    due = [total // shards] * shards
    for s in sorted(range(shards), key=lambda s: -load[s])[: total % shards]:
        due[s] += 1
    surplus = [max(0, a - b) for a, b in zip(load, due, strict=True)]
    lack = [max(0, b - a) for a, b in zip(load, due, strict=True)]
    given = [sum(surplus[:s]) for s in range(shards)]
    taken = [sum(lack[:s]) for s in range(shards)]

    # 2 * shards * buckets rows at most
    before = F.coalesce(F.sum("n").over(Window.partitionBy("label").orderBy("linked", "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("label").alias("l"), F.col("linked").alias("k"), F.col("bucket").alias("b"), before.alias("before"))
    if 2 * shards * buckets <= MAX_BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    ranked = placed.withColumn("within", F.row_number().over(Window.partitionBy("label", "linked", "bucket").orderBy("row")) - 1)
    ranked = ranked.join(offsets, (F.col("label") == F.col("l")) & (F.col("linked") == F.col("k")) & (F.col("bucket") == F.col("b")))
    rank = F.col("before") + F.col("within")
    over = _of(surplus, F.col("label"), "long")
    nth = _of(given, F.col("label"), "long") + rank
    to = F.lit(0)
    for s in range(shards):
        if lack[s]:
            to = F.when(nth >= taken[s], F.lit(s)).otherwise(to)
    out = ranked.select("doc_id", "size", "text_crc32", "linked", "label", rank.alias("rank"), over.alias("over"), nth.alias("nth"), (rank < over).alias("goes"), to.alias("to"))
    slot = F.when(F.col("goes"), _of(load, F.col("to"), "long") + F.col("nth") - _of(taken, F.col("to"), "long")).otherwise(F.col("rank") - F.col("over"))
    return out.select("doc_id", "size", "text_crc32", F.when(F.col("goes"), F.col("to")).otherwise(F.col("label")).cast("int").alias("shard"), slot.cast("long").alias("slot"), "linked")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
