"""Sharding by balanced label propagation under the law `rows`: counts of the shards differ by one at most.

Documents are linked if their texts are equal. Every document begins in a shard by its hash. In each round, joins of the summed table
(group, shard, count) find the shard that holds most of a group; the group's other documents ask to move there, and moves are accepted,
by a hash of the group, up to the room the shard still has for linked documents, so the edges cut fall while no shard overfills. A group
larger than a shard's capacity keeps its parts in as few shards as hold it. At the end documents are numbered within their shard, linked
ones first, and those beyond a shard's quota go to the shards with room: only counts of shards reach the driver.

Defined results: a null text has size 1, CRC-32 0 and is linked with nothing; repeated rows are separate documents of one group; shard
and slot are deterministic up to swaps of rows equal in all columns; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, settled, table

SHARDS = 16
ROUNDS = 4


def sized(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(text.isNotNull(), F.unhex(F.sha2(text, 256))).alias("grp"),
    )


def propagated(parts: DataFrame, quota: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(grp, shard, to): where the documents of a group that are in `shard` go. parts: (grp, shard, n), one row for each group and shard."""
    moves = parts.select("grp", "shard", F.col("shard").alias("to"), "n")
    for k in range(rounds):
        now = moves.groupBy("grp", "to").agg(F.sum("n").alias("n"))
        best = now.groupBy("grp").agg(F.max_by("to", F.struct("n", -F.col("to"))).alias("want"), F.sum("n").alias("total"))
        # a group larger than a shard can't gather in one: it keeps a share in each shard it needs
        asks = settled(moves.join(best.where(F.col("total") <= quota), "grp", "left"))
        load, ask = [0] * shards, [0] * shards
        for r in asks.groupBy("to", "want").agg(F.sum("n").alias("n")).collect():  # at most shards x (shards + 1) rows
            load[r["to"]] += r["n"]
            if r["want"] is not None and r["want"] != r["to"]:
                ask[r["want"]] += r["n"]
        if not any(ask):
            break
        share = [min(1.0, max(0, quota - load[s]) / ask[s]) if ask[s] else 1.0 for s in range(shards)]
        accepted = F.pmod(F.xxhash64("grp", F.lit(k)), F.lit(1_000_000)) < F.lit(1_000_000) * F.get(F.array(*map(F.lit, share)), F.col("want"))
        moves = asks.select("grp", "shard", F.when(F.col("want").isNotNull() & accepted, F.col("want")).otherwise(F.col("to")).alias("to"), "n")
    return settled(moves)


def sharded(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of (doc_id, text)."""
    base = settled(sized(docs).withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(shards)).cast("int")))
    total = base.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    parts = base.where(F.col("grp").isNotNull()).groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("n"))
    size = parts.groupBy("grp").agg(F.sum("n").alias("all")).where("all > 1").select("grp", "all")
    linked = settled(parts.join(size, "grp"))
    big = linked.where(F.col("all") > quotas[-1]).select("grp", "all").distinct().collect()  # fewer than `shards` groups can be so large
    moves = propagated(linked.select("grp", "shard", "n"), quotas[-1], shards, rounds).select("grp", "shard", "to")
    placed = base.join(moves, ["grp", "shard"], "left")
    # the rows of such a group fill whole shards one after the other, by hash: the next one only when the last is full
    to, first = F.col("to"), 0
    for r in sorted(big, key=lambda r: (-r["all"], bytes(r["grp"]))):
        need = min(shards, -(-r["all"] // max(1, quotas[-1])))
        to = F.when(F.col("grp") == F.lit(bytes(r["grp"])), F.pmod(F.lit(first) + F.pmod(F.xxhash64("doc_id", F.lit("big")), F.lit(need)), F.lit(shards))).otherwise(to)
        first += need
    placed = placed.withColumn("label", F.coalesce(to, F.col("shard")).cast("int")).withColumn("single", to.isNull())
    placed = placed.select("doc_id", "size", "text_crc32", "label", "single", F.xxhash64("grp").alias("g"))
    order = numbered(placed, F.col("label"), F.col("single"), F.col("g"), F.col("doc_id"), F.col("size"), F.col("text_crc32"))
    held = [0] * shards
    for r in placed_counts(order):
        held[r["label"]] = r["n"]
    before = [sum(held[:s]) for s in range(shards)]
    over_before = [sum(max(0, held[i] - quotas[i]) for i in range(s)) for s in range(shards)]
    at = lambda values, c: F.get(F.array(*[F.lit(v).cast("long") for v in values]), c)
    label = F.col("label")
    df = order.withColumn("pos", F.col("position") - at(before, label))
    df = df.withColumn("extra", F.when(F.col("pos") >= at(quotas, label), at(over_before, label) + F.col("pos") - at(quotas, label)))
    shard, slot, seen = label, F.col("pos"), 0
    for s in range(shards):
        room = max(0, quotas[s] - held[s])
        here = (F.col("extra") >= seen) & (F.col("extra") < seen + room)
        shard, slot = F.when(here, F.lit(s)).otherwise(shard), F.when(here, F.lit(held[s] - seen) + F.col("extra")).otherwise(slot)
        seen += room
    return df.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def placed_counts(order: DataFrame) -> list:
    return order.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))
