"""Sharding by balanced label propagation.

Documents with equal texts are linked.  Linked documents get seed labels (shards), group beside
group, that leave some of each shard's quota free.  In each round a group of linked documents whose members bear
several labels moves towards the label most of its members have, as far as the quota of that shard
leaves room; moves that would exceed it are refused.  Documents without a link then fill every
shard to exactly its quota, so that counts differ by one at most (law ``rows``).
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.ranks import with_global_position, with_slot
from corpusloom.staging import stage

SHARDS, ROUNDS, PER_DOCUMENT = 40, 3, 16
# Share of a shard's quota that seeds may take.
SEEDED = 0.9


def _propagate(labels: DataFrame, quotas: list[int], rounds: int) -> DataFrame:
    """Move linked documents ``(pos, link, shard)`` towards their neighbours' shards."""
    shards = len(quotas)
    for _ in range(rounds):
        held = {r["shard"]: r["n"] for r in labels.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        room = F.array(*[F.lit(quotas[s] - held.get(s, 0)).cast("bigint") for s in range(shards)])
        votes = labels.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"))
        wanted = (
            votes.groupBy("link").agg(F.max(F.struct("n", (-F.col("shard")).alias("s"))).alias("top"), F.count(F.lit(1)).alias("spread"))
            .where("spread > 1").select("link", (-F.col("top.s")).alias("to"))
        )
        # Only groups with several labels are left; their moves are counted in whole (group, from) portions.
        moves = votes.join(wanted, "link").where("shard <> to").withColumn("room", F.get(room, F.col("to")))
        upto = Window.partitionBy("to").orderBy("n", "link", "shard").rowsBetween(Window.unboundedPreceding, 0)
        granted = stage(moves.withColumn("upto", F.sum("n").over(upto)).where("upto <= room").select("link", "shard", "to"), "moves")
        if granted.isEmpty():
            break
        moved = labels.join(granted, ["link", "shard"], "left")
        labels = stage(moved.select("pos", "link", F.coalesce("to", "shard").alias("shard")), "labels")
    return labels


def assign_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, text: str = "text") -> DataFrame:
    """Add ``size, text_crc32, law, shard, slot, grown_shard`` to ``docs``' ``doc_id``.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 16; ``slot`` numbers a shard's rows
    from 0 without gaps; the law is ``rows``, so ``grown_shard`` is null.  Null and empty texts are
    linked with each other.  Repeated rows are separate rows of one group; null ids are ids like
    any other, ordered first.  Fewer rows than shards leave the last shards empty; an empty table
    gives no rows.  Other columns are ignored.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    slim = stage(
        docs.select(
            "doc_id",
            (F.octet_length(whole) + PER_DOCUMENT).cast("bigint").alias("size"),
            F.crc32(whole).alias("text_crc32"),
            F.md5(whole).alias("link"),
        ),
        "slim",
    )
    # Staged, so that the join has plain sides and a very large group can be split.
    linking = stage(slim.groupBy("link").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "links")
    marked = slim.join(linking, "link", "left").withColumn("alone", F.col("copies").isNull()).withColumn("_row", F.monotonically_increasing_id())
    # Linked documents first, groups side by side.
    ranked = with_global_position(
        marked, [F.col("alone"), F.col("link"), F.col("doc_id"), F.col("_row")], "pos"
    ).select("doc_id", "size", "text_crc32", "link", "alone", "pos")
    ranked = stage(ranked, "positions")
    totals = ranked.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("alone")).alias("linked")).first()
    n, linked = totals["n"], totals["linked"]
    quotas = [n * (s + 1) // shards - n * s // shards for s in range(shards)]
    longs = lambda values: F.array(*[F.lit(v).cast("bigint") for v in values])
    passed = lambda ends: F.size(F.filter(longs(ends), lambda e: e <= F.col("pos"))).cast("int")
    # Seeds fill shards in order, and leave room for moves unless nearly all documents are linked.
    seeds = [int(SEEDED * q) for q in quotas]
    seeds = seeds if sum(seeds) >= linked else quotas
    labels = ranked.where("not alone").select("pos", "link", passed(list(accumulate(seeds))).alias("shard"))
    labels = _propagate(labels, quotas, rounds) if linked else labels
    labels = stage(with_slot(labels.select("pos", "shard"), "shard", "pos", "slot"), "labels")
    held = {r["shard"]: r["n"] for r in labels.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Documents without links, in order, fill what the quotas leave free.
    starts, ends, first = [], [], linked
    for s in range(shards):
        starts.append(first - held.get(s, 0))
        first += quotas[s] - held.get(s, 0)
        ends.append(first)
    alone = ranked.where("alone").withColumn("shard", passed(ends)).withColumn("slot", F.col("pos") - F.get(longs(starts), F.col("shard")))
    placed = ranked.where("not alone").join(labels, "pos").select(*alone.columns).unionByName(alone)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "pos",
    )
