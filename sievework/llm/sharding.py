"""Shards by a weighted hash tree: region, then rack, then shard.

At each level every child draws ln(u) / weight, with u from a hash of the key and the child, and the
largest draw wins. A child's draw depends on nothing but the key and itself, so when weights change,
rows move only into or out of the subtrees whose weights changed. New shards first fill the last rack,
then open a rack, then a region; a shard that opens a region takes rows only into itself.

Slots number the rows of a shard without gaps: counts by shard and block of rows are summed, and rows
are numbered within a block; no task holds a whole shard.

Defined cases: a null key is a key like any other; null text counts 16 bytes and has the crc of empty
text; repeated rows go to the same shard and get slots of their own; equal draws (2 to the power -53)
go to the higher number; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import cut

#: Shards of a rack and racks of a region, in the order in which new shards fill them.
RACK, REGION = 5, 2
#: Rows of a block within which slots are counted.
BLOCK_BITS = 16


def tree(weights: list[float]) -> dict[int, dict[int, dict[int, float]]]:
    """region -> rack -> shard -> weight."""
    out: dict[int, dict[int, dict[int, float]]] = {}
    for shard, w in enumerate(weights):
        rack = shard // RACK
        out.setdefault(rack // REGION, {}).setdefault(rack, {})[shard] = w
    return out


def weight(node) -> float:
    return sum(map(weight, node.values())) if isinstance(node, dict) else node


def _winner(key: Column, level: int, children: dict) -> Column:
    """The child with the largest draw."""
    draws = []
    for name, below in children.items():
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(level), F.lit(name), key), 11) + 0.5) / float(1 << 53)
        draws.append(F.struct((F.log(u) / F.lit(float(weight(below)))).alias("draw"), F.lit(name).alias("name")))
    return (F.greatest(*draws) if len(draws) > 1 else draws[0])["name"]


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard of a key; shards of weight 0 are left out."""
    regions = tree([w for w in weights])
    regions = {r: {k: {s: w for s, w in shards.items() if w > 0} for k, shards in racks.items()} for r, racks in regions.items()}
    regions = {r: {k: s for k, s in racks.items() if s} for r, racks in regions.items()}
    regions = {r: racks for r, racks in regions.items() if racks}
    region = _winner(key, 0, regions)
    out = None
    for r, racks in regions.items():
        rack, inner = _winner(key, 1, racks), None
        for k, shards in racks.items():
            won = _winner(key, 2, shards)
            inner = F.when(rack == k, won) if inner is None else inner.when(rack == k, won)
        out = F.when(region == r, inner) if out is None else out.when(region == r, inner)
    return out


def assign(docs: DataFrame, shards: int = 40, weights: list[float] | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law ``key`` holds as written where the next shard opens a region, that is at counts divisible by ten
    (40, say). At others the next shard joins a region, and rows move between shards of that region as well.
    """
    weights = weights or [1.0] * shards
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + F.lit(16)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
            shard_of(F.col("doc_id"), weights).alias("shard"), shard_of(F.col("doc_id"), [*weights, 1.0]).alias("grown_shard"),
            F.monotonically_increasing_id().alias("rid"),
        ).withColumn("block", F.shiftright("rid", BLOCK_BITS))
    )
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    at = F.row_number().over(Window.partitionBy("shard", "block").orderBy("rid")) - 1
    return rows.withColumn("at", at).join(starts, ["shard", "block"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("at")).alias("slot"), "grown_shard")
