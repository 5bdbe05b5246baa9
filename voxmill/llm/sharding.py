"""Shards by k-d tree: split at weighted medians along the widest metadata dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running_totals, settled, table

SHARDS = 40
ROW_BYTES = 16
#: A cut moves to the border of a group of equal texts where that shifts no more than this share of a shard.
GROUP_TOLERANCE = 0.01
#: Copies of a text share all of these. The source does not serve: copies come from many sources and would be torn apart.
DIMENSIONS = ("_d_size", "_d_lang", "_d_script")


def kd_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row, with the shards' bytes near equal.

    Each level cuts every open node, with its share of leaves, at the weighted quantile of
    its widest dimension (log size, language, share of
    non-ASCII bytes), found by a
    range-dealt running sum; the number of nodes is at most `shards`. Equal texts stand
    together in each order, so one cut parts at most one group of copies, and none where the
    border of a small group is within the tolerance. Null texts have no bytes of their own;
    null and clashing metadata are values like any other; an empty table gives no rows.
    """
    coded = lambda c: F.coalesce(F.xxhash64(F.col(c).cast("string")).bitwiseAND(0xFFFF), F.lit(-1)) / 65536.0
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_text"),
        (F.log2(F.octet_length(text) + 1.0) / 32).alias("_d_size"),
        (coded("lang") if "lang" in docs.columns else F.lit(0.0)).alias("_d_lang"),
        (1 - F.char_length(text) / F.greatest(F.octet_length(text), F.lit(1))).alias("_d_script"),
    )
    rows = settled(rows.withColumn("_first", F.lit(0)).withColumn("_leaves", F.lit(shards)))
    spread = [(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]
    while True:
        nodes = rows.where("_leaves > 1").groupBy("_first", "_leaves").agg(F.sum("size").alias("total"), *spread).collect()  # at most `shards` rows
        if not nodes:
            break
        along, goal = F.lit(0.0), F.lit(None).cast("double")
        slack = min(n.total / n._leaves for n in nodes) * GROUP_TOLERANCE
        for n in nodes:
            widest = max(DIMENSIONS, key=lambda d: n[d])
            along = F.when(F.col("_first") == n._first, F.col(widest)).otherwise(along)
            goal = F.when(F.col("_first") == n._first, F.lit(n.total * (n._leaves // 2) / n._leaves)).otherwise(goal)
        inner, leaf = rows.where("_leaves > 1"), rows.where("_leaves = 1")
        order = ["_along", "_text", "doc_id", "_tie"]
        inner = running_totals(inner.withColumn("_along", along).withColumn("_tie", F.monotonically_increasing_id()), ["_first"], order, ["size"])
        # The copies that share their place in the order move together if they are few bytes.
        group = inner.groupBy("_first", "_along", "_text").agg(F.min("size_before").alias("_from"), F.sum("size").alias("_bytes"))
        cut = group.withColumn("_goal", goal).where("_from < _goal and _goal < _from + _bytes").where(F.col("_bytes") <= 2 * slack)
        moved = {r._first: (r._from, r._from + r._bytes) for r in cut.collect()}  # at most one row a node
        at = goal
        for n in nodes:
            if n._first in moved:
                g = n.total * (n._leaves // 2) / n._leaves
                border = min(moved[n._first], key=lambda b, g=g: abs(b - g))
                at = F.when(F.col("_first") == n._first, F.lit(float(border))).otherwise(at)
        left = F.floor(F.col("_leaves") / 2).cast("int")
        below = F.col("size_before") + F.col("size") / 2 < at
        inner = inner.withColumn("_below", below).select(
            *[c for c in rows.columns if c not in ("_first", "_leaves")],
            F.when(F.col("_below"), F.col("_first")).otherwise(F.col("_first") + left).alias("_first"),
            F.when(F.col("_below"), left).otherwise(F.col("_leaves") - left).alias("_leaves"),
        )
        rows = settled(leaf.unionByName(inner))
    placed = rows.select("doc_id", "size", "text_crc32", "_text", F.col("_first").alias("shard"), F.lit(1).alias("_n"), F.monotonically_increasing_id().alias("_tie"))
    return running_totals(placed, ["shard"], ["_text", "doc_id", "_tie"], ["_n"]).select(
        "doc_id", "size", "text_crc32", "shard", F.col("_n_before").cast("long").alias("slot")
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
