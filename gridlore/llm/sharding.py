"""Sharding by a hierarchical weighted hash tree.

Regions hold racks, racks hold shards; a node weighs what the shards below it weigh. A document descends
from the top: at each level every child draws weight-scaled exponential time -ln(u) / weight from a hash of
document and child, and the least wins. A child's draw depends on its own weight alone, so a change of
weight moves documents only into or out of the subtrees whose weights change. A grown tree gets its new
shard as a region of its own: no other weight changes, so the new shard takes documents only into itself.

Null ids and texts are hashed as such and placed; empty texts have size 1; very long texts are digested whole, in
place. Rows that share an id share a shard, in slots of their own; equal draws, as good as impossible, go to the
first child. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm import common


@dataclass(frozen=True)
class Tree:
    """regions[i][j] is a rack: the (shard, weight) pairs it holds."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @classmethod
    def regular(cls, shards: int, racks: int = 2, per_rack: int = 2) -> Tree:
        """Whole regions of racks x per_rack shards, then a region for each shard left over."""
        size = racks * per_rack
        whole = shards // size * size
        regions = [tuple(tuple((s, 1.0) for s in range(r, r + per_rack)) for r in range(b, b + size, per_rack)) for b in range(0, whole, size)]
        return cls(tuple(regions) + tuple((((s, 1.0),),) for s in range(whole, shards)))

    def grown(self, weight: float = 1.0) -> Tree:
        new = 1 + max((s for region in self.regions for rack in region for s, _ in rack), default=-1)
        return Tree((*self.regions, (((new, weight),),)))


def draw(key: Column, node: str, weight: float) -> Column:
    """Exponential time of rate `weight`, from 60 bits of a hash of the document's key and the node's name."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(node))), 1, 15), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(2**60))) / F.lit(float(weight))


def least(key: Column, nodes: list[tuple[str, float, Column]]) -> Column:
    """What the node with the least draw stands for."""
    if len(nodes) == 1:
        return nodes[0][2]
    return F.least(*(F.struct(draw(key, name, w).alias("t"), F.lit(i).alias("i"), down.alias("s")) for i, (name, w, down) in enumerate(nodes) if w > 0))["s"]


def assign(key: Column, tree: Tree) -> Column:
    regions = []
    for i, region in enumerate(tree.regions):
        racks = []
        for j, rack in enumerate(region):
            shards = [(f"shard{s}", w, F.lit(s)) for s, w in rack]
            racks.append((f"region{i}rack{j}", sum(w for _, w in rack), least(key, shards)))
        regions.append((f"region{i}", sum(w for _, w, _ in racks), least(key, racks)))
    return least(key, regions)


def shard(docs: DataFrame, tree: Tree, part_rows: int = 200_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard. Texts are digested where they are read;
    only the digests are shuffled, a shard in parts of about `part_rows` rows."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    placed = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        assign(key, tree).alias("shard"),
        assign(key, tree.grown()).alias("grown_shard"),
    )
    placed = common.scratch(placed, "shards")
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    ranked = common.rank_within(placed, ["shard"], order, "slot", part_rows)
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long"), "grown_shard")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.table(spark, sf_dir, "documents"), Tree.regular(8))
