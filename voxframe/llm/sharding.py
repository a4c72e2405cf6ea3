"""Shards by a hierarchical weighted hash tree: region, rack, shard.

A document descends the tree and at every level enters the child with the least
draw ``-ln(u) / weight``, where ``u`` is hashed from the key and the child's place
in the tree and the weight is the sum of what lies below. Draws of different nodes
are independent, so only the children of the nodes it passes are hashed, and a
changed weight moves documents only into or out of the subtree it belongs to.

A shard added to a region that exists raises the weight of that region. The old
weight keeps its draw; the increment is a candidate of its own beside the regions,
leading straight to the new shard. So one more shard takes documents only into
itself, wherever it is put, and takes its share. The ``generation`` of a shard
says when it came; a region consists of those of its first generation, later ones
are increments. A shard that opens a region is reached through it.

NULL ids hash as the empty string, NULL texts have no bytes, repeated rows get
the same shard and slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage

HASH_BITS = 52


@dataclass(frozen=True)
class Shard:
    number: int
    region: int
    rack: int
    weight: float = 1.0
    generation: int = 0


def tree(shards: int, racks_per_region: int = 3, shards_per_rack: int = 4) -> list[Shard]:
    """Equal shards that fill rack after rack and region after region."""
    per_region = racks_per_region * shards_per_rack
    return [Shard(i, i // per_region, i // shards_per_rack) for i in range(shards)]


def grown_from(shards: Sequence[Shard], grown: Sequence[Shard]) -> list[Shard]:
    """``grown`` with its new shards marked as later than all of ``shards``, which it must hold unchanged."""
    old = {s.number: s for s in shards}
    latest = max((s.generation for s in shards), default=-1)
    if any(old.get(s.number, s) != s for s in grown) or not set(old) <= {s.number for s in grown}:
        raise ValueError("a grown tree keeps the old shards with their places and weights")
    return [s if s.number in old else replace(s, generation=latest + 1) for s in grown]


def children(shards: Sequence[Shard]) -> dict[str, list[tuple[str, float]]]:
    """The tree by paths: what can be entered from each node, and its weight.

    ``""`` leads to regions ``/0`` and to increments ``+24``, a region to racks ``/0/2``, a rack to shards ``/0/2/9``.
    """
    first: dict[int, int] = {}
    for s in shards:
        first[s.region] = min(first.get(s.region, s.generation), s.generation)
    found: dict[str, dict[str, float]] = {}
    for s in sorted(shards, key=lambda s: s.number):
        if s.generation > first[s.region]:
            found.setdefault("", {})[f"+{s.number}"] = s.weight
            continue
        path = ["", f"/{s.region}", f"/{s.region}/{s.rack}", f"/{s.region}/{s.rack}/{s.number}"]
        for above, below in zip(path, path[1:]):
            held = found.setdefault(above, {})
            held[below] = held.get(below, 0.0) + s.weight
    return {above: list(held.items()) for above, held in found.items()}


def descend(rows: DataFrame, key: str, shards: Sequence[Shard], out: str) -> DataFrame:
    """``rows`` with the shard of ``key`` as column ``out``: one node entered a level, and only its children hashed."""
    nodes = F.create_map(*[x for above, held in children(shards).items() for x in (
        F.lit(above), F.array(*[F.struct(F.lit(below).alias("node"), F.lit(float(weight)).alias("weight")) for below, weight in held]))])
    path = f"{out}_path"
    at = rows.withColumn(path, F.lit(""))
    for _ in range(3):
        def draw(child: Column) -> Column:
            digest = F.md5(F.concat(F.col(key), child["node"]).cast("binary"))
            u = (F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("double") + 0.5) / float(2**HASH_BITS)
            return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["node"].alias("node"))

        entered = F.array_min(F.transform(F.element_at(nodes, F.col(path)), draw))["node"]
        # an increment is at its shard already
        at = at.withColumn(path, F.when(F.startswith(F.col(path), F.lit("+")), F.col(path)).otherwise(entered))
    return at.withColumn(out, F.regexp_extract(path, "([0-9]+)$", 1).cast("int")).drop(path)


def assign(docs: DataFrame, shards: Sequence[Shard], grown: Sequence[Shard], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot, grown_shard)``.

    Slots count the rows of a shard from 0 without gaps. A shard is cut into
    pieces by a hash, pieces are numbered on their own and shifted by the sizes
    of the pieces before them, so no task holds a whole shard.
    """
    # written once: two branches read it, and neither needs the texts again
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_key"),
    )
    placed = descend(descend(rows, "_key", shards, "shard"), "_key", grown_from(shards, grown), "grown_shard")
    rows = cut_lineage(placed.drop("_key"))
    pieces = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.withColumn("_piece", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(pieces)).cast("int"))
    sizes = cut.groupBy("shard", "_piece").agg(F.count("*").alias("_n"))
    before = W.partitionBy("shard").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("shard", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("shard", "_piece").orderBy("doc_id", "text_crc32", "size")
    return (
        cut.withColumn("_at", F.row_number().over(inside))
        .join(starts, ["shard", "_piece"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_at") - 1).cast("bigint").alias("slot"), "grown_shard")
    )
