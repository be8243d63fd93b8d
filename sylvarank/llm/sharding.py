"""K-d tree sharding of documents by metadata, with DataFrame operations only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import dense_ranks
from .common import broadcast_if_few, stage

#: Bits of a coordinate's value and of the tie-breaking hash in a cut key.
TIE_BITS = 20
#: Values of a dimension, scaled to the whole table's range, run from 0 to this.
VALUE_TOP = float(1 << 30)


def _units(docs: DataFrame, id_col: str, text_col: str, meta: list[str], unit_bytes: float) -> tuple[DataFrame, DataFrame]:
    """Documents with their group and unit; units with their weight and coordinates.

    A group holds the documents with one text.  A heavy group is dealt, by id
    hash, to as many units as keep each small; others are one unit.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    size = F.octet_length(text).cast("long") + 8
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("grp"), *(F.col(c).cast("string").alias(f"m{i}") for i, c in enumerate(meta)))
    groups = rows.groupBy("grp").agg(F.sum("size").alias("weight"), F.max("size").alias("size"), *(F.min(f"m{i}").alias(f"m{i}") for i in range(len(meta))))
    heavy = groups.where(F.col("weight") > unit_bytes).select("grp", F.ceil(F.col("weight") / unit_bytes).alias("parts"))  # at most total / unit_bytes rows
    rows = rows.drop(*(f"m{i}" for i in range(len(meta)))).join(F.broadcast(heavy), "grp", "left")
    rows = rows.withColumn("unit", F.when(F.col("parts") > 1, F.pmod(F.xxhash64(F.col("doc_id")), F.col("parts"))).otherwise(F.lit(0)).cast("long")).drop("parts")
    rows = stage(rows, "shard-rows")  # so that the sums below start from unsorted rows and combine within tasks
    units = rows.groupBy("grp", "unit").agg(F.sum("size").alias("weight")).join(groups.drop("weight"), "grp")
    return rows, units


def _of(node: Column, values: list, kind: str = "bigint") -> Column:
    """The node's entry in a list with one value for each node of the level.

    The list is one literal, so a plan does not grow with the number of nodes.
    """
    return F.element_at(F.from_json(F.lit(json.dumps(values)), F.lit(f"array<{kind}>")), (node + 1).cast("int"))


def _with_codes(units: DataFrame, columns: list[str]) -> DataFrame:
    """``units`` with each metadata column replaced by the rank of its value among the distinct ones; null is the empty text."""
    for column in columns:
        ranks = dense_ranks(units.select(F.coalesce(F.col(column), F.lit("")).alias("value")))
        units = units.withColumn("value", F.coalesce(F.col(column), F.lit(""))).join(broadcast_if_few(ranks, 100_000), "value").drop("value", column).withColumn(column, F.col("rank").cast("double")).drop("rank")
    return units


def kd_shards(
    docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text",
    metadata: tuple[str, ...] = ("lang", "source"), tolerance: float = 0.01, bins: int = 4096, rows_per_bucket: int = 50_000,
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: shards of near-equal bytes.

    Each tree node is split at the weighted median (weight: bytes) along its
    widest dimension (a metadata value counts by its rank among the distinct ones), until leaves reach the target, ``target_bytes`` or an
    equal part of the total; a node that stands for an odd number of leaves is
    split in that proportion.  The dimensions are the logarithm of the size and
    the metadata columns, each scaled to the whole table's range.  Equal texts
    form one group with common coordinates and stay together, unless a cut goes
    through the group: a group of more bytes than ``tolerance`` of a leaf is dealt to
    units of that size first, which may part.  A unit is never smaller than the
    longest document, beyond which equal bytes cannot be had anyway.

    The medians are found by weighted histograms of ``bins`` cells, refined
    around the cut until what is left in the cell is within the tolerance; the
    driver gets one row per node and round.  Slots are counted within buckets of
    ids and shifted by the earlier buckets' counts, so no task holds a shard.

    Null texts have size 8.  Null metadata sort first.  Rows with equal or null
    ids keep a row and a slot each.  An empty table gives no rows.
    """
    octets = F.octet_length(F.col(text_col))
    total, count, longest = docs.agg(F.sum(F.coalesce(octets, F.lit(0)).cast("long") + 8), F.count("*"), F.max(octets)).first()
    total = total or 0
    leaves = shards or max(1, math.ceil(total / (target_bytes or max(total, 1))))
    leaf = max(1.0, total / leaves)
    rows, units = _units(docs, id_col, text_col, list(metadata), max(tolerance * leaf, (longest or 0) + 8))
    dims = [F.log2(F.col("size")), *(F.col(f"m{i}") for i in range(len(metadata)))]
    names = [f"d{i}" for i in range(len(dims))]
    tie = F.shiftrightunsigned(F.xxhash64("grp", "unit"), 64 - TIE_BITS)
    units = _with_codes(units, [f"m{i}" for i in range(len(metadata))]) if count else units
    units = units.select("grp", "unit", "weight", tie.alias("tie"), *(d.cast("double").alias(n) for d, n in zip(dims, names)))
    ranges = lambda df: df.agg(F.sum("weight").alias("w"), *(F.struct(F.min(n).alias("lo"), F.max(n).alias("hi")).alias(n) for n in names))
    if count:
        units = stage(units, "shard-units")
        whole = ranges(units.groupBy()).first()
        units = units.select("grp", "unit", "weight", "tie", *(((F.col(n) - whole[n].lo) / max(whole[n].hi - whole[n].lo, 1e-12) * VALUE_TOP).cast("long").alias(n) for n in names))
    live = units.withColumn("node", F.lit(0))
    nodes = [(0, leaves)]  # of each node, its first shard and its number of shards
    at = F.col("node")
    while count and max(n for _, n in nodes) > 1:
        splits = _of(at, [int(n > 1) for _, n in nodes]) == 1
        here = live.where(splits)
        stats = {r["node"]: r for r in ranges(here.groupBy("node")).collect()}
        stats = {i: r for i, r in stats.items() if nodes[i][1] > 1}
        per_node = lambda d, default: [d.get(i, default) for i in range(len(nodes))]
        widest = {i: max(range(len(dims)), key=lambda k, r=r: r[names[k]].hi - r[names[k]].lo) for i, r in stats.items()}
        chosen = _of(at, per_node(widest, 0))
        value = F.coalesce(*(F.when(chosen == k, F.col(n)) for k, n in enumerate(names)))
        live = live.withColumn("key", F.shiftleft(value, TIE_BITS) + F.col("tie"))
        goal = {i: r["w"] * (nodes[i][1] // 2) / nodes[i][1] for i, r in stats.items()}
        # of each node, the first key and the width of the range that holds the cut, and the weight before it
        search = {i: (r[names[widest[i]]].lo << TIE_BITS, (r[names[widest[i]]].hi - r[names[widest[i]]].lo + 1) << TIE_BITS, 0) for i, r in stats.items()}
        cuts: dict[int, int] = {}
        while search:
            cell = {i: max(1, -(-width // bins)) for i, (_, width, _) in search.items()}
            low = _of(at, per_node({i: v[0] for i, v in search.items()}, 0))
            end = _of(at, per_node({i: v[0] + v[1] for i, v in search.items()}, -1))
            inside = live.where((F.col("key") >= low) & (F.col("key") < end))
            hist = inside.groupBy("node", F.floor((F.col("key") - low) / _of(at, per_node(cell, 1))).alias("cell")).agg(F.sum("weight").alias("w"))
            run = hist.withColumn("upto", F.sum("w").over(Window.partitionBy("node").orderBy("cell")))
            need = _of(at, [float(goal[i] - search[i][2]) if i in search else 0.0 for i in range(len(nodes))], "double")
            found = {r["node"]: r["h"] for r in run.where(F.col("upto") >= need).groupBy("node").agg(F.min(F.struct("cell", "w", "upto")).alias("h")).collect()}
            for i in list(search):
                first, width, before = search.pop(i)
                if i not in found:  # all of the range lies below the cut
                    cuts[i] = first + width
                    continue
                h = found[i]
                start, start_w = first + h["cell"] * cell[i], before + h["upto"] - h["w"]
                if cell[i] == 1 or h["w"] <= tolerance * leaf:
                    cuts[i] = start if goal[i] - start_w < h["w"] / 2 else start + cell[i]
                else:
                    search[i] = (start, cell[i], start_w)
        grown, moved = [], []
        for i, (first, n) in enumerate(nodes):
            moved.append(len(grown))
            grown += [(first, n // 2), (first + n // 2, n - n // 2)] if n > 1 else [(first, n)]
        right = F.when(splits, (F.col("key") >= _of(at, per_node(cuts, 0))).cast("int")).otherwise(0)
        live = stage(live.withColumn("node", _of(at, moved) + right).drop("key"), "shard-tree")
        nodes = grown
    leaf_of = live.select("grp", "unit", _of(at, [first for first, _ in nodes]).cast("int").alias("shard"))
    buckets = max(1, -(-count // rows_per_bucket))
    placed = rows.join(leaf_of, ["grp", "unit"]).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets * 8)))
    placed = stage(placed.select("doc_id", "size", "text_crc32", "shard", "bucket"), "shard-placed")
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    ranked = placed.withColumn("rank", F.row_number().over(order) - 1)
    return ranked.join(bases, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank")).cast("long").alias("slot"))
