"""Exact tree edit distance of ordered trees, batched over pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LEAF_KINDS


class Postorder:
    """What the forest recurrence needs of a tree: labels, leftmost leaves, keyroots, subtree ids."""

    def __init__(self, depths: tuple[int, ...], labels: tuple[str, ...], ids: dict):
        children: list[list[int]] = [[] for _ in depths]
        path: list[int] = []
        for k, d in enumerate(depths):
            del path[d:]
            if path:
                children[path[-1]].append(k)
            path.append(k)
        order, todo = [], [(0, False)] if depths else []
        while todo:
            k, done = todo.pop()
            if done:
                order.append(k)
            else:
                todo.append((k, True))
                todo += [(c, False) for c in reversed(children[k])]
        place = {k: i for i, k in enumerate(order)}
        self.labels = [labels[k] for k in order]
        self.leftmost, self.subtree = [], []
        for i, k in enumerate(order):
            kids = [place[c] for c in children[k]]
            self.leftmost.append(self.leftmost[kids[0]] if kids else i)
            self.subtree.append(ids.setdefault((labels[k], tuple(self.subtree[c] for c in kids)), len(ids)))
        last = {left: i for i, left in enumerate(self.leftmost)}
        self.keyroots = sorted(last.values())


def edit_distance(left: Postorder, right: Postorder, insert: float = 1.0, delete: float = 1.0, replace: float = 0.4, scale: float = 0.2, prefixes: tuple[str, ...] = LEAF_KINDS) -> float:
    """Least cost of edits; simple nodes (by label prefix) cost ``scale`` times as much and are renamed for nothing.

    Renaming is free between equal whole subtrees.  Both trees must share the
    dictionary of subtree ids.
    """
    marks = tuple(f"{p}(" for p in prefixes)
    simple_l, simple_r = ([x.startswith(marks) for x in t.labels] for t in (left, right))
    drop = [delete * (scale if s else 1) for s in simple_l]
    add = [insert * (scale if s else 1) for s in simple_r]
    n, m = len(drop), len(add)
    if not n or not m:
        return float(sum(drop) + sum(add))
    tree = [[0.0] * m for _ in range(n)]
    for i in left.keyroots:
        a = left.leftmost[i]
        for j in right.keyroots:
            b = right.leftmost[j]
            above = [0.0]
            for y in range(b, j + 1):
                above.append(above[-1] + add[y])
            forest = [above]
            for x in range(a, i + 1):
                row, lx, cost, whole = [above[0] + drop[x]], left.leftmost[x], drop[x], left.leftmost[x] == a
                below = forest[lx - a]
                for y in range(b, j + 1):
                    k = y - b
                    best = min(above[k + 1] + cost, row[k] + add[y])
                    if whole and right.leftmost[y] == b:
                        free = simple_l[x] or simple_r[y] or left.subtree[x] == right.subtree[y]
                        best = min(best, above[k] + (0.0 if free else replace))
                        tree[x][y] = best
                    else:
                        best = min(best, below[right.leftmost[y] - b] + tree[x][y])
                    row.append(best)
                forest.append(row)
                above = row
    return tree[n - 1][m - 1]


def similarity(distance: float, left_size: int, right_size: int) -> float:
    """One less the distance over the larger size; 0 without nodes.  May be negative."""
    larger = max(left_size, right_size)
    return 1 - distance / larger if larger else 0.0


def tree_arrays(nodes: DataFrame) -> DataFrame:
    """``tree_id, depths, labels, size``: a tree as arrays in preorder."""
    rows = nodes.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "depth", "label"))).alias("t"))
    return rows.select("tree_id", F.transform("t", lambda x: x["depth"]).alias("depths"), F.transform("t", lambda x: x["label"]).alias("labels"), F.size("t").alias("size"))


def ted_scores(pairs: DataFrame, nodes: DataFrame, size_cutoff: int | None = None, insert: float = 1.0, delete: float = 1.0, replace: float = 0.4, scale: float = 0.2, raw: DataFrame | None = None) -> DataFrame:
    """``query_id, name, teds`` of pairs of trees; null for queries of more than ``size_cutoff`` nodes.

    Pairs of equal shapes are computed once; pairs over the cutoff never reach
    Python.  Tree ids without nodes give null.  Distances are taken over the
    larger of the candidate's size and the query's, which is its ``raw_size``
    where ``raw`` (``query_id, raw_size``) has one.
    """
    trees = tree_arrays(nodes).withColumn("shape", F.md5(F.concat_ws("|", F.transform("depths", lambda d: d.cast("string")), F.col("labels"))))
    keyed = pairs.select("query_id", "name").join(trees.select(F.col("tree_id").alias("query_id"), F.col("shape").alias("qs"), F.col("size").alias("q_size")), "query_id", "left").join(trees.select(F.col("tree_id").alias("name"), F.col("shape").alias("cs"), F.col("size").alias("c_size")), "name", "left")
    keyed = keyed.withColumn("base", F.col("q_size")) if raw is None else keyed.join(raw.select("query_id", F.col("raw_size").alias("base")), "query_id", "left").withColumn("base", F.coalesce("base", "q_size"))
    asked = keyed if size_cutoff is None else keyed.where(F.col("q_size") <= size_cutoff)
    shapes = trees.groupBy("shape").agg(F.first("depths").alias("depths"), F.first("labels").alias("labels"))
    work = asked.where("qs is not null and cs is not null").select("qs", "cs").distinct().join(shapes.select(F.col("shape").alias("qs"), F.col("depths").alias("qd"), F.col("labels").alias("ql")), "qs").join(shapes.select(F.col("shape").alias("cs"), F.col("depths").alias("cd"), F.col("labels").alias("cl")), "cs")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: dict = {}
        build = lru_cache(10_000)(lambda d, labels: Postorder(d, labels, ids))
        for pdf in frames:
            out = []
            for qd, ql, cd, cl in zip(pdf["qd"], pdf["ql"], pdf["cd"], pdf["cl"]):
                left, right = build(tuple(qd), tuple(ql)), build(tuple(cd), tuple(cl))
                out.append(edit_distance(left, right, insert, delete, replace, scale))
            yield pd.DataFrame({"qs": pdf["qs"], "cs": pdf["cs"], "distance": out})

    scored = work.mapInPandas(run, "qs string, cs string, distance double")
    over = F.lit(False) if size_cutoff is None else F.col("q_size") > size_cutoff
    return keyed.join(scored, ["qs", "cs"], "left").select("query_id", "name", F.when(~over, 1 - F.col("distance") / F.greatest("base", "c_size")).alias("teds"))
