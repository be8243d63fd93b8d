"""Typed expression JSON: validation, binder names, shared subtrees, simplification, node tables.

A node is ``(constructor, payload, children)`` with tuples inside, so equal
subtrees are equal values.  One table says which fields a constructor has; all
walks are driven by it.
"""

from __future__ import annotations

import json
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: JSON key -> constructor, payload fields (name, kind), child fields.  Fixed values of the format.
SHAPES = {
    "bvar": ("BVar", (("deBruijnIndex", "index"),), ()),
    "fvar": ("FVar", (("fvarId", "text"),), ()),
    "mvar": ("MVar", (("mvarId", "text"),), ()),
    "sort": ("Sort", (("u", "text"),), ()),
    "const": ("Const", (("declName", "text"), ("us", "texts")), ()),
    "app": ("App", (), ("fn", "arg")),
    "lam": ("Lam", (("binderName", "text"), ("binderInfo", "text")), ("binderType", "body")),
    "forallE": ("ForallE", (("binderName", "text"), ("binderInfo", "text")), ("binderType", "body")),
    "letE": ("LetE", (("declName", "text"), ("nonDep", "flag")), ("type", "value", "body")),
    "lit": ("Lit", (("literal", "any"),), ()),
    "mdata": ("MData", (("data", "any"),), ("expr",)),
    "proj": ("Proj", (("typeName", "text"), ("idx", "int")), ("struct",)),
}
#: Constructors that may be given as a bare string instead of an object.
BARE = {"fvar", "mvar", "sort"}
#: Frames that walks of a tree may take; expressions of some thousand levels fit.
DEEPEST = 20_000
DROPPED_BINDERS = {"BVar", "FVar", "MVar", "Sort", "Const"}
NODE_SCHEMA = "tree_id string, node_id int, parent_id int, ord int, depth int, ctor string, label string, n_children int, error string"

Node = tuple[str, tuple, tuple]


def _payload(value, kind: str, where: str):
    plain = isinstance(value, str)
    whole = isinstance(value, int) and not isinstance(value, bool)
    good = {"text": plain, "int": whole, "index": whole or plain, "flag": isinstance(value, bool), "texts": isinstance(value, list) and all(isinstance(x, str) for x in value), "any": value is not None}
    if not good[kind]:
        raise ValueError(f"{where}: not a value of kind {kind}: {value!r}")
    return tuple(value) if kind == "texts" else value if kind != "any" or isinstance(value, str) else json.dumps(value, sort_keys=True)


def parse(data) -> Node:
    """Builds a tree from JSON text or decoded JSON; raises ValueError on anything malformed."""
    if isinstance(data, str):
        data = json.loads(data)
    if not isinstance(data, dict) or len(data) != 1:
        raise ValueError("an expression is an object with one key")
    ((key, body),) = data.items()
    if key not in SHAPES:
        raise ValueError(f"unknown constructor: {key}")
    ctor, payload, children = SHAPES[key]
    if key in BARE and isinstance(body, str):
        body = {payload[0][0]: body}
    if not isinstance(body, dict):
        raise ValueError(f"{key}: not an object")
    if missing := [f for f in (*(n for n, _ in payload), *children) if f not in body]:
        raise ValueError(f"{key}: missing {missing}")
    return ctor, tuple(_payload(body[n], k, f"{key}.{n}") for n, k in payload), tuple([parse(body[c]) for c in children])


def name_binders(node: Node, stack: tuple[str, ...] = ()) -> Node:
    """Replaces bound indices by binder names; an index beyond the binders raises.

    A binder's type is outside its scope; the value of a let is inside.
    """
    ctor, payload, children = node
    if ctor == "BVar":
        index = payload[0]
        if not isinstance(index, int) or not -len(stack) <= index < len(stack):
            raise ValueError(f"unbound index: {index}")
        return ctor, (stack[index],), ()
    if ctor in ("Lam", "ForallE", "LetE"):
        inner = (payload[0], *stack)
        return ctor, payload, (name_binders(children[0], stack), *[name_binders(c, inner) for c in children[1:]])
    return ctor, payload, tuple([name_binders(c, stack) for c in children])


def keyed(node: Node) -> tuple[str, Node, tuple]:
    """A subtree's key with the node and its keyed children; every key is built once from those below.

    Keys name the structure: binder kinds and let flags do not count.
    """
    ctor, payload, children = node
    kids = tuple([keyed(c) for c in children])
    shown = payload[:1] if ctor in ("Lam", "ForallE", "LetE") else payload
    return "-".join([ctor, *(",".join(p) if isinstance(p, tuple) else str(p) for p in shown), *(k[0] for k in kids)]), node, kids


def numbered(node: Node, ids: dict) -> tuple[int, Node, tuple]:
    """As ``keyed``, with a number for each different key, so that a node costs the same at any depth."""
    ctor, payload, children = node
    kids = tuple([numbered(c, ids) for c in children])
    shown = payload[:1] if ctor in ("Lam", "ForallE", "LetE") else payload
    told = tuple([",".join(p) if isinstance(p, tuple) else str(p) for p in shown])
    return ids.setdefault((ctor, told, tuple([k[0] for k in kids])), len(ids)), node, kids


def structural_key(node: Node) -> str:
    return keyed(node)[0]


def subtree_counts(node: Node) -> Counter:
    return _counts(keyed(node))


def _counts(top: tuple[str, Node, tuple]) -> Counter:
    counts, todo = Counter(), [top]
    while todo:
        key, _, kids = todo.pop()
        counts[key] += 1
        todo += kids
    return counts


def share_subtrees(node: Node, named: bool = True) -> Node:
    """Every repeated subtree that is no constant becomes a variable v0, v1, ... in preorder."""
    top = numbered(name_binders(node) if named else node, {})
    counts, names = _counts(top), {}

    def walk(at: tuple[int, Node, tuple]) -> Node:
        key, (ctor, payload, _), kids = at
        if ctor != "Const" and counts[key] > 1:
            return "FVar", (names.setdefault(key, f"v{len(names)}"),), ()
        return ctor, payload, tuple([walk(k) for k in kids])

    return walk(top)


def drop_simple_binders(node: Node) -> Node:
    """Removes quantifiers over leaf types, keeping their bodies as they are, to a fixed point."""
    while True:
        before = node
        node = _dropped(node)
        if node == before:
            return node


def _dropped(node: Node) -> Node:
    while node[0] == "ForallE" and node[2][0][0] in DROPPED_BINDERS:
        node = node[2][1]
    return node[0], node[1], tuple([_dropped(c) for c in node[2]])


def label(node: Node) -> str:
    ctor, payload, children = node
    if children:
        return ctor
    return f"Const({payload[0]}, {list(payload[1])!r})" if ctor == "Const" else f"{ctor}({payload[0]})"


def preorder(node: Node) -> list[tuple[int, int | None, int, int, str, str, int]]:
    """``node_id, parent_id, ord, depth, ctor, label, n_children`` in preorder."""
    out, todo = [], [(node, None, 0, 0)]
    while todo:
        at, parent, place, depth = todo.pop()
        mine = len(out)
        out.append((mine, parent, place, depth, at[0], label(at), len(at[2])))
        todo += [(c, mine, k, depth + 1) for k, c in reversed(list(enumerate(at[2])))]
    return out


def constant_names(node: Node) -> list[str]:
    """Names of constants in preorder; a projection also names its type."""
    out, todo = [], [node]
    while todo:
        at = todo.pop()
        if at[0] in ("Const", "Proj"):
            out.append(at[1][0])
        todo += reversed(at[2])
    return out


def flatten(expressions: DataFrame, id_col: str = "tree_id", json_col: str = "expression_json", share: bool = True, simplify: bool = True) -> DataFrame:
    """Node rows of each expression; a malformed one gives a single row with ``error``.

    Null expressions give an error row too.  Trees are handled one by one, so a
    task's memory is bounded by its largest tree.
    """
    names = [c.split(" ")[0] for c in NODE_SCHEMA.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int32() for c in NODE_SCHEMA.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEPEST))
        for batch in batches:
            rows = []
            for tree, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    if text is None:
                        raise ValueError("no expression")
                    node = parse(text)
                    node = share_subtrees(node) if share else node
                    node = drop_simple_binders(node) if simplify else node
                    rows += [(tree, *r, None) for r in preorder(node)]
                except (ValueError, RecursionError) as e:
                    rows.append((tree, *[None] * 7, f"{type(e).__name__}: {e}"[:500]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return expressions.select(F.col(id_col).cast("string"), json_col).mapInArrow(walk, NODE_SCHEMA)


def constant_tokens(expressions: DataFrame, id_col: str = "tree_id", json_col: str = "expression_json") -> DataFrame:
    """``tree_id, name``: constants of the expressions as they stand, each occurrence a row.

    Nothing is shared or simplified first, and a projection names its type.
    Null and malformed expressions have none.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEPEST))
        for batch in batches:
            ids, names = [], []
            for tree, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = constant_names(parse(text)) if text is not None else []
                except (ValueError, RecursionError):
                    found = []
                ids += [tree] * len(found)
                names += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(names, pa.string())], ["tree_id", "name"])

    return expressions.select(F.col(id_col).cast("string"), json_col).mapInArrow(walk, "tree_id string, name string")


def subtree_keys(nodes: DataFrame) -> DataFrame:
    """``tree_id, node_id, depth, key``: structural keys built level by level, deepest first, from a node table."""
    deepest = nodes.agg(F.max("depth")).first()[0]
    keys = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        here = nodes.where(F.col("depth") == depth).select("tree_id", "node_id", "parent_id", "ord", "depth", "label")
        if keys is None:
            level = here.withColumn("key", F.col("label"))
        else:
            below = keys.where(F.col("depth") == depth + 1).groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "key"))).alias("below"))
            level = here.join(below, ["tree_id", "node_id"], "left").withColumn("key", F.concat_ws("-", F.array("label"), F.transform("below", lambda x: x["key"]))).select("tree_id", "node_id", "parent_id", "ord", "depth", "label", "key")
        keys = level if keys is None else keys.unionByName(level)
    if keys is None:
        return nodes.select("tree_id", "node_id", "depth", F.col("label").alias("key")).limit(0)
    return keys.select("tree_id", "node_id", "depth", "key")
