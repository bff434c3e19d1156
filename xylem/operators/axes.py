"""The 13 axes as joins of a context with the node table, and node tests as filters.

Contexts come as (doc_id, org, x_pre, x_size, x_parent, x_sib, x_kind): org is
the node for which the path is evaluated, x the node that the step starts at.
Every join is an equality on doc_id at least, so intervals are residual
conditions of hash joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xylem.model import NODE_COLUMNS
from xylem.plans.ast import REVERSE, Test

TREE = "kind NOT IN ('attr', 'ns')"
#: A step to a distinct set of nodes from a distinct one.
EQUI = {"child", "attribute", "self"}


def test_condition(t: Test, axis: str) -> Column | None:
    """The filter of a node test; None if every node passes."""
    kind = F.col("kind")
    if axis == "attribute":
        own = kind == "attr"
    elif axis == "namespace":
        own = kind == "ns"
    else:
        own = kind == "element"
    if t.kind == "node":
        return own if axis in ("attribute", "namespace") else None
    if t.kind in ("text", "comment", "pi"):
        if axis in ("attribute", "namespace"):
            return F.lit(False)
        return (kind == t.kind) & (F.col("local") == t.local) if t.local is not None else kind == t.kind
    if t.kind == "any":
        return own
    if axis == "namespace":
        return own & (F.col("local") == t.local) if t.kind in ("name", "local") and not t.prefix else F.lit(False)
    if t.kind == "local":
        return own & (F.col("local") == t.local)
    if t.kind == "prefix":
        return own & (F.col("ns_uri") == t.uri)
    return own & (F.col("local") == t.local) & (F.col("ns_uri") == t.uri if t.uri is not None else F.col("ns_uri").isNull())


def as_context(rows: DataFrame) -> DataFrame:
    """Rows with doc_id, org and node columns as contexts of a step."""
    return rows.select("doc_id", "org", *(F.col(c).alias(f"x_{c}") for c in ("pre", "size", "parent", "sib", "kind")))


def _join(ctx: DataFrame, n: DataFrame, *conditions: str, equal: dict[str, str] | None = None) -> DataFrame:
    """ctx joined with nodes on doc_id, on equal (node column: context column) and on conditions; result: doc_id, org, x_pre, node columns."""
    right = n.withColumnRenamed("doc_id", "n_doc")
    on = F.col("doc_id") == F.col("n_doc")
    for a, b in (equal or {}).items():
        on &= F.col(a) == F.col(b)
    for c in conditions:
        on &= F.expr(c)
    return ctx.join(right, on).select("doc_id", "org", "x_pre", *NODE_COLUMNS[1:])


def step(ctx: DataFrame, nodes: DataFrame, axis: str, test: Test) -> DataFrame:
    """(doc_id, org, x_pre, node columns) of every node on the axis of every context that passes the test."""
    condition = test_condition(test, axis)
    n = nodes if condition is None else nodes.where(condition)
    if axis == "child":
        return _join(ctx, n.where(TREE), equal={"parent": "x_pre"})
    if axis == "attribute":
        return _join(ctx, n, equal={"parent": "x_pre"})
    if axis == "descendant":
        return _join(ctx, n.where(TREE), "pre > x_pre", "pre <= x_pre + x_size")
    if axis == "descendant-or-self":
        return _join(ctx, n, "pre >= x_pre", "pre <= x_pre + x_size", f"({TREE} OR pre = x_pre)")
    if axis == "parent":
        return _join(ctx, n, equal={"pre": "x_parent"})
    if axis == "ancestor":
        return _join(ctx, n, "pre < x_pre", "x_pre <= pre + size")
    if axis == "ancestor-or-self":
        return _join(ctx, n, "pre <= x_pre", "x_pre <= pre + size")
    if axis == "self":
        return _join(ctx, n, equal={"pre": "x_pre"})
    if axis == "following-sibling":
        return _join(ctx, n, "sib > x_sib", equal={"parent": "x_parent"})
    if axis == "preceding-sibling":
        return _join(ctx, n, "sib < x_sib", equal={"parent": "x_parent"})
    if axis == "following":
        return _join(ctx, n.where(TREE), "pre > x_pre + x_size")
    if axis == "preceding":
        return _join(ctx, n.where(TREE), "pre + size < x_pre")
    return _namespaces(ctx, nodes, n)


def _namespaces(ctx: DataFrame, nodes: DataFrame, n: DataFrame) -> DataFrame:
    """The nearest declaration of each prefix on the context or an ancestor; elements only; undeclared prefixes have none."""
    owner = nodes.where("kind = 'element'").select(F.col("doc_id").alias("o_doc"), F.col("pre").alias("o_pre"), F.col("size").alias("o_size"))
    declared = n.join(owner, (F.col("doc_id") == F.col("o_doc")) & (F.col("parent") == F.col("o_pre"))).drop("o_doc")
    right = declared.withColumnRenamed("doc_id", "n_doc")
    on = (F.col("doc_id") == F.col("n_doc")) & F.expr("o_pre <= x_pre AND x_pre <= o_pre + o_size")
    met = ctx.where("x_kind = 'element'").join(right, on)
    near = Window.partitionBy("doc_id", "org", "x_pre", "local").orderBy(F.col("o_pre").desc())
    return met.withColumn("_near", F.row_number().over(near)).where("_near = 1 AND value <> ''").select("doc_id", "org", "x_pre", *NODE_COLUMNS[1:])


def all_following(ctx: DataFrame, nodes: DataFrame, test: Test) -> DataFrame:
    """following:: of many contexts at once: what begins after the context that ends first."""
    first = ctx.groupBy("doc_id", "org").agg(F.min(F.expr("x_pre + x_size")).alias("x_pre"))
    return _join(first, _tested(nodes, test, "following"), "pre > x_pre")


def all_preceding(ctx: DataFrame, nodes: DataFrame, test: Test) -> DataFrame:
    """preceding:: of many contexts at once: what ends before the context that begins last."""
    last = ctx.groupBy("doc_id", "org").agg(F.max("x_pre").alias("x_pre"))
    return _join(last, _tested(nodes, test, "preceding"), "pre + size < x_pre")


def _tested(nodes: DataFrame, test: Test, axis: str) -> DataFrame:
    condition = test_condition(test, axis)
    tree = nodes.where(TREE)
    return tree if condition is None else tree.where(condition)


def proximity(axis: str, *groups: str):
    """The window of proximity positions on an axis."""
    order = F.col("pre").desc() if axis in REVERSE else F.col("pre").asc()
    return Window.partitionBy("doc_id", *groups).orderBy(order)
