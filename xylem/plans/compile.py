"""Loop lifting: an XPath expression becomes a DataFrame plan for all contexts at once.

A loop is a DataFrame with one row for each evaluation: the context node's
columns (doc_id, pre, ...), its position and size where they are needed, and
whatever the caller carries along. A scalar becomes a Column over the loop,
after joins that keep its rows; a node-set becomes rows (doc_id, org, node
columns), org being the context's pre. Node-sets depend on their context node
only, so inner loops need no keys of outer ones. What depends on the document
alone (absolute paths) is one set for each document.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xylem.functions import scalars as x
from xylem.model import NODE_COLUMNS, XPathTypeError
from xylem.operators import axes
from xylem.plans.ast import Call, Chain, Expr, Filter, Literal, Negate, Number, Path, Step, Union, Variable
from xylem.plans.parser import is_numeric, uses_position

COMPARISONS = ("=", "!=", "<", "<=", ">", ">=")
FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "=", "!=": "!="}
NUMERIC = {"last", "position", "count", "string-length", "number", "sum", "floor", "ceiling", "round"}
BOOLEAN = {"starts-with", "contains", "boolean", "not", "true", "false", "lang"}


@dataclass
class Loop:
    """df has the context node's columns. top: one row for each document, its root. unique: no context node twice."""

    df: DataFrame
    top: bool = False
    unique: bool = False
    pos: str | None = None
    last: str | None = None

    def of(self, df: DataFrame) -> Loop:
        return Loop(df, self.top, self.unique, self.pos, self.last)


@dataclass
class NodeSet:
    """Rows (doc_id, org, node columns), distinct; by_doc: org doesn't matter, the set is the whole document's."""

    df: DataFrame
    by_doc: bool = False
    single: bool = False  # one node for each org at most
    level: bool = False  # all nodes of an org on one level


class Compiler:
    """Plans over one node table. strict: a value of a wrong type is an error; otherwise it is empty."""

    def __init__(self, nodes: DataFrame, ids: DataFrame | None = None, variables: dict | None = None, strict: bool = False):
        self.nodes, self.ids, self.variables, self.strict = nodes, ids, variables or {}, strict
        self.names = itertools.count()

    def wrong(self, message: str) -> None:
        if self.strict:
            raise XPathTypeError(message)

    def name(self) -> str:
        return f"_v{next(self.names)}"

    # types

    def kind(self, e: Expr) -> str:
        if isinstance(e, (Path, Union, Filter)) or isinstance(e, Call) and e.name == "id":
            return "ns"
        if isinstance(e, Variable):
            value = self.variable(e)
            return "ns" if isinstance(value, DataFrame) else "bool" if isinstance(value, bool) else "num" if isinstance(value, (int, float)) else "str"
        if isinstance(e, Literal):
            return "str"
        if isinstance(e, Chain):
            return "bool" if e.rest[0][0] in (*COMPARISONS, "and", "or") else "num"
        if isinstance(e, (Number, Negate)):
            return "num"
        return "num" if e.name in NUMERIC else "bool" if e.name in BOOLEAN else "str"

    def variable(self, e: Variable):
        if e.name not in self.variables:
            raise XPathTypeError(f"variable ${e.name} isn't bound")
        return self.variables[e.name]

    # node-sets

    def nodeset(self, e: Expr, loop: Loop) -> NodeSet:
        if isinstance(e, Path):
            return self.path(e, loop)
        if isinstance(e, Union):
            return self.union(e, loop)
        if isinstance(e, Filter):
            base = self.nodeset(e.base, loop)
            for p in e.predicates:
                base = NodeSet(self.predicate(base.df, p, "child", *([] if base.by_doc else ["org"])), base.by_doc, base.single, base.level)
            return base
        if isinstance(e, Call) and e.name == "id":
            return self.by_id(e.args[0], loop)
        if isinstance(e, Variable) and isinstance(value := self.variable(e), DataFrame):
            return NodeSet(value.select("doc_id", "pre").distinct().join(self.nodes, ["doc_id", "pre"]).select("doc_id", F.lit(0).alias("org"), *NODE_COLUMNS[1:]), by_doc=True)
        self.wrong(f"{e} is no node-set")
        return NodeSet(self.nodes.where("false").select("doc_id", F.lit(0).alias("org"), *NODE_COLUMNS[1:]), by_doc=True)

    def contexts(self, loop: Loop) -> DataFrame:
        df = loop.df.select("doc_id", F.col("pre").alias("org"), *NODE_COLUMNS[1:])
        return df if loop.unique else df.dropDuplicates(["doc_id", "pre"])

    def path(self, e: Path, loop: Loop) -> NodeSet:
        steps = list(e.steps)
        if e.start is not None:
            at = self.nodeset(e.start, loop)
        elif e.absolute:
            root = self.nodes.where("pre = 0").select("doc_id", F.lit(0).alias("org"), *NODE_COLUMNS[1:])
            at = NodeSet(root, by_doc=True, single=True, level=True)
            if steps and steps[0].axis in ("child", "descendant"):
                # from the root: a filter, no join
                first = steps.pop(0)
                inside = "parent = 0" if first.axis == "child" else "pre > 0"
                n = self.nodes.where(axes.TREE).where(inside)
                condition = axes.test_condition(first.test, first.axis)
                n = n if condition is None else n.where(condition)
                rows = n.select("doc_id", F.lit(0).alias("org"), F.lit(0).alias("x_pre"), *NODE_COLUMNS[1:])
                at = self.after(first, rows, at)
        else:
            at = NodeSet(self.contexts(loop), single=True, level=True)
            if steps and steps[0].axis == "self" and steps[0].test.kind == "node":
                first = steps.pop(0)
                at = self.after(first, at.df.withColumn("x_pre", F.col("pre")), at)
        for s in steps:
            at = self.step(s, at)
        return at

    def step(self, s: Step, at: NodeSet) -> NodeSet:
        ctx = axes.as_context(at.df)
        if s.axis in ("following", "preceding") and not s.predicates and not at.single:
            rows = (axes.all_following if s.axis == "following" else axes.all_preceding)(ctx, self.nodes, s.test)
            return NodeSet(rows.drop("x_pre"), at.by_doc)
        return self.after(s, axes.step(ctx, self.nodes, s.axis, s.test), at)

    def after(self, s: Step, rows: DataFrame, at: NodeSet) -> NodeSet:
        """Predicates, then distinct nodes where the axis can meet one twice."""
        for p in s.predicates:
            rows = self.predicate(rows, p, s.axis, "org", "x_pre")
        distinct = at.single or s.axis in axes.EQUI or at.level and s.axis in ("descendant", "descendant-or-self")
        level = at.level and s.axis in ("child", "attribute", "self", "parent")
        out = rows.select("doc_id", "org", *NODE_COLUMNS[1:])
        if not distinct:
            out = out.dropDuplicates(["doc_id", "org", "pre"])
        return NodeSet(out, at.by_doc, at.single and s.axis in ("self", "parent"), level)

    def predicate(self, rows: DataFrame, p: Expr, axis: str, *groups: str) -> DataFrame:
        """Rows (doc_id, groups, node columns) for which the predicate holds; positions count in each group."""
        columns = rows.columns
        number = is_numeric(p, self.variables)
        if isinstance(p, Number):
            if p.value != int(p.value) or p.value < 1:
                return rows.where("false")
            where = self.name()
            return rows.withColumn(where, F.row_number().over(axes.proximity(axis, *groups))).where(F.col(where) == int(p.value)).select(*columns)
        loop = Loop(rows)
        if number or uses_position(p):
            loop.pos, loop.last = self.name(), self.name()
            rows = rows.withColumn(loop.pos, F.row_number().over(axes.proximity(axis, *groups)).cast("double"))
            if _mentions(p, "last"):
                rows = rows.withColumn(loop.last, F.count(F.lit(1)).over(Window.partitionBy("doc_id", *groups)).cast("double"))
            loop.df = rows
        if number:
            df, value = self.number(p, loop)
            return df.where(x.xeq_num(F.col(loop.pos), value)).select(*columns)
        return self.where(p, loop).select(*columns)

    def where(self, p: Expr, loop: Loop, holds: bool = True) -> DataFrame:
        """The rows of a loop for which a boolean holds (or doesn't): semi and anti joins where there is a node-set."""
        if isinstance(p, Chain) and p.rest[0][0] == ("and" if holds else "or"):
            df = loop.df
            for part in (p.first, *(e for _, e in p.rest)):
                df = self.where(part, loop.of(df), holds)
            return df
        if isinstance(p, Call) and p.name == "not":
            return self.where(p.args[0], loop, not holds)
        if isinstance(p, Call) and p.name == "boolean":
            return self.where(p.args[0], loop, holds)
        how = "left_semi" if holds else "left_anti"
        if self.kind(p) == "ns":
            return self.match(loop, self.nodeset(p, loop), how)
        if isinstance(p, Chain) and len(p.rest) == 1 and p.rest[0][0] in COMPARISONS:
            op, a, b = p.rest[0][0], p.first, p.rest[0][1]
            if self.kind(b) == "ns" and self.kind(a) != "ns":
                op, a, b = FLIP[op], b, a
            if self.kind(a) == "ns" and (value := self.constant(b)) is not None:
                found = self.nodeset(a, loop)
                return self.match(loop, NodeSet(found.df.where(self.holds(op, F.col("value"), value)), found.by_doc), how)
        df, value = self.boolean(p, loop)
        return df.where(value if holds else ~value)

    def match(self, loop: Loop, found: NodeSet, how: str) -> DataFrame:
        if found.by_doc:
            return loop.df.join(found.df.select("doc_id").distinct(), "doc_id", how)
        return loop.df.join(found.df.select("doc_id", F.col("org").alias("pre")), ["doc_id", "pre"], how)

    def constant(self, e: Expr):
        """The value of a literal, a number or a scalar variable that isn't a boolean; None otherwise."""
        if isinstance(e, (Literal, Number)):
            return e.value
        if isinstance(e, Variable) and not isinstance(value := self.variable(e), (DataFrame, bool)):
            return value
        return None

    def holds(self, op: str, text: Column, value) -> Column:
        """The comparison of a node's string-value with a constant."""
        if op in ("=", "!=") and isinstance(value, str):
            return text == value if op == "=" else text != value
        number = F.lit(float(value)) if not isinstance(value, str) else x.xnum_of_string(F.lit(value))
        return _compare(op, x.xnum_of_string(text), number)

    def union(self, e: Union, loop: Loop) -> NodeSet:
        parts = []
        for p in e.parts:
            if self.kind(p) != "ns":
                self.wrong(f"{p} is no node-set")
                continue
            parts.append(self.nodeset(p, loop))
        if not parts:
            return self.nodeset(Literal(""), loop)
        by_doc = all(p.by_doc for p in parts)
        df = None
        for p in parts:
            one = p.df
            if p.by_doc and not by_doc:  # the document's set, for each context
                one = self.contexts(loop).select("doc_id", "org").join(one.drop("org"), "doc_id")
            one = one.select("doc_id", "org", *NODE_COLUMNS[1:])
            df = one if df is None else df.unionByName(one)
        return NodeSet(df.dropDuplicates(["doc_id", "org", "pre"]), by_doc)

    def by_id(self, arg: Expr, loop: Loop) -> NodeSet:
        if self.kind(arg) == "ns":
            found = self.nodeset(arg, loop)
            texts, by_doc = found.df.select("doc_id", "org", F.col("value").alias("_text")), found.by_doc
        else:
            df, text = self.string(arg, loop)
            texts, by_doc = df.select("doc_id", F.col("pre").alias("org"), text.alias("_text")), False
        if self.ids is None:
            return NodeSet(self.nodes.where("false").select("doc_id", F.lit(0).alias("org"), *NODE_COLUMNS[1:]), by_doc)
        names = texts.select("doc_id", "org", F.explode(F.split("_text", "[ \t\r\n]+")).alias("id")).where("id <> ''").distinct()
        # IDs and nodes grow with the collection, but the few columns of them that are left look small enough to be broadcast
        hit = names.join(self.ids.hint("merge"), ["doc_id", "id"]).select("doc_id", "org", "pre").distinct()
        return NodeSet(hit.join(self.nodes.hint("merge"), ["doc_id", "pre"]).select("doc_id", "org", *NODE_COLUMNS[1:]), by_doc)

    # a value for each context, from a node-set

    def reduce(self, found: NodeSet, loop: Loop, **aggregates: Column) -> tuple[DataFrame, dict[str, Column]]:
        """loop with aggregates of a set for each context; null where the set is empty."""
        names = {k: self.name() for k in aggregates}
        keys = ["doc_id"] if found.by_doc else ["doc_id", "org"]
        totals = found.df.groupBy(*keys).agg(*(c.alias(names[k]) for k, c in aggregates.items()))
        if not found.by_doc:
            totals = totals.withColumnRenamed("org", "pre")
        df = loop.df.join(totals, ["doc_id"] if found.by_doc else ["doc_id", "pre"], "left")
        return df, {k: F.col(v) for k, v in names.items()}

    def first(self, e: Expr, loop: Loop, value: Column) -> tuple[DataFrame, Column]:
        """A value of the first node of a set in document order; null for the empty set."""
        if isinstance(e, Path) and not e.absolute and e.start is None and len(e.steps) == 1 and not e.steps[0].predicates:
            s = e.steps[0]
            if s.axis == "self" and s.test.kind == "node":
                return loop.df, value
            if s.axis == "attribute" and s.test.kind == "name":  # one at most: no aggregate
                condition = axes.test_condition(s.test, s.axis)
                name = self.name()
                own = self.nodes.where(condition).select("doc_id", F.col("parent").alias("pre"), value.alias(name))
                return loop.df.join(own, ["doc_id", "pre"], "left"), F.col(name)
        df, got = self.reduce(self.nodeset(e, loop), loop, first=F.min_by(value, "pre"))
        return df, got["first"]

    # scalars

    def string(self, e: Expr, loop: Loop) -> tuple[DataFrame, Column]:
        kind = self.kind(e)
        if kind == "ns":
            df, value = self.first(e, loop, F.col("value"))
            return df, F.coalesce(value, F.lit(""))
        df, value = self.scalar(e, loop)
        return df, value if kind == "str" else x.xstr_of_num(value) if kind == "num" else x.xstr_of_bool(value)

    def number(self, e: Expr, loop: Loop) -> tuple[DataFrame, Column]:
        kind = self.kind(e)
        if kind == "num":
            return self.scalar(e, loop)
        if kind == "bool":
            df, value = self.scalar(e, loop)
            return df, x.xnum_of_bool(value)
        df, value = self.string(e, loop)
        return df, x.xnum_of_string(value)

    def boolean(self, e: Expr, loop: Loop) -> tuple[DataFrame, Column]:
        kind = self.kind(e)
        if kind == "ns":
            df, got = self.reduce(self.nodeset(e, loop), loop, any=F.lit(True) & F.first(F.lit(True)))
            return df, F.coalesce(got["any"], F.lit(False))
        df, value = self.scalar(e, loop)
        return df, value if kind == "bool" else x.xbool_of_num(value) if kind == "num" else x.xbool_of_string(value)

    def each(self, method, args, loop: Loop) -> tuple[DataFrame, list[Column]]:
        df, out = loop.df, []
        for a in args:
            df, value = method(a, loop.of(df))
            out.append(value)
        return df, out

    def scalar(self, e: Expr, loop: Loop) -> tuple[DataFrame, Column]:
        if isinstance(e, (Number, Literal)):
            return loop.df, F.lit(e.value)
        if isinstance(e, Variable):
            value = self.variable(e)
            return loop.df, F.lit(float(value) if isinstance(value, int) and not isinstance(value, bool) else value)
        if isinstance(e, Negate):
            df, value = self.number(e.base, loop)
            return df, -value if e.times % 2 else value
        if isinstance(e, Chain):
            return self.chain(e, loop)
        return self.call(e, loop)

    def chain(self, e: Chain, loop: Loop) -> tuple[DataFrame, Column]:
        op = e.rest[0][0]
        if op in ("and", "or"):
            df, values = self.each(self.boolean, [e.first, *(p for _, p in e.rest)], loop)
            out = values[0]
            for v in values[1:]:
                out = out & v if op == "and" else out | v
            return df, out
        if op in COMPARISONS:
            if len(e.rest) == 1:
                return self.compare(op, e.first, e.rest[0][1], loop)
            # a < b < c is (a < b) < c: the result is a boolean, the next comparison's left side
            df, value = self.compare(op, e.first, e.rest[0][1], loop)
            for op, b in e.rest[1:]:
                df, value = self.compare_bool(op, value, b, loop.of(df))
            return df, value
        df, values = self.each(self.number, [e.first, *(p for _, p in e.rest)], loop)
        out = values[0]
        for (op, _), v in zip(e.rest, values[1:], strict=True):
            out = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "div": x.xdiv, "mod": x.xmod}[op](out, v)
        return df, out

    def compare_bool(self, op: str, a: Column, b: Expr, loop: Loop) -> tuple[DataFrame, Column]:
        if op in ("=", "!="):
            df, value = self.boolean(b, loop)
            return df, a == value if op == "=" else a != value
        df, value = (lambda d, v: (d, x.xnum_of_bool(v)))(*self.boolean(b, loop)) if self.kind(b) == "ns" else self.number(b, loop)
        return df, _compare(op, x.xnum_of_bool(a), value)

    def compare(self, op: str, a: Expr, b: Expr, loop: Loop) -> tuple[DataFrame, Column]:
        ka, kb = self.kind(a), self.kind(b)
        if ka == "ns" and kb == "ns":
            return self.compare_sets(op, a, b, loop)
        if kb == "ns":
            op, a, b, ka, kb = FLIP[op], b, a, kb, ka
        if ka == "ns" and kb != "bool":
            found = self.nodeset(a, loop)
            value = self.constant(b)
            if value is not None:
                hit = NodeSet(found.df.where(self.holds(op, F.col("value"), value)), found.by_doc)
                df, got = self.reduce(hit, loop, any=F.first(F.lit(True)))
                return df, F.coalesce(got["any"], F.lit(False))
            # the other side varies by row: it meets a distinct value of the set, its least or its greatest
            texts = kb == "str" and op in ("=", "!=")
            df, other = (self.string if texts else self.number)(b, loop)
            own = F.col("value") if texts else x.xnum_of_string(F.col("value"))
            if op == "=":
                mark, key, theirs = self.name(), self.name(), self.name()
                keys = ["doc_id"] if found.by_doc else ["doc_id", "org"]
                values = found.df.select(*keys, own.alias(key)).where(~F.isnan(key) if not texts else F.lit(True)).distinct().withColumn(mark, F.lit(True))
                values = values.withColumnRenamed("doc_id", f"{mark}d").withColumnRenamed("org", f"{mark}o")
                df = df.withColumn(theirs, other)
                on = (F.col("doc_id") == F.col(f"{mark}d")) & (F.col(theirs) == F.col(key))
                if not found.by_doc:
                    on &= F.col("pre") == F.col(f"{mark}o")
                return df.join(values, on, "left").drop(f"{mark}d", f"{mark}o", key), F.coalesce(F.col(mark), F.lit(False))
            if op == "!=":
                df, got = self.reduce(found, loop.of(df), lo=F.min(own), hi=F.max(own))
                apart = (got["lo"] != other) | (got["hi"] != other)
                if not texts:
                    apart = apart | F.isnan(other) | F.isnan(got["hi"])  # the greatest of numbers is NaN if there is one
                return df, F.coalesce(apart, F.lit(False))
            own = F.nanvl(own, F.lit(None).cast("double"))
            df, got = self.reduce(found, loop.of(df), edge=F.min(own) if op in ("<", "<=") else F.max(own))
            return df, F.coalesce(_compare(op, got["edge"], other), F.lit(False))
        if "bool" in (ka, kb):
            df, value = self.boolean(a, loop)
            if op in ("=", "!=") or ka == "ns":
                df, other = self.boolean(b, loop.of(df))
                if op in ("=", "!="):
                    return df, value == other if op == "=" else value != other
                return df, _compare(op, x.xnum_of_bool(value), x.xnum_of_bool(other))
        if op in ("=", "!=") and "num" not in (ka, kb):
            df, (u, v) = self.each(self.string, [a, b], loop)
            return df, u == v if op == "=" else u != v
        df, (u, v) = self.each(self.number, [a, b], loop)
        return df, _compare(op, u, v)

    def compare_sets(self, op: str, a: Expr, b: Expr, loop: Loop) -> tuple[DataFrame, Column]:
        s, t = self.nodeset(a, loop), self.nodeset(b, loop)
        if op == "=":
            # a semi join on the string-values
            if s.by_doc and not t.by_doc:
                s, t = t, s
            keys = ["doc_id", "value"] if t.by_doc else ["doc_id", "org", "value"]
            hit = s.df.join(t.df.select(*keys), keys, "left_semi")
            df, got = self.reduce(NodeSet(hit, s.by_doc), loop, any=F.first(F.lit(True)))
            return df, F.coalesce(got["any"], F.lit(False))
        if op == "!=":
            df, p = self.reduce(s, loop, lo=F.min("value"), hi=F.max("value"))
            df, q = self.reduce(t, loop.of(df), lo=F.min("value"), hi=F.max("value"))
            same = (p["lo"] == p["hi"]) & (q["lo"] == q["hi"]) & (p["lo"] == q["lo"])
            return df, F.coalesce(~same, F.lit(False))
        number = F.nanvl(x.xnum_of_string(F.col("value")), F.lit(None).cast("double"))
        df, p = self.reduce(s, loop, lo=F.min(number), hi=F.max(number))
        df, q = self.reduce(t, loop.of(df), lo=F.min(number), hi=F.max(number))
        low, high = (p["lo"], q["hi"]) if op in ("<", "<=") else (q["lo"], p["hi"])
        return df, F.coalesce(low < high if op in ("<", ">") else low <= high, F.lit(False))

    def call(self, e: Call, loop: Loop) -> tuple[DataFrame, Column]:
        name, args = e.name, e.args
        if name == "true" or name == "false":
            return loop.df, F.lit(name == "true")
        if name == "position":
            return loop.df, F.col(loop.pos) if loop.pos else F.lit(1.0)
        if name == "last":
            return loop.df, F.col(loop.last) if loop.last else F.lit(1.0)
        if name in ("count", "sum"):
            if self.kind(args[0]) != "ns":
                self.wrong(f"{name}() of {args[0]}, which is no node-set")
                return loop.df, F.lit(0.0 if name == "count" else float("nan"))
            total = F.count(F.lit(1)).cast("double") if name == "count" else F.sum(x.xnum_of_string(F.col("value")))
            df, got = self.reduce(self.nodeset(args[0], loop), loop, total=total)
            return df, F.coalesce(got["total"], F.lit(0.0))
        if name in ("local-name", "namespace-uri", "name"):
            none = F.lit("")
            own = F.when(F.col("kind").isin("element", "attr", "pi", "ns"), F.coalesce("local", none)).otherwise(none)
            if name == "name":
                own = F.when(F.col("kind").isin("element", "attr"), F.concat_ws(":", F.when(F.col("prefix") != "", F.col("prefix")), "local")).otherwise(own)
            if name == "namespace-uri":
                own = F.when(F.col("kind").isin("element", "attr"), F.coalesce("ns_uri", none)).otherwise(none)
            if not args:
                return loop.df, own
            if self.kind(args[0]) != "ns":
                self.wrong(f"{name}() of {args[0]}, which is no node-set")
                return loop.df, none
            df, value = self.first(args[0], loop, own)
            return df, F.coalesce(value, none)
        if name == "string":
            return self.string(args[0], loop) if args else (loop.df, F.coalesce("value", F.lit("")))
        if name == "number":
            return self.number(args[0], loop) if args else (loop.df, x.xnum_of_string(F.coalesce("value", F.lit(""))))
        if name == "boolean":
            return self.boolean(args[0], loop)
        if name == "not":
            df, value = self.boolean(args[0], loop)
            return df, ~value
        if name == "lang":
            df, want = self.string(args[0], loop)
            have, want = F.lower(F.coalesce("lang", F.lit(""))), F.lower(want)
            return df, F.col("lang").isNotNull() & ((have == want) | F.startswith(have, F.concat(want, F.lit("-"))))
        if name in ("floor", "ceiling", "round"):
            df, value = self.number(args[0], loop)
            return df, {"floor": x.xfloor, "ceiling": x.xceiling, "round": x.xround}[name](value)
        if name == "substring":
            df, text = self.string(args[0], loop)
            df, rest = self.each(self.number, args[1:], loop.of(df))
            return df, x.xsubstring(text, *rest)
        if name in ("string-length", "normalize-space"):
            df, text = self.string(args[0], loop) if args else (loop.df, F.coalesce("value", F.lit("")))
            return df, F.length(text).cast("double") if name == "string-length" else x.xnormalize_space(text)
        df, texts = self.each(self.string, args, loop)
        out = {"concat": F.concat, "starts-with": F.startswith, "contains": F.contains, "substring-before": x.xsubstring_before, "substring-after": x.xsubstring_after, "translate": x.xtranslate}[name](*texts)
        return df, out


def _compare(op: str, a: Column, b: Column) -> Column:
    if op in ("=", "!="):
        return x.xeq_num(a, b) if op == "=" else x.xne_num(a, b)
    return {"<": x.xlt, "<=": x.xle}[op](a, b) if op in ("<", "<=") else {">": x.xlt, ">=": x.xle}[op](b, a)


def _mentions(e: Expr, function: str) -> bool:
    if isinstance(e, Call):
        return e.name == function or any(_mentions(a, function) for a in e.args)
    if isinstance(e, Chain):
        return _mentions(e.first, function) or any(_mentions(p, function) for _, p in e.rest)
    if isinstance(e, Negate):
        return _mentions(e.base, function)
    return isinstance(e, (Union, Filter)) or isinstance(e, Path) and e.start is not None
