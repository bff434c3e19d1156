"""XPath 1.0 over a node table: compile once, evaluate on all documents at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.functions import scalars as x
from xylem.model import NODE_COLUMNS, Limits, XPathTypeError
from xylem.plans import ast
from xylem.plans.compile import Compiler, Loop
from xylem.plans.parser import parse, rewrite

TYPES = {"string": "string", "double": "double", "long": "bigint", "boolean": "boolean"}


@dataclass(frozen=True)
class Xml:
    """A collection: its nodes and, for id(), its ids; both DataFrames as shred() gives them."""

    nodes: DataFrame
    ids: DataFrame | None = None


class XPath:
    """A compiled expression. str() is its canonical text, which compiles to an equal expression."""

    def __init__(self, text: str, namespaces: dict[str, str] | None = None, limits: Limits | None = None):
        self.expr = parse(text, namespaces, limits)

    def __str__(self) -> str:
        return str(self.expr)

    def variables(self) -> list[str]:
        """Names of variables in the order of their first use."""
        found: list[str] = []

        def walk(e):
            if isinstance(e, ast.Variable) and e.name not in found:
                found.append(e.name)
            for part in vars(e).values() if isinstance(e, (ast.Expr, ast.Step)) else e if isinstance(e, tuple) else ():
                walk(part)

        walk(self.expr)
        return found

    def kind(self, variables: dict | None = None) -> str:
        """nodeset, string, number or boolean."""
        own = Compiler(None, None, variables)
        return {"ns": "nodeset", "str": "string", "num": "number", "bool": "boolean"}[own.kind(self.expr)]

    def _start(self, xml: Xml, context: DataFrame | None, variables, strict):
        compiler = Compiler(xml.nodes, xml.ids, variables, strict)
        if context is None:
            return compiler, Loop(xml.nodes.where("pre = 0"), top=True, unique=True)
        at = context.select("doc_id", "pre").distinct()
        return compiler, Loop(at.join(xml.nodes, ["doc_id", "pre"]).select(*NODE_COLUMNS), unique=True)

    def evaluate(self, xml: Xml, context: DataFrame | None = None, variables: dict | None = None, strict: bool = False) -> DataFrame:
        """For a node-set the nodes' columns, with `context` (the context node's pre) if contexts are given; else doc_id, context and value.

        Without contexts the context node is each document's root. Rows come in
        no order; sort by doc_id and pre for document order.
        """
        compiler, loop = self._start(xml, context, variables, strict)
        e = rewrite(self.expr, variables)
        if compiler.kind(e) == "ns":
            found = compiler.nodeset(e, loop)
            if context is None:
                return found.df.select(*NODE_COLUMNS)
            df = found.df
            if found.by_doc:
                df = loop.df.select("doc_id", F.col("pre").alias("org")).join(df.drop("org"), "doc_id")
            return df.select(F.col("org").alias("context"), *NODE_COLUMNS)
        df, value = compiler.scalar(e, loop)
        keys = ["doc_id"] if context is None else ["doc_id", F.col("pre").alias("context")]
        return df.select(*keys, value.alias("value"))

    def extract_all(self, xml: Xml, kind: str = "string", context: DataFrame | None = None, variables: dict | None = None, errors: str = "null") -> DataFrame:
        """doc_id, pre and value, converted: one row for each node. A node that can't be converted is null, or with errors='raise' fails the query."""
        if self.kind(variables) != "nodeset":
            raise XPathTypeError(f"{self} is no node-set")
        found = self.evaluate(xml, context, variables)
        keys = [c for c in ("context",) if c in found.columns]
        return found.select("doc_id", *keys, "pre", convert(F.col("value"), kind, errors).alias("value"))

    def extract_one(self, xml: Xml, kind: str = "string", context: DataFrame | None = None, variables: dict | None = None, errors: str = "null") -> DataFrame:
        """doc_id and value for each context: of a node-set's first node (null for the empty set), or of the scalar."""
        compiler, loop = self._start(xml, context, variables, False)
        e = rewrite(self.expr, variables)
        keys = ["doc_id"] if context is None else ["doc_id", F.col("pre").alias("context")]
        if compiler.kind(e) == "ns":
            df, value = compiler.first(e, loop, F.col("value"))
            return df.select(*keys, convert(value, kind, errors).alias("value"))
        if kind == "double":
            df, value = compiler.number(e, loop)
            return df.select(*keys, value.alias("value"))
        if kind == "boolean":
            df, value = compiler.boolean(e, loop)
            return df.select(*keys, value.alias("value"))
        df, value = compiler.string(e, loop)
        return df.select(*keys, convert(value, kind, errors).alias("value"))


def convert(text, kind: str, errors: str = "null"):
    """A string-value as a string, double (a number), long (an integer of at most 2**53) or boolean (true, false, 1, 0)."""
    if kind == "string":
        return text
    number = x.xnum_of_string(text)
    if kind == "double":
        good, value = ~F.isnan(number), number
    elif kind == "long":
        whole = F.abs(number) <= float(1 << 53)
        good, value = whole & (number == F.floor(F.when(whole, number))), F.when(whole, number).cast("long")
    elif kind == "boolean":
        bare = x.ws_trim(text)
        good, value = bare.isin("true", "false", "1", "0"), bare.isin("true", "1")
    else:
        raise ValueError(f"no such kind: {kind}")
    failed = F.raise_error(F.concat(F.lit(f"not a {kind}: "), text)).cast(TYPES[kind]) if errors == "raise" else F.lit(None).cast(TYPES[kind])
    return F.when(text.isNull(), F.lit(None).cast(TYPES[kind])).when(good, value).otherwise(failed)


def compile(text: str, namespaces: dict[str, str] | None = None, limits: Limits | None = None) -> XPath:  # noqa: A001
    return XPath(text, namespaces, limits)
