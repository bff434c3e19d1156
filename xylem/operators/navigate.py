"""Tree navigation as projections and filters of the node table; at is a DataFrame of (doc_id, pre)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.model import NODES

KEYS = ["doc_id", "pre"]
TREE = "kind NOT IN ('attr', 'ns')"


def empty(spark: SparkSession, doc_id: int = 0) -> DataFrame:
    """A document that is a root only."""
    return spark.createDataFrame([(doc_id, 0, 0, 0, None, None, "root", None, None, None, "", None, None, None)], NODES)


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where("pre = 0")


def root_elements(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent = 0 AND kind = 'element'")


def nodes_at(nodes: DataFrame, at: DataFrame) -> DataFrame:
    return nodes.join(at.select(*KEYS).distinct(), KEYS, "left_semi")


def parents(nodes: DataFrame, at: DataFrame) -> DataFrame:
    up = nodes_at(nodes, at).select("doc_id", F.col("parent").alias("pre"))
    return nodes_at(nodes, up)


def _under(nodes: DataFrame, at: DataFrame, condition: str) -> DataFrame:
    return nodes.where(condition).join(at.select("doc_id", F.col("pre").alias("parent")).distinct(), ["doc_id", "parent"], "left_semi")


def children(nodes: DataFrame, at: DataFrame) -> DataFrame:
    return _under(nodes, at, TREE)


def attributes(nodes: DataFrame, at: DataFrame) -> DataFrame:
    return _under(nodes, at, "kind = 'attr'")


def declared_namespaces(nodes: DataFrame, at: DataFrame) -> DataFrame:
    """Namespace nodes declared on the nodes themselves, not those in scope."""
    return _under(nodes, at, "kind = 'ns'")


def descendants(nodes: DataFrame, at: DataFrame) -> DataFrame:
    """All nodes below, attributes and namespaces left out."""
    spans = nodes_at(nodes, at).select(F.col("doc_id").alias("a_doc"), F.col("pre").alias("a_pre"), F.col("size").alias("a_size"))
    on = (F.col("doc_id") == F.col("a_doc")) & F.expr("pre > a_pre AND pre <= a_pre + a_size")
    return nodes.where(TREE).join(spans, on, "left_semi")


def attribute(nodes: DataFrame, at: DataFrame, local: str) -> DataFrame:
    """doc_id, pre and value of the first attribute of a local name, in any namespace."""
    own = attributes(nodes, at).where(F.col("local") == local)
    return own.groupBy("doc_id", F.col("parent").alias("pre")).agg(F.min_by("value", F.col("pre")).alias("value"))


def attribute_ns(nodes: DataFrame, at: DataFrame, ns: str | None, local: str) -> DataFrame:
    own = attributes(nodes, at).where((F.col("local") == local) & F.col("ns_uri").eqNullSafe(F.lit(ns)))
    return own.select("doc_id", F.col("parent").alias("pre"), "value")


def element_by_id(nodes: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    return nodes_at(nodes, ids.where(F.col("id") == name))


def qualified_name() -> Column:
    """A column of nodes: the name with its prefix, as written."""
    return F.concat_ws(":", F.when(F.col("prefix") != "", F.col("prefix")), "local")


def text() -> Column:
    """A column of nodes: all text below; '' for comments and instructions, whose string-value is something else."""
    return F.when(F.col("kind").isin("comment", "pi"), "").otherwise(F.coalesce("value", F.lit("")))


def text_content(nodes: DataFrame, at: DataFrame) -> DataFrame:
    """doc_id, pre and value: the text of elements with one child, a text node; null for others."""
    own = children(nodes, at).groupBy("doc_id", F.col("parent").alias("pre")).agg(F.count("*").alias("n"), F.min("kind").alias("k"), F.min("value").alias("v"))
    return at.select(*KEYS).join(own, KEYS, "left").select(*KEYS, F.when((F.col("n") == 1) & (F.col("k") == "text"), F.col("v")).alias("value"))


def source(documents: DataFrame, nodes: DataFrame, at: DataFrame, xml: str = "xml") -> DataFrame:
    """doc_id, pre and the source text of nodes that were parsed: their span of the document's UTF-8 bytes."""
    spans = nodes_at(nodes, at).where("src_end IS NOT NULL").select(*KEYS, "src_start", "src_end")
    both = spans.join(documents.select("doc_id", F.col(xml).cast("binary").alias("_xml")), "doc_id")
    return both.select(*KEYS, F.decode(F.expr("substring(_xml, src_start + 1, src_end - src_start)"), "UTF-8").alias("source"))


def sizes(nodes: DataFrame) -> DataFrame:
    """doc_id and the number of its nodes."""
    return nodes.groupBy("doc_id").agg(F.count("*").alias("n"))


def in_document_order(nodes: DataFrame) -> DataFrame:
    """Sorted for output: by document, then by pre; descendants follow their ancestors."""
    return nodes.orderBy("doc_id", "pre")
