"""XML made from relational tables with built-in functions, one document for each row of a driving table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.operators.serialise import escape_attribute_column, escape_text_column


def element(name: str, /, *content: Column, **attributes: Column) -> Column:
    """A column of elements; content is XML, attributes are text. Null attributes are left out, null content is empty."""
    head = [F.lit(f"<{name}")]
    for k, v in attributes.items():
        key = k.replace("__", ":")
        head.append(F.coalesce(F.concat(F.lit(f' {key}="'), escape_attribute_column(v.cast("string")), F.lit('"')), F.lit("")))
    body = [F.coalesce(c, F.lit("")) for c in content]
    return F.concat(*head, F.lit(">"), *body, F.lit(f"</{name}>"))


def text(c: Column) -> Column:
    return escape_text_column(c.cast("string"))


def money(name: str) -> Column:
    """A double as text with two decimals, never an exponent."""
    return text(F.col(name).cast("decimal(18,2)"))


def children(xml: Column, *order: str) -> Column:
    """An aggregate: the group's XML in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, xml.alias("xml")))), lambda x: x["xml"]), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order(@id @status @priority) / total, line(@n @flag @status)* / qty, price, disc."""
    line = element("line", element("qty", money("l_quantity")), element("price", money("l_extendedprice")), element("disc", money("l_discount")), n=F.col("l_linenumber"), flag=F.col("l_returnflag"), status=F.col("l_linestatus"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(children(line, "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus").alias("lines"))
    both = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    xml = element("order", element("total", money("o_totalprice")), F.col("lines"), id=F.col("o_orderkey"), status=F.col("o_orderstatus"), priority=F.col("o_orderpriority"))
    return both.select(F.col("o_orderkey").alias("doc_id"), xml.alias("xml"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region(@name) / nation(@name)* / supplier(@id)* / bal."""
    supplier = element("supplier", element("bal", money("s_acctbal")), id=F.col("s_suppkey"))
    suppliers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(children(supplier, "s_suppkey").alias("suppliers"))
    nation = element("nation", F.col("suppliers"), name=F.col("n_name"))
    nations = table(spark, sf_dir, "nation").join(suppliers, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(children(nation, "n_nationkey").alias("nations"))
    both = table(spark, sf_dir, "region").join(nations, "r_regionkey", "left")
    return both.select(F.col("r_regionkey").cast("long").alias("doc_id"), element("region", F.col("nations"), name=F.col("r_name")).alias("xml"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c:customer(xmlns:c @c:id @xml:lang) / c:name, c:seg, c:bal, memo."""
    lang = F.when(F.col("c_nationkey") % 2 == 0, "en-GB").otherwise("fr")
    memo = element("memo", F.lit("  spaced \t "), text(F.col("c_mktsegment")), F.lit("\n  out  "))
    xml = element("c:customer", element("c:name", text(F.col("c_name"))), element("c:seg", text(F.col("c_mktsegment"))), element("c:bal", money("c_acctbal")), memo, xmlns__c=F.lit("urn:c"), c__id=F.col("c_custkey"), xml__lang=lang)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), xml.alias("xml"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log(@user) / e(@id @type @k)* / v, by user."""
    k = F.get_json_object("props", "$.k")
    e = element("e", element("v", money("value")), id=F.col("event_id"), type=F.col("event_type"), k=k)
    logs = table(spark, sf_dir, "events").groupBy("user_id").agg(children(e, "event_id").alias("events"))
    return logs.select(F.col("user_id").alias("doc_id"), element("log", F.col("events"), user=F.col("user_id")).alias("xml"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc(@id @xml:lang) / text."""
    xml = element("doc", element("text", text(F.col("text"))), id=F.col("doc_id"), xml__lang=F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", xml.alias("xml"))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BINARY documents in three encodings: c(@key, an ID) / a comment, an instruction, name, bal, ref (two names of IDs, one that is there)."""
    k = F.col("c_custkey")
    key = F.concat(F.lit("k"), k.cast("string"))
    body = F.concat(F.lit("<!DOCTYPE c [<!ATTLIST c key ID #IMPLIED>]>"), element("c", F.concat(F.lit("<!--"), F.col("c_mktsegment"), F.lit("--><?seg "), F.col("c_mktsegment"), F.lit("?>")), element("name", text(F.col("c_name"))), element("bal", money("c_acctbal")), element("ref", F.concat(F.lit("none "), key)), key=key))
    latin = F.encode(F.concat(F.lit('<?xml version="1.0" encoding="ISO-8859-1"?>'), body), "ISO-8859-1")
    xml = F.when(k % 3 == 0, latin).when(k % 3 == 1, F.encode(body, "UTF-16")).otherwise(F.encode(body, "UTF-8"))
    return table(spark, sf_dir, "customer").select(k.cast("long").alias("doc_id"), xml.alias("xml"))


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n(@name) / a (text), b (empty): one for each nation."""
    xml = element("n", F.lit("<a>t</a><b/>"), name=F.col("n_name"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), xml.alias("xml"))


def navs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nav element of each page."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_extract("html", r"(?s)<nav\b.*?</nav>", 0).alias("xml"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages, which aren't XML."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("xml"))
