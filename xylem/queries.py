"""Queries over XML made from the relational tables, with the same results in SQL over the tables themselves.

node-set query gives doc_id and value, one row for each node; a scalar query
gives doc_id and value, one row for each document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.functions.register import register
from xylem.operators import mutate, navigate
from xylem.operators.serialise import Options, needs_xml_11, serialise
from xylem.sources import tables
from xylem.sources.shred import docs_of, ids_of, nodes_of, shred
from xylem.storage import written
from xylem.streaming.events import read_events
from xylem.xpath import Xml, XPath

NS = {"c": "urn:c"}
_WRITTEN: dict[tuple, DataFrame] = {}


def shredded(spark: SparkSession, sf_dir: str, fixture: str) -> DataFrame:
    """A fixture's rows, shredded once for each session and written by kind of node: scans prune kinds and columns."""
    key = (spark.sparkContext.applicationId, sf_dir, fixture)
    if key not in _WRITTEN:
        made = getattr(tables, fixture)(spark, sf_dir)
        # small inputs are merged into few partitions after a shuffle; parsing is worth more tasks than their bytes are
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        _WRITTEN[key] = written(shred(made.repartition(parts, "doc_id")).withColumn("part", F.coalesce("kind", "row")), "part")
    return _WRITTEN[key]


def collection(spark: SparkSession, sf_dir: str, fixture: str) -> Xml:
    rows = shredded(spark, sf_dir, fixture)
    return Xml(nodes_of(rows), ids_of(rows))


@dataclass(frozen=True)
class Case:
    fixture: str
    expression: str
    sql: str
    number: bool = False  # round the value to two decimals: sums may be added in any order
    variables: dict | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        xml = collection(spark, sf_dir, self.fixture)
        out = XPath(self.expression, NS).evaluate(xml, variables=self.variables, strict=True)
        value = F.round("value", 2) if self.number else F.col("value")
        return out.select("doc_id", value.alias("value"))


LINES = """WITH l AS (SELECT *, cast(cast(l_quantity AS DECIMAL(18,2)) AS VARCHAR) AS qty, cast(cast(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS price, cast(cast(l_discount AS DECIMAL(18,2)) AS VARCHAR) AS disc,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
 o AS (SELECT orders.*, coalesce(k.n, 0) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) k ON o_orderkey = l_orderkey) """


def _l(value: str, where: str = "true", tail: str = "") -> str:
    return f"{LINES} SELECT l_orderkey AS doc_id, {value} AS value FROM l WHERE {where} {tail}"


def _o(value: str, where: str = "true") -> str:
    return f"{LINES} SELECT o_orderkey AS doc_id, {value} AS value FROM o WHERE {where}"


def _c(value: str, where: str = "true") -> str:
    return f"SELECT c_custkey AS doc_id, {value} AS value FROM customer WHERE {where}"


_SUM = "(SELECT {} FROM lineitem WHERE l_orderkey = o_orderkey)"
_BAL = "cast(c_acctbal AS DECIMAL(18,2))"

CASES: dict[str, Case] = {
    # axes
    "axis_child": Case("orders", "/order/line/qty", _l("qty")),
    "axis_descendant": Case("orders", "/descendant::price", _l("price")),
    "axis_descendant_or_self": Case("orders", "count(//line/descendant-or-self::*)", _o("cast(4 * n AS DOUBLE)")),
    "axis_parent": Case("orders", "//qty[. > 45]/../@n", _l("cast(l_linenumber AS VARCHAR)", "l_quantity > 45")),
    "axis_ancestor": Case("orders", "count(//disc/ancestor::*)", _o("cast(CASE WHEN n > 0 THEN n + 1 ELSE 0 END AS DOUBLE)")),
    "axis_ancestor_or_self": Case("orders", "count(//line/ancestor-or-self::*)", _o("cast(CASE WHEN n > 0 THEN n + 1 ELSE 0 END AS DOUBLE)")),
    "axis_self": Case("orders", "/order/line/*[self::price]", _l("price")),
    "axis_attribute": Case("orders", "//line/@flag", _l("l_returnflag")),
    "axis_following_sibling": Case("orders", "/order/line[1]/following-sibling::line/qty", _l("qty", "rn > 1")),
    "axis_preceding_sibling": Case("orders", "/order/line[last()]/preceding-sibling::line[1]/qty", _l("qty", "rn = n - 1")),
    "axis_following": Case("orders", "count(/order/line[1]/following::qty)", _o("cast(greatest(n - 1, 0) AS DOUBLE)")),
    "axis_preceding": Case("orders", "count(/order/line[last()]/preceding::qty)", _o("cast(greatest(n - 1, 0) AS DOUBLE)")),
    "axis_following_all": Case("orders", "count(//*/following::*)", _o("cast(4 * n AS DOUBLE)")),
    "axis_preceding_all": Case("orders", "count(//*/preceding::*)", _o("cast(CASE WHEN n > 0 THEN 1 + 4 * (n - 1) + 2 ELSE 0 END AS DOUBLE)")),
    "axis_namespace": Case("customers", "string(//c:name/namespace::c)", _c("'urn:c'")),
    "axis_namespace_count": Case("customers", "count(//c:seg/namespace::*)", _c("2.0::DOUBLE")),
    "axis_three_levels": Case("regions", "//supplier[bal > 5000]/ancestor::nation/@name", "SELECT cast(n_regionkey AS BIGINT) AS doc_id, n_name AS value FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)"),
    # node tests
    "test_name": Case("orders", "/order/total", _o("cast(cast(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)")),
    "test_prefixed": Case("customers", "/c:customer/c:name", _c("c_name")),
    "test_any": Case("orders", "count(/order/*)", _o("cast(n + 1 AS DOUBLE)")),
    "test_any_namespace": Case("customers", "/*:customer/*:seg", _c("c_mktsegment")),
    "test_namespace_any": Case("customers", "count(/c:customer/c:*)", _c("3.0::DOUBLE")),
    "test_text": Case("orders", "count(//text())", _o("cast(1 + 3 * n AS DOUBLE)")),
    "test_node": Case("orders", "count(//node())", _o("cast(3 + 7 * n AS DOUBLE)")),
    "test_comment_pi": Case("orders", "count(//comment() | //processing-instruction())", _o("0.0::DOUBLE")),
    "test_attribute_any": Case("orders", "count(//@*)", _o("cast(3 + 3 * n AS DOUBLE)")),
    # predicates, positions, filters
    "predicate_boolean": Case("orders", "/order/line[@flag = 'R']/price", _l("price", "l_returnflag = 'R'")),
    "predicate_index": Case("orders", "/order/line[2]/qty", _l("qty", "rn = 2")),
    "predicate_last": Case("orders", "//line[last()]/qty", _l("qty", "rn = n")),
    "predicate_position": Case("orders", "/order/line[position() mod 2 = 0]/qty", _l("qty", "rn % 2 = 0")),
    "predicate_top_k": Case("orders", "/order/line[position() <= 3]/qty", _l("qty", "rn <= 3")),
    "predicate_chain": Case("orders", "/order/line[@flag = 'N'][1]/qty", f"{LINES}, m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY rn) AS k FROM l WHERE l_returnflag = 'N') SELECT l_orderkey AS doc_id, qty AS value FROM m WHERE k = 1"),
    "predicate_exists": Case("regions", "//nation[supplier]/@name", "SELECT cast(n_regionkey AS BIGINT) AS doc_id, n_name AS value FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)"),
    "predicate_not_exists": Case("orders", "/order[not(line)]/@id", _o("cast(o_orderkey AS VARCHAR)", "n = 0")),
    "predicate_nested": Case("regions", "/region[nation[count(supplier) > 3]]/@name", "SELECT cast(r_regionkey AS BIGINT) AS doc_id, r_name AS value FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) > 3))"),
    "predicate_relative": Case("orders", "/order/line[qty > ../line[1]/qty]/@n", f"{LINES} SELECT l.l_orderkey AS doc_id, cast(l.l_linenumber AS VARCHAR) AS value FROM l JOIN (SELECT l_orderkey, l_quantity AS q FROM l WHERE rn = 1) f ON l.l_orderkey = f.l_orderkey WHERE l.l_quantity > f.q"),
    "filter_expression": Case("orders", "(//line)[2]/price", _l("price", "rn = 2")),
    "filter_last": Case("orders", "(//qty | //disc)[last()]", _l("disc", "rn = n")),
    "variable_number": Case("orders", "/order/line[qty > $q]/price", _l("price", "l_quantity > 40"), variables={"q": 40}),
    "variable_string": Case("orders", "/order/line[@flag = $f]/qty", _l("qty", "l_returnflag = 'A'"), variables={"f": "A"}),
    # operators
    "operator_or": Case("orders", "/order/line[@flag = 'A' or qty < 5]/qty", _l("qty", "l_returnflag = 'A' OR l_quantity < 5")),
    "operator_and": Case("orders", "/order/line[@flag = 'N' and disc > 0.05]/price", _l("price", "l_returnflag = 'N' AND cast(l_discount AS DECIMAL(18,2)) > 0.05")),
    "operator_equal": Case("orders", "/order/@status = 'F'", _o("o_orderstatus = 'F'")),
    "operator_not_equal": Case("orders", "/order/line[@status != 'O']/@n", _l("cast(l_linenumber AS VARCHAR)", "l_linestatus <> 'O'")),
    "operator_less": Case("orders", "/order/line[qty < 3]/qty", _l("qty", "l_quantity < 3")),
    "operator_greater_equal": Case("orders", "/order/line[50 <= qty]/price", _l("price", "l_quantity >= 50")),
    "operator_set_equal": Case("orders", "/order/line[@flag = 'R']/qty = /order/line[@flag = 'N']/qty", _o("EXISTS (SELECT 1 FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.qty = b.qty WHERE a.l_orderkey = o_orderkey AND a.l_returnflag = 'R' AND b.l_returnflag = 'N')")),
    "operator_set_not_equal": Case("orders", "/order/line/@flag != /order/line/@flag", _o("coalesce((SELECT min(l_returnflag) <> max(l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey), false)")),
    "operator_set_less": Case("orders", "/order/line[@flag = 'A']/qty < /order/line[@flag = 'N']/qty", _o("coalesce((SELECT min(l_quantity) FILTER (WHERE l_returnflag = 'A') < max(l_quantity) FILTER (WHERE l_returnflag = 'N') FROM lineitem WHERE l_orderkey = o_orderkey), false)")),
    "operator_set_boolean": Case("orders", "/order/line = true()", _o("n > 0")),
    "operator_arithmetic": Case("orders", "/order/total * 2 - 1 + 3 div 2", _o("round(cast(o_totalprice AS DECIMAL(18,2))::DOUBLE * 2 - 1 + 1.5, 2)"), number=True),
    "operator_mod": Case("orders", "/order/@id mod 7", _o("cast(o_orderkey % 7 AS DOUBLE)")),
    "operator_div": Case("orders", "count(//line[@flag = 'R']) div count(//line)", _o(f"CASE WHEN n = 0 THEN 'NaN'::DOUBLE ELSE round({_SUM.format(chr(99) + 'ount(*) FILTER (WHERE l_returnflag = ' + repr('R') + ')')}::DOUBLE / n, 2) END"), number=True),
    "operator_negate": Case("customers", "-//c:bal", _c(f"-({_BAL}::DOUBLE)")),
    "operator_union": Case("orders", "/order/total | /order/line[1]/qty", f"{LINES} SELECT o_orderkey AS doc_id, cast(cast(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS value FROM o UNION ALL SELECT l_orderkey, qty FROM l WHERE rn = 1"),
    # functions
    "function_count": Case("orders", "count(//line[qty > 10])", _o(_SUM.format("count(*) FILTER (WHERE l_quantity > 10)") + "::DOUBLE")),
    "function_sum": Case("orders", "sum(//price)", _o("round(coalesce(" + _SUM.format("sum(cast(l_extendedprice AS DECIMAL(18,2)))") + ", 0)::DOUBLE, 2)"), number=True),
    "function_position_last": Case("orders", "/order/line[position() = last() - 1]/qty", _l("qty", "rn = n - 1")),
    "function_local_name": Case("customers", "local-name(/*/*[2])", _c("'seg'")),
    "function_namespace_uri": Case("customers", "namespace-uri(/*)", _c("'urn:c'")),
    "function_name": Case("customers", "name(/*/*[1])", _c("'c:name'")),
    "function_string": Case("customers", "string(//c:name)", _c("c_name")),
    "function_string_mixed": Case("regions", "string-length(string(/region))", "SELECT cast(r_regionkey AS BIGINT) AS doc_id, cast(coalesce((SELECT sum(length(cast(cast(s_acctbal AS DECIMAL(18,2)) AS VARCHAR))) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey), 0) AS DOUBLE) AS value FROM region"),
    "function_concat": Case("customers", "concat(//c:name, '-', //c:seg, '!')", _c("c_name || '-' || c_mktsegment || '!'")),
    "function_starts_with": Case("customers", "starts-with(//c:seg, 'BUI')", _c("starts_with(c_mktsegment, 'BUI')")),
    "function_contains": Case("customers", "//c:seg[contains(., 'MA')]", _c("c_mktsegment", "contains(c_mktsegment, 'MA')")),
    "function_substring_before": Case("customers", "substring-before(//c:name, '#')", _c("split_part(c_name, '#', 1)")),
    "function_substring_after": Case("customers", "substring-after(//c:name, '#')", _c("split_part(c_name, '#', 2)")),
    "function_substring": Case("customers", "substring(//c:seg, 2, 3)", _c("substring(c_mktsegment, 2, 3)")),
    "function_string_length": Case("customers", "string-length(//c:seg)", _c("length(c_mktsegment)::DOUBLE")),
    "function_normalize_space": Case("customers", "normalize-space(//memo)", _c("'spaced ' || c_mktsegment || ' out'")),
    "function_translate": Case("customers", "translate(//c:seg, 'AEIOU', 'aei')", _c("translate(c_mktsegment, 'AEIOU', 'aei')")),
    "function_boolean": Case("orders", "boolean(//line[@flag = 'R'])", _o("EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")),
    "function_not": Case("orders", "not(//line[@flag = 'R'])", _o("NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")),
    "function_true_false": Case("regions", "true() and not(false())", "SELECT cast(r_regionkey AS BIGINT) AS doc_id, true AS value FROM region"),
    "function_lang": Case("customers", "//c:name[lang('en')]", _c("c_name", "c_nationkey % 2 = 0")),
    "function_number": Case("customers", "number(//c:bal)", _c(f"{_BAL}::DOUBLE")),
    "function_number_nan": Case("customers", "string(number(//c:name))", _c("'NaN'")),
    "function_floor": Case("customers", "floor(//c:bal)", _c(f"floor({_BAL}::DOUBLE)")),
    "function_ceiling": Case("customers", "ceiling(//c:bal)", _c(f"ceil({_BAL}::DOUBLE)")),
    "function_round": Case("customers", "round(//c:bal)", _c(f"floor({_BAL}::DOUBLE + 0.5)")),
    "function_number_format": Case("events", "string(count(//e) * 1.5)", "SELECT user_id AS doc_id, CASE WHEN count(*) % 2 = 0 THEN cast(count(*) * 3 // 2 AS VARCHAR) ELSE cast(count(*) * 3 // 2 AS VARCHAR) || '.5' END AS value FROM events GROUP BY 1"),
    # bytes in three encodings, with IDs, comments and instructions
    "function_id": Case("marked", "id(//ref)/name", _c("c_name")),
    "function_id_string": Case("marked", "count(id('k1 k2 none'))", _c("CASE WHEN c_custkey IN (1, 2) THEN 1.0 ELSE 0.0 END::DOUBLE")),
    "test_comment": Case("marked", "//comment()", _c("c_mktsegment")),
    "test_instruction": Case("marked", "/c/processing-instruction('seg')", _c("c_mktsegment")),
    "test_instruction_other": Case("marked", "count(//processing-instruction('gap'))", _c("0.0::DOUBLE")),
    "scalar_not_equal": Case("marked", "string(//comment()) != 'BUILDING'", _c("c_mktsegment <> 'BUILDING'")),
    "scalar_less": Case("marked", "number(//bal) < 100", _c(f"{_BAL} < 100")),
    "scalar_less_equal": Case("marked", "number(//bal) <= 0", _c(f"{_BAL} <= 0")),
    "scalar_greater": Case("marked", "number(//bal) > 5000", _c(f"{_BAL} > 5000")),
    "scalar_greater_equal": Case("marked", "number(//bal) >= 100", _c(f"{_BAL} >= 100")),
    "set_equals_varying": Case("orders", "/order/line[../line/qty = disc * 100]/@n", f"{LINES} SELECT a.l_orderkey AS doc_id, cast(a.l_linenumber AS VARCHAR) AS value FROM l a WHERE EXISTS (SELECT 1 FROM l b WHERE b.l_orderkey = a.l_orderkey AND cast(b.qty AS DOUBLE) = cast(a.disc AS DOUBLE) * 100)"),
    "set_differs_from_varying": Case("orders", "/order/line[../line/@flag != string(@flag)]/@n", f"{LINES} SELECT a.l_orderkey AS doc_id, cast(a.l_linenumber AS VARCHAR) AS value FROM l a WHERE EXISTS (SELECT 1 FROM l b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag <> a.l_returnflag)"),
    "set_less_than_varying": Case("orders", "/order/line[../line/qty < qty * 0.5]/@n", f"{LINES} SELECT a.l_orderkey AS doc_id, cast(a.l_linenumber AS VARCHAR) AS value FROM l a WHERE EXISTS (SELECT 1 FROM l b WHERE b.l_orderkey = a.l_orderkey AND cast(b.qty AS DOUBLE) < cast(a.qty AS DOUBLE) * 0.5)"),
    "axis_namespace_position": Case("customers", "string(/*/namespace::*[2]) = string(/*/namespace::*[position() = 2])", _c("true")),
    # logs
    "events_predicate": Case("events", "//e[@type = 'click']/v", "SELECT user_id AS doc_id, cast(cast(value AS DECIMAL(18,2)) AS VARCHAR) AS value FROM events WHERE event_type = 'click'"),
    "events_attribute_number": Case("events", "count(//e[@k > 50])", "SELECT user_id AS doc_id, cast(count(*) FILTER (WHERE cast(json_extract_string(props, '$.k') AS INT) > 50) AS DOUBLE) AS value FROM events GROUP BY 1"),
    "events_average": Case("events", "sum(//v) div count(//v)", "SELECT user_id AS doc_id, round(sum(cast(value AS DECIMAL(18,2)))::DOUBLE / count(*), 2) AS value FROM events GROUP BY 1", number=True),
    # pages
    "pages_links": Case("navs", "//a/@href", r"SELECT page_id AS doc_id, replace(unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav\b.*?</nav>'), 'href=\"([^\"]*)\"', 1)), '&amp;', '&') AS value FROM pages"),
    "pages_items": Case("navs", "count(//li)", r"SELECT page_id AS doc_id, cast(len(regexp_extract_all(regexp_extract(html, '(?s)<nav\b.*?</nav>'), '<li>')) AS DOUBLE) AS value FROM pages"),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line of each order: how many, and their quantity in all."""
    last = XPath("//line[last()]/qty").extract_all(collection(spark, sf_dir, "orders"), "double")
    return last.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("qty"))


def extract_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed columns beside each other: one join for each."""
    xml = collection(spark, sf_dir, "customers")
    one = lambda e, kind, name: XPath(e, NS).extract_one(xml, kind).select("doc_id", F.col("value").alias(name))
    return one("/*/@c:id", "long", "id").join(one("//c:bal", "double", "balance"), "doc_id").join(one("//c:seg", "string", "segment"), "doc_id").join(one("//c:bal > 0", "boolean", "positive"), "doc_id")


def well_formed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole page is an error row, none fails the job."""
    return docs_of(shredded(spark, sf_dir, "pages")).select("doc_id", "ok", F.col("error_kind").alias("kind"))


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-formed documents with their numbers of nodes."""
    return docs_of(shredded(spark, sf_dir, "orders")).select("doc_id", "ok", F.col("n_nodes").cast("long").alias("n_nodes"))


def kinds_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = collection(spark, sf_dir, "orders").nodes
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts escaped, parsed, serialised and parsed again."""
    once = nodes_of(shredded(spark, sf_dir, "documents"))
    again = nodes_of(shred(serialise(once)))
    return again.where("kind = 'element' AND local = 'text'").select("doc_id", "value")


def serialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serialise(collection(spark, sf_dir, "regions").nodes).select("doc_id", "xml")


def serialised_pretty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serialise(collection(spark, sf_dir, "regions").nodes, Options(indent=2, empty="<a />", newline="\r\n")).select("doc_id", "xml")


def xml_11_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return needs_xml_11(nodes_of(shredded(spark, sf_dir, "documents"))).select("doc_id", "needs")


def pulled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all orders by type."""
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_events(tables.orders(spark, sf_dir).repartition(parts, "doc_id")).groupBy("type").agg(F.count("*").alias("n"))


def navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent, place among siblings, number of descendants and attributes of every nation element."""
    nodes = collection(spark, sf_dir, "regions").nodes
    attrs = nodes.where("kind = 'attr' AND local = 'name'").select("doc_id", F.col("parent").alias("pre"), F.col("value").alias("name"))
    return nodes.where("local = 'nation'").join(attrs, ["doc_id", "pre"]).select("doc_id", "name", F.col("sib").cast("long").alias("sib"), ((F.col("size") - 1) / 4).cast("long").alias("suppliers"))


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's total marked, its first line removed and a note added: what is left of each."""
    steps = [
        mutate.Step(1, "remove", {"local": "line", "sib": 1}),
        mutate.Step(2, "set_attribute", {"local": "total"}, local="checked", value="yes"),
        mutate.Step(3, "append_element", {"local": "order", "kind": "element"}, local="note"),
    ]
    after = mutate.edit_documents(tables.orders(spark, sf_dir), steps, ["doc_id", "local", "error_kind"])
    count = lambda c: F.count_if(F.expr(c)).alias(c.split("'")[1])
    return after.groupBy("doc_id").agg(count("local = 'line'"), count("local = 'note'"), count("local = 'checked'"), F.max("error_kind").alias("error"))


def parsed_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BINARY documents and the encodings they were read in."""
    return docs_of(shredded(spark, sf_dir, "marked")).select("doc_id", "ok", "encoding")


def from_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression for every nation element: a scalar and a node-set, strict and lenient."""
    xml = collection(spark, sf_dir, "regions")
    at = xml.nodes.where("local = 'nation'")
    named = XPath("string(@name)").evaluate(xml, context=at).select("doc_id", "context", F.col("value").alias("name"))
    rich = XPath("supplier[bal > $least]").evaluate(xml, context=at, variables={"least": 5000}, strict=True).groupBy("doc_id", "context").agg(F.count("*").alias("n"))
    return named.join(rich, ["doc_id", "context"], "left").select("doc_id", "name", F.coalesce("n", F.lit(0)).alias("n"))


def _region_nodes(spark: SparkSession, sf_dir: str, local: str) -> tuple[DataFrame, DataFrame]:
    nodes = collection(spark, sf_dir, "regions").nodes
    return nodes, nodes.where(F.col("local") == local).where("kind = 'element'").select("doc_id", "pre")


def navigate_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children, descendants, attributes and all nodes of each region's nations."""
    nodes, at = _region_nodes(spark, sf_dir, "nation")
    parts = {"children": navigate.children(nodes, at), "descendants": navigate.descendants(nodes, at), "attributes": navigate.attributes(nodes, at)}
    out = navigate.sizes(nodes).select("doc_id", F.col("n").alias("nodes"))
    for name, part in parts.items():
        out = out.join(part.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left").fillna(0, [name])
    return out


def navigate_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of each supplier's parent, by attribute(), once for each nation."""
    nodes, at = _region_nodes(spark, sf_dir, "supplier")
    up = navigate.parents(nodes, at)
    return navigate.attribute_ns(nodes, navigate.attribute(nodes, up, "name"), None, "name").select("doc_id", F.col("value").alias("name"))


def navigate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each balance, by text_content() and by text()."""
    nodes, at = _region_nodes(spark, sf_dir, "bal")
    own = navigate.nodes_at(nodes, at).select("doc_id", "pre", navigate.text().alias("text"))
    return navigate.text_content(nodes, at).join(own, ["doc_id", "pre"]).select("doc_id", "value", "text")


def navigate_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root nodes with their elements: names as written, namespaces declared on them."""
    nodes = collection(spark, sf_dir, "customers").nodes
    top = navigate.root_elements(nodes)
    declared = navigate.declared_namespaces(nodes, top).where("local = 'c'").select("doc_id", F.col("value").alias("uri"))
    return navigate.roots(nodes).select("doc_id").join(top.select("doc_id", navigate.qualified_name().alias("name")), "doc_id").join(declared, "doc_id")


def navigate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = collection(spark, sf_dir, "marked")
    return navigate.element_by_id(xml.nodes, xml.ids, "k1").select("doc_id", "local")


def navigate_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source text of each nation's first child element."""
    nodes = nodes_of(shredded(spark, sf_dir, "plots"))
    return navigate.source(tables.plots(spark, sf_dir), nodes, nodes.where("local = 'a'")).select("doc_id", "source")


def all_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of edit in one script for each document, then the text of what is left."""
    nodes = nodes_of(shredded(spark, sf_dir, "plots"))
    name = navigate.attribute(nodes, navigate.root_elements(nodes), "name").select("doc_id", F.col("value").alias("name"))
    # places: n is 1, a 4, its text 5, b 6
    steps = [(1, "append_text", 6, None, None, "x"), (2, "append_comment", 1, None, None, "c"), (3, "append_pi", 1, None, "p", "d"), (4, "set_text", 5, None, None, "NAME"), (5, "reparent", 4, 6, None, None), (6, "append_element", 1, None, "z", None), (7, "insert_at", -6, 1, "0", None), (8, "remove_attribute", 1, None, "name", None), (9, "declare_namespace", 1, None, "q", "urn:q"), (10, "compact", None, None, None, None), (11, "append_element", 1, None, "gone", None), (12, "detach", -11, None, None, None)]
    kinds = {"seq": "int", "op": "string", "target": "int", "arg": "int", "local": "string", "value": "string"}
    each = F.explode(F.array(*(F.struct(*(F.lit(v).cast(k).alias(c) for v, (c, k) in zip(x, kinds.items(), strict=True))) for x in steps)))
    script = name.select("doc_id", "name", each.alias("s")).select("doc_id", "s.seq", "s.op", "s.target", "s.arg", F.lit(None).cast("string").alias("ns"), "s.local", F.when(F.col("s.value") == "NAME", F.col("name")).otherwise(F.col("s.value")).alias("value"))
    return serialise(mutate.edit(nodes, script)).select("doc_id", "xml")


def registered_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL functions over whole pages and balances."""
    register(spark)
    pages = tables.pages(spark, sf_dir)
    return pages.select("doc_id", F.expr("xml_is_well_formed(xml)").alias("ok"), F.expr("xml_error(xml).kind").alias("kind"), F.expr("xpath_number_format(cast(doc_id as double) / 2)").alias("half"))


def function_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """xml_nodes() of each nation's document, laterally."""
    register(spark)
    view = f"plots_{abs(hash(sf_dir))}"
    tables.plots(spark, sf_dir).createOrReplaceTempView(view)
    return spark.sql(f"SELECT doc_id, count_if(kind = 'element') AS elements, max(level) AS depth FROM {view}, LATERAL xml_nodes(xml) GROUP BY doc_id").selectExpr("doc_id", "elements", "cast(depth as bigint) AS depth")


EXTRA: dict[str, tuple[Callable, str | None]] = {
    "parse_bytes": (parsed_bytes, "SELECT c_custkey AS doc_id, true AS ok, CASE c_custkey % 3 WHEN 0 THEN 'latin-1' WHEN 1 THEN 'utf-16-be' ELSE 'utf-8' END AS encoding FROM customer"),
    "evaluate_from_contexts": (from_contexts, "SELECT cast(n_regionkey AS BIGINT) AS doc_id, n_name AS name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND cast(s_acctbal AS DECIMAL(18,2)) > 5000) AS n FROM nation"),
    "navigate_down": (navigate_down, """WITH k AS (SELECT n_regionkey AS r, count(DISTINCT n_nationkey) AS n, count(s_suppkey) AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)
 SELECT cast(r_regionkey AS BIGINT) AS doc_id, 4 + 2 * coalesce(n, 0) + 4 * coalesce(s, 0) AS nodes, coalesce(s, 0) AS children, 3 * coalesce(s, 0) AS descendants, coalesce(n, 0) AS attributes FROM region LEFT JOIN k ON r = r_regionkey"""),
    "navigate_up": (navigate_up, "SELECT cast(n_regionkey AS BIGINT) AS doc_id, n_name AS name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)"),
    "navigate_texts": (navigate_texts, "SELECT cast(n_regionkey AS BIGINT) AS doc_id, cast(cast(s_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS value, cast(cast(s_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "navigate_roots": (navigate_roots, "SELECT c_custkey AS doc_id, 'c:customer' AS name, 'urn:c' AS uri FROM customer"),
    "navigate_ids": (navigate_ids, "SELECT c_custkey AS doc_id, 'c' AS local FROM customer WHERE c_custkey = 1"),
    "navigate_source": (navigate_source, "SELECT cast(n_nationkey AS BIGINT) AS doc_id, '<a>t</a>' AS source FROM nation"),
    "edit_every_kind": (all_edits, "SELECT cast(n_nationkey AS BIGINT) AS doc_id, '<n xmlns:q=\"urn:q\"><z/><b>x<a>' || n_name || '</a></b><!--c--><?p d?></n>' AS xml FROM nation"),
    "functions_registered": (registered_functions, "SELECT page_id AS doc_id, false AS ok, 'MismatchedEndTag' AS kind, CASE WHEN page_id % 2 = 0 THEN cast(page_id // 2 AS VARCHAR) ELSE cast(page_id // 2 AS VARCHAR) || '.5' END AS half FROM pages"),
    "functions_nodes": (function_nodes, "SELECT cast(n_nationkey AS BIGINT) AS doc_id, 3::BIGINT AS elements, 3::BIGINT AS depth FROM nation"),
    "last_line_quantity": (flagship, f"{LINES} SELECT count(*) AS n, round(sum(l_quantity), 2) AS qty FROM l WHERE rn = n"),
    "extract_typed": (extract_typed, f"SELECT c_custkey AS doc_id, c_custkey AS id, {_BAL}::DOUBLE AS balance, c_mktsegment AS segment, {_BAL} > 0 AS positive FROM customer"),
    "parse_errors": (well_formed_pages, "SELECT page_id AS doc_id, false AS ok, 'MismatchedEndTag' AS kind FROM pages"),
    "parse_documents": (document_rows, _o("n").replace("n AS value", "true AS ok, 8 + 10 * n AS n_nodes")),
    "parse_node_kinds": (kinds_of_nodes, f"{LINES} SELECT 'root' AS kind, count(*) AS n FROM o UNION ALL SELECT 'element', sum(2 + 4 * n)::BIGINT FROM o UNION ALL SELECT 'attr', sum(3 + 3 * n)::BIGINT FROM o UNION ALL SELECT 'ns', count(*) FROM o UNION ALL SELECT 'text', sum(1 + 3 * n)::BIGINT FROM o"),
    "serialise_round_trip": (round_trip, "SELECT doc_id, text AS value FROM documents"),
    "serialise_canonical": (serialised, """WITH s AS (SELECT s_nationkey, string_agg('<supplier id="' || s_suppkey || '"><bal>' || cast(cast(s_acctbal AS DECIMAL(18,2)) AS VARCHAR) || '</bal></supplier>', '' ORDER BY s_suppkey) AS x FROM supplier GROUP BY 1),
 n AS (SELECT n_regionkey, string_agg('<nation name="' || n_name || '"' || CASE WHEN x IS NULL THEN '/>' ELSE '>' || x || '</nation>' END, '' ORDER BY n_nationkey) AS y FROM nation LEFT JOIN s ON n_nationkey = s_nationkey GROUP BY 1)
 SELECT cast(r_regionkey AS BIGINT) AS doc_id, '<region name="' || r_name || '"' || CASE WHEN y IS NULL THEN '/>' ELSE '>' || y || '</region>' END AS xml FROM region LEFT JOIN n ON n_regionkey = r_regionkey"""),
    "serialise_pretty": (serialised_pretty, """WITH s AS (SELECT s_nationkey, string_agg('    <supplier id="' || s_suppkey || '">' || e || '      <bal>' || cast(cast(s_acctbal AS DECIMAL(18,2)) AS VARCHAR) || '</bal>' || e || '    </supplier>' || e, '' ORDER BY s_suppkey) AS x FROM supplier, (SELECT chr(13) || chr(10) AS e) GROUP BY 1),
 n AS (SELECT n_regionkey, string_agg('  <nation name="' || n_name || '"' || CASE WHEN x IS NULL THEN ' />' || e ELSE '>' || e || x || '  </nation>' || e END, '' ORDER BY n_nationkey) AS y FROM nation CROSS JOIN (SELECT chr(13) || chr(10) AS e) LEFT JOIN s ON n_nationkey = s_nationkey GROUP BY 1)
 SELECT cast(r_regionkey AS BIGINT) AS doc_id, '<region name="' || r_name || '"' || CASE WHEN y IS NULL THEN ' />' ELSE '>' || chr(13) || chr(10) || y || '</region>' END AS xml FROM region LEFT JOIN n ON n_regionkey = r_regionkey"""),
    "serialise_version": (xml_11_needed, "SELECT doc_id, regexp_matches(text, '[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]') AS needs FROM documents"),
    "events_of_documents": (pulled_events, f"{LINES} SELECT 'StartElement' AS type, sum(2 + 4 * n)::BIGINT AS n FROM o UNION ALL SELECT 'EndElement', sum(2 + 4 * n)::BIGINT FROM o UNION ALL SELECT 'Text', sum(1 + 3 * n)::BIGINT FROM o"),
    "navigate_nations": (navigation, "SELECT cast(n_regionkey AS BIGINT) AS doc_id, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS sib, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation"),
    "edit_documents": (edited, f"{LINES} SELECT o_orderkey AS doc_id, greatest(n - 1, 0) AS line, 1::BIGINT AS note, 1::BIGINT AS checked, NULL::VARCHAR AS error FROM o"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{f"xpath_{k}": c.run for k, c in CASES.items()}, **{k: f for k, (f, _) in EXTRA.items()}}


def oracle_sql() -> dict[str, str]:
    return {**{f"xpath_{k}": c.sql for k, c in CASES.items()}, **{k: s for k, (_, s) in EXTRA.items() if s}}
