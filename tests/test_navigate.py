"""Navigation over a small document."""

import pytest

from xylem.operators import navigate as nav
from xylem.sources.shred import ids_of, nodes_of, shred

XML = '<!DOCTYPE r [<!ATTLIST a k ID #IMPLIED>]><r xmlns:m="urn:m" id="0"><!--c--><a k="one" x="1" m:x="2">t</a><m:b>u<c/></m:b><e/></r>'


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(1, XML)], "doc_id long, xml string")
    out = shred(docs).persist()
    return docs, nodes_of(out), ids_of(out)


def names(df):
    return [r["local"] or r["kind"] for r in nav.in_document_order(df).collect()]


def test_navigation(tables):
    docs, nodes, ids = tables
    r = nav.root_elements(nodes)
    assert names(r) == ["r"] and names(nav.roots(nodes)) == ["root"]
    assert names(nav.children(nodes, r)) == ["comment", "a", "b", "e"]
    assert names(nav.descendants(nodes, r)) == ["comment", "a", "text", "b", "text", "c", "e"]
    assert names(nav.parents(nodes, nodes.where("local = 'c'"))) == ["b"]
    a = nav.element_by_id(nodes, ids, "one")
    assert names(a) == ["a"] and names(nav.attributes(nodes, a)) == ["k", "x", "x"]
    assert sorted(names(nav.declared_namespaces(nodes, r))) == ["m", "xml"]
    assert nav.attribute(nodes, a, "x").first()["value"] == "1"
    assert nav.attribute_ns(nodes, a, "urn:m", "x").first()["value"] == "2"
    assert nav.attribute_ns(nodes, a, None, "none").count() == 0
    content = {x["pre"]: x["value"] for x in nav.text_content(nodes, nodes.where("kind = 'element'")).collect()}
    assert content[a.first()["pre"]] == "t" and sum(v is None for v in content.values()) == 4
    assert nodes.where("local = 'b'").select(nav.qualified_name().alias("q")).first()["q"] == "m:b"
    assert nodes.where("kind = 'comment'").select(nav.text().alias("t")).first()["t"] == ""
    found = {x["source"] for x in nav.source(docs, nodes, nodes.where("kind IN ('element', 'comment')")).collect()}
    assert {"<e/>", "<c/>", "<m:b>u<c/></m:b>", '<a k="one" x="1" m:x="2">t</a>', "<!--c-->"} <= found
    assert nav.sizes(nodes).first()["n"] == nodes.count()


def test_empty(spark):
    assert [r["kind"] for r in nav.empty(spark, 3).collect()] == ["root"]
