"""Shredding, encodings, limits, events, streaming, serialising and edits."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from xylem import queries as xml_queries
from xylem.functions.register import register
from xylem.functions.scalars import format_number
from xylem.model import NODE_COLUMNS, Limits, NodeError, XmlError
from xylem.operators import mutate
from xylem.operators.serialise import Options, escape_attribute, escape_text, serialise, write_document
from xylem.sources import encoding, plain
from xylem.sources.shred import docs_of, ids_of, nodes_of, shred, shred_bytes, shred_text, shredded_batches
from xylem.streaming.events import PushReader, events_of, read_events, stream_events

NAMES = ["pre", "size", "level", "parent", "sib", "kind", "local", "ns_uri", "prefix", "value", "lang", "src_start", "src_end"]


def rows(text, **more):
    return [dict(zip(NAMES, r, strict=True)) for r in shred_text(text, **more).rows]


def shape(text):
    return [(r["kind"], r["local"], r["ns_uri"], r["value"]) for r in rows(text) if r["kind"] not in ("root", "ns")]


def test_nodes_in_document_order():
    got = rows('<a x="1" xmlns:p="urn:p">t<b/>u<![CDATA[v]]>&amp;<!--c--><?pi d?></a>')
    assert [r["kind"] for r in got] == ["root", "element", "ns", "ns", "attr", "text", "element", "text", "comment", "pi"]
    assert got[1]["value"] == "tuv&" and got[0]["value"] == "tuv&" and got[1]["size"] == 8
    assert [r["sib"] for r in got] == [None, 0, None, None, None, 0, 1, 2, 3, 4]
    assert [r["parent"] for r in got] == [None, 0, 1, 1, 1, 1, 1, 1, 1, 1]
    b = got[6]
    assert '<a x="1" xmlns:p="urn:p">t<b/>u'[b["src_start"] : b["src_end"]] == "<b/>"


@pytest.mark.parametrize(
    "text,kind",
    [
        ("", "NoRootElement"), ("<a>", "UnexpectedEof"), ("<a></b>", "MismatchedEndTag"), ("<a/><b/>", "TrailingContent"), ("<a x='1' x='2'/>", "DuplicateAttribute"), ("<p:a/>", "UnboundPrefix"),
        ("<a>&nope;</a>", "UnknownEntity"), ("<a>]]></a>", "IllegalCdataEnd"), ("<a x=1/>", "UnquotedAttributeValue"), ("<a>&#0;</a>", "IllegalCharacter"), ("<a xmlns:p=''/>", "ReservedNamespace"), ("<a><![CDATA[x</a>", "Unterminated"),
        ("<a xmlns:p='u' xmlns:q='u' p:x='1' q:x='2'/>", "DuplicateAttribute"), ("<!DOCTYPE a [<!ENTITY e '&e;'>]><a>&e;</a>", "EntityLimitExceeded"),
    ],
)
def test_errors(text, kind):
    with pytest.raises(XmlError) as e:
        shred_text(text)
    assert e.value.kind == kind


@pytest.mark.parametrize(
    "text,kind",
    [("<a>x&b</a>", "Unterminated"), ("<a>x & y<b/>; z</a>", "Unterminated"), ("<a>&#12</a>", "Unterminated"), ("<a x='1&b' y=';'/>", "Unterminated"), ("<a x='1'>&b</a>", "Unterminated"), ("<a>x & y; z</a>", "InvalidName"), ("<a x='1'>it& 's; z</a>", "InvalidName"), ("<a>&amp;<1></a>", "InvalidName"), ("<a><!--&a--><1/></a>", "InvalidName")],
)
def test_references_without_an_end(text, kind):
    with pytest.raises(XmlError) as e:
        shred_text(text)
    assert e.value.kind == kind


def test_limits():
    deep = "<a>" * 300 + "</a>" * 300
    for text, limits, kind in ((deep, Limits(), "DepthLimitExceeded"), ("<a><b/></a>", Limits(max_nodes=2), "TooManyNodes"), ("<a x='1' y='2'/>", Limits(max_attributes_per_element=1), "TooManyAttributes"), ("<a x='123'/>", Limits(max_attribute_size=2), "AttributeTooLarge"), ("<abc/>", Limits(max_name_length=2), "NameTooLong"), ("<a>abc</a>", Limits(max_text_length=2), "TextTooLong"), ("<a>abc</a>", Limits(max_document_bytes=3), "DocumentTooLarge")):
        with pytest.raises(XmlError) as e:
            shred_text(text, limits)
        assert e.value.kind == kind
    with pytest.raises(XmlError) as e:
        shred_bytes(b"<a>abc</a>", Limits(max_input_bytes=3))
    assert e.value.kind == "InputTooLarge"
    bomb = "<!DOCTYPE a [<!ENTITY a '" + "x" * 1000 + "'>" + "".join(f"<!ENTITY {b} '{('&' + a + ';') * 10}'>" for a, b in zip("abcdefg", "bcdefgh", strict=True)) + "]><a>&h;</a>"
    with pytest.raises(XmlError) as e:
        shred_text(bomb)
    assert e.value.kind == "EntityLimitExceeded"


def test_encodings():
    text = "<a>é</a>"
    for data in (text.encode(), b"\xef\xbb\xbf" + text.encode(), b"\xff\xfe" + text.encode("utf-16-le"), b"\xfe\xff" + text.encode("utf-16-be"), text.encode("utf-16-le"), b"<?xml version='1.0' encoding='ISO-8859-1'?>" + text.encode("latin-1"), "<?xml version='1.0' encoding='UTF-16'?><a>é</a>".encode("utf-16")):
        assert shred_bytes(data).rows[0][9] == "é"
    for bad in (b"<a>\xe9</a>", b"\xff\xfe" + "<?xml version='1.0' encoding='UTF-8'?><a/>".encode("utf-16-le"), b"<?xml version='1.0' encoding='UTF-16'?><a/>", b"<?xml version='1.0' encoding='x-none'?><a/>", b"\xff\xfe<\x00a\x00/\x00>\x00\x00\xd8"):
        with pytest.raises(XmlError):
            shred_bytes(bad)
    assert encoding.from_name("Latin1") == "latin-1" and encoding.is_legal_name("utf-8") and not encoding.is_legal_name("8bit")


def test_fifth_edition_names_and_version_11():
    assert shape("<Ĳ ⰰ='1'>é</Ĳ>") == [("element", "Ĳ", None, "é"), ("attr", "ⰰ", None, "1"), ("text", None, None, "é")]
    with pytest.raises(XmlError):
        shred_text("<Ĳ/>", Limits(fourth_edition=True))
    assert rows("<?xml version='1.1'?><a>&#1;\x85</a>")[1]["value"] == "\x01\n"
    with pytest.raises(XmlError):
        shred_text("<a>&#1;</a>")


def test_entities_and_ids():
    assert shape("<!DOCTYPE a [<!ENTITY e 'x<b/>y'>]><a>&e;</a>")[0] == ("element", "a", None, "xy")
    out = shred_text("<!DOCTYPE a [<!ATTLIST b k ID #IMPLIED v CDATA 'default'>]><a><b k='  one '/><b k='two'/><b k='one'/></a>")
    assert out.ids == {"one": 3, "two": 5} and all(r[6] != "v" for r in out.rows)
    assert shape("<!DOCTYPE a SYSTEM 'x.dtd'><a>&u;</a>")[0][3] == ""
    assert rows("<!DOCTYPE a [<!ENTITY e SYSTEM 'e.txt'>]><a>&e;</a>", external={"e.txt": "<b>in</b>"})[1]["value"] == "in"


def test_bad_documents_are_rows(spark):
    df = spark.createDataFrame([(1, "<a/>"), (2, "<a>"), (3, None)], "doc_id long, xml string")
    out = shred(df)
    docs = {r["doc_id"]: r for r in docs_of(out).collect()}
    assert docs[1]["ok"] and not docs[2]["ok"] and not docs[3]["ok"] and docs[2]["line"] == 1
    assert {r["doc_id"] for r in nodes_of(out).collect()} == {1} and ids_of(out).count() == 0
    binary = spark.createDataFrame([(1, bytearray("<a>é</a>".encode("utf-16")))], "doc_id long, xml binary")
    assert nodes_of(shred(binary)).where("kind = 'text'").first()["value"] == "é"
    assert shred(df.where("false")).count() == 0


def test_escapes():
    assert escape_text("a<b>&\r\x01\x85") == "a&lt;b&gt;&amp;&#13;&#1;&#133;"
    assert escape_attribute('"\t\n') == "&quot;&#9;&#10;"


@pytest.mark.parametrize("text", ['<a x="1&#10;2">t<b/>u&amp;<!--c--><?p d?></a>', '<a xmlns="urn:d" xmlns:p="urn:p" p:x="1"><p:b/><c xmlns=""><d/></c></a>', "<?xml version='1.1'?><a>&#1;</a>", "<!--h--><a/><?t?>", "<a>&#13;\n]]&gt;</a>"])
def test_round_trip(text):
    once = rows(text)
    xml = write_document(once)
    again = rows(xml)
    drop = lambda rs: [{k: v for k, v in r.items() if not k.startswith("src")} for r in rs]
    assert drop(again) == drop(once) and write_document(again) == xml


def test_options(spark):
    tree = rows("<a><b><c/></b><d>t</d></a>")
    assert write_document(tree, Options(indent=2)) == "<a>\n  <b>\n    <c/>\n  </b>\n  <d>t</d>\n</a>"
    assert write_document(tree, Options(indent="\t", empty="<a />", newline="\r\n")) == "<a>\r\n\t<b>\r\n\t\t<c />\r\n\t</b>\r\n\t<d>t</d>\r\n</a>"
    assert write_document(rows("<a/>"), Options(empty="<a></a>")) == "<a></a>"
    with pytest.raises(XmlError):
        write_document([r for r in tree if r["kind"] == "root"], Options(checked=True))
    made = nodes_of(shred(spark.createDataFrame([(5, "<a><b/></a>"), (6, "<x>y</x>")], "doc_id long, xml string")))
    assert {r["doc_id"]: r["xml"] for r in serialise(made).collect()} == {5: "<a><b/></a>", 6: "<x>y</x>"}


def test_namespaces_are_repaired():
    tree = mutate.Tree()
    a = tree.append_element(0, "urn:a", "a", "p")
    tree.nodes[-1] = a
    tree.set_attribute(-1, "urn:b", "x", "1")
    names = ["pre", "size", "level", "parent", "sib", "kind", "local", "ns_uri", "prefix", "value"]
    xml = write_document([dict(zip(names, r, strict=False)) for r in tree.rows()])
    got = rows(xml)
    assert (got[1]["local"], got[1]["ns_uri"]) == ("a", "urn:a") and any(r["kind"] == "attr" and r["ns_uri"] == "urn:b" for r in got)


def test_edits(spark):
    nodes = nodes_of(shred(spark.createDataFrame([(1, "<a><b>x</b><c/></a>"), (2, "<a/>"), (3, "<a/>")], "doc_id long, xml string")))
    b = nodes.where("local = 'b'").first()["pre"]
    c = nodes.where("local = 'c'").first()["pre"]
    text = nodes.where("kind = 'text'").first()["pre"]
    ops = [
        (1, 1, "append_element", c, None, None, "d", None), (1, 2, "append_text", -1, None, None, None, "new"), (1, 3, "set_attribute", b, None, None, "k", "v"), (1, 4, "set_text", text, None, None, None, "y"), (1, 5, "reparent", b, c, None, None, None),
        (1, 6, "append_comment", c, None, None, None, "n"), (1, 7, "append_pi", c, None, None, "t", "d"), (1, 8, "declare_namespace", c, None, None, "p", "urn:p"), (1, 9, "insert_at", -1, 1, None, "0", None), (1, 10, "compact", None, None, None, None, None),
        (2, 1, "append_element", 0, None, None, "second", None),
    ]
    after = mutate.edit(nodes, spark.createDataFrame(ops, mutate.SCRIPT)).persist()
    out = {r["doc_id"]: r["xml"] for r in serialise(after).collect()}
    assert out == {1: '<a><d>new</d><c xmlns:p="urn:p"><b k="v">y</b><!--n--><?t d?></c></a>', 2: "<a/>", 3: "<a/>"}
    assert {(r["doc_id"], r["error_kind"]) for r in after.collect()} == {(1, None), (2, "RootElementExists"), (3, None)}
    tree = mutate.Tree(rows("<a><b/></a>"))
    for bad in (lambda: tree.insert_at(1, 3, None), lambda: tree.append_element(1, None, "1x"), lambda: tree.append_comment(1, "a--b"), lambda: tree.append_pi(1, "xml", ""), lambda: tree.remove(0), lambda: tree.set_text(1, "x"), lambda: tree.get(99), lambda: tree.append_text(0, "x"), lambda: tree.declare_namespace(1, "xmlns", "u")):
        with pytest.raises(NodeError):
            bad()
    assert tree.remove_attribute(1, None, "none") is False


def test_builder():
    made = mutate.Builder("a").attr("x", "1").text("t").child("b").text("u").up().child("c").finish()
    assert write_document([dict(zip(NAMES, r, strict=True)) for r in made]) == '<a x="1">t<b>u</b><c/></a>'
    with pytest.raises(NodeError):
        mutate.Builder("a").child("1").finish()


DOC = "<a x='é'>t<b>&amp;</b><!--c--><?p d?>u</a>"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, len(DOC.encode())), max_size=8))
def test_events_do_not_depend_on_chunks(cuts):
    data, at = DOC.encode(), sorted({0, *cuts, len(DOC.encode())})
    reader, got = PushReader(), []
    for a, b in zip(at, at[1:], strict=False):
        got += reader.feed(data[a:b], b == len(data))
    assert got == list(events_of(DOC))


def test_events(spark):
    kinds = [e["type"] for e in events_of("<a><b/>t</a>")]
    assert kinds == ["StartElement", "StartElement", "EndElement", "Text", "EndElement"]
    reader = PushReader()
    bad = reader.feed(b"<a></b>", True)
    assert bad[-1]["type"] == "Error" and bad[-1]["error_kind"] == "MismatchedEndTag" and reader.feed(b"<c/>") == []
    df = spark.createDataFrame([(1, DOC), (2, "<a>")], "doc_id long, xml string")
    got = read_events(df).collect()
    assert [r["type"] for r in sorted(got, key=lambda r: (r["doc_id"], r["seq"])) if r["doc_id"] == 2] == ["StartElement", "Error"]


def test_stream_of_chunks(spark, tmp_path):
    data = DOC.encode()
    parts = [(1, k, data[a : a + 7], a + 7 >= len(data)) for k, a in enumerate(range(0, len(data), 7))] + [(2, 0, b"<a></b>", True), (2, 1, b"<c/>", True)]
    schema = "doc_id long, seq long, data binary, is_last boolean"
    for k in range(3):  # files arrive one after another
        pd.DataFrame([p for p in parts if p[1] * 3 // 7 == k], columns=["doc_id", "seq", "data", "is_last"]).to_parquet(tmp_path / f"{k}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    q = stream_events(stream).writeStream.format("memory").queryName("pulled").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(spark.table("pulled").collect(), key=lambda r: (r["doc_id"], r["seq"]))
    assert [r["type"] for r in got if r["doc_id"] == 1] == [e["type"] for e in events_of(DOC)]
    assert [r["text"] for r in got if r["doc_id"] == 1] == [e["text"] for e in events_of(DOC)]
    assert [r["type"] for r in got if r["doc_id"] == 2] == ["StartElement", "Error"]


def test_sql_functions(spark):
    register(spark)
    spark.createDataFrame([(1, "<a><b/></a>"), (2, "<a>")], "id long, xml string").createOrReplaceTempView("x")
    got = spark.sql("SELECT id, xml_is_well_formed(xml) AS ok, xml_error(xml).kind AS kind FROM x ORDER BY id").collect()
    assert [(r["ok"], r["kind"] is None) for r in got] == [(True, True), (False, False)]
    got = spark.sql("SELECT id, n.local FROM x, LATERAL xml_nodes(x.xml) n WHERE n.kind = 'element' ORDER BY n.pre").collect()
    assert [(r["id"], r["local"]) for r in got] == [(1, "a"), (1, "b")]
    assert spark.sql("SELECT xpath_number_format(17.5D) AS s").first()["s"] == "17.5"


@pytest.mark.parametrize("x,s", [(1.0, "1"), (-4.0, "-4"), (1.5, "1.5"), (9.99 + 7.5, "17.49"), (0.1 + 0.2, "0.3"), (float("inf"), "Infinity"), (-0.0, "0"), (1e20, "100000000000000000000"), (1e-7, "0.0000001"), (123456789.125, "123456789.125"), (1e22, "10000000000000000000000")])
def test_number_format(x, s):
    assert format_number(x) == s


def test_edit_shuffles_nodes_once(spark):
    """Nodes and operations meet in one shuffle, in pieces of many rows, whatever the number of documents and pieces."""
    docs = [(i, f"<a><b>{i}</b><c/></a>") for i in range(300)]
    nodes = nodes_of(shred(spark.createDataFrame(docs, "doc_id long, xml string")))
    script = spark.createDataFrame([(i, 1, "remove", 3, None, None, None, None) for i in range(0, 300, 3)] + [(1, 1, "remove", 99, None, None, None, None)], mutate.SCRIPT)
    after = mutate.edit(nodes, script)
    assert after._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    assert after._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {r["doc_id"]: (r["value"], r["error_kind"]) for r in after.where("kind = 'root'").collect()}
    assert got == {i: ("" if i % 3 == 0 else str(i), "Stale" if i == 1 else None) for i in range(300)}


PLAIN = ["<a/>", "<a p='1'>t</a>", '<a p="1" q = "x y"><b>t</b>u<c r=""/><b>v<d/></b> </a >', "<a><b></a></b>", "<a><b/>", '<a p="1" p="2"/>', "<a>x&amp;y</a>", "<a>\n</a>", "<x:a/>", '<a xmlns="u"><b/></a>', "<a/><b/>", "<a>é</a>", "<!--c--><a/>", '<a p="<"/>', "<a>></a>", "", "<a></a> ", '<a p="1"q="2"/>', "<a>" + "t" * 9_000 + "</a>", "<1/>", "</a>", "<a><b><c>t</c></b><b>u<c/></b></a>"]


@pytest.mark.parametrize("limits", [Limits(), Limits(max_depth=2, max_nodes=9, max_attributes_per_element=1, max_attribute_size=2, max_text_length=2)])
def test_plain_documents_are_read_as_the_parser_reads_them(limits):
    """Many at a time, as columns; what isn't plain is left to the parser."""
    found, nodes, n_nodes = plain.Parser(limits).parse(pa.array(range(len(PLAIN)), pa.int64()), pa.array(PLAIN))
    one_by_one = [[[i, *r] for r in shred_text(PLAIN[i], limits).rows] for i in range(len(PLAIN)) if found[i]]
    assert [list(r.values()) for r in nodes.to_pylist()] == sum(one_by_one, []) and n_nodes.tolist() == [len(x) for x in one_by_one]
    assert [PLAIN[i] for i in range(len(PLAIN)) if found[i]] == [PLAIN[i] for i in ((0, 2, 21) if limits == Limits() else (0,))]


def test_columns_are_edited_as_trees():
    text = '<o k="1"><t>5</t><l><q>1</q><e/></l>x<l><q>2</q></l></o>'
    n = len(shred_text(text).rows)
    nodes = pa.Table.from_batches([x for x, _, _ in shredded_batches([pa.RecordBatch.from_arrays([pa.array(range(3 * n), pa.int64()), pa.array([text] * (3 * n))], ["doc_id", "xml"])], Limits())])
    ops = [(d, s, op, (d // 3 + s * (d % 3)) % n, None, None, f"n{s}", ("", "v")[s % 2]) for d in range(3 * n) for s, op in enumerate(("set_attribute", "remove", "append_element", "append_element"))]
    ops += [(0, 9, "detach", 3, None, None, None, None)]
    schema = mutate._schema(mutate.SCRIPT)
    script = lambda d: [dict(zip(schema.names, x, strict=True)) for x in ops if x[0] == d]
    steps = pa.Table.from_pylist([x for d in range(3 * n) for x in script(d)], schema)
    got = pa.Table.from_batches(list(mutate._edited_batches(nodes, steps)))
    want = [x for d in range(3 * n) for x in mutate._edited_tree(d, [r for r in nodes.to_pylist() if r["doc_id"] == d], script(d))]
    assert sorted((tuple(r.values()) for r in got.to_pylist()), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])
    at = np.arange(3 * n)
    simple = mutate._simple(nodes.combine_chunks(), steps, at * n, (at + 1) * n, np.searchsorted(steps["doc_id"].to_numpy(), at), np.searchsorted(steps["doc_id"].to_numpy(), at, "right"))
    assert 0 < simple.sum() < 3 * n


def test_edit_documents_in_one_pass(spark, tmp_path):
    """As edit() with a script made of the nodes, with nothing written and no shuffle; text that isn't plain is edited too."""
    docs = [(1, "<a><b>1</b><b/><c/></a>"), (2, "<a><b>&lt;</b></a>"), (3, "<a>"), (4, "<c/>"), (5, None)]
    df = spark.createDataFrame(docs, "doc_id long, xml string")
    steps = [mutate.Step(1, "remove", {"local": "b", "sib": 0}), mutate.Step(2, "set_attribute", {"local": "c"}, local="k", value="v")]
    after = mutate.edit_documents(df, steps)
    assert after._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    script = [(1, 1, "remove", 3, None, None, None, None), (1, 2, "set_attribute", 6, None, None, "k", "v"), (2, 1, "remove", 3, None, None, None, None), (4, 2, "set_attribute", 1, None, None, "k", "v")]
    want = mutate.edit(nodes_of(shred(df)), spark.createDataFrame(script, mutate.SCRIPT))
    key = lambda r: (r["doc_id"], r["pre"])
    assert sorted(after.collect(), key=key) == sorted(want.collect(), key=key)
    assert {(r["doc_id"], r["xml"]) for r in serialise(after.select(*NODE_COLUMNS)).select("doc_id", "xml").collect()} == {(1, '<a><b/><c k="v"/></a>'), (2, "<a/>"), (4, '<c k="v"/>')}
    some = mutate.edit_documents(df, steps, ["doc_id", "local"])
    assert some.columns == ["doc_id", "local"] and some.count() == after.count()


def test_edit_documents_query_writes_no_nodes(spark):
    assert {f.rsplit("/", 1)[-1] for f in xml_queries.edited(spark, "/root/testdata/sf0.001").inputFiles()} == {"orders.parquet", "lineitem.parquet"}
