"""Shredding: documents to rows of nodes, in one pass over Arrow batches.

A document that isn't well-formed, or exceeds a limit, is a row of docs with
ok = false and its error; it has no nodes. It never fails the job.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.model import DOCS, IDS, NODES, XML_NS, Limits, XmlError
from xylem.sources import encoding as enc
from xylem.sources import plain

SEP = "\x1f"
_START_TAG = re.compile(rb"<[^\"'>]*(?:(?:\"[^\"]*\"|'[^']*')[^\"'>]*)*>")
_IN_VALUE = re.compile(rb"<[^\"'>]*(?:(?:\"[^\"]*\"|'[^']*')[^\"'>]*)*([\"'])(?:(?!\1)[^<])*")
_QUOTED = re.compile(rb"\"[^\"]*\"|'[^']*'|<!--.*?-->", re.S)
_REFERENCE = re.compile(rb"&([^#&;\s][^&;\s]*);")
_NO_MARKUP = re.compile(rb"<!\[CDATA\[.*?\]\]>|<!--.*?-->|<\?.*?\?>", re.S)
#: What expat's codes are called here.
KINDS_BY_CODE = {
    2: "InvalidName", 3: "NoRootElement", 4: "InvalidName", 5: "Unterminated", 6: "MalformedEncoding", 7: "MismatchedEndTag", 8: "DuplicateAttribute", 9: "TrailingContent", 10: "MalformedDtd", 11: "UnknownEntity", 12: "EntityLimitExceeded", 14: "IllegalCharacter", 15: "ForbiddenEntityReference", 16: "ForbiddenEntityReference",
    17: "ReservedPiTarget", 18: "UnsupportedEncoding", 19: "MalformedEncoding", 20: "Unterminated", 21: "MalformedDtd", 24: "MalformedDtd", 27: "UnboundPrefix", 28: "ReservedNamespace", 29: "MalformedDtd", 30: "MalformedDeclaration", 31: "MalformedDeclaration", 32: "MalformedDtd", 38: "ReservedNamespace", 39: "ReservedNamespace", 40: "ReservedNamespace", 43: "EntityLimitExceeded",
}


def _reference_unterminated(data: bytes, at: int) -> bool:
    """Whether byte `at` breaks off a reference in text or an attribute's value that has no `;` before the next `<` or the value's quote."""
    amp = data.rfind(b"&", 0, at)
    if amp < 0 or data[at] < 0x20 and data[at] not in b"\t\r\n" or re.search(rb"[\s<;\"']", data[amp:at]):
        return False
    tag = data.rfind(b"<", 0, amp)
    value = _IN_VALUE.fullmatch(data, tag, amp) if tag >= 0 else None
    if value and data[tag + 1 : tag + 2] in (b"!", b"?"):
        return False
    found = re.compile(rb"[;<" + (value[1] if value else b"") + rb"]").search(data, amp)
    return not found or found[0] != b";"


def kind_of(code: int, data: bytes, at: int, inside: bool) -> str:
    """The kind of error of expat's code at byte `at` of data; inside: whether an element is open. Codes that cover several kinds are told apart by the bytes."""
    if code == 3 and inside:
        return "UnexpectedEof"
    if code == 5 and re.match(rb"<[^!?/]", data[at : at + 2]):
        # a tag without an end: the input ends in an attribute's value or between its parts
        return "Unterminated" if re.search(rb"[\"']", re.sub(rb"\"[^\"]*\"|'[^']*'", b"", data[at:])) else "UnexpectedEof"
    if code != 4 or at >= len(data):
        return KINDS_BY_CODE.get(code, "InvalidName")
    if data[max(0, at - 2) : at + 1] == b"]]>":
        return "IllegalCdataEnd"
    if data[max(0, at - 2) : at] == b"--" and data.rfind(b"<!--", 0, at) > data.rfind(b"-->", 0, at - 2):
        return "MalformedComment"
    if _reference_unterminated(data, at):
        return "Unterminated"
    tag = data.rfind(b"<", 0, at)
    if tag >= 0 and re.fullmatch(rb"<[^\s!?/=\"'>]+(?:\s+[^\s=\"'>]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*(?:\s+[^\s=\"'>]+\s*(?:=\s*)?)?", data[tag:at]) and data[at] not in b"<" and data[tag:at].rstrip()[-1:] in b"=\"'":
        return "UnquotedAttributeValue"
    return "InvalidName"


@dataclass
class Shredded:
    """A document's nodes in order, as lists of the columns of NODES without doc_id."""

    rows: list[list] = field(default_factory=list)
    ids: dict[str, int] = field(default_factory=dict)
    encoding: str = "utf-8"
    version: str = "1.0"


# places in a row
PRE, SIZE, LEVEL, PARENT, SIB, KIND, LOCAL, NS, PREFIX, VALUE, LANG, START, END = range(13)


class _Builder:
    def __init__(self, text: str, limits: Limits, external: dict[str, str] | None, masked: bool):
        self.data = text.encode()
        self.limits, self.external = limits, external or {}
        self.show = enc.unmask if masked else (lambda x: x)
        self.out = Shredded()
        self.parser = p = expat.ParserCreate("utf-8", SEP)
        p.namespace_prefixes = True
        p.ordered_attributes = p.specified_attributes = True
        p.buffer_text = True
        p.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_UNLESS_STANDALONE if self.external else expat.XML_PARAM_ENTITY_PARSING_NEVER)
        p.StartElementHandler, p.EndElementHandler = self.start, self.end
        p.CharacterDataHandler, p.CommentHandler, p.ProcessingInstructionHandler = self.text, self.comment, self.pi
        p.StartNamespaceDeclHandler = lambda prefix, uri: self.declared.append((prefix, uri))
        p.AttlistDeclHandler = self.attlist
        p.ExternalEntityRefHandler = self.external_entity
        p.StartDoctypeDeclHandler, p.EndDoctypeDeclHandler = self.doctype, self.end_doctype
        p.EntityDeclHandler = self.entity
        self.declared: list[tuple] = []
        self.id_attributes: set[tuple[str, str]] = set()
        self.in_doctype = self.parameter_chars = 0
        self.entities: dict[str, list[str]] = {}  # the references in each internal entity's text
        self.nested: dict[str, int] = {}
        self.depth = self.chars = self.entity_depth = 0
        root = [0, 0, 0, None, None, "root", None, None, None, None, None, 0, len(self.data)]
        self.out.rows.append(root)
        self.stack = [root]
        self.children = [0]
        self.parts: list[str] = []  # the document's text so far
        self.marks = [0]  # how many parts there were when each open node began
        self.run: list[str] = []

    def fail(self, kind: str, detail: str = "") -> None:
        p = self.parser
        raise XmlError(kind, detail, max(0, p.CurrentByteIndex), p.CurrentLineNumber, p.CurrentColumnNumber + 1)

    def add(self, kind, local, ns, prefix, value, start, end, child=True):
        rows = self.out.rows
        if len(rows) >= self.limits.max_nodes:
            self.fail("TooManyNodes", "max_nodes")
        parent = self.stack[-1]
        sib = None
        if child:
            sib = self.children[-1]
            self.children[-1] += 1
        row = [len(rows), 0, len(self.stack), parent[PRE], sib, kind, local, ns, prefix, value, parent[LANG], start, end]
        rows.append(row)
        return row

    def flush(self):
        if self.run:
            text = self.show("".join(self.run))
            self.run = []
            if len(self.stack) > 1:
                if len(text) > self.limits.max_text_length:
                    self.fail("TextTooLong", "max_text_length")
                self.add("text", None, None, None, text, self.run_start, max(self.run_start, self.parser.CurrentByteIndex))
                self.parts.append(text)

    def name(self, raw: str) -> tuple[str, str | None, str | None]:
        parts = raw.split(SEP)
        if len(parts[-1]) > self.limits.max_name_length:
            self.fail("NameTooLong", "max_name_length")
        if len(parts) == 1:
            return self.show(raw), None, None
        if len(parts) == 2:
            return self.show(parts[1]), self.show(parts[0]), None
        return self.show(parts[1]), self.show(parts[0]), self.show(parts[2])

    def start(self, raw, attributes):
        self.flush()
        self.depth += 1
        limits = self.limits
        if self.depth > limits.max_depth:
            self.fail("DepthLimitExceeded", "max_depth")
        if len(attributes) // 2 > limits.max_attributes_per_element:
            self.fail("TooManyAttributes", "max_attributes_per_element")
        local, ns, prefix = self.name(raw)
        row = self.add("element", local, ns, prefix, None, self.parser.CurrentByteIndex, None)
        self.stack.append(row)
        self.children.append(0)
        self.marks.append(len(self.parts))
        if row[PARENT] == 0:
            self.declared.insert(0, ("xml", XML_NS))
        for p, uri in self.declared:
            self.add("ns", self.show(p) or "", None, None, self.show(uri) or "", row[START], row[START], False)
        self.declared = []
        own = f"{prefix}:{local}" if prefix else local
        attrs = []
        for raw_name, value in zip(attributes[::2], attributes[1::2], strict=True):
            if len(value) > limits.max_attribute_size:
                self.fail("AttributeTooLarge", "max_attribute_size")
            self.expanded(len(value))
            a_local, a_ns, a_prefix = self.name(raw_name)
            value = self.show(value)
            if a_ns == XML_NS and a_local == "lang":
                row[LANG] = value
            attrs.append((a_local, a_ns, a_prefix, value))
        for a_local, a_ns, a_prefix, value in attrs:
            a = self.add("attr", a_local, a_ns, a_prefix, value, row[START], row[START], False)
            if (own, f"{a_prefix}:{a_local}" if a_prefix else a_local) in self.id_attributes:
                self.out.ids.setdefault(value.strip(" \t\r\n"), row[PRE])
            a[LANG] = row[LANG]

    def end(self, raw):
        self.flush()
        self.depth -= 1
        row = self.stack.pop()
        empty = not self.children.pop()
        row[SIZE] = len(self.out.rows) - 1 - row[PRE]
        row[VALUE] = "".join(self.parts[self.marks.pop() :])
        tag = _START_TAG.match(self.data, row[START]) if empty else None
        if tag and tag[0].endswith(b"/>"):
            row[END] = tag.end()
        else:
            row[END] = self.data.find(b">", max(self.parser.CurrentByteIndex, 0)) + 1
        if not self.stack[1:]:
            self.root_value = row[VALUE]

    def text(self, data):
        if not self.run:
            self.run_start = self.parser.CurrentByteIndex
        self.run.append(data)
        self.expanded(len(data))

    def expanded(self, size: int) -> None:
        """Count characters of text and attributes: what is beyond the document's bytes comes from entities."""
        self.chars += size
        if self.chars > len(self.data) + self.limits.max_entity_expansion:
            self.fail("EntityLimitExceeded", "max_entity_expansion")

    def comment(self, data):
        if self.in_doctype:
            return
        self.flush()
        at = self.parser.CurrentByteIndex
        self.add("comment", None, None, None, self.show(data), at, self.data.find(b"-->", at) + 3)

    def pi(self, target, data):
        if self.in_doctype:
            return
        self.flush()
        if ":" in target:
            self.fail("InvalidName", target)
        at = self.parser.CurrentByteIndex
        self.add("pi", self.show(target), None, None, self.show(data), at, self.data.find(b"?>", at) + 2)

    def doctype(self, *_):
        self.in_doctype = 1
        self.doctype_at = self.parser.CurrentByteIndex

    def end_doctype(self):
        self.in_doctype = 0
        at = self.parser.CurrentByteIndex
        if at - self.doctype_at > self.limits.max_dtd_bytes:
            self.fail("DtdTooLarge", "max_dtd_bytes")
        depth = deepest = 0
        for c in _QUOTED.sub(b"", self.data[self.doctype_at : at]):
            depth += (c == 0x28) - (c == 0x29)
            deepest = max(deepest, depth)
        if deepest > self.limits.max_dtd_depth:
            self.fail("DtdDepthLimitExceeded", "max_dtd_depth")
        deep = {name for name in self.entities if self.levels(name, frozenset()) > self.limits.max_entity_depth}
        if deep and any(m.decode("utf-8", "replace") in deep for m in _REFERENCE.findall(_NO_MARKUP.sub(b"", self.data[at:]))):
            self.fail("EntityLimitExceeded", "max_entity_depth")

    def levels(self, name: str, above: frozenset[str]) -> int:
        """How deep the references in an internal entity's text go, itself included; it stops one above the limit, and at a loop, which the parser refuses."""
        if name not in self.nested:
            inner = [x for x in self.entities.get(name, ()) if x not in above and x != name]
            deep = len(above) > self.limits.max_entity_depth
            self.nested[name] = 1 + (0 if deep else max((self.levels(x, above | {name}) for x in inner), default=0))
        return self.nested[name]

    def entity(self, name, is_parameter, value, *_):
        if self.parser.CurrentByteIndex - getattr(self, "doctype_at", 0) > self.limits.max_dtd_bytes:
            self.fail("DtdTooLarge", "max_dtd_bytes")
        if value is not None and is_parameter:
            self.parameter_chars += len(value)
            if self.parameter_chars > self.limits.max_pe_expansion:
                self.fail("EntityLimitExceeded", "max_pe_expansion")
        elif value is not None:
            self.entities.setdefault(name, [m.decode() for m in _REFERENCE.findall(value.encode("utf-8", "replace"))])

    def attlist(self, element, attribute, kind, default, required):
        if kind == "ID":
            show = lambda x: self.show(x.split(SEP)[-1])
            self.id_attributes.add((show(element), show(attribute)))

    def external_entity(self, context, base, system, public):
        text = self.external.get(system)
        if text is None:
            return 1  # content that wasn't supplied is empty
        if self.entity_depth >= self.limits.max_entity_depth:
            self.fail("EntityLimitExceeded", "max_entity_depth")
        self.entity_depth += 1
        sub = self.parser.ExternalEntityParserCreate(context)
        keep, self.parser = self.parser, sub
        try:
            sub.Parse(text.encode(), True)
        finally:
            self.parser = keep
            self.entity_depth -= 1
        return 1

    def parse(self) -> Shredded:
        try:
            self.parser.Parse(self.data, True)
        except expat.ExpatError as e:
            p = self.parser
            raise XmlError(kind_of(e.code, self.data, p.ErrorByteIndex, len(self.stack) > 1), expat.ErrorString(e.code), max(0, p.ErrorByteIndex), e.lineno, e.offset + 1) from None
        root = self.out.rows[0]
        root[SIZE], root[VALUE] = len(self.out.rows) - 1, getattr(self, "root_value", "")
        return self.out


def shred_text(text: str, limits: Limits | None = None, external: dict[str, str] | None = None) -> Shredded:
    """Parse one document; XmlError if it isn't well-formed or exceeds a limit."""
    limits = limits or Limits()
    try:
        size = len(text.encode())
    except UnicodeEncodeError as e:
        raise XmlError("IllegalCharacter", "a surrogate", len(text[: e.start].encode("utf-8", "replace"))) from None
    if size > limits.max_document_bytes:
        raise XmlError("DocumentTooLarge", "max_document_bytes")
    text = text.removeprefix("﻿")
    version = enc.version_of(text)
    if not version.startswith("1."):
        raise XmlError("UnsupportedVersion", version)
    plain = declared_utf8(text)
    try:
        if version == "1.1":
            raise XmlError("InvalidName")
        out = _Builder(plain, limits, external, False).parse()
    except XmlError as e:
        # the parser's names are the fourth edition's, its characters version 1.0's
        if e.kind not in ("InvalidName", "IllegalCharacter") or limits.fourth_edition and version != "1.1":
            raise
        masked = enc.mask(plain, version, not limits.fourth_edition)
        if masked == plain and version != "1.1":
            raise
        out = _Builder(masked.replace('version="1.1"', 'version="1.0"', 1).replace("version='1.1'", "version='1.0'", 1), limits, external, True).parse()
    out.version = version
    return out


_ENCODING = re.compile(r"\sencoding\s*=\s*('[^']*'|\"[^\"]*\")")


def declared_utf8(text: str) -> str:
    """The text with its declaration's encoding, which it no longer has, as spaces: offsets hold."""
    found = enc.DECLARATION.match(text[:1024])
    if not found or not found["encoding"]:
        return text
    head = found[0]
    return _ENCODING.sub(lambda m: " " * len(m[0]), head, count=1) + text[len(head) :]


def shred_bytes(data: bytes, limits: Limits | None = None, external: dict[str, str] | None = None) -> Shredded:
    limits = limits or Limits()
    if len(data) > limits.max_input_bytes:
        raise XmlError("InputTooLarge", "max_input_bytes")
    text, codec = enc.decode(data)
    out = shred_text(text, limits, external)
    out.encoding = codec
    return out


TAGGED = f"{NODES}, id string, ok boolean, error_kind string, error_detail string, error_offset int, line int, col int, encoding string, xml_version string, n_nodes int, row string"
_NODE_NAMES = [c.split()[0] for c in NODES.split(", ")][1:]


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(a, kinds[b]) for a, b in (c.split() for c in TAGGED.split(", "))])


def shred(df: DataFrame, xml: str = "xml", doc_id: str = "doc_id", limits: Limits | None = None, external: dict[str, str] | None = None) -> DataFrame:
    """Rows of nodes, documents and IDs, told apart by `row` (node, doc or id), of every document in a STRING or BINARY column.

    One pass over the column; split it with nodes_of(), docs_of() and ids_of(),
    after writing or persisting it if more than one is needed. A null document
    has a row of docs with ok = false.
    """
    limits = limits or Limits()
    sent = df.sparkSession.sparkContext.broadcast(external) if external else None

    def run(batches):
        schema = _arrow_schema()

        def batch_of(docs, nodes, ids):
            n, d, k = nodes.num_rows, len(docs), len(ids)
            null = lambda size, name: pa.nulls(size, schema.field(name).type)
            cols = {}
            for name in ["doc_id", *_NODE_NAMES]:
                kind = schema.field(name).type
                extra_doc = pa.array([x[0] for x in docs], kind) if name == "doc_id" else null(d, name)
                extra_id = pa.array([x[0] for x in ids], kind) if name == "doc_id" else pa.array([x[2] for x in ids], kind) if name == "pre" else null(k, name)
                cols[name] = pa.concat_arrays([nodes[name], extra_doc, extra_id])
            for i, name in enumerate(["ok", "error_kind", "error_detail", "error_offset", "line", "col", "encoding", "xml_version", "n_nodes"]):
                cols[name] = pa.concat_arrays([null(n, name), pa.array([x[i + 1] for x in docs], schema.field(name).type), null(k, name)])
            cols["id"] = pa.concat_arrays([null(n + d, "id"), pa.array([x[1] for x in ids], pa.string())])
            cols["row"] = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(3, dtype=np.int32), [n, d, k])), pa.array(["node", "doc", "id"])).dictionary_decode()
            return pa.RecordBatch.from_arrays([cols[name] for name in schema.names], schema=schema)

        for nodes, docs, ids in shredded_batches(batches, limits, sent.value if sent else None):
            rest = nodes.slice(FLUSH_ROWS)
            yield batch_of(docs, nodes.slice(0, FLUSH_ROWS), ids)
            for k in range(0, rest.num_rows, FLUSH_ROWS):
                yield batch_of([], rest.slice(k, FLUSH_ROWS), [])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(xml).alias("xml")).mapInArrow(run, TAGGED)


FLUSH_ROWS = 20_000


def shredded_batches(batches: Iterator[pa.RecordBatch], limits: Limits, external: dict[str, str] | None = None) -> Iterator[tuple[pa.RecordBatch, list[tuple], list[tuple]]]:
    """Nodes of whole documents as columns, with the documents' and IDs' rows, from batches of doc_id and xml."""
    schema = pa.schema([_arrow_schema().field(name) for name in ["doc_id", *_NODE_NAMES]])
    parser = plain.Parser(limits)

    def columns(nodes):
        by = list(zip(*nodes, strict=True)) or [[]] * 14
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(by, schema, strict=True)], schema=schema)

    def one_by_one(keys, documents, parse):
        docs, nodes, ids = [], [], []
        for key, document in zip(keys.to_pylist(), documents.to_pylist(), strict=True):
            try:
                if document is None:
                    raise XmlError("NoRootElement", "null document")
                out = parse(document, limits, external)
                nodes += [(key, *r) for r in out.rows]
                ids += [(key, name, pre) for name, pre in out.ids.items()]
                docs.append((key, True, None, None, None, None, None, out.encoding, out.version, len(out.rows)))
            except XmlError as e:
                docs.append((key, False, e.kind, e.detail, e.offset, e.line, e.col, None, None, 0))
            if len(nodes) >= FLUSH_ROWS:
                yield columns(nodes), docs, ids
                docs, nodes, ids = [], [], []
        if docs:
            yield columns(nodes), docs, ids

    for batch in batches:
        keys, documents = batch.column(0), batch.column(1)
        if not pa.types.is_string(documents.type):
            yield from one_by_one(keys, documents, shred_text if pa.types.is_large_string(documents.type) else shred_bytes)
            continue
        ends = plain.bytes_of(documents)[1]
        first = 0
        while first < len(keys):
            stop = max(first + 1, int(np.searchsorted(ends, ends[first] + plain.AT_ONCE, "right")) - 1)
            some_keys, some = keys.slice(first, stop - first), documents.slice(first, stop - first)
            is_plain, nodes, n_nodes = parser.parse(some_keys, some)
            if nodes is not None:
                done = some_keys.filter(pa.array(is_plain)).to_pylist()
                yield nodes, [(key, True, None, None, None, None, None, "utf-8", "1.0", int(n)) for key, n in zip(done, n_nodes, strict=True)], []
            if not is_plain.all():
                others = pa.array(~is_plain)
                yield from one_by_one(some_keys.filter(others), some.filter(others), shred_text)
            first = stop


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def nodes_of(shredded: DataFrame) -> DataFrame:
    return shredded.where("row = 'node'").select(*_columns(NODES))


def docs_of(shredded: DataFrame) -> DataFrame:
    return shredded.where("row = 'doc'").select(*_columns(DOCS))


def ids_of(shredded: DataFrame) -> DataFrame:
    return shredded.where("row = 'id'").select(*_columns(IDS))


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, xml): the files below a path, one document each; doc_id is a hash of the path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", F.col("content").alias("xml"))
