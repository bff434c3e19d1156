"""Schemas, limits and errors."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

INF = 1 << 62
XML_NS = "http://www.w3.org/XML/1998/namespace"
XMLNS_NS = "http://www.w3.org/2000/xmlns/"

#: One row for each document: whether it is well-formed, and if not, why and where.
DOCS = (
    "doc_id long, ok boolean, error_kind string, error_detail string, error_offset int, line int, col int, "
    "encoding string, xml_version string, n_nodes int"
)
#: One row for each node. value is the node's XPath string-value; lang the nearest xml:lang.
NODES = (
    "doc_id long, pre int, size int, level int, parent int, sib int, kind string, local string, ns_uri string, "
    "prefix string, value string, lang string, src_start int, src_end int"
)
IDS = "doc_id long, id string, pre int"
EVENTS = (
    "doc_id long, seq long, type string, ns string, local string, prefix string, "
    "attrs array<struct<ns:string,local:string,value:string>>, nsdecls array<struct<prefix:string,uri:string>>, "
    "text string, target string, error_kind string, error_offset int"
)
NODE_COLUMNS = [c.split()[0] for c in NODES.split(", ")]
KINDS = ("root", "element", "attr", "ns", "text", "comment", "pi")


class XmlError(ValueError):
    """A document that isn't well-formed or exceeds a limit: kind, detail, byte offset, line and column (from 1)."""

    def __init__(self, kind: str, detail: str = "", offset: int = 0, line: int = 1, col: int = 1):
        super().__init__(f"{kind}: {detail} at byte {offset}")
        self.kind, self.detail, self.offset, self.line, self.col = kind, detail, offset, line, col


class XPathSyntaxError(ValueError):
    """An expression that doesn't compile; offset is in characters."""

    def __init__(self, message: str, offset: int = 0):
        super().__init__(f"{message} at {offset}")
        self.offset = offset


class XPathTypeError(TypeError):
    """A value of a type that the operation doesn't take, in strict evaluation."""


class NodeError(ValueError):
    """An edit that would break the tree."""


@dataclass(frozen=True)
class Limits:
    """Budgets for untrusted input; the fields' defaults are the default profile."""

    max_depth: int = 256
    max_attributes_per_element: int = 1_000
    max_attribute_size: int = 524_288
    max_name_length: int = 8_192
    max_nodes: int = INF
    max_text_length: int = INF
    max_input_bytes: int = INF
    max_document_bytes: int = INF
    max_entity_depth: int = 10
    max_entity_expansion: int = 10_000_000
    max_dtd_bytes: int = 16 << 20
    max_dtd_depth: int = 64
    max_pe_expansion: int = 10_000_000
    max_construct_bytes: int = 64 << 20
    max_xpath_depth: int = 256
    max_xpath_operators: int = 10_000
    max_xpath_bytes: int = 1 << 20
    max_xpath_nodes: int = 40_000
    max_xpath_arguments: int = 10_000
    fourth_edition: bool = False

    @classmethod
    def strict(cls) -> Limits:
        return cls(
            max_depth=64, max_attributes_per_element=64, max_attribute_size=8 << 10, max_name_length=256, max_nodes=100_000, max_text_length=1 << 20, max_input_bytes=8 << 20, max_document_bytes=8 << 20,
            max_entity_depth=4, max_entity_expansion=100_000, max_dtd_bytes=64 << 10, max_dtd_depth=32, max_pe_expansion=100_000, max_construct_bytes=1 << 20,
            max_xpath_depth=32, max_xpath_operators=1_000, max_xpath_bytes=64 << 10, max_xpath_nodes=4_000, max_xpath_arguments=1_000,
        )

    @classmethod
    def permissive(cls) -> Limits:
        return cls(
            max_attributes_per_element=100_000, max_attribute_size=64 << 20, max_name_length=1 << 20, max_entity_depth=40, max_entity_expansion=10**9, max_dtd_bytes=INF, max_pe_expansion=10**9, max_construct_bytes=INF,
            max_xpath_depth=1_000, max_xpath_operators=1_000_000, max_xpath_bytes=INF, max_xpath_nodes=4_000_000, max_xpath_arguments=1_000_000,
        )

    def with_(self, **changes) -> Limits:
        return replace(self, **changes)


LIMIT_NAMES = [f.name for f in fields(Limits)]
