"""Node tables to XML text, one document at a time, streamed through sorted partitions.

Escapes are such that parsing gives the same nodes back: line ends, tabs and
control characters that parsing would change are references. Prefixes that
aren't bound where they are needed are declared. A document that needs XML 1.1
(control characters) says so; one that needs it and declares 1.0 can't be
written checked.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xylem.model import XML_NS, XmlError


@dataclass(frozen=True)
class Options:
    """indent: None, a number of spaces or '\\t'; empty: '<a/>', '<a />' or '<a></a>'; newline: '\\n' or '\\r\\n'; declaration: None, or the version's."""

    indent: int | str | None = None
    empty: str = "<a/>"
    newline: str = "\n"
    declaration: bool = False
    checked: bool = False


_CONTROL = re.compile("[\x01-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f ]")
_ONLY_11 = re.compile("[\x01-\x08\x0b\x0c\x0e-\x1f]")


def escape_text(s: str) -> str:
    s = s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#13;")
    return _CONTROL.sub(lambda m: f"&#{ord(m[0])};", s)


def escape_attribute(s: str) -> str:
    return escape_text(s).replace('"', "&quot;").replace("\t", "&#9;").replace("\n", "&#10;")


def escape_text_column(s: Column) -> Column:
    """escape_text() without control characters, as built-in functions."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def escape_attribute_column(s: Column) -> Column:
    s = escape_text_column(s)
    for a, b in (('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def needs_xml_11(nodes: DataFrame) -> DataFrame:
    """doc_id and needs: whether a document holds characters that only XML 1.1 can refer to."""
    own = F.col("kind").isin("text", "attr") & F.col("value").rlike("[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]")
    return nodes.groupBy("doc_id").agg(F.max(F.coalesce(own, F.lit(False))).alias("needs"))


def write_document(rows: list[dict], options: Options = Options()) -> str:
    """XML of one document's rows (any order); XmlError, if checked, where there is no root element or XML 1.0 can't hold it."""
    rows = sorted(rows, key=lambda r: r["pre"])
    children: dict[int, list[dict]] = {}
    own: dict[int, list[dict]] = {}
    for r in rows[1:]:
        (own if r["kind"] in ("attr", "ns") else children).setdefault(r["parent"], []).append(r)
    top = [r for r in children.get(rows[0]["pre"], []) if r["kind"] != "text"] if rows else []
    version = "1.1" if any(r["value"] and r["kind"] in ("text", "attr") and _ONLY_11.search(r["value"]) for r in rows) else "1.0"
    if options.checked:
        if not any(r["kind"] == "element" for r in top):
            raise XmlError("NoRootElement")
        if version == "1.1" and any(r["kind"] in ("comment", "pi") and r["value"] and _ONLY_11.search(r["value"]) for r in rows):
            raise XmlError("IllegalCharacter", "a control character in a comment or instruction")
    out: list[str] = []
    unit = None if options.indent is None else "\t" if options.indent == "\t" else " " * int(options.indent)
    if version == "1.1" or options.declaration:
        out.append(f'<?xml version="{version}"?>' + (options.newline if unit is not None or options.declaration else ""))

    def line(depth):
        out.append(options.newline + unit * depth)

    # an explicit stack: depth is bounded by the input, not by Python's recursion
    todo: list[tuple] = []
    for i, r in reversed(list(enumerate(top))):
        todo.append(("node", r, {"xml": XML_NS}, 0, unit is not None and i > 0))
    while todo:
        what, r, scope, depth, fresh = todo.pop()
        if what == "end":
            if fresh:
                line(depth)
            out.append(f"</{r}>")
            continue
        if fresh:
            line(depth)
        if r["kind"] == "text":
            out.append(escape_text(r["value"]))
        elif r["kind"] == "comment":
            out.append(f"<!--{r['value']}-->")
        elif r["kind"] == "pi":
            out.append(f"<?{r['local']}{' ' + r['value'] if r['value'] else ''}?>")
        else:
            name, scope = _start(r, own.get(r["pre"], []), scope, out)
            inner = children.get(r["pre"], [])
            if not inner:
                out.append({"<a/>": "/>", "<a />": " />", "<a></a>": f"></{name}>"}[options.empty])
                continue
            out.append(">")
            # white space only where it can't be mistaken for content
            spread = unit is not None and all(c["kind"] == "element" for c in inner)
            todo.append(("end", name, scope, depth, spread))
            for c in reversed(inner):
                todo.append(("node", c, scope, depth + 1, spread))
    return "".join(out)


def _start(r: dict, own: list[dict], scope: dict[str, str], out: list[str]) -> tuple[str, dict[str, str]]:
    """Write a start tag up to its end; gives the name as written and the bindings inside."""
    declared = {d["local"]: d["value"] for d in own if d["kind"] == "ns" and not (d["local"] == "xml" and d["value"] == XML_NS)}
    inside = {**scope, **declared}

    def bind(uri, prefix, attribute):
        """A prefix for a namespace: the stored one, one in scope, or a new one."""
        if uri is None:
            if not attribute and inside.get(""):
                inside[""] = declared[""] = ""
            return ""
        prefix = prefix or ""
        if inside.get(prefix) == uri and (prefix or not attribute):
            return prefix
        for p, u in inside.items():
            if u == uri and (p or not attribute):
                return p
        if prefix in declared or attribute and not prefix or prefix == "xmlns":
            k = 0
            while f"ns{k}" in inside:
                k += 1
            prefix = f"ns{k}"
        inside[prefix] = declared[prefix] = uri
        return prefix

    p = bind(r["ns_uri"], r["prefix"], False)
    name = f"{p}:{r['local']}" if p else r["local"]
    attrs = []
    for a in own:
        if a["kind"] == "attr":
            p = bind(a["ns_uri"], a["prefix"], True)
            attrs.append((f"{p}:{a['local']}" if p else a["local"], a["value"]))
    out.append(f"<{name}")
    for p, uri in declared.items():
        out.append(f' xmlns{":" + p if p else ""}="{escape_attribute(uri)}"')
    for a, value in attrs:
        out.append(f' {a}="{escape_attribute(value)}"')
    return name, inside


NEEDED = ["doc_id", "pre", "parent", "kind", "local", "ns_uri", "prefix", "value"]


def serialise(nodes: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, xml and, where a checked document can't be written, error_kind: one row for each document.

    Rows are sorted within partitions and read in a stream; a task holds one
    document at a time.
    """
    # the string-values of elements aren't read: they don't cross to Python
    value = F.when(F.col("kind").isin("root", "element"), None).otherwise(F.col("value")).alias("value")
    rows = nodes.select(*NEEDED[:-1], value).repartition("doc_id").sortWithinPartitions("doc_id", "pre")

    def write(batches):
        at, own, done = None, [], []

        def close():
            try:
                done.append((at, write_document(own, options), None))
            except XmlError as e:
                done.append((at, None, e.kind))

        def table():
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "xml", "error_kind"])
            done.clear()
            return out

        for batch in batches:
            for r in batch.to_pylist():
                if r["doc_id"] != at:
                    if own:
                        close()
                        if len(done) >= 1000:
                            yield table()
                    at, own = r["doc_id"], []
                own.append(r)
        if own:
            close()
        if done:
            yield table()

    return rows.mapInArrow(write, "doc_id long, xml string, error_kind string")
