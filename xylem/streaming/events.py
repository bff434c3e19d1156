"""Pull events: one document read in order, whole or in chunks, in batch or in Structured Streaming.

Events are StartElement, EndElement, Text, Comment and ProcessingInstruction,
in the columns of EVENTS. A document that fails ends with an Error event; what
came before it stands, and later chunks are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from xylem.model import EVENTS, Limits, XmlError
from xylem.sources.shred import SEP, declared_utf8, kind_of

NAMES = ["seq", "type", "ns", "local", "prefix", "attrs", "nsdecls", "text", "target", "error_kind", "error_offset"]


class PushReader:
    """Feeds bytes in any pieces; gives the events that are complete. The same events come whatever the pieces."""

    def __init__(self, limits: Limits | None = None):
        self.limits = limits or Limits()
        self.out: list[dict] = []
        self.declared: list[dict] = []
        self.run: list[str] = []
        self.depth = self.fed = self.chars = self.nodes = 0
        self.failed = self.done = False
        self.held, self.held_at, self.at = b"", 0, 0  # what has been fed since the last event, for errors
        self.parameter_chars = self.doctype_at = 0
        self.parser = p = expat.ParserCreate(None, SEP)
        p.namespace_prefixes = p.ordered_attributes = p.specified_attributes = p.buffer_text = True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self._start, self._end, self._text
        p.CommentHandler = lambda data: self._event("Comment", text=data)
        p.ProcessingInstructionHandler = lambda target, data: self._event("ProcessingInstruction", target=target, text=data)
        p.StartNamespaceDeclHandler = lambda prefix, uri: self.declared.append({"prefix": prefix or "", "uri": uri or ""})
        p.StartDoctypeDeclHandler, p.EndDoctypeDeclHandler, p.EntityDeclHandler = self._doctype, self._dtd_size, self._entity

    def _doctype(self, *_) -> None:
        self.doctype_at = self.parser.CurrentByteIndex

    def _dtd_size(self) -> None:
        if self.parser.CurrentByteIndex - self.doctype_at > self.limits.max_dtd_bytes:
            raise XmlError("DtdTooLarge")

    def _entity(self, name, is_parameter, value, *_) -> None:
        self._dtd_size()
        if value is not None and is_parameter:
            self.parameter_chars += len(value)
            if self.parameter_chars > self.limits.max_pe_expansion:
                raise XmlError("EntityLimitExceeded")

    def _event(self, kind: str, **own) -> None:
        self._flush()
        self.at = self.parser.CurrentByteIndex
        if kind != "EndElement":
            self._count()
        self.out.append(dict.fromkeys(NAMES) | {"type": kind, "attrs": [], "nsdecls": []} | own)

    def _flush(self) -> None:
        if self.run:
            text, self.run = "".join(self.run), []
            if len(text) > self.limits.max_text_length:
                raise XmlError("TextTooLong")
            if self.depth:
                self.out.append(dict.fromkeys(NAMES) | {"type": "Text", "attrs": [], "nsdecls": [], "text": text})

    def _name(self, raw: str) -> tuple[str | None, str, str | None]:
        parts = raw.split(SEP)
        if len(parts[1 if len(parts) > 1 else 0]) > self.limits.max_name_length:
            raise XmlError("NameTooLong")
        return (None, raw, None) if len(parts) == 1 else (parts[0], parts[1], parts[2] if len(parts) > 2 else None)

    def _start(self, raw, attributes):
        ns, local, prefix = self._name(raw)
        attrs = []
        for k, v in zip(attributes[::2], attributes[1::2], strict=True):
            a = self._name(k)
            if len(v) > self.limits.max_attribute_size:
                raise XmlError("AttributeTooLarge")
            self._expanded(len(v))
            attrs.append({"ns": a[0], "local": a[1], "value": v})
        if len(attrs) > self.limits.max_attributes_per_element:
            raise XmlError("TooManyAttributes")
        self._event("StartElement", ns=ns, local=local, prefix=prefix, attrs=attrs, nsdecls=self.declared)
        self.declared = []
        self.depth += 1
        if self.depth > self.limits.max_depth:
            raise XmlError("DepthLimitExceeded")

    def _end(self, raw):
        ns, local, prefix = self._name(raw)
        self._event("EndElement", ns=ns, local=local, prefix=prefix)
        self.depth -= 1

    def _text(self, data):
        self.run.append(data)
        self.at = self.parser.CurrentByteIndex
        self._expanded(len(data))

    def _expanded(self, size: int) -> None:
        """Count characters of text and attributes: what is beyond the bytes fed comes from entities."""
        self.chars += size
        if self.chars > self.fed + self.limits.max_entity_expansion:
            raise XmlError("EntityLimitExceeded")

    def _count(self) -> None:
        self.nodes += 1
        if self.nodes > self.limits.max_nodes:
            raise XmlError("TooManyNodes")

    def feed(self, data: bytes, last: bool = False) -> list[dict]:
        """Complete events of what has been fed; last ends the document. After a failure there are none."""
        if self.failed or self.done:
            return []
        self.fed += len(data)
        self.held += data
        try:
            if self.fed > min(self.limits.max_input_bytes, self.limits.max_document_bytes):
                raise XmlError("InputTooLarge" if self.fed > self.limits.max_input_bytes else "DocumentTooLarge")
            self.parser.Parse(data, last)
            keep = max(0, self.at - self.held_at - 2)
            self.held, self.held_at = self.held[keep:], self.held_at + keep
            if last:
                self._flush()
                self.done = True
        except (expat.ExpatError, XmlError) as e:
            self.run = []
            kind = e.kind if isinstance(e, XmlError) else kind_of(e.code, self.held, self.parser.ErrorByteIndex - self.held_at, self.depth > 0)
            self.out.append(dict.fromkeys(NAMES) | {"type": "Error", "attrs": [], "nsdecls": [], "error_kind": kind, "error_offset": max(0, self.parser.ErrorByteIndex)})
            self.failed = True
        out, self.out = self.out, []
        return out


def events_of(document: str | bytes, limits: Limits | None = None, chunk: int = 1 << 16) -> Iterator[dict]:
    """Events of one document, read in chunks: memory doesn't grow with it."""
    # a string is no longer in the encoding that it declares
    data = declared_utf8(document).encode("utf-8", "surrogatepass") if isinstance(document, str) else bytes(document)
    reader = PushReader(limits)
    for i in range(0, max(len(data), 1), chunk):
        yield from reader.feed(data[i : i + chunk], i + chunk >= len(data))


def _schema() -> pa.Schema:
    attr = pa.struct([("ns", pa.string()), ("local", pa.string()), ("value", pa.string())])
    decl = pa.struct([("prefix", pa.string()), ("uri", pa.string())])
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(attr), pa.list_(decl), pa.string(), pa.string(), pa.string(), pa.int32()]
    return pa.schema(list(zip(["doc_id", *NAMES], kinds, strict=True)))


def read_events(df: DataFrame, xml: str = "xml", doc_id: str = "doc_id", limits: Limits | None = None) -> DataFrame:
    """The events of every document of a STRING or BINARY column."""

    def run(batches):
        schema, held = _schema(), []
        for batch in batches:
            for key, document in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, e in enumerate(events_of(document or b"", limits)):
                    held.append({**e, "doc_id": key, "seq": k})
                    if len(held) >= 20_000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(xml).alias("xml")).mapInArrow(run, EVENTS)


def stream_events(chunks: DataFrame, limits: Limits | None = None, idle: str | None = None) -> DataFrame:
    """Events of documents that arrive in chunks: rows (doc_id long, seq long, data binary, is_last boolean) of a stream.

    A document's state is its bytes so far, at most max_construct_bytes, and
    how many events have been given; a parser can't be kept between batches,
    so the bytes are read again and only new events are given.
    """
    limits = limits or Limits()
    columns = ["doc_id", *NAMES]

    def update(key, frames, state: GroupState):
        data, given, closed = state.get if state.exists else (b"", 0, False)
        rows = pd.concat(list(frames)).sort_values("seq") if frames else pd.DataFrame()
        if closed:
            return
        last = bool(len(rows)) and bool(rows["is_last"].any())
        data = data + b"".join(bytes(x) for x in rows["data"] if x is not None)
        reader = PushReader(limits)
        if len(data) > limits.max_construct_bytes:
            events, closed = [dict.fromkeys(NAMES) | {"type": "Error", "attrs": [], "nsdecls": [], "error_kind": "ConstructTooLarge", "error_offset": 0}], True
        else:
            events = reader.feed(data, last)[given:]
            closed = reader.failed or reader.done
        out = [{**e, "doc_id": key[0], "seq": given + k} for k, e in enumerate(events)]
        state.update((b"" if closed else data, given + len(out), closed))
        if out:
            frame = pd.DataFrame(out, columns=columns)
            frame["error_offset"] = frame["error_offset"].astype("Int32")
            yield frame

    return chunks.groupBy("doc_id").applyInPandasWithState(update, EVENTS, "data binary, given long, closed boolean", "append", GroupStateTimeout.NoTimeout)
