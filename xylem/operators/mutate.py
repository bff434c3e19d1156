"""Edits of trees: a script of operations for each document, applied in order; and documents built from scratch.

A script is a DataFrame (doc_id, seq, op, target, arg, ns, local, value): target
is a node's pre in the input, or -k for the node that the script's operation
with seq k has made. Operations of a document are applied in order of seq; the
first that would break the tree stops the document, which is then reported
with its error and keeps its old nodes.

    op                 target       arg            ns, local, value
    append_element     parent                      namespace, name, prefix
    append_text        parent                      , , text
    append_comment     parent                      , , text
    append_pi          parent                      , target, data
    set_text           text node                   , , text
    remove             node
    detach             node
    reparent           node         new parent
    insert_at          node         new parent     , place among its children,
    set_attribute      element                     namespace, name, value
    remove_attribute   element                     namespace, name,
    declare_namespace  element                     , prefix, uri
    compact
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.model import KINDS, NODE_COLUMNS, NODES, XML_NS, XMLNS_NS, Limits, NodeError
from xylem.sources.encoding import is_ncname
from xylem.sources.plain import bytes_of, chosen, places_among_siblings, slices
from xylem.sources.shred import shredded_batches

SCRIPT = "doc_id long, seq int, op string, target int, arg int, ns string, local string, value string"


class Tree:
    """One document's nodes as linked records; rows() numbers them anew."""

    def __init__(self, rows: list[dict] | None = None):
        self.nodes: dict[int, dict] = {}
        self.root = None
        for r in sorted(rows or [], key=lambda r: r["pre"]):
            n = {"kind": r["kind"], "local": r["local"], "ns": r["ns_uri"], "prefix": r["prefix"], "value": r["value"], "children": [], "attrs": [], "decls": [], "parent": None, "id": r["pre"]}
            self.nodes[r["pre"]] = n
            if r["kind"] == "root":
                self.root = n
                continue
            parent = self.nodes[r["parent"]]
            n["parent"] = parent
            parent["attrs" if r["kind"] == "attr" else "decls" if r["kind"] == "ns" else "children"].append(n)
        if self.root is None:
            self.root = {"kind": "root", "local": None, "ns": None, "prefix": None, "value": None, "children": [], "attrs": [], "decls": [], "parent": None, "id": 0}
            self.nodes[0] = self.root

    def get(self, key: int) -> dict:
        n = self.nodes.get(key)
        if n is None or n.get("removed"):
            raise NodeError("Stale")
        return n

    def container(self, key: int) -> dict:
        n = self.get(key)
        if n["kind"] not in ("root", "element"):
            raise NodeError("NotAContainer")
        return n

    def element(self, key: int) -> dict:
        n = self.get(key)
        if n["kind"] != "element":
            raise NodeError("NotAnElement")
        return n

    def _make(self, kind, local=None, ns=None, prefix=None, value=None) -> dict:
        return {"kind": kind, "local": local, "ns": ns, "prefix": prefix, "value": value, "children": [], "attrs": [], "decls": [], "parent": None, "id": None}

    def _place(self, parent: dict, node: dict, at: int | None = None) -> dict:
        if parent["kind"] == "root":
            if node["kind"] == "element" and any(c["kind"] == "element" for c in parent["children"]):
                raise NodeError("RootElementExists")
            if node["kind"] == "text" and node["value"].strip(" \t\r\n"):
                raise NodeError("InvalidText")
        node["parent"] = parent
        if at is None:
            parent["children"].append(node)
        else:
            parent["children"].insert(max(0, min(at, len(parent["children"]))), node)
        return node

    def append_element(self, parent: int, ns: str | None, local: str, prefix: str | None = None) -> dict:
        _check_name(local)
        n = self._place(self.container(parent), self._make("element", local, ns or None, prefix or None))
        if n["parent"] is self.root:
            n["decls"].append({**self._make("ns", "xml", value=XML_NS), "parent": n})
        return n

    def append_text(self, parent: int, text: str) -> dict:
        return self._place(self.container(parent), self._make("text", value=text))

    def append_comment(self, parent: int, text: str) -> dict:
        if "--" in text or text.endswith("-"):
            raise NodeError("InvalidText")
        return self._place(self.container(parent), self._make("comment", value=text))

    def append_pi(self, parent: int, target: str, data: str | None) -> dict:
        _check_name(target)
        if target.lower() == "xml":
            raise NodeError("InvalidName")
        if "?>" in (data or ""):
            raise NodeError("InvalidText")
        return self._place(self.container(parent), self._make("pi", target, value=data or ""))

    def set_text(self, key: int, text: str) -> None:
        n = self.get(key)
        if n["kind"] != "text":
            raise NodeError("NotText")
        n["value"] = text

    def _unlink(self, n: dict) -> None:
        if n["parent"] is not None:
            own = n["parent"]["attrs" if n["kind"] == "attr" else "decls" if n["kind"] == "ns" else "children"]
            own[:] = [c for c in own if c is not n]
            n["parent"] = None

    def remove(self, key: int) -> None:
        n = self.get(key)
        if n is self.root:
            raise NodeError("NotRemovable")
        self._unlink(n)
        todo = [n]
        while todo:
            m = todo.pop()
            m["removed"] = True
            todo += m["children"] + m["attrs"] + m["decls"]

    def detach(self, key: int) -> dict:
        n = self.get(key)
        if n is self.root:
            raise NodeError("NotRemovable")
        if n["kind"] in ("attr", "ns"):
            raise NodeError("NotAChild")
        self._unlink(n)
        return n

    def insert_at(self, key: int, parent: int, at: int | None) -> dict:
        n, p = self.get(key), self.container(parent)
        if n is self.root or n["kind"] in ("attr", "ns"):
            raise NodeError("NotAChild")
        m = p
        while m is not None:
            if m is n:
                raise NodeError("WouldCycle")
            m = m["parent"]
        if p["kind"] == "root" and n["kind"] == "element" and n["parent"] is not p and any(c["kind"] == "element" for c in p["children"]):
            raise NodeError("RootElementExists")
        self._unlink(n)
        return self._place(p, n, at)

    def set_attribute(self, key: int, ns: str | None, local: str, value: str, prefix: str | None = None) -> dict:
        _check_name(local)
        n = self.element(key)
        if ns == XMLNS_NS or not ns and local == "xmlns":
            raise NodeError("InvalidName")
        for a in n["attrs"]:
            if (a["ns"], a["local"]) == (ns or None, local):
                a["value"] = value
                return a
        a = {**self._make("attr", local, ns or None, prefix, value), "parent": n}
        n["attrs"].append(a)
        return a

    def remove_attribute(self, key: int, ns: str | None, local: str) -> bool:
        n = self.element(key)
        before = len(n["attrs"])
        n["attrs"] = [a for a in n["attrs"] if (a["ns"], a["local"]) != (ns or None, local)]
        return len(n["attrs"]) < before

    def declare_namespace(self, key: int, prefix: str | None, uri: str) -> dict:
        n = self.element(key)
        prefix = prefix or ""
        if prefix:
            _check_name(prefix)
        if prefix == "xmlns" or uri == XMLNS_NS or (prefix == "xml") != (uri == XML_NS) or prefix and not uri:
            raise NodeError("InvalidName")
        for d in n["decls"]:
            if d["local"] == prefix:
                d["value"] = uri
                return d
        d = {**self._make("ns", prefix, value=uri), "parent": n}
        n["decls"].append(d)
        return d

    def apply(self, op: str, target, arg, ns, local, value):
        if op == "append_element":
            return self.append_element(target, ns, local, value)
        if op == "append_text":
            return self.append_text(target, value or "")
        if op == "append_comment":
            return self.append_comment(target, value or "")
        if op == "append_pi":
            return self.append_pi(target, local, value)
        if op == "set_text":
            return self.set_text(target, value or "")
        if op == "remove":
            return self.remove(target)
        if op == "detach":
            return self.detach(target)
        if op == "reparent":
            return self.insert_at(target, arg, None)
        if op == "insert_at":
            return self.insert_at(target, arg, int(local))
        if op == "set_attribute":
            return self.set_attribute(target, ns, local, value or "")
        if op == "remove_attribute":
            return self.remove_attribute(target, ns, local)
        if op == "declare_namespace":
            return self.declare_namespace(target, local, value or "")
        if op == "compact":
            return None  # rows have no gaps
        raise NodeError("InvalidText")

    def rows(self) -> list[list]:
        """The columns of NODES without doc_id, in document order."""
        out: list[list] = []
        texts: list[str] = []

        def add(n, level, parent, sib, lang):
            row = [len(out), 0, level, parent, sib, n["kind"], n["local"], n["ns"], n["prefix"], n["value"], lang, None, None]
            out.append(row)
            return row

        todo = [("open", self.root, 0, None, None, None)]
        while todo:
            what, n, level, parent, sib, lang = todo.pop()
            if what == "close":
                row, mark = n
                row[1] = len(out) - 1 - row[0]
                row[9] = "".join(texts[mark:])
                continue
            own = next((a["value"] for a in n["attrs"] if a["ns"] == XML_NS and a["local"] == "lang"), lang)
            row = add(n, level, parent, sib, own)
            if n["kind"] == "text":
                texts.append(n["value"])
            if n["kind"] not in ("root", "element"):
                continue
            for d in n["decls"] + n["attrs"]:
                add(d, level + 1, row[0], None, own)
            todo.append(("close", (row, len(texts)), 0, None, None, None))
            for k, c in reversed(list(enumerate(n["children"]))):
                todo.append(("open", c, level + 1, row[0], k, own))
        return out


def _check_name(name: str | None) -> None:
    if not name or not is_ncname(name):
        raise NodeError("InvalidName")


EDITED = f"{NODES}, error_seq int, error_kind string"


#: Rows that a task packs at a time.
PACKED_ROWS = 400_000
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _schema(columns: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def _packed(df: DataFrame, schema: pa.Schema, buckets: int, is_script: bool) -> DataFrame:
    """df's rows as compressed columns, a blob for each bucket of doc_id and PACKED_ROWS rows: a shuffle writes a fraction of what it would for rows."""

    def run(batches):
        held, size = [], 0

        def send():
            rows = pa.Table.from_batches(held).combine_chunks()
            at = pc.fill_null(rows["doc_id"], 0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
            at = (at % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(at, kind="stable")
            rows, at = rows.take(pa.array(order)), at[order]
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
                # taken again, so that a blob holds its own rows alone
                part = rows.take(pa.array(np.arange(i, j))).combine_chunks().to_batches()[0]
                data = part.serialize()
                blob = pa.compress(data, codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([int(at[i])], pa.int32()), pa.array([is_script]), pa.array([data.size], pa.int64()), pa.array([blob], pa.binary())], ["bucket", "is_script", "size", "blob"])
            held.clear()

        for batch in batches:
            if batch.num_rows:
                held.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema, strict=True)], schema=schema))
                size += batch.num_rows
            if size >= PACKED_ROWS:
                yield from send()
                size = 0
        if held:
            yield from send()

    return df.mapInArrow(run, "bucket int, is_script boolean, size long, blob binary")


def _edited_tree(at: int, before: list[dict], edits: list[dict]) -> list[tuple]:
    tree, error = Tree(before), (None, None)
    for o in edits:
        try:
            made = tree.apply(o["op"], o["target"], o["arg"], o["ns"], o["local"], o["value"])
            if isinstance(made, dict):
                tree.nodes[-o["seq"]] = made
        except NodeError as e:
            error = (o["seq"], str(e))
            break
    if error[0] is None:
        return [(at, *r, None, None) for r in tree.rows()]
    return [(*(r[c] for c in NODE_COLUMNS), *error) for r in before]


def _edited_batches(rows: pa.Table, steps: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows of whole documents after their steps, with the columns of EDITED. Most documents are edited as columns, all others as trees."""
    schema = _schema(EDITED)

    def table(done):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    def as_edited(part):
        for batch in part.combine_chunks().to_batches(20_000):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.string())], schema=schema)

    steps = steps.filter(pc.is_valid(steps["doc_id"])).sort_by([("doc_id", "ascending"), ("seq", "ascending")])
    touched = pc.is_in(rows["doc_id"], value_set=steps["doc_id"].combine_chunks(), skip_nulls=True)
    yield from as_edited(rows.filter(pc.invert(touched)))
    rows = rows.filter(touched).combine_chunks()
    doc, pre = rows["doc_id"].to_numpy(), rows["pre"].to_numpy()
    if not ((doc[1:] > doc[:-1]) | (doc[1:] == doc[:-1]) & (pre[1:] > pre[:-1])).all():
        rows = rows.sort_by([("doc_id", "ascending"), ("pre", "ascending")]).combine_chunks()
    ids = np.unique(steps["doc_id"].to_numpy())
    n0, n1 = (np.searchsorted(rows["doc_id"].to_numpy(), ids, side) for side in ("left", "right"))
    s0, s1 = (np.searchsorted(steps["doc_id"].to_numpy(), ids, side) for side in ("left", "right"))
    simple = _simple(rows, steps, n0, n1, s0, s1)
    if simple.any():
        mine = lambda x, lengths: x.filter(pa.array(np.repeat(simple, lengths))).combine_chunks()
        yield from as_edited(_edited_columns(mine(rows, n1 - n0), mine(steps, s1 - s0)))
    others, done = np.flatnonzero(~simple), []
    for k in range(0, len(others), 500):  # some documents' rows at a time
        some = others[k : k + 500]
        pick = lambda x, first, end: x.take(pa.array(np.concatenate([np.arange(first[j], end[j]) for j in some]))).to_pylist()  # noqa: B023, E731
        nodes_, steps_ = pick(rows, n0, n1), pick(steps, s0, s1)
        n_at = s_at = 0
        for j in some:
            n, s = int(n1[j] - n0[j]), int(s1[j] - s0[j])
            done += _edited_tree(int(ids[j]), nodes_[n_at : n_at + n], steps_[s_at : s_at + s])
            n_at, s_at = n_at + n, s_at + s
            if len(done) >= 20_000:
                yield table(done)
                done = []
    if done:
        yield table(done)


def _numbers(column) -> np.ndarray:
    """A column's numbers, nulls as -1."""
    return pc.fill_null(column, -1).to_numpy().astype(np.int64)


def _kinds(rows: pa.Table) -> np.ndarray:
    return _numbers(pc.index_in(rows["kind"], pa.array(KINDS, pa.string())))


def _simple(rows: pa.Table, steps: pa.Table, n0, n1, s0, s1) -> np.ndarray:
    """Documents whose steps can't fail and don't depend on each other: they remove nodes, append elements and add attributes that aren't there, none of these below a removed node."""
    n_docs = len(n0)
    simple = n1 > n0
    if not rows.num_rows:
        return simple
    node_doc, step_doc = np.repeat(np.arange(n_docs), n1 - n0), np.repeat(np.arange(n_docs), s1 - s0)

    def without(docs):
        simple[docs] = False

    pre, size, kind = _numbers(rows["pre"]), _numbers(rows["size"]), _kinds(rows)
    without(node_doc[(pre != np.arange(len(pre)) - n0[node_doc]) | pc.is_valid(rows["lang"]).to_numpy() | pc.is_null(rows["value"]).to_numpy() | (kind < 0)])
    without(node_doc[(pre == 0) & (size != (n1 - n0)[node_doc] - 1)])
    # kinds of steps, and whether their names and values are plain
    seq, op = _numbers(steps["seq"]), _numbers(pc.index_in(steps["op"], pa.array(["remove", "append_element", "set_attribute"])))
    without(step_doc[(op < 0) | (seq < 0)])
    without(step_doc[1:][(seq[1:] == seq[:-1]) & (step_doc[1:] == step_doc[:-1])])
    local = pc.dictionary_encode(steps["local"].combine_chunks())
    names = local.dictionary.to_pylist()
    name = _numbers(local.indices)
    good = np.array([*(is_ncname(x) and x != "xmlns" for x in names), False])[name]
    without(step_doc[(op > 0) & (~good | pc.not_equal(pc.fill_null(steps["ns"], ""), "").to_numpy())])
    # targets
    target = _numbers(steps["target"])
    inside = (target >= 0) & (target < (n1 - n0)[step_doc])
    without(step_doc[~inside])
    at = np.where(inside, n0[step_doc] + target, 0)
    without(step_doc[np.where(op == 0, kind[at] == KINDS.index("root"), kind[at] != KINDS.index("element"))])
    # what is removed, once or more: no step is at or below another's removed node
    change = np.zeros(len(pre) + 1, np.int64)
    removed = inside & (op == 0) & simple[step_doc]
    np.add.at(change, at[removed], 1)
    np.add.at(change, at[removed] + size[at[removed]] + 1, -1)
    without(step_doc[np.cumsum(change)[at] > (op == 0)])
    # attributes that are there, or are set twice
    adds = np.flatnonzero(inside & (op == 2) & simple[step_doc])
    there = np.flatnonzero((kind == KINDS.index("attr")) & pc.is_null(rows["ns_uri"]).to_numpy())
    known = _numbers(pc.index_in(rows["local"].take(pa.array(there)), local.dictionary))
    owner = n0[node_doc[there]] + _numbers(rows["parent"].take(pa.array(there)))
    key = at[adds] * len(names) + name[adds]
    without(step_doc[adds[np.isin(key, (owner * len(names) + known)[known >= 0])]])
    order = np.argsort(key, kind="stable")
    without(step_doc[adds[order[1:][key[order[1:]] == key[order[:-1]]]]])
    return simple


def _edited_columns(rows: pa.Table, steps: pa.Table) -> pa.Table:
    """rows of whole documents, by doc_id and pre, after steps of which _simple() is true."""
    ids = rows["doc_id"].to_numpy()
    n = len(ids)
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    base = np.repeat(first, np.diff(np.append(first, n)))
    size, level, parent, kind = _numbers(rows["size"]), _numbers(rows["level"]), _numbers(rows["parent"]), _kinds(rows)
    up = np.where(parent < 0, -1, base + parent)
    step_at = first[np.searchsorted(ids[first], steps["doc_id"].to_numpy())] + _numbers(steps["target"])
    op = _numbers(pc.index_in(steps["op"], pa.array(["remove", "append_element", "set_attribute"])))
    gone = np.zeros(n + 1, np.int64)
    gone[step_at[op == 0]] += 1
    np.subtract.at(gone, step_at[op == 0] + size[step_at[op == 0]] + 1, 1)
    kept = np.flatnonzero(np.cumsum(gone)[:n] == 0)
    # new rows: attributes behind an element's own, elements behind its last descendant, inner elements' before outer ones'
    made = np.flatnonzero(op > 0)
    target, is_attr = step_at[made], op[made] == 2
    own = np.flatnonzero((kind == KINDS.index("attr")) | (kind == KINDS.index("ns")))
    n_own = np.bincount(up[own], minlength=n)
    after = np.where(is_attr, target + n_own[target], target + size[target])
    order = np.lexsort((made, np.where(is_attr, 0, -level[target]), ~is_attr, after))
    made, target, is_attr, after = made[order], target[order], is_attr[order], after[order]
    source = np.insert(kept, np.searchsorted(kept, after, "right"), n + np.arange(len(made)))  # new rows are numbered from n
    total = len(source)
    place = np.full(n + len(made), -1)
    place[source] = np.arange(total)
    parent_of = np.append(up, target)[source]
    level = np.append(level, level[target] + 1)[source].astype(np.int32)
    kind = np.append(kind, np.where(is_attr, KINDS.index("attr"), KINDS.index("element")))[source]
    up = np.where(parent_of < 0, -1, place[parent_of])
    ids = np.append(ids, ids[target])[source]
    base = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    base = np.repeat(base, np.diff(np.append(base, total)))
    # an element's rows end before the next row that is no deeper
    size = np.zeros(total, np.int64)
    for depth in range(int(level.max(initial=0)), 0, -1):
        here = np.flatnonzero(level == depth)
        size += np.bincount(up[here], size[here] + 1, total).astype(np.int64)
    child = np.flatnonzero((up >= 0) & (kind != KINDS.index("attr")) & (kind != KINDS.index("ns")))
    sib = np.full(total, -1, np.int32)
    sib[child] = places_among_siblings(level[child], up[child])
    # strings: an element's is a slice of all texts
    none = pa.nulls(len(made), pa.string())
    step_local, step_value = (steps[c].take(pa.array(made)).combine_chunks() for c in ("local", "value"))
    step_prefix = pc.if_else(pa.array(is_attr), none, pc.if_else(pc.equal(step_value, ""), none, step_value))
    both = lambda column, new: pa.concat_arrays([rows[column].combine_chunks(), new])
    strings, at = bytes_of(both("value", pc.if_else(pa.array(is_attr), pc.fill_null(step_value, ""), "")))
    length = np.diff(at)
    is_text = kind == KINDS.index("text")
    texts = slices(strings, at[:-1][source[is_text]], length[source[is_text]])
    texts_ = bytes_of(texts)[0]
    text_at = np.zeros(total + 1, np.int64)
    np.cumsum(np.where(is_text, length[source], 0), out=text_at[1:])
    whole = (kind == KINDS.index("root")) | (kind == KINDS.index("element"))
    value = slices(np.concatenate([strings, texts_]), np.where(whole, len(strings) + text_at[:-1], at[:-1][source]), np.where(whole, text_at[np.arange(total) + size + 1] - text_at[:-1], length[source]))
    numbers = lambda x: pa.array(x.astype(np.int32), mask=x < 0)
    return pa.table({
        "doc_id": pa.array(ids), "pre": numbers(np.arange(total) - base), "size": numbers(size), "level": numbers(level), "parent": pa.array((up - base).astype(np.int32), mask=up < 0), "sib": numbers(sib), "kind": chosen(list(KINDS), kind),
        **{c: both(c, new).take(pa.array(source)) for c, new in (("local", step_local), ("ns_uri", none), ("prefix", step_prefix))}, "value": value, "lang": pa.nulls(total, pa.string()), "src_start": pa.nulls(total, pa.int32()), "src_end": pa.nulls(total, pa.int32()),
    }, schema=_schema(NODES))


@dataclass(frozen=True)
class Step:
    """An operation on every node whose columns have the values of `where`, as a script's row for each."""

    seq: int
    op: str
    where: dict
    arg: int | None = None
    ns: str | None = None
    local: str | None = None
    value: str | None = None


def edit_documents(df: DataFrame, steps: list[Step], columns: list[str] | None = None, xml: str = "xml", doc_id: str = "doc_id", limits: Limits | None = None) -> DataFrame:
    """Documents parsed and edited in one pass: edit(nodes, script) for a script whose targets are found in each document by itself, with no shuffle and nothing written.

    columns: those of EDITED that are needed. Documents that can't be parsed
    have no rows, as with nodes_of().
    """
    limits, columns = limits or Limits(), columns or [c.split()[0] for c in EDITED.split(", ")]
    script_schema = _schema(SCRIPT)

    def run(batches):
        for nodes, _, _ in shredded_batches(batches, limits):
            rows, scripts = pa.Table.from_batches([nodes]), []
            for s in steps:
                hits = None
                for c, v in s.where.items():
                    hit = pc.equal(rows[c], pa.scalar(v, rows[c].type))
                    hits = hit if hits is None else pc.and_(hits, hit)
                found = rows.filter(hits).select(["doc_id", "pre"]).combine_chunks()
                same = lambda v, name: pa.repeat(pa.scalar(v, script_schema.field(name).type), found.num_rows)  # noqa: B023, E731
                scripts.append(pa.table([found["doc_id"], same(s.seq, "seq"), same(s.op, "op"), found["pre"], *(same(getattr(s, x), x) for x in ("arg", "ns", "local", "value"))], schema=script_schema))
            for batch in _edited_batches(rows, pa.concat_tables(scripts)):
                yield batch.select(columns)

    kinds = dict(c.split() for c in EDITED.split(", "))
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(xml).alias("xml")).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns))


def edit(nodes: DataFrame, script: DataFrame) -> DataFrame:
    """nodes after the script, with error_seq and error_kind on the rows of documents whose script failed.

    Nodes and operations meet in buckets of documents, in one shuffle of
    packed rows; a task reads a bucket at a time. Rows of documents without a
    script pass by as columns.
    """
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts
    node_schema, script_schema = _schema(NODES), _schema(SCRIPT)
    ops = script.select(*(F.col(name).cast(kind).alias(name) for name, kind in (c.split() for c in SCRIPT.split(", "))))
    both = _packed(nodes.select(*NODE_COLUMNS), node_schema, buckets, False).unionByName(_packed(ops, script_schema, buckets, True))

    def run(batches):
        def close(found, steps):
            return _edited_batches(pa.Table.from_batches(found, node_schema), pa.Table.from_batches(steps, script_schema))

        at, found, steps = None, [], []
        for batch in batches:
            for bucket, is_script, size, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at and (found or steps):
                    yield from close(found, steps)
                    found, steps = [], []
                at = bucket
                data = pa.decompress(blob, decompressed_size=size, codec="zstd")
                (steps if is_script else found).append(pa.ipc.read_record_batch(data, script_schema if is_script else node_schema))
        if found or steps:
            yield from close(found, steps)

    return both.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, EDITED)


class Builder:
    """A document in the making: Builder('a').attr('x', '1').text('t').child('b').up().finish(). The first error is raised at the end."""

    def __init__(self, local: str, ns: str | None = None):
        self.tree, self.error = Tree(), None
        self.at = self._do(lambda: self.tree.append_element(0, ns, local)) or self.tree.root

    def _do(self, action):
        if self.error is None:
            try:
                return action()
            except NodeError as e:
                self.error = e
        return None

    def _key(self, n: dict) -> int:
        key = -1 - len(self.tree.nodes)
        self.tree.nodes[key] = n
        return key

    def attr(self, local: str, value: str, ns: str | None = None) -> Builder:
        self._do(lambda: self.tree.set_attribute(self._key(self.at), ns, local, value))
        return self

    def text(self, text: str) -> Builder:
        self._do(lambda: self.tree.append_text(self._key(self.at), text))
        return self

    def child(self, local: str, ns: str | None = None) -> Builder:
        made = self._do(lambda: self.tree.append_element(self._key(self.at), ns, local))
        self.at = made or self.at
        return self

    def up(self) -> Builder:
        self.at = self.at["parent"] if self.at["parent"] is not None and self.at["parent"]["kind"] == "element" else self.at
        return self

    def finish(self) -> list[list]:
        if self.error:
            raise self.error
        return self.tree.rows()


def rows_table(doc_id: int, rows: list[list]) -> pa.Table:
    """Rows of one document as an Arrow table with the columns of NODES."""
    return pa.table({c: [doc_id] * len(rows) if i == 0 else [r[i - 1] for r in rows] for i, c in enumerate(NODE_COLUMNS)})
