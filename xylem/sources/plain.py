"""Plain documents parsed many at a time, as columns. The parser takes all others, and decides on every error.

A plain document is printable ASCII: tags without prefixes or declared
namespaces, attributes in double quotes, text without references or `>`, and
nothing outside its element. Tags are told apart by their bytes without the
attributes' values, so each such form is looked at once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from xylem.model import KINDS, NODE_COLUMNS, XML_NS, Limits

#: Bytes of text that are parsed at a time; their nodes' columns take about 60 times as much.
AT_ONCE = 1 << 20
#: Longer text isn't plain: the parser gives it before it has read all of it.
BUFFERED = 8_192
_FORM = re.compile(r'<(?:/(?P<end>[A-Za-z_][\w.-]*) *|(?P<start>[A-Za-z_][\w.-]*)(?P<attributes>(?: +[A-Za-z_][\w.-]* *= *"")*) *(?P<empty>/?))>', re.A)
_NAME = re.compile(r"[\w.-]+", re.A)
_REFUSED = np.ones(256, bool)
_REFUSED[0x20:0x7F] = False
_REFUSED[ord("&")] = True
START, END, EMPTY = range(3)
ROOT, ELEMENT, ATTR, NAMESPACE, TEXT = (KINDS.index(k) for k in ("root", "element", "attr", "ns", "text"))
_XML_NS = np.frombuffer(XML_NS.encode(), np.uint8)


def bytes_of(strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The strings' bytes, and where each begins, with the end at last."""
    _, places, data = strings.buffers()
    at = np.frombuffer(places, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(source: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.StringArray:
    """Strings of `size` bytes from places of source."""
    ends = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    picked = source[np.arange(ends[-1]) + np.repeat(at - ends[:-1], size)]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(picked))


def places_among_siblings(level: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """For children in document order, with their parents' numbers: of one level, a parent's children are adjacent."""
    order = np.argsort(level.astype(np.uint16), kind="stable")
    by = parent[order]
    first = np.flatnonzero(np.append(True, by[1:] != by[:-1])) if len(by) else np.zeros(0, np.int64)
    out = np.empty(len(by), np.int32)
    out[order] = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
    return out


def chosen(names: list[str], number: np.ndarray) -> pa.Array:
    """names by number, null where it is negative."""
    return pa.DictionaryArray.from_arrays(pa.array(number.astype(np.int32), mask=number < 0), pa.array(names, pa.string())).dictionary_decode()


class Parser:
    """Remembers the forms of tags from one call to the next."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.forms: dict[str, tuple | None] = {}

    def form(self, text: str) -> tuple | None:
        """What the tag is, its name and its attributes' names; None if it isn't plain."""
        if text not in self.forms:
            if len(self.forms) >= 10_000:
                self.forms.clear()
            m, found, limits = _FORM.fullmatch(text), None, self.limits
            if m:
                name, names = m["end"] or m["start"], _NAME.findall(m["attributes"] or "")
                if len(set(names)) == len(names) <= limits.max_attributes_per_element and max(map(len, [name, *names])) <= limits.max_name_length and "xmlns" not in names:
                    found = (END if m["end"] else EMPTY if m["empty"] else START, name, names)
            self.forms[text] = found
        return self.forms[text]

    def parse(self, ids: pa.Array, texts: pa.StringArray) -> tuple[np.ndarray, pa.RecordBatch | None, np.ndarray]:
        """Which documents are plain, the columns of NODES of these, and their numbers of nodes."""
        data, at = bytes_of(texts)
        plain = (np.diff(at) > 0) & texts.is_valid().to_numpy(zero_copy_only=False)
        plain[np.searchsorted(at, np.flatnonzero(_REFUSED[data]), "right") - 1] = False
        if self.limits.max_document_bytes < len(data):
            plain &= np.diff(at) <= self.limits.max_document_bytes
        while plain.any():
            mask = pa.array(plain)
            found = self._columns(ids.filter(mask), texts.filter(mask))
            if isinstance(found, tuple):
                return plain, *found
            plain[np.flatnonzero(plain)[found]] = False
        return plain, None, np.zeros(0, np.int64)

    def _columns(self, ids: pa.Array, texts: pa.StringArray):
        """Columns of NODES and numbers of nodes, or which documents aren't plain."""
        limits = self.limits
        data, at = bytes_of(texts)
        lt, gt = np.flatnonzero(data == ord("<")), np.flatnonzero(data == ord(">"))
        n_lt, n_gt = np.diff(np.searchsorted(lt, at)), np.diff(np.searchsorted(gt, at))
        bad = (n_lt != n_gt) | (data[at[:-1]] != ord("<")) | (data[at[1:] - 1] != ord(">"))
        if bad.any():
            return bad
        n, n_docs = len(lt), len(ids)
        doc = np.repeat(np.arange(n_docs), n_lt)
        first = np.append(True, doc[1:] != doc[:-1])
        last = np.append(first[1:], True)

        def of(tags):
            found = np.zeros(n_docs, bool)
            found[doc[tags]] = True
            return found

        next_lt = np.append(lt[1:], len(data))
        wrong = (lt > gt) | (gt > next_lt) & ~last
        if wrong.any():
            return of(wrong)
        # attributes' values
        quote = np.flatnonzero(data == ord('"'))
        tag = np.searchsorted(lt, quote, "right") - 1
        inside = quote < gt[tag]
        quote, tag = quote[inside], tag[inside]
        wrong = np.bincount(tag, minlength=n) % 2 == 1
        if wrong.any():
            return of(wrong)
        v_at, v_end, v_tag = quote[0::2] + 1, quote[1::2], tag[0::2]
        if (v_end - v_at > limits.max_attribute_size).any():
            return of(v_tag[v_end - v_at > limits.max_attribute_size])
        # forms of tags
        step = np.zeros(len(data) + 1, np.int8)
        step[lt] += 1
        step[gt + 1] -= 1
        step[v_at] -= 1
        step[v_end] += 1
        form_ends = np.zeros(n + 1, np.int64)
        np.cumsum(gt - lt + 1 - np.bincount(v_tag, v_end - v_at, n).astype(np.int64), out=form_ends[1:])
        forms = pa.StringArray.from_buffers(n, pa.py_buffer(form_ends.astype(np.int32)), pa.py_buffer(data[np.cumsum(step[:-1], dtype=np.int8).view(bool)])).dictionary_encode()
        form, known = forms.indices.to_numpy(), [self.form(x) for x in forms.dictionary.to_pylist()]
        wrong = np.array([x is None for x in known])[form]
        if wrong.any():
            return of(wrong)
        names = {"xml": 0}
        number = lambda x: names.setdefault(x, len(names))
        what = np.array([x[0] for x in known], np.int8)[form]
        name = np.array([number(x[1]) for x in known], np.int32)[form]
        counts = np.array([len(x[2]) for x in known])
        n_attrs, first_name = counts[form], (np.cumsum(counts) - counts)[form]
        attr_names = np.array([number(y) for x in known for y in x[2]], np.int32)
        # depth, and which end is whose
        change = np.array([1, -1, 0])[what]
        after = np.cumsum(change)
        after -= np.repeat((after - change)[first], n_lt)
        wrong = np.where(last, after != 0, after < 1)
        if wrong.any():
            return of(wrong)
        opens = what != END
        level = np.where(opens, after - change, after)
        wrong = opens & (level >= min(limits.max_depth, 60_000))
        if wrong.any():
            return of(wrong)
        paired = np.flatnonzero(what != EMPTY)
        paired = paired[np.argsort(level[paired].astype(np.uint16), kind="stable")]
        begin, end = paired[0::2], paired[1::2]
        wrong = name[begin] != name[end]
        if wrong.any():
            return of(begin[wrong])
        closed = np.arange(n)
        closed[begin] = end
        # the tag of the element around each tag; -1 is the document
        around = np.full(n, -1)
        begins = np.flatnonzero(what == START)
        for k in range(int(level.max(initial=0))):
            outer, inner = begins[level[begins] == k], np.flatnonzero(level == k + 1)
            around[inner] = outer[np.searchsorted(outer, inner) - 1]
        # numbers of nodes: an element and what belongs to it by its first tag, text by the tag before it
        text_size = np.where(last, 0, next_lt - gt - 1)
        wrong = text_size > min(limits.max_text_length, BUFFERED)
        if wrong.any():
            return of(wrong)
        has_text = text_size > 0
        made = np.where(opens, 1 + n_attrs, 0) + 2 * first + has_text
        row = np.cumsum(made) - made
        total = int(made.sum())
        n_nodes = np.bincount(doc, made, n_docs).astype(np.int64)
        if n_nodes.max() > limits.max_nodes:
            return n_nodes > limits.max_nodes
        root = row[first]
        element = row + first  # of tags that open
        e = np.flatnonzero(opens)
        t = np.flatnonzero(has_text)
        text_row = row[t] + made[t] - 1
        attr = element[v_tag] + 1 + first[v_tag] + np.arange(len(v_tag)) - (np.cumsum(n_attrs) - n_attrs)[v_tag]
        ns = root + 2
        text_parent = np.where(what[t] == START, t, around[t])

        kind = np.full(total, ELEMENT, np.int8)
        kind[root], kind[ns], kind[attr], kind[text_row] = ROOT, NAMESPACE, ATTR, TEXT
        local = np.full(total, -1, np.int32)
        local[element[e]], local[ns], local[attr] = name[e], 0, attr_names[first_name[v_tag] + np.arange(len(v_tag)) - (np.cumsum(n_attrs) - n_attrs)[v_tag]]
        base = np.repeat(root, n_nodes)
        levels = np.zeros(total, np.int32)
        levels[element[e]], levels[ns], levels[attr], levels[text_row] = level[e] + 1, 2, level[v_tag] + 2, level[text_parent] + 2
        parent = np.full(total, -1, np.int64)
        parent[element[e]] = np.where(around[e] < 0, np.repeat(root, n_lt)[e], element[around[e]])
        parent[ns], parent[attr], parent[text_row] = root + 1, element[v_tag], element[text_parent]
        size = np.zeros(total, np.int64)
        size[element[e]] = np.where(what[e] == EMPTY, n_attrs[e] + first[e], row[closed[e]] - 1 - element[e])
        size[root] = n_nodes - 1
        child = np.flatnonzero((kind == ELEMENT) | (kind == TEXT))
        sib = np.full(total, -1, np.int32)
        sib[child] = places_among_siblings(levels[child], parent[child])
        start, stop = np.zeros(total, np.int64), np.zeros(total, np.int64)
        tag_doc = at[:-1][doc]
        start[element[e]], stop[element[e]] = (lt - tag_doc)[e], (gt[closed] + 1 - tag_doc)[e]
        start[attr] = stop[attr] = (lt - tag_doc)[v_tag]
        start[text_row] = stop[text_row] = (next_lt - tag_doc)[t]  # the parser gives buffered text at its end
        stop[root] = np.diff(at)
        # strings: an element's is a slice of all texts
        step[:] = 0
        step[gt[t] + 1] += 1
        step[next_lt[t]] -= 1
        texts_ = data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
        v_from, v_size = np.zeros(total, np.int64), np.zeros(total, np.int64)
        own = np.zeros(total + 1, np.int64)
        own[text_row + 1] = text_size[t]
        own = np.cumsum(own)
        v_from[:] = own[:-1] + len(data)
        v_size[:] = own[np.arange(total) + size + 1] - own[:-1]
        v_from[attr], v_size[attr] = v_at, v_end - v_at
        v_from[ns], v_size[ns] = len(data) + len(texts_), len(_XML_NS)
        empty = pa.nulls(total, pa.string())
        numbers = lambda x: pa.array(x.astype(np.int32))
        columns = {
            "doc_id": ids.take(pa.array(np.repeat(np.arange(n_docs), n_nodes))), "pre": numbers(np.arange(total) - base), "size": numbers(size), "level": numbers(levels),
            "parent": pa.array((parent - base).astype(np.int32), mask=parent < 0), "sib": pa.array(sib, mask=sib < 0), "kind": chosen(list(KINDS), kind), "local": chosen(list(names), local),
            "ns_uri": empty, "prefix": empty, "value": slices(np.concatenate([data, texts_, _XML_NS]), v_from, v_size), "lang": empty, "src_start": numbers(start), "src_end": numbers(stop),
        }
        return pa.RecordBatch.from_arrays([columns[c] for c in NODE_COLUMNS], NODE_COLUMNS), n_nodes
