"""Every axis from every node of random trees, against a walk of the tree."""

import random

import pytest

from xylem.plans.ast import AXES
from xylem.sources.shred import nodes_of, shred, shred_text
from xylem.xpath import Xml, XPath


def random_xml(rng, depth=0):
    name = rng.choice("abc")
    attrs = "".join(f' {k}="{rng.randint(0, 9)}"' for k in rng.sample(["x", "y"], rng.randint(0, 2)))
    decl = rng.choice(["", "", ' xmlns:p="urn:1"', ' xmlns:p="urn:2"', ' xmlns="urn:d"', ' xmlns=""'])
    parts = []
    for _ in range(rng.randint(0, 3) if depth < 4 else 0):
        parts.append(rng.choice([lambda: random_xml(rng, depth + 1), lambda: "t", lambda: "<!--c-->", lambda: "<?q r?>"])())
    return f"<{name}{decl}{attrs}>{''.join(parts)}</{name}>"


RNG = random.Random(11)
TEXTS = [random_xml(RNG) for _ in range(25)]


def walk(rows, axis, x):
    """Places of the nodes on an axis of the node at place x, by parents and children only."""
    kind = lambda n: rows[n][5]
    parent = lambda n: rows[n][3]
    tree = lambda n: kind(n) not in ("attr", "ns")
    children = lambda n: [m for m in range(len(rows)) if parent(m) == n and tree(m)]

    def below(n):
        return [d for c in children(n) for d in (c, *below(c))]

    def above(n):
        return [] if parent(n) is None else [parent(n), *above(parent(n))]

    siblings = children(parent(x)) if parent(x) is not None and tree(x) else []
    if axis == "child":
        return children(x)
    if axis == "descendant":
        return below(x)
    if axis == "descendant-or-self":
        return [x, *below(x)]
    if axis == "parent":
        return above(x)[:1]
    if axis == "ancestor":
        return above(x)
    if axis == "ancestor-or-self":
        return [x, *above(x)]
    if axis == "self":
        return [x]
    if axis == "attribute":
        return [m for m in range(len(rows)) if parent(m) == x and kind(m) == "attr"]
    if axis == "following-sibling":
        return [m for m in siblings if m > x]
    if axis == "preceding-sibling":
        return [m for m in siblings if m < x]
    own = set(below(x)) | {x}
    if axis == "following":
        return [m for m in range(len(rows)) if tree(m) and m > x and m not in own]
    if axis == "preceding":
        return [m for m in range(len(rows)) if tree(m) and m < x and m not in above(x)]
    seen, out = set(), []
    for n in [x, *above(x)] if kind(x) == "element" else []:
        for m in range(len(rows)):
            if parent(m) == n and kind(m) == "ns" and rows[m][6] not in seen:
                seen.add(rows[m][6])
                if rows[m][9]:
                    out.append(m)
    return out


@pytest.fixture(scope="module")
def trees(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, xml string")
    nodes = nodes_of(shred(df)).persist()
    yield nodes
    nodes.unpersist()


@pytest.mark.parametrize("axis", AXES)
def test_axis(trees, axis):
    got = {(r["doc_id"], r["context"], r["pre"]) for r in XPath(f"{axis}::node()").evaluate(Xml(trees), context=trees).collect()}
    want = set()
    for k, text in enumerate(TEXTS):
        rows = shred_text(text).rows
        want |= {(k, x, m) for x in range(len(rows)) for m in walk(rows, axis, x)}
    assert got == want


@pytest.mark.parametrize("axis", ["following", "preceding"])
def test_closed_forms_equal_the_definition(trees, axis):
    whole = {(r["doc_id"], r["pre"]) for r in XPath(f"//*/{axis}::node()").evaluate(Xml(trees)).collect()}
    each = {(r["doc_id"], r["pre"]) for r in XPath(f"//*/{axis}::node()[true()]").evaluate(Xml(trees)).collect()}
    assert whole == each


@pytest.mark.parametrize("axis", ["ancestor", "following-sibling", "preceding-sibling", "descendant", "preceding"])
def test_positions_count_along_the_axis(trees, axis):
    got = {(r["doc_id"], r["context"], r["pre"]) for r in XPath(f"{axis}::*[2]").evaluate(Xml(trees), context=trees).collect()}
    want = set()
    for k, text in enumerate(TEXTS):
        rows = shred_text(text).rows
        for x in range(len(rows)):
            found = sorted((m for m in walk(rows, axis, x) if rows[m][5] == "element"), reverse=axis in ("ancestor", "preceding-sibling", "preceding"))
            want |= {(k, x, m) for m in found[1:2]}
    assert got == want
