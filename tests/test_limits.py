"""Limits for untrusted input, the same for shredding and for events; strings that declare an encoding."""

import pytest

from xylem.model import Limits, XmlError
from xylem.sources.shred import shred_text
from xylem.streaming.events import PushReader, events_of


def outcome(text, limits=None):
    """What shredding and events say of a document: the kind of error or None."""
    try:
        shred_text(text, limits)
        one = None
    except XmlError as e:
        one = e.kind
    return one, next((e["error_kind"] for e in events_of(text, limits) if e["type"] == "Error"), None)


@pytest.mark.parametrize(
    "limits,text,kind",
    [
        ({"max_name_length": 5}, f"<{'n' * 100}/>", "NameTooLong"),
        ({"max_attribute_size": 10}, f"<a b='{'c' * 11}'/>", "AttributeTooLarge"),
        ({"max_text_length": 10}, f"<a>{'c' * 11}</a>", "TextTooLong"),
        ({"max_document_bytes": 20}, f"<a>{'c' * 21}</a>", "DocumentTooLarge"),
        ({"max_depth": 3}, "<a><a><a><a/></a></a></a>", "DepthLimitExceeded"),
        ({"max_entity_expansion": 1000}, f"<!DOCTYPE a [<!ENTITY e '{'x' * 100}'>]><a b='{'&e;' * 400}'/>", "EntityLimitExceeded"),
        ({"max_entity_expansion": 1000}, f"<!DOCTYPE a [<!ENTITY e '{'x' * 100}'>]><a>{'&e;' * 400}</a>", "EntityLimitExceeded"),
    ],
)
def test_limits_hold_for_both(limits, text, kind):
    assert outcome(text, Limits(**limits)) == (kind, kind)
    assert outcome(text) == (None, None)


@pytest.mark.parametrize(
    "text,kind",
    [
        ("<a>x]]>y</a>", "IllegalCdataEnd"), ("<a><!-- b -- c --></a>", "MalformedComment"), ("<a><!-- b ---></a>", "MalformedComment"), ("<a b=c/>", "UnquotedAttributeValue"), ("<a b=/>", "UnquotedAttributeValue"),
        ("<a b='1'c='2'/>", "UnquotedAttributeValue"), ("<a><b>", "UnexpectedEof"), ("<a b", "UnexpectedEof"), ("<a b='c", "Unterminated"), ("<!-- b", "Unterminated"), ("", "NoRootElement"), ("<1/>", "InvalidName"), ("<a b='<'/>", "InvalidName"), ("<a ]]/>", "InvalidName"),
    ],
)
def test_kinds_of_errors_are_the_same_for_both(text, kind):
    assert outcome(text) == (kind, kind)
    pieces = PushReader()
    got = [e for k, c in enumerate(text.encode()) for e in pieces.feed(bytes([c]), k + 1 == len(text))] or pieces.feed(b"", True)
    assert got[-1]["error_kind"] == kind


def test_unknown_versions_are_refused():
    with pytest.raises(XmlError, match="UnsupportedVersion"):
        shred_text("<?xml version='2.0'?><a/>")
    assert shred_text("<?xml version='1.7'?><a/>").rows


def test_declarations_are_bounded_in_events():
    wide = "".join(f"<!ENTITY % p{k} '{'y' * 1000}'>" for k in range(20))
    assert outcome(f"<!DOCTYPE a [{wide}]><a/>", Limits(max_pe_expansion=10_000)) == ("EntityLimitExceeded", "EntityLimitExceeded")
    assert outcome(f"<!DOCTYPE a [{wide}]><a/>", Limits(max_dtd_bytes=1000)) == ("DtdTooLarge", "DtdTooLarge")


def nested(levels, use="&e0;"):
    entities = "".join(f"<!ENTITY e{k} '&e{k + 1};'>" for k in range(levels - 1))
    return f"<!DOCTYPE a [{entities}<!ENTITY e{levels - 1} 'x'>]><a>{use}</a>"


def test_depth_of_internal_entities():
    with pytest.raises(XmlError, match="EntityLimitExceeded"):
        shred_text(nested(39), Limits.strict())
    with pytest.raises(XmlError, match="EntityLimitExceeded"):
        shred_text(nested(5), Limits.strict())
    assert shred_text(nested(4), Limits.strict()).rows[0][9] == "x"
    # what isn't used, or stands where nothing is replaced, counts nothing
    assert shred_text(nested(39, "<![CDATA[&e0;]]>"), Limits.strict()).rows[0][9] == "&e0;"


def test_depth_of_content_models_and_parameter_entities():
    deep = f"<!DOCTYPE a [<!ELEMENT a {'(' * 40}b{')' * 40}>]><a/>"
    with pytest.raises(XmlError, match="DtdDepthLimitExceeded"):
        shred_text(deep, Limits.strict())
    assert shred_text(deep).rows
    wide = "".join(f"<!ENTITY % p{k} '{'y' * 1000}'>" for k in range(20))
    with pytest.raises(XmlError, match="EntityLimitExceeded"):
        shred_text(f"<!DOCTYPE a [{wide}]><a/>", Limits(max_pe_expansion=10_000))


def test_a_string_is_not_in_the_encoding_it_declares():
    text = '<?xml version="1.0" encoding="ISO-8859-1"?><a>\u00e9</a>'
    assert shred_text(text).rows[0][9] == "\u00e9"
    assert [e["text"] for e in events_of(text) if e["type"] == "Text"] == ["\u00e9"]
    assert [e["text"] for e in events_of(text.encode("latin-1")) if e["type"] == "Text"] == ["\u00e9"]
