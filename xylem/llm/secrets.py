"""Secret scans in DataFrame expressions only.

Two layers. The base layer is three patterns. The entropy layer looks at runs
of token characters: a window slides over a run, the counts of the characters
in it are updated by the one that enters and the one that leaves, and with
them the sum of c * log2(c); windows whose Shannon entropy reaches the
threshold of the run's character class become spans, merged where they touch.
Runs that match the allow-list are passed over. The sum is kept in integers
(units of 2**-20 bit), so results don't depend on the order of additions.

Positions are code points, ends exclusive. A regular expression's matches and
the text between them alternate, so positions are running sums of lengths.

Nulls: a null text is empty: no spans. Repeated rows are scanned each. An
empty table gives no rows. Other columns are kept by `scan`, whatever their
names; columns that it adds replace columns of the same name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, in the order in which kinds are listed.
BASE = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    # a run of 16 or 32 characters at least is what is left when shorter matches are dropped
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
}
ASSIGN_LEAST = 8
UNIT = 1 << 20


@dataclass(frozen=True)
class EntropyClass:
    """A character class: its kind, its alphabet, the runs it takes, the window and the entropy in bits that a window must have."""

    kind: str
    alphabet: str
    runs: str
    window: int
    bits: float


HEX = EntropyClass("entropy_hex", "0123456789abcdef", r"[0-9a-f]+", 24, 3.0)
BASE64 = EntropyClass("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", r"[A-Za-z0-9+/_=-]+", 24, 3.9)
#: A run belongs to the first class that takes it as a whole.
CLASSES = (HEX, BASE64)
RUN = r"[A-Za-z0-9+/_=-]{24,}"
#: Runs that are no secrets. Words (no digit) or numbers (no letter), repeated single characters, counting, samples.
ALLOW = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^(.)\1*$",
    r"(?i)0123456789|abcdefghijkl|example|placeholder|changeme",
    r"^[A-Za-z]+(?:[-_/=][A-Za-z]+)*[-_/=]?[0-9]{1,4}$",
)


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def entropy_sums(window: int) -> list[int]:
    """c * log2(c) for c = 0 .. window, in units."""
    return [round(c * math.log2(c) * UNIT) if c else 0 for c in range(window + 1)]


def entropy_bound(window: int, bits: float) -> int:
    """The largest sum of c * log2(c) of a window whose entropy is `bits` or more."""
    return math.floor(window * (math.log2(window) - bits) * UNIT)


def _positions(pieces: str, matches: str, extra: str = "0") -> str:
    """SQL: (start, end, extra) of each match, from the pieces between matches and the matches."""
    return f"""aggregate(sequence(0, size({matches}) - 1),
        named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,extra:int>>)),
        (acc, i) -> named_struct('at', acc.at + length({pieces}[i]) + length({matches}[i]),
            'out', concat(acc.out, array(named_struct('start', acc.at + length({pieces}[i]), 'end', acc.at + length({pieces}[i]) + length({matches}[i]), 'extra', {extra})))),
        acc -> acc.out)"""


def _windows(c: EntropyClass, run: str, start: str) -> str:
    """SQL: spans of the windows of a run that reach the class's entropy."""
    sums = ",".join(f"{x}L" for x in entropy_sums(c.window))
    code = f"instr({_q(c.alphabet)}, {{}}) - 1"
    into, out = code.format("ch[i]"), code.format(f"ch[i - {c.window}]")
    # the character that leaves first lowers the sum, then the one that enters raises it
    return f"""flatten(transform(array(split({run}, '')), ch -> aggregate(sequence(0, length({run}) - 1),
        named_struct('n', array_repeat(0, {len(c.alphabet)}), 's', 0L, 'out', cast(array() as array<struct<start:int,end:int>>)),
        (acc, i) -> transform(array(struct(
                CASE WHEN i >= {c.window} THEN {out} ELSE -1 END AS lost, {into} AS got)), io -> transform(array(
                named_struct('n', transform(acc.n, (v, k) -> v + CASE WHEN k = io.got THEN 1 ELSE 0 END - CASE WHEN k = io.lost THEN 1 ELSE 0 END),
                    's', CASE WHEN io.lost = io.got THEN acc.s ELSE acc.s
                        + CASE WHEN io.lost >= 0 THEN array({sums})[acc.n[greatest(io.lost, 0)] - 1] - array({sums})[acc.n[greatest(io.lost, 0)]] ELSE 0L END
                        + array({sums})[acc.n[io.got] + 1] - array({sums})[acc.n[io.got]] END)), y -> named_struct('n', y.n, 's', y.s,
                    'out', CASE WHEN i < {c.window - 1} OR y.s > {entropy_bound(c.window, c.bits)}L THEN acc.out
                        WHEN size(acc.out) > 0 AND element_at(acc.out, -1).end >= {start} + i - {c.window - 1}
                            THEN concat(slice(acc.out, 1, size(acc.out) - 1), array(named_struct('start', element_at(acc.out, -1).start, 'end', {start} + i + 1)))
                        ELSE concat(acc.out, array(named_struct('start', {start} + i - {c.window - 1}, 'end', {start} + i + 1))) END))[0])[0],
        acc -> acc.out)))"""


def secret_spans(text: Column | str, df: DataFrame, classes: tuple[EntropyClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """df with `_spans`: array of (start, k, end), k the place of the kind in KINDS, by start, then kind."""
    out = df.withColumn("_text", F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    for kind, pattern in BASE.items():
        out = out.withColumn(f"_{kind}", F.expr(f"regexp_extract_all(_text, {_q(pattern)}, 0)"))
    out = out.withColumn("_run", F.expr(f"regexp_extract_all(_text, {_q(RUN)}, 0)"))
    none = "cast(array() as array<struct<start:int,k:int,end:int>>)"
    spans = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        extra = f"length(regexp_extract(_{kind}[i], {_q(pattern)}, 2))" if kind == "assign" else "0"
        found = _positions(f"split(_text, {_q(pattern)}, -1)", f"_{kind}", extra)
        # the pieces are bound once, not split anew for each match
        found = found.replace(f"split(_text, {_q(pattern)}, -1)", "p")
        found = f"flatten(transform(array(split(_text, {_q(pattern)}, -1)), p -> {found}))"
        if kind == "assign":
            found = f"filter({found}, x -> x.extra >= {ASSIGN_LEAST})"
        spans.append(f"CASE WHEN size(_{kind}) = 0 THEN {none} ELSE transform({found}, x -> named_struct('start', x.start, 'k', {k}, 'end', x.end)) END")
    allowed = " OR ".join(f"r rlike {_q(x)}" for x in allow) or "false"
    found = f"flatten(transform(array(split(_text, {_q(RUN)}, -1)), p -> {_positions('p', '_run', 'i')}))"
    cases, taken = "", "false"
    for j, c in enumerate(classes):
        whole = f"_run[x.extra] rlike {_q(f'^{c.runs}$')}"
        cases += f" WHEN {whole} THEN transform({_windows(c, '_run[x.extra]', 'x.start')}, w -> named_struct('start', w.start, 'k', {len(BASE) + j}, 'end', w.end))"
        taken += f" OR {whole}"
    spans.append(f"""CASE WHEN NOT exists(_run, r -> NOT ({allowed})) THEN {none} ELSE
        flatten(transform(filter({found}, x -> NOT exists(array(_run[x.extra]), r -> {allowed})), x -> CASE{cases} ELSE {none} END)) END""")
    return out.withColumn("_spans", F.expr(f"array_sort(concat({', '.join(spans)}))"))


def kinds(classes: tuple[EntropyClass, ...] = CLASSES) -> list[str]:
    return [*BASE, *(c.kind for c in classes)]


def scan(docs: DataFrame, text_col: str = "text", classes: tuple[EntropyClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """docs with `secret_spans`: array of (kind, start, end) by start, then kind, and `redacted`: the text with each span replaced by [kind]."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text_col}`").alias("_in"))
    found = secret_spans("_in", packed, classes, allow)
    names = "array(" + ",".join(_q(x) for x in kinds(classes)) + ")"
    redacted = f"""CASE WHEN size(_spans) = 0 THEN _in ELSE aggregate(_spans,
        named_struct('at', 0, 'out', cast(array() as array<string>)),
        (acc, s) -> CASE WHEN s.end <= acc.at THEN acc
            WHEN s.start < acc.at THEN named_struct('at', s.end, 'out', acc.out)
            ELSE named_struct('at', s.end, 'out', concat(acc.out, array(substring(_text, acc.at + 1, s.start - acc.at), concat('[', {names}[s.k], ']')))) END,
        acc -> concat(array_join(acc.out, ''), substring(_text, acc.at + 1, length(_text)))) END"""
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c not in ("secret_spans", "redacted")]
    return found.select(*kept, F.expr(f"transform(_spans, s -> named_struct('kind', {names}[s.k], 'start', s.start, 'end', s.end))").alias("secret_spans"), F.expr(redacted).alias("redacted"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, the hash of the base spans and all spans as text."""
    found = scan(docs.select("doc_id", "text")).withColumn("b", F.expr(f"filter(secret_spans, s -> s.kind in ({', '.join(_q(x) for x in BASE)}))"))
    joined = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(F.expr(f"cast(size(filter(b, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE),
        F.sha2(F.expr(joined.format("b")).cast("binary"), 256).alias("base_sha256"),
        F.expr(joined.format("secret_spans")).alias("spans"),
    )
