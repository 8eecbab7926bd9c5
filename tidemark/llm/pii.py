"""Personal data by anchor expansion.

One Aho-Corasick pass over a whole text finds anchors: at-signs, plus signs, digits, URL schemes and
identifier cues. At each anchor a small deterministic parser expands to the left and right and validates
what it finds: addresses by their grammar and ranges, card numbers by the Luhn sum, bank accounts by their
check digits, other accounts and credentials by what may follow their cue. Each kind keeps the end of its
last match, so its spans never overlap, as with a leftmost scan of the text.

Bounds of the added kinds: a scheme is as long as its characters go on, and begins with a letter; an IBAN has 15 to 34
characters (ISO 13616) and right check digits; an account number after its cue has 6 to 17 digits, 17 being the width
of that field in bank transfers and fewer than 6 being dates and counts; a credential has 8 characters or more, one of
them a digit, since shorter ones and plain words after a cue are prose; a key id has the 20 characters of its form.

Defined results: a null or empty text has no spans; offsets count code points, end exclusive; every row
gives a row, repeated rows too; other columns pass through ``redact`` untouched and ``find`` doesn't read
them. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import arrow_map, column_texts, named

#: In the order in which spans with the same start are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("url", "account", "credential")
KINDS = BASE_KINDS + ADDED_KINDS
_RANK = {k: i for i, k in enumerate(KINDS)}

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_QUAD = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]++:[A-Za-z0-9._~%!$&'()*+,;=:-]++@[A-Za-z0-9.-]++(?:/[^\s\"'<>]*+)?")
_IBAN = re.compile(r"[\s:#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?: (?:number|no\.?|nr\.?|#))?[\s:#=]{1,3}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])")
_SSN = re.compile(r"[\s:#=]{0,3}((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9-])")
_SECRET = re.compile(r"\s{0,3}[=:]\s{0,3}([\"']?)([A-Za-z0-9+/_.~-]{8,})\1")
_KEY_ID = re.compile(r"[0-9A-Z]{16}(?![0-9A-Za-z])")


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _word_before(text: str, at: int) -> bool:
    return at > 0 and (text[at - 1].isalnum() or text[at - 1] == "_")


# A parser takes (text, anchor's start, anchor's end, where its kind may start) and returns
# (start, end of a valid span or None, where the kind goes on).
_Found = tuple[tuple[int, int] | None, int]


def _email(text: str, start: int, end: int, free: int) -> _Found:
    left = start
    while left > free and text[left - 1] in _LOCAL:
        left -= 1
    domain = _DOMAIN.match(text, end) if left < start else None
    return ((left, domain.end()), domain.end()) if domain else (None, free)


def _ip(text: str, start: int, end: int, free: int) -> _Found:
    if start < free:
        return None, free
    if m := _QUAD.match(text, start):
        return (m.span() if all(map(_octet, m.groups())) else None), m.end()
    return None, _CHAIN.match(text, start).end()  # no later start in a chain of fewer than four parts fits


def _card(text: str, start: int, end: int, free: int) -> _Found:
    if start < free or not (m := _DIGITS.match(text, start)):
        return None, free
    digits = m.group().replace(" ", "").replace("-", "")
    return (m.span() if 12 <= len(digits) <= 19 and _luhn(digits) else None), m.end()


def _phone(text: str, start: int, end: int, free: int) -> _Found:
    if start < free or not (m := _PHONE.match(text, start)):
        return None, free
    return (m.span() if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15 else None), m.end()


def _url(text: str, start: int, end: int, free: int) -> _Found:
    left = start
    while left > free and (text[left - 1].isascii() and text[left - 1].isalnum() or text[left - 1] in "+.-"):
        left -= 1
    while left < start and not text[left].isalpha():  # a scheme begins with a letter
        left += 1
    m = _USERINFO.match(text, end) if left < start else None
    return ((left, m.end()), m.end()) if m else (None, free)


def _iban(text: str, start: int, end: int, free: int) -> _Found:
    if start < free or _word_before(text, start) or not (m := _IBAN.match(text, end)):
        return None, free
    first, last = m.span(1)
    while True:  # a word in capitals after the number is taken for a part of it at first
        code = text[first:last].replace(" ", "")
        if len(code) < 15:
            return None, m.end()
        if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return (first, last), last
        last = max(text.rfind(" ", first, last), first)


def _after_cue(pattern: re.Pattern[str], group: int) -> Callable[[str, int, int, int], _Found]:
    def parse(text: str, start: int, end: int, free: int) -> _Found:
        if start < free or _word_before(text, start) or not (m := pattern.match(text, end)):
            return None, free
        return m.span(group), m.end()

    return parse


def _credential(text: str, start: int, end: int, free: int) -> _Found:
    if start < free or not (m := _SECRET.match(text, end)) or not any(c.isdigit() for c in m.group(2)):
        return None, free
    return m.span(2), m.end()


def _key_id(text: str, start: int, end: int, free: int) -> _Found:
    if start < free or _word_before(text, start) or not (m := _KEY_ID.match(text, end)):
        return None, free
    return (start, m.end()), m.end()


#: The anchors of each parser. Cues in lower case also stand capitalised and in capitals.
_ANCHORS: list[tuple[tuple[str, ...], str, Callable[[str, int, int, int], _Found]]] = [
    (("@",), "email", _email),
    (tuple("0123456789"), "ip", _ip),
    (tuple("0123456789"), "card", _card),
    (("+",), "phone", _phone),
    (("://",), "url", _url),
    (("iban",), "account", _iban),
    (("account", "acct", "konto", "compte", "cuenta"), "account", _after_cue(_ACCOUNT, 1)),
    (("ssn", "social security number"), "account", _after_cue(_SSN, 1)),
    (("password", "passwd", "token", "secret", "api_key", "apikey"), "credential", _credential),
    (("AKIA", "ASIA"), "credential", _key_id),
]


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    parsers: dict[str, list[tuple[str, Callable]]] = {}
    for cues, kind, parse in _ANCHORS:
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()} if cue.islower() else {cue}:
                parsers.setdefault(form, []).append((kind, parse))
    found = ahocorasick.Automaton()
    for form, what in parsers.items():
        found.add_word(form, (len(form), what))
    found.make_automaton()
    return found


def spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of all personal data in one text, by start, then kind."""
    free: dict[str, int] = {}
    out = []
    for last, (length, parsers) in _automaton().iter(text):
        start, end = last + 1 - length, last + 1
        for kind, parse in parsers:
            span, free[kind] = parse(text, start, end, free.get(kind, 0))
            if span:
                out.append((kind, *span))
    return sorted(out, key=lambda s: (s[1], _RANK[s[0]], s[2]))


def _span_type() -> pa.DataType:
    return pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans)`` for every row of ``docs``."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[dict(zip(("kind", "start", "end"), s)) for s in spans(t)] for t in column_texts(batch, 1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _span_type())], ["doc_id", "spans"])

    kind = dict(docs.dtypes)[id_col]
    doc_id, text = named([id_col, text_col])
    return arrow_map(docs.select(doc_id.alias("doc_id"), text.alias("text")), make, f"doc_id {kind}, spans {SPANS}")


def _merged(found: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Overlapping spans become one, named by the first."""
    now: tuple[str, int, int] | None = None
    for kind, start, end in found:
        if now and start < now[2]:
            now = (now[0], now[1], max(now[2], end))
        else:
            if now:
                yield now
            now = (kind, start, end)
    if now:
        yield now


def redacted(text: str) -> str:
    """``text`` with a placeholder such as ``<email>`` for each span."""
    out, at = [], 0
    for kind, start, end in _merged(spans(text)):
        out += [text[at:start], f"<{kind}>"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text_col`` replaced; a null text stays null, and all other
    columns and their order stay as they are."""
    at = docs.columns.index(text_col)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t if t is None else redacted(t) for t in batch.column(at).to_pylist()]
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()))

    return arrow_map(docs, make, docs.schema)
