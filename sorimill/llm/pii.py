"""Personal data by anchor expansion.

One Aho-Corasick pass over each text finds anchors: at-signs, schemes, cue
words of identifiers, digits next to a dot, a plus sign or another digit. At
each anchor a deterministic parser walks left and right to the boundaries of
the address or account and validates it. Base kinds: ``email``, ``ip``,
``card`` and ``phone``. Kinds that only anchors give: ``login`` (user and
password in front of the host after a scheme), ``obfuscated`` (an e-mail with
its at-sign spelled out in brackets), ``iban`` (mod-97 checked, next to its
cue) and ``account`` (a number of at least six digits behind a cue).

Defined cases: a null or empty text has no spans; any other column may be null;
repeated rows give repeated results; an empty table gives an empty table; a
carried column named like the result gives way to it. A text of any length is
searched whole, in time linear in its length.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, as_text

KINDS = ("email", "ip", "card", "phone", "login", "obfuscated", "iban", "account")

SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType(), False),
        T.StructField("start", T.IntegerType(), False),
        T.StructField("end", T.IntegerType(), False),
        T.StructField("value", T.StringType(), False),
    ]
)

_DIGITS = "0123456789"
_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta")
_SPELLED_AT = ("[at]", "(at)", "{at}")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*")
_CHAIN = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PHONE_RUN = re.compile(r"[ ().0-9-]+")
_LOGIN = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=-]+:[^\s/?#@]+@[A-Za-z0-9.-]+")
_SPELLED_HOST = re.compile(r" ?([A-Za-z0-9-]+(?:(?:\.| ?[\[({]dot[\])}] ?)[A-Za-z0-9-]+)+)")
_AFTER_CUE = re.compile(r"(?:[ \t]*(?:number|no|nr|num)\b\.?)?[ \t]*[:=#]?[ \t]*")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,33}(?![A-Za-z0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _mod97(value: str) -> bool:
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    """Anchors and, as their value, the parser that each one calls."""
    a = ahocorasick.Automaton()
    a.add_word("@", ("at", 1))
    a.add_word("://", ("scheme", 3))
    for spelled in _SPELLED_AT:
        a.add_word(spelled, ("spelled", len(spelled)))
        a.add_word(spelled.upper(), ("spelled", len(spelled)))
    for cue in _CUES:
        for form in (cue, cue.capitalize(), cue.upper()):
            a.add_word(form, ("cue", len(form)))
    for x in _DIGITS:
        a.add_word(f"+{x}", ("plus", 2))
        for y in _DIGITS:
            a.add_word(f"{x}.{y}", ("dot", 3))
            for gap in ("", " ", "-"):
                a.add_word(x + gap + y, ("pair", 2 + len(gap)))
    a.make_automaton()
    return a


def _walk_left(text: str, at: int, least: int, joins: str) -> int:
    """Start of the run of digits, joined singly by ``joins``, that holds text[at]."""
    while at > least:
        before = text[at - 1]
        if before in _DIGITS:
            at -= 1
        elif before in joins and at - 1 > least and text[at - 2] in _DIGITS:
            at -= 2
        else:
            break
    return at


def find(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """Spans of one text as (kind, start, end) in code points, by start and kind."""
    spans: list[tuple[str, int, int]] = []
    email_end = dotted_end = chain_end = phone_end = 0
    for last, (kind, width) in anchors.iter(text):
        at = last + 1 - width
        if kind == "pair":
            if at < chain_end:
                continue
            start = _walk_left(text, at, chain_end, " -")
            chain_end = _CHAIN.match(text, start).end()
            digits = text[start:chain_end].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", start, chain_end))
        elif kind == "dot":
            if at < dotted_end:
                continue
            start = _walk_left(text, at, dotted_end, ".")
            dotted_end = _DOTTED.match(text, start).end()
            parts = text[start:dotted_end].split(".")
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = start + len(".".join(four))
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                    spans.append(("ip", start, end))
                start = end + 1
        elif kind == "at":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                spans.append(("email", start, email_end))
        elif kind == "plus":
            if at < phone_end or not (m := _PHONE_RUN.match(text, at + 2)):
                continue
            run = m.group().rstrip(" ().-")
            if len(run) > 1:
                phone_end = at + 2 + len(run)
                if 10 <= 1 + sum(map(run.count, _DIGITS)) <= 15:
                    spans.append(("phone", at, phone_end))
        elif kind == "scheme":
            if m := _LOGIN.match(text, at + 3):
                spans.append(("login", at + 3, m.end()))
        elif kind == "spelled":
            end = at - (at > 0 and text[at - 1] == " ")
            start = end
            while start and text[start - 1] in _LOCAL:
                start -= 1
            if start < end and (m := _SPELLED_HOST.match(text, at + width)):
                spans.append(("obfuscated", start, m.end()))
        elif not text[at - 1 : at].isalnum() and not text[at + width : at + width + 1].isalpha():
            begin = _AFTER_CUE.match(text, at + width).end()
            if m := _IBAN.match(text, begin):
                # blanks may lead into the words that follow: the longest valid prefix counts
                value, end = m.group(), m.end()
                while value and not (15 <= len(v := value.replace(" ", "")) <= 34 and _mod97(v)):
                    value = value[: value.rfind(" ")] if " " in value else ""
                    end = begin + len(value)
                if value:
                    spans.append(("iban", begin, end))
            elif m := _ACCOUNT.match(text, begin):
                spans.append(("account", begin, m.end()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_pii(df: DataFrame, text: str = "text", output: str = "pii", keep: list[str] | None = None) -> DataFrame:
    """Add ``output``: an array of (kind, start, end, value) for each text."""

    def make():
        anchors = automaton()

        def run(column):
            return [[[{"kind": k, "start": a, "end": b, "value": t[a:b]} for k, a, b in find(t, anchors)] for t in as_text(column)]]

        return run

    return append_columns(df, [text], [T.StructField(output, T.ArrayType(SPAN, False), False)], make, keep)
