"""Fuzzy search for short licence notices.

A text becomes its words, lower-cased in A-Z and joined by single blanks. Each
notice with up to ``errors`` edits is split into ``errors`` + 1 pieces; by the
pigeonhole principle one of them stands unchanged in any match, so an
Aho-Corasick pass over the pieces of all notices finds every candidate. At each
candidate the regex library's bounded-error matching verifies the edits. Matches
without edits of a notice with ``errors`` 0 are word for word.

Defined cases: a null or empty text has no words and no matches; texts are
searched whole; matches of one notice don't overlap unless it allows no errors;
repeated rows give repeated results; an empty table gives an empty table;
clashing columns give way. Edits count UTF-8 bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, as_bytes


@dataclass(frozen=True)
class Notice:
    label: str
    phrase: str
    errors: int = 0


#: Exact phrases and notices with edits; about one edit for each eight letters.
PHRASES = (
    Notice("gpl", "gnu general public license"),
    Notice("apache", "apache license"),
    Notice("cc-by", "cc by"),
    Notice("mit", "mit license"),
)
NOTICES = (
    *PHRASES,
    Notice("gpl", "licensed under the gnu general public license", 5),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("agpl", "gnu affero general public license", 3),
    Notice("apache", "licensed under the apache license version 2 0", 5),
    Notice("mit", "released under the mit license", 3),
    Notice("mit", "permission is hereby granted free of charge to any person", 6),
    Notice("bsd", "redistribution and use in source and binary forms", 5),
    Notice("mpl", "mozilla public license", 2),
    Notice("cc-by-nc", "cc by nc"),
    Notice("cc-by-sa", "cc by sa"),
    Notice("cc-by-nd", "cc by nd"),
    Notice("cc-by", "creative commons attribution", 3),
    Notice("cc0", "cc0 1 0 universal", 1),
    Notice("all-rights-reserved", "all rights reserved", 2),
)

MATCH = T.StructType(
    [
        T.StructField("label", T.StringType(), False),
        T.StructField("phrase", T.StringType(), False),
        T.StructField("first_word", T.LongType(), False),
        T.StructField("words", T.LongType(), False),
        T.StructField("errors", T.IntegerType(), False),
        T.StructField("score", T.DoubleType(), False),
        T.StructField("value", T.StringType(), False),
    ]
)

#: A-Z to lower case, other ASCII signs than letters and digits to blanks.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)


def folded(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Scanner:
    def __init__(self, notices: tuple[Notice, ...]):
        self.notices = notices
        self.shapes = [f" {n.phrase} " for n in notices]
        self.checks = [regex.compile(f"(?e)(?:{regex.escape(s)}){{e<={n.errors}}}") for s, n in zip(self.shapes, notices)]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (shape, n) in enumerate(zip(self.shapes, notices)):
            cuts = [len(shape) * i // (n.errors + 1) for i in range(n.errors + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(shape[a:b], []).append((k, a))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def find(self, words: list[bytes]) -> list[tuple[int, int, int, int, str]]:
        """(notice, first word, words, errors, matched text), by place."""
        text = f" {b' '.join(words).decode('latin-1')} "
        ranges: dict[int, list[list[int]]] = {}
        found = []
        for last, (width, uses) in self.seeds.iter(text):
            for k, offset in uses:
                errors = self.notices[k].errors
                begin = last + 1 - width - offset
                if not errors:
                    found.append((begin, begin + len(self.shapes[k]), k, 0))
                    continue
                begin, end = max(0, begin - errors), begin + len(self.shapes[k]) + errors
                own = ranges.setdefault(k, [])
                if own and begin <= own[-1][1]:
                    own[-1][1] = max(end, own[-1][1])
                else:
                    own.append([begin, end])
        for k, places in ranges.items():
            for begin, end in places:
                for m in self.checks[k].finditer(text, begin, min(end, len(text))):
                    found.append((m.start(), m.end(), k, sum(m.fuzzy_counts)))
        out, at, seen = [], 0, 0
        for begin, end, k, errors in sorted(found):
            seen += text.count(" ", at, begin)
            at = begin
            inner = text[begin:end].strip()
            # a match that starts inside a word belongs to that word
            first = seen if text[begin] == " " else max(0, seen - 1)
            out.append((k, first, inner.count(" ") + 1, errors, inner))
        return out


def find_notices(
    df: DataFrame, text: str = "text", notices: tuple[Notice, ...] = NOTICES, output: str = "notices", keep: list[str] | None = None
) -> DataFrame:
    """Add ``output``, an array of matches, and ``n_words``."""

    def make():
        scanner = Scanner(notices)

        def run(column):
            rows, counts = [], []
            for t in as_bytes(column):
                words = folded(t)
                counts.append(len(words))
                rows.append(
                    [
                        {
                            "label": notices[k].label,
                            "phrase": notices[k].phrase,
                            "first_word": first,
                            "words": n,
                            "errors": errors,
                            "score": max(0.0, 1 - errors / len(notices[k].phrase)),
                            "value": value.encode("latin-1").decode("utf-8", "replace"),
                        }
                        for k, first, n, errors, value in scanner.find(words)
                    ]
                    if words
                    else []
                )
            return [rows, counts]

        return run

    fields = [T.StructField(output, T.ArrayType(MATCH, False), False), T.StructField("n_words", T.LongType(), False)]
    return append_columns(df, [text], fields, make, keep)
