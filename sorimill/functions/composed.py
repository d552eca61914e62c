"""Canonical composition (NFC), with a map from its code points back to the source.

Spark has no such function, but the library its collations come with does. It is called
in the JVM, for texts that may need it only; the map is made for those that do.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import let

_LEAD, _VOWEL, _TAIL = r"\x{1100}-\x{115F}\x{A960}-\x{A97C}", r"\x{1160}-\x{11A7}\x{D7B0}-\x{D7C6}", r"\x{11A8}-\x{11FF}\x{D7CB}-\x{D7FB}"
_OPEN = "".join(map(chr, range(0xAC00, 0xD7A4, 28)))
SPAN = "struct<start:int,end:int>"
REWRITE = "struct<start:int,end:int,before:string,after:string>"


def _ranges(characters: list[int]) -> str:
    """Characters, in order, as ranges for a pattern."""
    starts = [c for i, c in enumerate(characters) if i == 0 or characters[i - 1] != c - 1]
    ends = [c for i, c in enumerate(characters) if i == len(characters) - 1 or characters[i + 1] != c + 1]
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends))


@cache
def combining() -> str:
    """The characters with a combining class."""
    return _ranges([c for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c))])


@cache
def _may_change() -> str:
    """What a text must hold to be changed: marks, letters of syllables, characters that stand for others."""
    others = [c for c in range(0x300, 0x30000) if not 0xD800 <= c < 0xE000 and not unicodedata.is_normalized("NFC", chr(c))]
    return rf"[\p{{M}}{_LEAD}{_VOWEL}{_TAIL}{_ranges(others)}]"


@cache
def _cluster() -> str:
    """What is composed as a whole: letters of a syllable, or a character, with the marks behind them."""
    mark = f"[{combining()}]*+"
    return rf"(?s)(?:[{_LEAD}]{mark}[{_VOWEL}]{mark}[{_TAIL}]|[{_LEAD}]{mark}[{_VOWEL}]|[{_OPEN}]{mark}[{_TAIL}]|.){mark}"


def _composed(text: Column) -> Column:
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(False))
    return F.when(text.rlike(_may_change()), composed).otherwise(text)


def nfc(text: Column) -> Column:
    """The text in NFC; null stays null."""
    return _composed(text)


def nfc_mapped(text: Column) -> Column:
    """(text, spans, rewrites): NFC, for each of its code points the range (start, end) of
    the source that it came from, and the clusters that changed. Null stays null."""
    none = lambda kind: F.expr(f"cast(array() as array<{kind}>)")

    def result(x: Column) -> Column:
        places = F.when(x == "", none(SPAN)).otherwise(F.transform(F.sequence(F.lit(0), F.length(x) - 1), lambda i: F.struct(i.alias("start"), (i + 1).alias("end"))))
        same = F.struct(x.alias("text"), places.cast(f"array<{SPAN}>").alias("spans"), none(REWRITE).alias("rewrites"))
        clusters = F.transform(F.regexp_extract_all(x, F.lit(_cluster()), F.lit(0)), lambda c: F.struct(c.alias("before"), _composed(c).alias("after")))

        def step(acc: Column, c: Column) -> Column:
            end = acc["at"] + F.length(c["before"])
            place = F.struct(acc["at"].alias("start"), end.alias("end"))
            change = F.when(c["before"] != c["after"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"), c["before"].alias("before"), c["after"].alias("after")))).otherwise(none(REWRITE))
            return F.struct(
                end.alias("at"), F.concat(acc["text"], c["after"]).alias("text"), F.concat(acc["spans"], F.array_repeat(place, F.length(c["after"]))).alias("spans"), F.concat(acc["rewrites"], change).alias("rewrites")
            )

        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"), none(SPAN).alias("spans"), none(REWRITE).alias("rewrites"))
        mapped = F.aggregate(clusters, start, step, lambda acc: F.struct(*[acc[f].alias(f) for f in ("text", "spans", "rewrites")]))
        return F.when(x.rlike(_may_change()), mapped).when(x.isNotNull(), same)

    return let(text, result)


def source_span(mapped: Column, start: Column, end: Column) -> Column:
    """(start, end) in the source of a range of the composed text; null if empty or outside."""
    inside = (F.lit(0) <= start) & (start < end) & (end <= F.size(mapped["spans"]))
    return F.when(inside, F.struct(F.get(mapped["spans"], start)["start"].alias("start"), F.get(mapped["spans"], end - 1)["end"].alias("end")))


def snapped(mapped: Column, start: Column, end: Column) -> Column:
    """The range of the composed text, widened to whole clusters; an empty one stays, null if outside."""
    spans = mapped["spans"]

    def wide(ends: Column) -> Column:
        first, last = F.array_position(spans, ends["first"]) - 1, F.size(spans) - F.array_position(F.reverse(spans), ends["last"]) + 1
        return F.struct(first.cast("int").alias("start"), last.cast("int").alias("end"))

    ends = F.struct(F.get(spans, start).alias("first"), F.get(spans, end - 1).alias("last"))
    given = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
    inside = (F.lit(0) <= start) & (start <= end) & (end <= F.size(spans))
    return F.when(inside & (start == end), given).when(inside, let(ends, wide))


def in_source(found: Column, mapped: Column) -> Column:
    """Rewrites or diagnostics of ``convert`` on the composed text, their ranges put into the source's."""

    def one(x: Column) -> Column:
        return let(source_span(mapped, x["start"], x["end"]), lambda s: x.withField("start", s["start"]).withField("end", s["end"]))

    return F.transform(found, one)
