"""Syllables: code-point arithmetic and character classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as t

FIRST, LAST = 0xAC00, 0xD7A3
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}\x{30000}-\x{3134F}"


def is_syllable(c: Column) -> Column:
    return c.between("가", "힣") & (F.length(c) == 1)


def decompose(c: Column) -> Column:
    """Indexes (onset, vowel, coda) of a syllable; null for other characters."""
    at = F.ascii(c) - FIRST
    parts = F.struct(
        F.floor(at / 588).cast("int").alias("onset"), F.floor(F.pmod(at, F.lit(588)) / 28).cast("int").alias("vowel"), F.pmod(at, F.lit(28)).cast("int").alias("coda")
    )
    return F.when(is_syllable(c), parts)


def compose(onset: Column, vowel: Column, coda: Column) -> Column:
    code = F.lit(FIRST) + onset * 588 + vowel * 28 + coda
    return F.decode(F.unhex(F.hex(code.cast("long"))), "UTF-16BE")


def letters(c: Column) -> Column:
    """The letters of a syllable as (onset, vowel, coda) strings; no coda is empty."""
    d = decompose(c)
    pick = lambda s, i: F.substring(F.lit(s), i + 1, F.lit(1))
    return F.when(
        d.isNotNull(), F.struct(pick(t.ONSETS, d["onset"]).alias("onset"), pick(t.VOWELS, d["vowel"]).alias("vowel"), F.trim(pick(t.CODAS, d["coda"])).alias("coda"))
    )


def character_kind(c: Column) -> Column:
    """LATIN, NUMBER, STRUCTURAL, HANGUL, HAN, UNSUPPORTED or OTHER; Han goes before number."""
    return (
        F.when(c.rlike(f"^[{HAN}]$"), "HAN")
        .when(c.rlike("^[A-Za-z]$"), "LATIN")
        .when(c.rlike(r"^\p{N}$"), "NUMBER")
        .when(c.rlike(r"^[._:/@#%+\-]$"), "STRUCTURAL")
        .when(c.rlike(r"^[가-힣ㄱ-ㆎ]$"), "HANGUL")
        .when(c.rlike(r"^[\p{L}\p{M}]$"), "UNSUPPORTED")
        .otherwise("OTHER")
    )


def is_plain_korean(text: Column) -> Column:
    """Syllables, white space and punctuation only: nothing to convert or report."""
    return ~text.rlike(r"[^가-힣\s\p{Z}\p{P}\x{85}]|[%％]")
