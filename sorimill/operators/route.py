"""Routing of spoken text: which parts are read, spelled by letter names, or left alone.

A text is cut into segments that cover it: protected structure, numbers and whatever
letters are glued to them, Latin words, Han, scripts without a reading, and the rest,
which is Korean. Segments that stay as written are walls to the sound rules; what a
reader should know about them is a report.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.hangul import HAN
from ..functions.numbers import let, spell_letters
from . import normalize as n


@cache
def numeric_han() -> str:
    """Han characters that are numerals, as a class of a pattern."""
    blocks = [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F), (0x30000, 0x323AF)]
    found = [c for a, b in blocks for c in range(a, min(b, sys.maxunicode) + 1) if unicodedata.numeric(chr(c), None) is not None]
    return "".join(f"\\x{{{c:X}}}" for c in found)


_HANGUL = r"가-힣\x{1100}-\x{11FF}"
_NUMBER = rf"[\p{{N}}&&[^{HAN}]]"
#: Characters that hold a structure together.
_STRUCTURE = rf"[.#_'’+\-A-Za-z{_HANGUL}{HAN}{_NUMBER}]"
_FOREIGN = rf"[\p{{L}}&&[^A-Za-z{_HANGUL}{HAN}]]"
_WORD = r"(?<![A-Za-z0-9])[A-Za-z](?:[A-Za-z0-9]|[._'’\-](?=[A-Za-z0-9]))*+(?:[+#]+(?![A-Za-z0-9]))?"
_LETTERS = r"^[A-Za-z'’]+$"
_UNSAFE = r"[\p{Cc}\p{Cf}\p{Co}\p{Cn}&&[^\t\r\n]]"
_EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]"
#: What may stand in the output beside letters and numbers.
_NEUTRAL = r" \t\r\n!-/:-@\[-`{-~。？！、・"
_ISSUES = {
    "unsupported_character": _UNSAFE,
    "unsupported_emoji": _EMOJI,
    "unsupported_symbol": rf"[^{_NEUTRAL}{_HANGUL}\x{{3130}}-\x{{318F}}\x{{A960}}-\x{{A97C}}\x{{D7B0}}-\x{{D7FB}}\p{{L}}\p{{N}}{_UNSAFE}{_EMOJI}]",
}

SEGMENT = "struct<text:string,out:string,handler:string,reason:string,rule_id:string,wall:boolean,reports:array<struct<start:int,end:int,code:string,rule_id:string>>>"
_REPORTS = "array<struct<start:int,end:int,code:string,rule_id:string>>"


def _marked(text: Column, pattern: str) -> Column:
    """Pieces of a text; those at odd places match the pattern."""
    return F.split(F.regexp_replace(text, pattern, f"{n.OPEN}$0{n.CLOSE}"), f"[{n.OPEN}{n.CLOSE}]")


def _segment(text: Column, handler: str, reason, rule: Column | None, wall, out: Column | None = None, reports: Column | None = None) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, (str, bool)) else x
    return F.struct(
        text.alias("text"),
        (text if out is None else out).alias("out"),
        F.lit(handler).alias("handler"),
        lit(reason).alias("reason"),
        (F.lit(None).cast("string") if rule is None else rule).alias("rule_id"),
        lit(wall).alias("wall"),
        (F.expr(f"cast(array() as {_REPORTS})") if reports is None else reports.cast(_REPORTS)).alias("reports"),
    ).cast(SEGMENT)


def _whole(text: Column, code: str, rule: str) -> Column:
    return F.array(F.struct(F.lit(0).alias("start"), F.length(n.unguarded(text)).alias("end"), F.lit(code).alias("code"), F.lit(rule).alias("rule_id")))


def _runs(text: Column, pattern: str, report) -> Column:
    """Reports on the runs of a pattern in a text; ``report`` gives (code, rule) of a run, null for none."""

    def of(pieces: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            code, rule = report(p)
            end = acc["at"] + F.length(n.unguarded(p))
            own = F.array(F.struct(acc["at"].alias("start"), end.alias("end"), code.alias("code"), rule.alias("rule_id")))
            empty = F.expr(f"cast(array() as {_REPORTS})")
            return F.struct(end.alias("at"), (~acc["odd"]).alias("odd"), F.concat(acc["all"], F.when(acc["odd"] & code.isNotNull(), own).otherwise(empty)).cast(_REPORTS).alias("all"))

        start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), F.expr(f"cast(array() as {_REPORTS})").alias("all"))
        return F.aggregate(pieces, start, step, lambda acc: acc["all"])

    return let(_marked(text, pattern), of)


def _protected(text: Column) -> Column:
    kind = (
        F.when(F.startswith(text, F.lit("`")), "inline_code")
        .when(text.rlike("^(?i:https?)://"), "url")
        .when(F.contains(text, F.lit("@")) & ~text.rlike(r"[/\\]"), "email")
        .when(F.contains(text, F.lit("\\")), "windows_path")
        .otherwise("posix_path")
    )
    reports = _runs(text, f"{_FOREIGN}+", lambda p: (F.lit("unsupported_script"), F.lit("routing.protected_unsupported_script")))
    return let(kind, lambda k: _segment(text, "protected", F.concat(F.lit("protected_"), k), F.concat(F.lit("protected."), k), True, reports=reports))


def _numbers(text: Column) -> Column:
    return _segment(text, "numeric", "numeric_passthrough", F.lit("numeric.passthrough"), True)


def _unchanged(text: Column, validate: bool = True) -> Column:
    def issue(p: Column):
        code = F
        for name, pattern in _ISSUES.items():
            code = code.when(p.rlike(f"^{pattern}"), name)
        return code, F.lit("output.validate")

    reports = _runs(text, "|".join(f"{p}+" for p in _ISSUES.values()), issue) if validate else None
    return _segment(text, "korean", "unchanged", None, False, reports=reports)


def _glued(text: Column) -> Column:
    """Numbers and the letters around them, as one piece."""
    han = f"[{HAN}]+"

    def report(p: Column):
        latin = p.rlike("^[A-Za-z]")
        code = F.when(latin, "unconverted_latin").when(~p.rlike(f"^[{numeric_han()}]+$"), "unconverted_han")
        return code, F.when(latin, "routing.numeric_latin").otherwise("routing.numeric_han")

    some = _runs(text, f"{_WORD}|{han}", report)
    whole = _whole(text, "unconverted_latin", "routing.numeric_latin")
    reports = let(some, lambda r: F.when((F.size(r) == 0) & text.rlike("[A-Za-z]"), whole.cast(_REPORTS)).otherwise(r))
    return _segment(text, "numeric", "numeric_passthrough", F.lit("numeric.passthrough"), True, reports=reports)


def _structure(run: Column) -> Column:
    """The segments of a run of letters, numbers and what joins them."""
    numerals = f"[{numeric_han()}]"
    real = run.rlike(_NUMBER)
    han = run.rlike(f"[[{HAN}]&&[^{numeric_han()}]]")
    numbers = real | (run.rlike(numerals) & ~han)
    foreign = run.rlike(f"[A-Za-z{_HANGUL}]") | han

    def number(p: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, _numbers(p)).otherwise(_unchanged(p))

    def word(p: Column, i: Column) -> Column:
        latin = _segment(p, "english", "english_letter_names", F.lit("english.letter_names.v1"), False, out=spell_letters(p))
        odd = _segment(p, "english", "structural_latin_token", None, True, reports=_whole(p, "unconverted_latin", "routing.latin"))
        kept = _segment(p, "korean", "ambiguous_han", None, True, reports=_whole(p, "unconverted_han", "routing.ambiguous_han"))
        of_match = F.when(p.rlike(_LETTERS), latin).when(p.rlike("^[A-Za-z]"), odd).when(p.rlike(f"^{numerals}+$"), _numbers(p)).otherwise(kept)
        return F.when(i % 2 == 1, of_match).otherwise(_unchanged(p))

    only_numbers = F.transform(_marked(run, f"[{numeric_han()}{_NUMBER}]+"), number)
    words = F.transform(_marked(run, f"{_WORD}|[{HAN}]+"), word)
    return F.when(~real & ~run.rlike(f"[A-Za-z{HAN}]"), F.array(_unchanged(run))).when(numbers & foreign, F.array(_glued(run))).when(numbers, only_numbers).otherwise(words)


def segments(text: Column) -> Column:
    """The segments of a text without marks, in order: (text, out, handler, reason, rule_id, wall, reports).

    ``out`` is what is pronounced; ranges of reports are code points of the segment.
    """

    def piece(x: Column, i: Column) -> Column:
        marked = _marked(F.translate(x, n.g.HIDDEN, ""), f"{_STRUCTURE}+|{_FOREIGN}+")

        def one(p: Column, j: Column) -> Column:
            foreign = _segment(p, "korean", "unsupported_script", None, True, reports=_whole(p, "unsupported_script", "routing.unsupported_script"))
            found = F.when(p.rlike(f"^{_FOREIGN}"), F.array(foreign)).otherwise(_structure(p))
            return F.when(j % 2 == 1, found).otherwise(F.array(_unchanged(p)))

        return F.when(i % 2 == 1, F.array(_protected(x))).otherwise(F.flatten(F.transform(marked, one)))

    return F.filter(F.flatten(F.transform(n.protected(text), piece)), lambda s: s["text"] != "")


def walled_text(text: Column) -> Column:
    """What is pronounced of a text without marks, walls between marks of their own."""
    wall = lambda s: F.concat(F.lit(n.WALL), s["out"], F.lit(n.UNWALL))
    return F.array_join(F.transform(segments(text), lambda s: F.when(s["wall"], wall(s)).otherwise(s["out"])), "")
