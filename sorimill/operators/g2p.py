"""Graphemes to phonemes: normalized text, then its surface pronunciation.

Latin words become letter names and take part in the sound rules; protected
structure, numbers that stay as written and other scripts are walls between runs.

Defined cases: null stays null, empty text stays empty; an analyzer's tokens that are
null or don't fit the text count as missing, and rules that need them are not applied.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import phonology
from ..functions.composed import nfc, nfc_mapped, source_span
from ..functions.numbers import let
from . import route
from .normalize import GROWTH, MAX_LENGTH, UNWALL, WALL, _key, _once, checked, guarded, positive, unguarded
from .normalize import normalize as spoken_form

_SPANS = "array<struct<start:int,end:int>>"
_DIAGNOSTIC = "struct<start:int,end:int,code:string,rule_id:string,severity:string,stage:string>"


def g2p(
    text: Column,
    normalize: bool = True,
    max_length: int = MAX_LENGTH,
    *,
    lexicon: Mapping[str, str] | None = None,
    analysis: Column | None = None,
) -> Column:
    """Surface pronunciation of a text; with normalize=False numbers stay as they are.

    ``lexicon`` belongs to the normalizer; ``analysis``: an analyzer's tokens of the
    text that is pronounced (``g2p_detail``'s normalized_text).
    """
    if not isinstance(normalize, bool):
        raise ValueError("normalize must be True or False")
    positive("max_length", max_length)

    def sounded(x: Column) -> Column:
        if analysis is None:
            return F.when(x.isNotNull(), unguarded(F.translate(phonology.pronounce(route.walled_text(guarded(x))), WALL + UNWALL, "")))
        return F.when(x.isNotNull(), _analyzed(x, analysis))

    spoken = spoken_form(text, max_length, lexicon=lexicon) if normalize else nfc(checked(text, max_length))
    return let(spoken, sounded) if analysis is not None else _once("sounded", spoken, sounded)


def _walls(segs: Column) -> Column:
    """One character for each of the output's: 1 for those of walls, else 0."""
    return F.array_join(F.transform(segs, lambda s: F.repeat(F.when(s["wall"], "1").otherwise("0"), F.length(s["out"]))), "")


def _analyzed(text: Column, analysis: Column) -> Column:
    """The pronunciation of spoken text, with an analyzer's tokens."""

    def of(z: Column) -> Column:
        flags = phonology.flags_of(z["out"], analysis)
        return phonology.pronounce_flagged(z["out"], phonology.walled(flags["flags"], z["walls"]), flags["known"])

    plain = lambda segs: F.transform(segs, lambda s: F.struct(unguarded(s["out"]).alias("out"), s["wall"].alias("wall")))
    both = let(plain(route.segments(guarded(text))), lambda segs: F.struct(F.array_join(F.transform(segs, lambda s: s["out"]), "").alias("out"), _walls(segs).alias("walls")))
    return let(both, of)


def g2p_detail(text: Column, max_length: int = GROWTH * MAX_LENGTH, analysis: Column | None = None) -> Column:
    """(source, normalized_text, surface_pronunciation, segments, rewrites, diagnostics, complete) of spoken text.

    Ranges are code points of the source. ``analysis``: an analyzer's tokens of normalized_text.
    """

    def build(source: Column) -> Column:
        both = F.struct(source.alias("source"), nfc_mapped(checked(source, max_length)).alias("m"))
        return let(both, lambda x: F.when(x["source"].isNotNull(), _detail(x["source"], x["m"], analysis)))

    return build(text) if analysis is not None else _once(_key("g2p_detail", max_length), text, build)


def _placed(found: Column) -> Column:
    """Segments with start and end in the text."""

    def step(acc: Column, s: Column) -> Column:
        end = acc["at"] + F.length(unguarded(s["text"]))
        own = F.struct(
            unguarded(s["text"]).alias("text"), unguarded(s["out"]).alias("out"), *[s[f].alias(f) for f in ("handler", "reason", "rule_id", "wall", "reports")], acc["at"].alias("start"), end.alias("end")
        )
        return F.struct(end.alias("at"), F.concat(acc["all"], F.array(own)).alias("all"))

    kind = route.SEGMENT[:-1] + ",start:int,end:int>"
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("all"))
    return F.aggregate(found, start, step, lambda acc: acc["all"])


def _detail(source: Column, mapped: Column | None, analysis: Column | None) -> Column:
    text = source if mapped is None else mapped["text"]
    place = (lambda s: s) if mapped is None else lambda s: source_span(mapped, s["start"], s["end"])

    def of(segs: Column) -> Column:
        out = F.array_join(F.transform(segs, lambda s: s["out"]), "")
        return let(F.struct(segs.alias("segs"), out.alias("out")), lambda z: done(z["segs"], z["out"], phonology.flags_of(z["out"], analysis)))

    def done(segs: Column, out: Column, f: Column) -> Column:
        # for each character of the output, the range of the text that it comes from
        origin = F.flatten(
            F.transform(
                segs,
                lambda s: F.transform(
                    F.when(F.length(s["out"]) > 0, F.sequence(F.lit(0), F.length(s["out"]) - 1)).otherwise(F.expr("cast(array() as array<int>)")),
                    lambda k: F.when(
                        F.length(s["out"]) == F.length(s["text"]), F.struct((s["start"] + k).alias("start"), (s["start"] + k + 1).alias("end"))
                    ).otherwise(F.struct(s["start"].alias("start"), s["end"].alias("end"))),
                ),
            )
        ).cast(_SPANS)
        return let(
            F.struct(phonology.walled(f["flags"], _walls(segs)).alias("flags"), f["known"].alias("known"), origin.alias("origin")),
            lambda z: result(segs, out, z["flags"], z["known"], z["origin"]),
        )

    def result(segs: Column, out: Column, flags: Column, known: Column, origin: Column) -> Column:
        def span(x: Column) -> Column:
            """The range of the text behind characters of the output, and those of each."""
            own = F.slice(origin, x["start"] + 1, x["end"] - x["start"])
            return F.struct(F.get(own, F.lit(0))["start"].alias("start"), F.get(own, F.size(own) - 1)["end"].alias("end"), F.array_distinct(F.transform(own, place)).cast(_SPANS).alias("spans"))

        def change(s: Column, spans: Column, before: Column, after: Column, rule: Column, stage: str) -> Column:
            return let(
                place(s),
                lambda p: F.struct(
                    p["start"].alias("start"), p["end"].alias("end"), spans.alias("spans"), before.alias("before"), after.alias("after"), rule.alias("rule_id"), F.lit(stage).alias("stage")
                ),
            )

        one = lambda s: F.array(place(s)).cast(_SPANS)
        named = F.transform(F.filter(segs, lambda s: s["rule_id"] == "english.letter_names.v1"), lambda s: change(s, one(s), s["text"], s["out"], s["rule_id"], "lexical"))
        sounds = F.transform(phonology.rewrites(out, flags, known), lambda r: let(span(r), lambda s: change(s, s["spans"], r["before"], r["after"], r["rule_id"], "phonology")))
        parts = [named, sounds]
        if mapped is not None:
            composed = F.transform(mapped["rewrites"], lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.array(F.struct(r["start"].alias("start"), r["end"].alias("end"))).cast(_SPANS).alias("spans"), r["before"].alias("before"), r["after"].alias("after"), F.lit("unicode.nfc").alias("rule_id"), F.lit("unicode").alias("stage")))
            parts = [composed, *parts]

        def report(s: Column, code: Column, rule: Column, stage: Column) -> Column:
            return let(place(s), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), code.alias("code"), rule.alias("rule_id"), F.lit("warning").alias("severity"), stage.alias("stage")).cast(_DIAGNOSTIC))

        routed = F.flatten(
            F.transform(
                segs,
                lambda s: F.transform(
                    s["reports"],
                    lambda r: report(
                        F.struct((s["start"] + r["start"]).alias("start"), (s["start"] + r["end"]).alias("end")),
                        r["code"],
                        r["rule_id"],
                        F.when(r["rule_id"] == "output.validate", "validation").otherwise("lexical"),
                    ),
                ),
            )
        )
        held = F.filter(phonology.candidates(out, flags), lambda c: c["lexical"] | ~known)
        missing = F.lit("analyzer_unavailable") if analysis is None else F.when(analysis.isNull(), "analyzer_unavailable").otherwise("analyzer_failed")
        skipped = F.flatten(
            F.transform(
                held,
                lambda c: let(
                    span(c),
                    lambda s: F.filter(
                        F.array(
                            F.when(~c["lexical"], report(s, missing, c["rule_id"], F.lit("phonology"))),
                            report(s, F.lit("morphology_rule_skipped"), c["rule_id"], F.lit("phonology")),
                        ),
                        lambda d: d.isNotNull(),
                    ),
                ),
            )
        )

        def order(a: Column, b: Column) -> Column:
            by = lambda x, y: F.when(x < y, -1).when(x > y, 1)
            key = lambda x: F.coalesce(x, F.lit(""))
            return F.coalesce(by(a["start"], b["start"]), by(a["code"], b["code"]), by(key(a["rule_id"]), key(b["rule_id"])), by(a["end"], b["end"]), F.lit(0))

        diagnostics = F.array_distinct(F.array_sort(F.concat(routed, skipped), order))
        shown = F.transform(
            segs,
            lambda s: let(
                place(s),
                lambda p: F.struct(
                    s["out"].alias("text"), p["start"].alias("start"), p["end"].alias("end"), s["handler"].alias("handler"), s["reason"].alias("reason"), s["rule_id"].alias("rule_id"),
                    F.when(s["wall"], "hard").when(s["handler"] == "english", "morpheme").otherwise("word").alias("boundary"),
                ),
            ),
        )
        return let(
            diagnostics,
            lambda d: F.struct(
                source.alias("source"),
                out.alias("normalized_text"),
                phonology.pronounce_flagged(out, flags, known).alias("surface_pronunciation"),
                shown.alias("segments"),
                F.concat(*parts).alias("rewrites"),
                d.alias("diagnostics"),
                (F.size(d) == 0).alias("complete"),
            ),
        )

    return let(_placed(route.segments(guarded(text))), of)
