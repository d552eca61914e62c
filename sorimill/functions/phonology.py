"""Surface pronunciation as one lookup for each pair of neighbouring syllables.

A syllable's coda and the next one's onset change only by (coda, next onset,
class of the next vowel, whether a blank stands between). The table of all
these, 28 x 20 x 3 x 2 entries, is computed here from the rules, in their order,
and put into the plan as one string. Column expressions look it up; no rows are
shuffled or exploded.

Some pairs depend on the class of the word. An analyzer's tokens may be passed in
as a column; then two more tables serve, for pairs of the class in question and
for others. Without tokens, or where they don't fit the text, such pairs stay.

What stands between WALL and UNWALL is no part of any pair and stays as it is.
``rewrites`` lists every change of a rule, ``candidates`` what only word classes, or
the lexicon, could decide. Both come from a table of the states between the rules.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as t
from .hangul import compose
from .numbers import let

NONE = len(t.ONSETS)  # no syllable follows
WALL, UNWALL = "\ufdd3\ufdd4"
_STOPS = "ㄱㄷㅅㅈ"


def _held(coda: str, onset: str, space: bool) -> bool:
    """Pairs whose reading depends on the word's class; without analysis they stay as written."""
    if space:
        return coda == "ㄹ" and onset in "ㄱㄷㅂㅅㅈ"
    return coda == "ㄺ" and onset == "ㄱ" or coda in "ㄴㄵㅁㄻㄼㄾ" and onset in _STOPS


#: What is known of the word's class: nothing, that it isn't the one in question, that it is.
HELD, FREE, TENSED = "held", "free", "tensed"


def pair(coda: str, onset: str, vowel: str, space: bool, word: str = HELD, steps: list | None = None) -> tuple[str, str, list[str]]:
    """(coda, onset, rules) of a pair; ``onset`` is empty at the end of a run.

    The state after each rule, (rule, coda, onset), is added to ``steps``.
    """
    rules: list[str] = []

    def to(c: str, o: str, rule: str) -> None:
        nonlocal coda, onset
        coda, onset = c, o
        rules.append(rule)
        if steps is not None:
            steps.append((rule, c, o))

    if coda == " ":
        return coda, onset, rules
    if word != FREE and onset and _held(coda, onset, space):
        if word == TENSED:
            article = "ko.modifier.tensing.27" if space else "ko.stem.rieul_giyeok" if coda == "ㄺ" else "ko.stem.tensing.25" if coda in "ㄼㄾ" else "ko.stem.tensing.24"
            to({"ㄵ": "ㄴ", "ㄻ": "ㅁ", "ㄺ": "ㄹ", "ㄼ": "ㄹ", "ㄾ": "ㄹ"}.get(coda, coda), t.TENSE[onset], article)
        return coda, onset, rules
    tight = bool(onset) and not space
    if tight and coda in "ㄷㅌㄾ" and onset == "ㅇ" and vowel in "ㅣㅕ":
        to("ㄹ" if coda == "ㄾ" else " ", "ㅈ" if coda == "ㄷ" else "ㅊ", "ko.palatalization")
    elif tight and coda == "ㄷ" and onset == "ㅎ" and vowel == "ㅣ":
        to(" ", "ㅊ", "ko.palatalization")
    if onset and coda in t.H_CODAS:
        left = t.H_CODAS[coda]
        if onset in t.ASPIRATED:
            to(left, t.ASPIRATED[onset], "ko.hieuh.consonant")
        elif onset == "ㅅ":
            to(left, "ㅆ", "ko.hieuh.consonant")
        elif onset == "ㄴ":
            to("ㄴ" if coda == "ㅎ" else left, "ㄴ", "ko.hieuh.consonant")
    elif onset == "ㅎ" and coda in t.H_MERGERS:
        to(*t.H_MERGERS[coda], "ko.hieuh.consonant")
    if tight and coda in t.H_CODAS and onset == "ㅇ":
        left = t.H_CODAS[coda]
        to(" ", "ㅇ" if left == " " else left, "ko.hieuh.vowel")
    if tight and onset == "ㅇ" and coda not in " ㅇ":
        if coda in t.CLUSTER_LIAISON:
            to(*t.CLUSTER_LIAISON[coda], "ko.liaison.cluster")
        else:
            to(" ", coda, "ko.liaison.single")
    if coda in t.CODA_SOUNDS and not (tight and onset == "ㅇ"):
        article = "9" if coda in "ㄲㅋㅅㅆㅈㅊㅌㅎㅍ" else "11" if coda in "ㄺㄻㄿㅀ" else "10"
        to(t.CODA_SOUNDS[coda], onset, f"ko.coda.{article}")
    if onset == "ㄹ" and coda == "ㄴ":
        to("ㄹ", "ㄹ", "ko.liquid.20")
    elif onset == "ㄴ" and coda == "ㄹ":
        to("ㄹ", "ㄹ", "ko.liquid.20")
    elif onset == "ㄹ" and coda in "ㄱㅂㅁㅇ":
        to(t.NASAL.get(coda, coda), "ㄴ", "ko.liquid.19")
    if coda in t.NASAL and onset and onset in "ㄴㅁ":
        to(t.NASAL[coda], onset, "ko.nasalization")
    if coda in "ㄱㄷㅂ" and onset in t.TENSE:
        to(coda, t.TENSE[onset], "ko.tensification")
    return coda, onset, rules


@cache
def table(word: str = HELD) -> str:
    """Two characters for each entry: the new coda and onset, as offsets from '0'."""
    out = []
    for coda in t.CODAS:
        for onset in (*t.ONSETS, ""):
            for vowel in "ㅣㅕㅏ":
                for space in (False, True):
                    c, o, _ = pair(coda, onset, vowel, space, word)
                    out.append(chr(48 + t.CODAS.index(c)) + chr(48 + (t.ONSETS.index(o) if o else NONE)))
    return "".join(out)


#: Rules in the order in which they run. The first three change a vowel.
VOWEL_RULES = ["ko.vowel.jyeo", "ko.vowel.consonant_ui", "ko.ui.particle"]
PASSES = [
    ["ko.stem.rieul_giyeok", "ko.stem.tensing.24", "ko.stem.tensing.25", "ko.modifier.tensing.27"],
    ["ko.palatalization"],
    ["ko.hieuh.consonant"],
    ["ko.hieuh.vowel"],
    ["ko.n_insertion.numeral"],
    ["ko.liaison.single", "ko.liaison.cluster"],
    ["ko.coda.9", "ko.coda.10", "ko.coda.11"],
    ["ko.liquid.19", "ko.liquid.20"],
    ["ko.nasalization"],
    ["ko.tensification"],
]
RULES = [r for rules in PASSES for r in rules]
#: Of the standard's article for each rule.
ARTICLES = {
    "ko.vowel.jyeo": "5.1", "ko.vowel.consonant_ui": "5.3", "ko.ui.particle": "5.4.2", "ko.stem.rieul_giyeok": "11.1", "ko.stem.tensing.24": "24",
    "ko.stem.tensing.25": "25", "ko.modifier.tensing.27": "27", "ko.palatalization": "17", "ko.hieuh.consonant": "12", "ko.hieuh.vowel": "12.4",
    "ko.n_insertion.numeral": "29", "ko.liaison.single": "13", "ko.liaison.cluster": "14", "ko.coda.9": "9", "ko.coda.10": "10", "ko.coda.11": "11",
    "ko.liquid.19": "19", "ko.liquid.20": "20", "ko.nasalization": "18", "ko.tensification": "23", "ko.lexical.balb_neolb": "10.1", "ko.liaison.lexical": "15",
}
_STEP = 3 * len(PASSES)


def _states(coda: str, onset: str, vowel: str, space: bool, word: str, inserted: bool = False) -> str:
    """For each pass three characters: the coda and onset behind it and the rule that ran, 0 for none."""
    steps: list = []
    pair(coda, "ㄴ" if inserted else onset, vowel, space, word, steps)
    done = {next(i for i, rules in enumerate(PASSES) if r in rules): (r, c, o) for r, c, o in steps}
    if inserted:
        done[4] = ("ko.n_insertion.numeral", coda, "ㄴ")
    out, now = [], (coda, onset)
    for i in range(len(PASSES)):
        rule = 0
        if i in done:
            now, rule = done[i][1:], RULES.index(done[i][0]) + 1
        out.append(chr(48 + t.CODAS.index(now[0])) + chr(48 + (t.ONSETS.index(now[1]) if now[1] else NONE)) + chr(48 + rule))
    return "".join(out)


@cache
def states_table(word: str = HELD) -> str:
    """``_states`` of every entry of ``table``, then, for each coda, of a pair that takes ㄴ in between."""
    every = [_states(c, o, v, s, word) for c in t.CODAS for o in (*t.ONSETS, "") for v in "ㅣㅕㅏ" for s in (False, True)]
    return "".join(every + [_states(c, "ㅇ", "ㅏ", False, word, inserted=True) for c in t.CODAS])


_YEO, _EO, _UI, _I = (t.VOWELS.index(v) for v in "ㅕㅓㅢㅣ")
_IEUNG, _NIEUN = t.ONSETS.index("ㅇ"), t.ONSETS.index("ㄴ")
_AFFRICATES = [t.ONSETS.index(o) for o in "ㅈㅉㅊ"]


#: What a token says of the code points at its ends.
_ENDING, _STEM, _MODIFIER, _PARTICLE = 1, 2, 4, 8
#: Nothing is known of any; this one stands behind a wall.
_WALLED = 16
_E = t.VOWELS.index("ㅔ")


def fits(text: Column, tokens: Column) -> Column:
    """Whether tokens (form, tag, start, end) are in order, apart and as the text has them."""

    def one(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(tokens, i - 1)["end"]).otherwise(0)
        same = F.substring(text, x["start"] + 1, x["end"] - x["start"]) == x["form"]
        return F.coalesce((x["start"] >= before) & (x["start"] < x["end"]) & (x["end"] <= F.length(text)) & (x["tag"] != "") & same, F.lit(False))

    return F.coalesce(F.forall(F.transform(tokens, one), lambda ok: ok), F.lit(False))


def _flags(text: Column, tokens: Column) -> Column:
    """One character for each of the text's: the sum of what tokens say of it, from '0' on."""

    def is_a(x: Column, prefix: str) -> Column:
        return F.exists(F.split(x["tag"], "[+]"), lambda part: F.startswith(part, F.lit(prefix)))

    def bit(yes: Column, value: int) -> Column:
        return F.when(yes, value).otherwise(0)

    def sign(value: Column) -> Column:
        return F.substring(F.lit("0123456789:;<=>?"), value + 1, F.lit(1))  # '0' and up

    def piece(x: Column, i: Column) -> Column:
        gap = x["start"] - F.when(i > 0, F.get(tokens, i - 1)["end"]).otherwise(0)
        n = x["end"] - x["start"]
        first, last = bit(is_a(x, "E"), _ENDING), bit(is_a(x, "V"), _STEM) + bit(is_a(x, "ETM"), _MODIFIER)
        signs = F.when(n == 1, sign(first + last + bit(is_a(x, "J"), _PARTICLE))).otherwise(F.concat(sign(first), F.repeat(F.lit("0"), n - 2), sign(last)))
        return F.concat(F.repeat(F.lit("0"), gap), signs)

    return F.rpad(F.array_join(F.transform(tokens, piece), ""), F.length(text), "0")


def pronounce(text: Column, tokens: Column | None = None) -> Column:
    """Standard pronunciation of a text; other characters than syllables are walls.

    ``tokens``: an analyzer's array of (form, tag, start, end) in code points of the
    text, end exclusive. If null or at odds with the text it counts as missing.
    """
    if tokens is None:
        return _written(F.regexp_extract_all(text, F.lit(f"{WALL}[^{UNWALL}]*{UNWALL}|[가-힣] *|(?s:.)"), F.lit(0)), F.lit(False), False)
    flags = F.when(fits(text, tokens), _flags(text, tokens))
    return let(F.struct(text.alias("text"), flags.alias("flags")), lambda x: pronounce_flagged(x["text"], x["flags"]))


def _flagged_units(text: Column, flags: Column) -> Column:
    pairs = F.zip_with(F.split(text, ""), F.split(flags, ""), lambda c, f: F.concat(f, c))
    return F.regexp_extract_all(F.array_join(pairs, ""), F.lit("(?:[@-_](?s:.))+|[0-?][가-힣](?:[0-?] )*|[0-?](?s:.)"), F.lit(0))


def walled(flags: Column, walls: Column) -> Column:
    """Flags with those of walls set: ``walls`` has "1" for each character that stands behind one."""
    marked = F.zip_with(F.split(flags, ""), F.split(walls, ""), lambda f, w: F.when(w == "1", "@").otherwise(f))
    return F.when(flags == "", flags).otherwise(F.array_join(marked, ""))


def flags_of(text: Column, tokens: Column | None) -> Column:
    """(flags, known) of a text: one character for each of its; known if the tokens fit."""
    nothing = F.repeat(F.lit("0"), F.length(text))
    if tokens is None:
        return F.struct(nothing.alias("flags"), F.lit(False).alias("known"))
    ok = fits(text, tokens)
    return F.struct(F.when(ok, _flags(text, tokens)).otherwise(nothing).alias("flags"), ok.alias("known"))


def pronounce_flagged(text: Column, flags: Column, known: Column | None = None) -> Column:
    """Pronunciation by flags, null flags standing for none; ``known`` says that they come from tokens."""
    known = flags.isNotNull() if known is None else known
    given = F.coalesce(flags, F.repeat(F.lit("0"), F.length(text)))
    return F.when(text == "", text).when(text.isNotNull(), _written(_flagged_units(text, given), known, True))


def _syllables(units: Column, marked: bool) -> Column:
    """Units, each a syllable with the blanks behind it or something else, as (o, v, c, s, u, x, f, w).

    Onset, vowel, coda, whether blanks follow, the text, its first character, its flag, the vowel as
    written. Marked ones have a flag in front of each character.
    """

    def syllable(u: Column, i: Column) -> Column:
        flag = F.ascii(u) - 48 if marked else F.lit(0)
        if marked:
            u = F.when(u.rlike("^[@-_]"), F.regexp_replace(u, "(?s)[@-_](.)", "$1")).otherwise(F.concat(F.substring(u, 2, 1), F.repeat(F.lit(" "), F.floor(F.length(u) / 2).cast("int") - 1)))
        at = F.ascii(u) - 0xAC00
        own = F.substring(u, 1, 1).between("가", "힣") & (flag < _WALLED)
        onset, vowel, coda = F.floor(at / 588), F.floor(F.pmod(at, F.lit(588)) / 28), F.pmod(at, F.lit(28))
        said = F.when((vowel == _YEO) & onset.isin(_AFFRICATES), _EO).when((vowel == _UI) & (onset != _IEUNG), _I).otherwise(vowel)
        return F.struct(
            F.when(own, onset).cast("int").alias("o"),
            said.cast("int").alias("v"),
            coda.cast("int").alias("c"),
            F.endswith(u, F.lit(" ")).alias("s"),
            u.alias("u"),
            F.when(own | (flag < _WALLED), F.substring(u, 1, 1)).otherwise("").alias("x"),
            flag.alias("f"),
            vowel.cast("int").alias("w"),
        )

    return F.transform(units, syllable)


def _deferred(sylls: Column) -> Column:
    """For each syllable 1 if the lexicon would have to decide it, 2 if the next one with it, else 0."""

    def one(a: Column, i: Column) -> Column:
        b, after = F.get(sylls, i + 1), F.get(sylls, i + 2)
        follows = b["o"].isNotNull()
        near = follows & ~a["s"]
        trample = F.when(~follows | a["s"], 1).when(b["o"] != _IEUNG, 2).otherwise(0)
        wide = near & ((b["x"] == "죽") | ((b["x"] == "둥") & (after["x"] == "글") & ~b["s"]))
        return F.coalesce(F.when(a["o"].isNull(), 0).when(a["x"] == "밟", trample).when((a["x"] == "넓") & wide, 2), F.lit(0))

    return F.transform(sylls, one)


def _place(sylls: Column, a: Column, i: Column) -> Column:
    """(at, inserted, free) of a syllable with the next: the entry of the table, whether ㄴ comes in between,
    and whether the next one follows as a neighbour."""
    b, after = F.get(sylls, i + 1), F.get(sylls, i + 2)
    six = (b["x"] == "육") & a["x"].isin(*t.SINO_BEFORE_SIX)
    yeo = (b["x"] == "여") & a["x"].isin(*t.NATIVE_BEFORE_YEO) & ~b["s"] & after["x"].isin("섯", "덟")
    inserted = ~a["s"] & (F.coalesce(six, F.lit(False)) | F.coalesce(yeo, F.lit(False)))
    onset = F.when(inserted, _NIEUN).otherwise(F.coalesce(b["o"], F.lit(NONE)))
    kind = F.when(b["v"] == _I, 0).when(b["v"] == _YEO, 1).otherwise(2)
    # a wall behind blanks ends the run like the end of the text
    at = ((a["c"] * (NONE + 1) + onset) * 3 + kind) * 2 + F.when(a["s"] & b["o"].isNotNull(), 1).otherwise(0)
    return F.struct(at.alias("at"), inserted.alias("inserted"))


def _tensed(a: Column, b: Column) -> Column:
    stem = ~a["s"] & (a["f"].bitwiseAND(_STEM) > 0) & (b["f"].bitwiseAND(_ENDING) > 0)
    return F.coalesce(stem | (a["s"] & (a["f"].bitwiseAND(_MODIFIER) > 0)), F.lit(False))


def _free(sylls: Column, later: Column, i: Column) -> Column:
    """``not _blocked``; a neighbour counts only if it is a syllable."""
    alone = F.get(sylls, i + 1)["o"].isNull()
    mine = (F.get(later, i) > 0) | F.coalesce(F.get(later, F.when(i > 0, i - 1)) == 2, F.lit(False))
    return ~(mine | F.when(alone, False).otherwise(F.coalesce(F.get(later, i + 1) > 0, F.lit(False))))


def _particle(sylls: Column, a: Column, i: Column) -> Column:
    """Whether a syllable may be the particle 의: directly behind another one."""
    last = F.when(i > 0, F.get(sylls, i - 1))
    return F.coalesce((a["x"] == "의") & a["o"].isNotNull() & last["o"].isNotNull() & ~last["s"], F.lit(False))


def _written(units: Column, known: Column, marked: bool) -> Column:
    """The pronunciation of units; ``known``: their flags come from an analyzer's tokens."""

    def meet(sylls: Column) -> Column:
        return let(_deferred(sylls), lambda later: after_pairs(sylls, later))

    def after_pairs(sylls: Column, later: Column) -> Column:
        def one(a: Column, i: Column) -> Column:
            def read(place: Column) -> Column:
                pick = lambda name: F.substring(F.lit(table(name)), place["at"] * 2 + 1, F.lit(2))
                code = pick(HELD)
                if marked:
                    code = F.when(~known, pick(HELD)).when(_tensed(a, F.get(sylls, i + 1)), pick(TENSED)).otherwise(pick(FREE))
                return let(code, lambda x: F.struct((F.ascii(F.substring(x, 1, 1)) - 48).alias("c"), (F.ascii(F.substring(x, 2, 1)) - 48).alias("o")))

            return F.when(a["o"].isNotNull() & _free(sylls, later, i), let(_place(sylls, a, i), read))

        def write(changed: Column) -> Column:
            def each(a: Column, i: Column) -> Column:
                before = F.when(i > 0, F.get(changed, i - 1)["o"])
                onset = F.when(before < NONE, before).otherwise(a["o"])
                coda = F.coalesce(F.get(changed, i)["c"], a["c"])
                blanks = F.substring(a["u"], F.lit(2), F.length(a["u"]))
                vowel = a["v"]
                if marked:
                    vowel = F.when(known & _particle(sylls, a, i) & (a["f"].bitwiseAND(_PARTICLE) > 0), _E).otherwise(vowel)
                return F.when(a["o"].isNull(), a["u"]).otherwise(F.concat(compose(onset, vowel, coda), blanks))

            return F.array_join(F.transform(sylls, each), "")

        return let(F.transform(sylls, one), write)

    return let(_syllables(units, marked), meet)


def rewrites(text: Column, flags: Column, known: Column) -> Column:
    """Array of (rule_id, start, end, before, after): what each rule changed, in the order in which they run.

    Ranges are code points of the text, from the first to behind the last syllable concerned.
    """
    n_vowels, n = len(VOWEL_RULES), len(PASSES)
    empty = F.expr("cast(array() as array<struct<pass:int,i:int,rule_id:string,start:int,end:int,before:string,after:string>>)")

    def meet(sylls: Column) -> Column:
        sizes = F.transform(sylls, lambda a: F.length(a["u"]))
        starts = F.aggregate(
            sizes,
            F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all")),
            lambda acc, k: F.struct((acc["at"] + k).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
            lambda acc: acc["all"],
        )
        return let(F.struct(_deferred(sylls).alias("later"), starts.alias("at")), lambda z: of(sylls, z["later"], z["at"]))

    def of(sylls: Column, later: Column, at: Column) -> Column:
        def code(a: Column, i: Column) -> Column:
            def read(place: Column) -> Column:
                entry = F.when(place["inserted"], F.lit(28 * (NONE + 1) * 6) + a["c"]).otherwise(place["at"])
                pick = lambda name: F.substring(F.lit(states_table(name)), entry * _STEP + 1, F.lit(_STEP))
                return F.when(~known, pick(HELD)).when(_tensed(a, F.get(sylls, i + 1)), pick(TENSED)).otherwise(pick(FREE))

            return F.when(a["o"].isNotNull() & _free(sylls, later, i), let(_place(sylls, a, i), read))

        def listed(codes: Column) -> Column:
            def state(i: Column, p: Column, which: int, otherwise: Column) -> Column:
                """Coda (0), onset of the next (1) or rule (2) of pair i behind pass p, counted from 1."""
                own = F.when(i >= 0, F.get(codes, i))
                value = F.ascii(F.substring(own, (p - 1) * 3 + 1 + which, F.lit(1))) - 48
                return F.when((p < 1) | own.isNull(), otherwise).otherwise(value)

            def vowel_of(i: Column) -> Column:
                a = F.get(sylls, i)
                return F.when(known & _particle(sylls, a, i) & (a["f"].bitwiseAND(_PARTICLE) > 0), _E).otherwise(a["v"])

            def syllable(i: Column, left: Column, coda: Column) -> Column:
                return compose(F.when(left < NONE, left).otherwise(F.get(sylls, i)["o"]), vowel_of(i), coda)

            def of_unit(a: Column, i: Column) -> Column:
                b = F.get(sylls, i + 1)
                row = lambda p, rule, end, before, after: F.struct(
                    p.cast("int").alias("pass"), i.cast("int").alias("i"), rule.alias("rule_id"), F.get(at, i).alias("start"), end.cast("int").alias("end"), before.alias("before"), after.alias("after")
                )
                first = F.substring(a["u"], 1, 1)
                changed = compose(a["o"], vowel_of(i), a["c"])
                kind = F.when(a["v"] != vowel_of(i), 2).when(a["v"] == _EO, 0).otherwise(1)
                vowel = F.when(
                    a["w"] != vowel_of(i), F.array(row(kind, F.get(F.array(*[F.lit(r) for r in VOWEL_RULES]), kind), F.get(at, i) + 1, first, changed))
                ).otherwise(empty)

                def at_pass(p: Column) -> Column:
                    rule = state(i, p, 2, F.lit(0))
                    follows = b["o"].isNotNull()
                    blanks = F.substring(a["u"], F.lit(2), F.length(a["u"]))

                    def both(q: Column) -> Column:
                        """The pair's text when this pass has run on those before it, and on this one if q is p."""
                        left = syllable(i, state(i - 1, p, 1, a["o"]), state(i, q, 0, a["c"]))
                        right = syllable(i + 1, state(i, q, 1, b["o"]), state(i + 1, p - 1, 0, b["c"]))
                        return F.when(follows, F.concat(left, blanks, right)).otherwise(left)

                    end = F.when(follows, F.get(at, i + 1) + 1).otherwise(F.get(at, i) + 1)
                    name = F.get(F.array(*[F.lit(r) for r in RULES]), rule - 1)
                    return F.when(rule > 0, row(p + n_vowels, name, end, both(p - 1), both(p)))

                passes = F.filter(F.transform(F.sequence(F.lit(1), F.lit(n)), at_pass), lambda r: r.isNotNull() & (r["before"] != r["after"]))
                return F.when(a["o"].isNull(), empty).otherwise(F.concat(vowel, passes))

            found = F.array_sort(F.flatten(F.transform(sylls, of_unit)))
            return F.transform(found, lambda r: F.struct(*[r[f].alias(f) for f in ("rule_id", "start", "end", "before", "after")]))

        return let(F.transform(sylls, code), listed)

    return F.when(text == "", F.expr("cast(array() as array<struct<rule_id:string,start:int,end:int,before:string,after:string>>)")).otherwise(
        let(_syllables(_flagged_units(text, flags), True), meet)
    )


def candidates(text: Column, flags: Column) -> Column:
    """Array of (rule_id, start, end, lexical): what needs word classes or, if lexical, a lexicon."""
    schema = "cast(array() as array<struct<rule_id:string,start:int,end:int,lexical:boolean>>)"

    def meet(sylls: Column) -> Column:
        starts = F.aggregate(
            sylls,
            F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all")),
            lambda acc, a: F.struct((acc["at"] + F.length(a["u"])).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
            lambda acc: acc["all"],
        )
        return let(F.struct(_deferred(sylls).alias("later"), starts.alias("at")), lambda z: of(sylls, z["later"], z["at"]))

    def of(sylls: Column, later: Column, at: Column) -> Column:
        def one(a: Column, i: Column) -> Column:
            b = F.get(sylls, i + 1)
            coda, onset = F.substring(F.lit(t.CODAS), a["c"] + 1, F.lit(1)), F.substring(F.lit(t.ONSETS), b["o"] + 1, F.lit(1))
            tight = ~a["s"] & onset.isin(*_STOPS)
            rule = (
                F.when(~a["s"] & (coda == "ㄺ") & (onset == "ㄱ"), "ko.stem.rieul_giyeok")
                .when(tight & coda.isin(*"ㄴㄵㅁㄻ"), "ko.stem.tensing.24")
                .when(tight & coda.isin(*"ㄼㄾ"), "ko.stem.tensing.25")
                .when(a["s"] & (coda == "ㄹ") & onset.isin(*"ㄱㄷㅂㅅㅈ"), "ko.modifier.tensing.27")
            )
            row = lambda name, to, lexical: F.struct(name.alias("rule_id"), F.get(at, i).alias("start"), (F.get(at, to) + 1).alias("end"), F.lit(lexical).alias("lexical"))
            deferred = F.get(later, i)
            found = F.array(
                F.when(_particle(sylls, a, i), row(F.lit("ko.ui.particle"), i, False)),
                F.when(deferred > 0, row(F.lit("ko.lexical.balb_neolb"), F.when(deferred == 2, i + 1).otherwise(i), True)),
                F.when((deferred == 0) & rule.isNotNull() & b["o"].isNotNull(), row(rule, i + 1, False)),
            )
            return F.when(a["o"].isNull(), F.expr(schema)).otherwise(F.filter(found, lambda r: r.isNotNull()))

        return F.flatten(F.transform(sylls, one))

    return F.when(text == "", F.expr(schema)).otherwise(let(_syllables(_flagged_units(text, flags), True), meet))
