"""The written-form grammar: what to cut out of a text, and what a piece can be.

Reading has two steps. The scan cuts out pieces: phrases, which may hold blanks,
and clusters, that is, everything glued to a digit or sign. It takes more than can
be read. Then each piece as a whole is held against the shapes, in order; the first
that fits gives its kind and its parts. What fits none, or has no certain reading,
stays as written, so nothing is ever read in part.

Both are written as templates. In a template a blank stands for blanks or none, "_"
for one or more, "[..]" for what may be missing, "(..|..)" for a choice, {name}
for a part of speech in WORDS and {part:name} for one that is kept under that name. All
else stands for itself. A line break is never inside a piece.
"""

from __future__ import annotations

import re
from functools import cache

from . import tables as t

#: Stands in front of a piece of text whose left neighbour, cut off, is a Latin letter, digit or underscore.
HIDDEN = "\ufdd6"

# Signs that carry meaning beside numbers.
ASCII_SIGNS = "^~=*<>%$"
WIDE_SIGNS = "−～∼〜–—×±÷≤≥％²³₩€£¥°℃㎡㎥μµ"
WAVES = "~〜～∼–—"
OPERATORS = "/*+<>≤≥÷="

_NUMERIC = r"[\p{N}&&[^0-9]]"
_BLANK = "[ \t]"
_SIGN = rf"[{re.escape(ASCII_SIGNS)}{WIDE_SIGNS}{_NUMERIC}]"
#: Goes on with a structure; a full stop or comma does so only in front of a letter or digit.
_GOES_ON = rf"[A-Za-z0-9_:/+\-가-힣{re.escape(ASCII_SIGNS)}{WIDE_SIGNS}{_NUMERIC}]"
#: Is glued to a number, whatever it is.
_GLUE = rf"[A-Za-z0-9_.,:/+\-{re.escape(ASCII_SIGNS)}[^\x00-\x7F\s\p{{Z}}\x{{85}}{HIDDEN}]]"

#: What must not stand in front of a piece.
LEFT = {
    "any": "",
    "letter": f"(?<![A-Za-z{HIDDEN}])",
    "digit": "(?<![0-9])",
    "word": f"(?<![A-Za-z0-9{HIDDEN}])",
    "syllable": f"(?<![A-Za-z0-9가-힣{HIDDEN}])",
    "name": f"(?<![A-Za-z0-9_{HIDDEN}])(?<![A-Za-z0-9_]\\.)",
    "dial": rf"(?<![A-Za-z0-9._/+\-{HIDDEN}])",
    "file": f"(?<![A-Za-z0-9_.{HIDDEN}-])",
    "noun": f"(?<![A-Za-z0-9_가-힣{HIDDEN}])(?<![A-Za-z0-9_]\\.)",
}
#: What must not stand behind it.
_DOTTED = r"(?!\.[A-Za-z0-9_])"
RIGHT = {
    "any": "",
    "letter": "(?![A-Za-z])",
    "word": "(?![A-Za-z0-9])",
    "syllable": "(?![A-Za-z0-9가-힣])",
    "name": rf"(?![A-Za-z0-9_]){_DOTTED}",
    "noun": rf"(?![A-Za-z0-9_가-힣]){_DOTTED}",
    "shut": rf"(?!{_GOES_ON}){_DOTTED}",
    "amount": rf"(?!(?![가-힣]){_GOES_ON})(?![.,][0-9]){_DOTTED}",
    "glue": rf"(?!{_GLUE})",
    "sum": r"(?![A-Za-z0-9._/+−-])",
    "file": "(?![A-Za-z0-9_.-])",
}


def one_of(words) -> str:
    """Any of some words, the longest first, behind a look at the first character."""
    words = t.longest_first(words)
    first = "".join(sorted({w[0] for w in words}))
    return f"(?=[{re.escape(first)}])(?:" + "|".join(map(re.escape, words)) + ")"


_LETTER = "[ㄱ-ㅎㅏ-ㅣ]"
_AMOUNT = r"[0-9]++(?:,[0-9]++)*+(?:\.[0-9]++)?+"
_NAMED = "(?:" + "|".join(re.escape(d).replace(r"\.", "[.·]") + _BLANK + "*" + e for d, e in t.HISTORY) + ")"

#: The parts of speech.
WORDS = {
    "amount": _AMOUNT,
    "number": rf"[+\-−]?{_AMOUNT}",
    "decimal": r"[+\-−]?[0-9]++(?:,[0-9]++)*+\.[0-9]++",
    "power": r"[-−]?[0-9]++",
    "long": "[0-9]{11,}",
    "digits": "[0-9]++",
    "octets": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}",
    "d2": "[0-9]{1,2}",
    "dd": "[0-9]{2}",
    "yyyy": "[0-9]{4}",
    "particle": one_of(t.PARTICLES),
    "tail": "[가-힣]*",
    "hangul": "[가-힣]+",
    "word": "[A-Za-z가-힣%％°℃㎡㎥μµ²³]+",
    "wave": f"[{WAVES}]",
    "operator": f"[{re.escape(OPERATORS)}]",
    "relation": "[<>≤≥=]",
    "between": rf"[-−{WAVES}/+*=<>≤≥±÷×]",
    "plusminus": "[×±]",
    "minus": "[-−]",
    "percent": "(?:%[pP]?|％)",
    "sign": r"[$₩€£¥]",
    "code": one_of(t.CURRENCY_CODES),
    "money": one_of(t.CURRENCY_WORDS),
    "scale": one_of(t.SCALES),
    "unit": one_of(t.ALL_UNITS),
    "wunit": one_of(t.UNIT_READINGS),
    "counter": f"(?>{one_of(t.HANGUL_UNITS)})",
    "lone": one_of(t.STANDALONE_UNITS),
    "side": one_of([*t.ALL_UNITS, "만원", "억원", "조원", "%", "%p", "%P", "％"]),
    "end": one_of([*(u for u in t.ALL_UNITS if u not in "년월일시분초"), "만원", "억원", "조원", "%", "%p", "%P", "％"]),
    "여": "여",
    "some": "[몇수]",
    "label": "(?:" + one_of(t.NUMBER_LABELS) + _BLANK + "*번호|" + one_of(t.PLAIN_LABELS) + ")",
    "code_body": rf"[0-9]++(?:(?:{_BLANK}|-)[0-9]++|{_BLANK}++[0-9]++|[가-힣](?=[0-9]{{4}})[0-9]++)*+[A-Za-z]?",
    "thing": one_of(t.NUMBERED_THINGS),
    "acronym": one_of([*t.CONVENTIONAL_READINGS, *t.INITIALISMS]),
    "mobile": r"\+82[-. ]?10[-. ]?[0-9]{3,4}[-. ][0-9]{4}",
    "landline": "0[0-9]{1,3}[-. ][0-9]{3,4}[-. ][0-9]{4}",
    "hotline": "1[568][0-9]{2}[- ][0-9]{4}",
    "dialled": r"(?:\+[0-9]{1,3}|0[0-9]{1,3})(?:[-. ][0-9]++){2,}+",
    "no_chain": "(?![-. ][0-9]{4}(?![0-9]))",
    "call": "11[29]",
    "history": _NAMED,
    "is_history": f"(?={_NAMED})",
    "day": "[0-9]{1,2}[.·][0-9]{1,2}",
    "event": _BLANK + "*" + "(?:" + "|".join(sorted({e for _, e in t.HISTORY})) + ")",
    "latin": "[A-Za-z]+",
    "possessive": "['’][A-Za-z]+",
    "ident": "[A-Za-z][A-Za-z0-9_.-]*",
    "identifier": "(?=[A-Za-z_.-]*[0-9])[A-Za-z][A-Za-z0-9_.-]*+",
    "stem": "[A-Za-z0-9_-]+",
    "extension": f"(?:{t.EXTENSIONS})",
    "hyphen": "[-‑]",
    "consonant": "[ㄱ-ㅎ]",
    "han": r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]+",
    "symbol": r"[$₩€£¥%％×±²³⁴=÷\^≤≥*<>∼]",
    "signs": rf"(?:{_SIGN}|[.,:/+\-])++",
    "chat": rf"[0-9](?:{_SIGN}|[A-Za-z0-9_.,:/+\-])*+{_LETTER}",
    "one": "[0-9]",
    "stack": "[ㄱ-ㅎ]{2,}[A-Za-z0-9]*",
    "version": r"[vV][0-9]+(?:\.[0-9]+)+",
    "exp": r"[eE][+\-]?[0-9]+",
    "power2": "[²³]",
    "nothing": "",
    "anything": ".+",
    "cluster": (
        # signs in a row, a sign with what follows, a digit behind another character, a digit with what follows
        rf"(?:[+\-]{{2,}}|[.,:/+\-]?{_SIGN}|[.,:/+\-](?=[0-9])|(?![A-Za-z0-9])[^\x00-\x7F\s\p{{Z}}\x{{85}}{HIDDEN}](?=[0-9])|[0-9]++(?={_GLUE})){_GLUE}*+"
    ),
    "rest": rf"(?:{_GOES_ON}|\.(?=[0-9]))*+",
    "glued": rf"{_GLUE}*+",
    "stop": "[.,]",
}

#: Larger ones, made of the others.
_COMPOSED = {
    "clock": "[(오전|오후) ]({d2}:{dd}[:{dd}]|{d2} 시[ {d2} 분[ {d2} 초]])",
    "colon": "[(오전|오후) ]{d2}:{dd}[:{dd}]",
    "date": "{yyyy}( - {d2} - {d2}| / {d2} / {d2}| . {d2} . {d2})",
    "fulldate": "{yyyy} 년 {d2} 월 {d2} 일",
    "monthday": "{d2} 월 {d2} 일",
    "yearmonth": "{yyyy} 년[ {d2} 월]",
    "phone": "({mobile}|{landline}|{hotline})",
}
_COMPOSED["calendar"] = "({fulldate}|{monthday}|{yearmonth})[{particle}]"
_COMPOSED["loose"] = "{clock}{tail}"
_COMPOSED["operand"] = "({date}[[.]{particle}]|{colon}[{particle}]|{sign} {number}[ {money}]|{number} ({unit}|{percent}))"


def compiled(template: str, parts: list[str] | None = None) -> str:
    """The pattern of a template; the names of its parts, in order, are added to ``parts``."""
    marks = {" ": _BLANK + "*", "_": _BLANK + "+", "[": "(?:", "]": ")?", "(": "(?:", ")": ")", "|": "|"}
    out = []
    for piece in re.findall(r"\{[^}]*\}|.", template):
        if piece[0] == "{" and len(piece) > 1:
            part, _, word = piece[1:-1].rpartition(":")
            body = WORDS[word] if word in WORDS else compiled(_COMPOSED[word])
            if part and parts is not None:
                parts.append(part)
            out.append(f"({body})" if part and parts is not None else f"(?:{body})")
        else:
            out.append(marks.get(piece) or re.escape(piece))
    return "".join(out)


#: Phrases of the scan: what must not stand on the left, the template, what must not stand on the right.
PHRASES = [
    # led by a word
    ("syllable", "(날짜|생일)[(은|는)] {d2}(.|/){d2}[{particle}]", "syllable"),
    ("syllable", "{label} [(:|#) ]{code_body}", "word"),
    ("syllable", "제 {number} {counter}{tail}", "any"),
    ("noun", "{some} {wunit}", "name"),
    # dates and times
    ("syllable", "{calendar} {wave} {calendar}{rest}", "any"),
    ("syllable", "({fulldate}|{monthday}){rest}", "any"),
    ("syllable", "{yearmonth}[{particle}]", "shut"),
    ("name", "{number} {end} {wave} {number} {end}[{particle}]", "shut"),
    ("syllable", "{loose} {wave} {loose}", "shut"),
    ("word", "{operand} {between} {operand}", "sum"),
    ("word", "{date}[[.]{particle}]{rest}", "any"),
    ("syllable", "{clock}{rest}", "any"),
    # numbers that are dialled, names of files and versions
    ("dial", "{phone}{no_chain}[{particle}]", "shut"),
    ("dial", "{dialled}{tail}", "shut"),
    ("dial", "{phone}{no_chain}{rest}", "any"),
    ("file", "{stem}.{extension}", "file"),
    ("word", "{version}", "word"),
    # money
    ("word", "([(+|-|−)]{sign} {number} {code}|{code} {sign} {number}|(+|-|−){sign} {number})", "shut"),
    ("word", "{sign} {number}[ {money}]", "glue"),
    ("word", "({code} {number}|{number} {code})[ {money}]", "glue"),
    ("word", "{number} {scale} 원[{particle}]", "glue"),
    ("word", "{number} {scale} {wave} {number} {scale} 원[{particle}]", "syllable"),
    # two numbers
    ("word", "{amount}_{amount}/{amount}[ {wunit}][{particle}]", "shut"),
    ("word", "{number}(_{operator} | {operator}_|_{minus}_){number}", "sum"),
    ("word", "{number} {plusminus} {number}[ {unit}]", "word"),
    ("name", "{number} {wave} {number} {side}[{particle}]", "shut"),
    ("name", "{number} {wave} {number}", "shut"),
    ("word", "{number} {wave} {number}{word}", "shut"),
    ("word", "[/]{ident} {relation} {number}[ ({unit}|{percent})]", "shut"),
    # a number and its unit
    ("digit", "{history}", "any"),
    ("name", "{lone}[{particle}]", "noun"),
    ("name", "({amount}/{amount} {wunit}|{number}[ {scale}] [여 ]{wunit})", "amount"),
    ("name", "{number}_{counter}{tail}", "name"),
    ("word", "{number}_{percent}", "word"),
    ("word", "{number}_{sign}", "word"),
    # a known word beside digits
    ("name", "{acronym}({hangul}{one}|{signs}{chat}){glued}", "any"),
]

#: Behind these in the scan: clusters, bare numbers, letters and scripts.
ATOMS = [
    ("word", "{cluster}", "any"),
    ("word", "{number}", "syllable"),
    ("letter", "{latin}{hyphen}{latin}", "letter"),
    ("word", "{identifier}", "word"),
    ("name", "{wunit}당[{particle}]", "noun"),
    ("name", "{acronym}", "name"),
    ("any", "{stack}", "any"),
    ("any", "{consonant}", "any"),
    ("any", "{han}", "any"),
    ("any", "{symbol}", "any"),
]

#: What nothing may be attached to: combining marks, format characters, conjoining letters.
ATTACHED = r"[\p{M}\p{Cf}\x{1100}-\x{11FF}\x{A960}-\x{A97F}\x{D7B0}-\x{D7FF}]"

#: Shapes with a reading, in order. Behind each, but where "=" ends its name, a particle and a stop may follow.
SHAPES = [
    ("decimal=", "{a:decimal}"),
    ("number=", "{a:number}"),
    ("number_punctuation=", "{a:number}{tail:stop}"),
    ("quantity_unit", "({a:amount}/{b:amount} {au:wunit}|{a:number}[ {bu:scale}] [{x:여} ]{au:wunit})"),
    ("percentage", "{a:number} {au:percent}"),
    ("time", "{x:clock}[{tail:particle}]"),
    ("korean_date", "{x:fulldate}[{tail:particle}]"),
    ("month_day", "{x:monthday}[{tail:particle}]"),
    ("year_month", "{x:yearmonth}[{tail:particle}]"),
    ("month", "{x:d2} 월[{tail:particle}]"),
    ("date", "{x:date}[[.]{tail:particle}]"),
    ("history", "{is_history}{x:day}{tail:event}"),
    ("phone", "{x:phone}[{tail:particle}]"),
    ("ipv4=", "{x:octets}"),
    ("version=", "{x:version}"),
    ("filename=", "{x:stem}.{extension}"),
    ("currency", "{x:sign} {a:number}[ {bu:money}]"),
    ("iso_currency", "({x:code} {a:number}|{a:number} {x:code})[ {bu:money}]"),
    ("scaled_currency", "{a:number} {au:scale} 원[{tail:particle}]"),
    ("scaled_range", "{a:number} {au:scale} {wave} {b:number} {bu:scale} 원[{tail:particle}]"),
    ("ordinal=", "제 {a:number} {au:counter}{tail:tail}"),
    ("range_both", "{a:number} {au:end} {wave} {b:number} {bu:end}[{tail:particle}]"),
    ("time_range=", "{x:loose} {wave} {tail:loose}"),
    ("range", "{a:number} {wave} {b:number}[ {bu:side}[{tail:particle}]]"),
    ("fraction", "{a:amount}/{b:amount}"),
    ("exponent", "{a:amount}^{b:power}"),
    ("number_hangul_unit", "{a:number} {au:counter}{tail:tail}"),
    ("number_suffix", "{a:number}{tail:particle}"),
    ("indefinite_unit=", "{x:some} {au:wunit}"),
    ("unit_per=", "{au:wunit}당[{tail:particle}]"),
    ("standalone_unit_symbol", "{au:lone}[{tail:particle}]"),
    ("acronym=", "{x:acronym}"),
    ("jamo=", "{x:consonant}"),
]

#: Shapes that are kept as written, in order.
KEPT = [
    ("contextual_short_date", "(날짜|생일){anything}"),
    ("contextual_identifier", "{label}{anything}"),
    ("unsupported_comparison", "[/]{ident} {relation} {number}[ ({unit}|{percent})]"),
    ("date_range", "{calendar} {wave} {calendar}{rest}"),
    ("mixed_fraction", "{amount}_{amount}/{amount}[ {wunit}][{particle}]"),
    ("unsupported_semantic_pair", "{operand} {between} {operand}[{particle}]"),
    ("mixed_currency", "([(+|-|−)]{sign} {number} {code}|{code} {sign} {number}|(+|-|−){sign} {number})"),
    ("mixed_numeric_context", "{acronym}({hangul}|{signs}){one}{anything}"),
    ("malformed_phone", "{dialled}{tail}"),
    ("malformed_structured", "({phone}|{clock}|{date}|{fulldate}|{monthday}){anything}"),
    ("unsupported_math", "{number}(_{operator} | {operator}_|_{minus}_){number}"),
    ("unsupported_range", "{number} {wave} {number} {word}"),
    ("ambiguous_hyphen", "{amount} - {amount}[ {unit}][{particle}][{stop}]"),
    ("ambiguous_numeric", "{long}"),
    (
        "unsupported_numeric",
        "([(+|-|−)].{digits}|{number}{exp}|{number} {sign}|{minus}{amount}/{amount}|{amount}^{power} {unit}|{number} {unit}(/{latin}|{power2})|{number} {plusminus} {number}[ {unit}])[{particle}][{stop}]",
    ),
    ("unsupported_prefixed_numeric", "{sign} {one}{anything}"),
    ("mixed_numeric_suffix", "{digits}{upto}{hangul}{latin}{anything_or_nothing}"),
    ("ambiguous_number_word", "{number}{hangul}"),
    ("ambiguous_identifier", "{ident}"),
    ("non_ascii_decimal", "{other_digits}"),
    ("non_ascii_numeric_cluster", "({digits}{beyond}{anything_or_nothing}|{beyond}{one}{anything_or_nothing})"),
    ("numeric_guard", "{one}{anything_or_nothing}"),
]
#: Kinds of pieces without a digit that are kept as written, in order.
KEPT_LETTERS = [
    ("ambiguous_latin_hyphen", "{latin}{hyphen}{latin}"),
    ("latin", "{latin}[{possessive}]"),
    ("jamo_cluster", "{stack}"),
    ("han", "{han}"),
    ("non_ascii_decimal", "{other_digits}"),
    ("unsupported_symbol", "{symbol}"),
]
WORDS |= {
    "upto": rf"{_GLUE}*?",
    "anything_or_nothing": ".*",
    "other_digits": r"[\p{Nd}&&[^0-9]]+",
    "beyond": r"[^\x00-\x7F]",
}

#: All kinds of pieces, by name.
KINDS = list(dict.fromkeys([k.rstrip("=") for k, _ in SHAPES] + [k for k, _ in KEPT + KEPT_LETTERS] + ["emergency", "numbered_item", "semantic_cluster"]))

#: Diagnostic code of kinds that are kept as written; of others it is ambiguous_numeric.
CODES = {
    "mixed_numeric_context": "ambiguous_identifier",
    "ambiguous_identifier": "ambiguous_identifier",
    "ambiguous_hyphen": "ambiguous_hyphen",
    "ambiguous_latin_hyphen": "unconverted_latin",
    "latin": "unconverted_latin",
    "han": "unconverted_han",
    "jamo_cluster": "unsupported_script",
    "unsupported_symbol": "unsupported_symbol",
    "attached": "unsupported_script",
}
#: Kinds of clusters whose code depends on the letters in them.
LOOSE_KINDS = ["unsupported_numeric", "mixed_numeric_suffix", "ambiguous_number_word", "non_ascii_numeric_cluster", "numeric_guard", "semantic_cluster"]


@cache
def scanner(lexicon: str = "") -> str:
    """The scan as one pattern. ``lexicon`` is the pattern of entries, which go first where both start at once.

    The groups call, item, word, odd and, with a lexicon, entry tell what the text around a piece decides.
    """
    call = rf"(?<call>{LEFT['word']}{compiled('{call}')}(?:{compiled('{particle}')}|(?!{_BLANK}+[가-힣A-Za-z])){RIGHT['shut']})"
    item = rf"(?<item>{LEFT['word']}{compiled('{number} 번')}(?={_BLANK}+{compiled('{thing}')}))"
    alternatives = [LEFT[a] + compiled(p) + RIGHT[b] for a, p, b in PHRASES + ATOMS]
    alternatives.append(f"(?<word>{LEFT['letter']}{compiled('{latin}[{possessive}]')}{RIGHT['letter']})")
    starts = "".join(sorted({w[0] for w in [*t.NUMBER_LABELS, *t.PLAIN_LABELS] if w[0] > "\x7f"} | set("날생제몇수오")))
    seen = rf"(?=[0-9A-Za-z.,:/+\-{re.escape(ASCII_SIGNS)}{starts}[^\x00-\x7F\s\p{{Z}}가-힣]]|[가-힣][0-9])"
    own = f"{seen}(?:{call}|{item}|{'|'.join(alternatives)})"
    both = f"(?<entry>{lexicon})|{own}" if lexicon else own
    return f"(?:{both})(?<odd>{ATTACHED}*)"


#: Fields of a piece, in order.
FIELDS = ("a", "au", "b", "bu", "x", "tail", "glue")


@cache
def shapes(separator: str) -> list[tuple[str, str, str]]:
    """(kind, anchored pattern, replacement that writes kind and FIELDS) of SHAPES."""
    out = []
    for kind, template in SHAPES:
        parts: list[str] = []
        body = compiled(template, parts)
        if kind.endswith("="):
            pattern = f"^{body}$"
        else:
            pattern, parts = f"^{body}({compiled('[{particle}][{stop}]')})$", [*parts, "glue"]
        groups = {f: "".join(f"${i}" for i, p in enumerate(parts, 1) if p == f) for f in FIELDS}
        out.append((kind.rstrip("="), pattern, separator.join([kind.rstrip("="), *groups.values()])))
    return out


def kept(letters: bool) -> list[tuple[str, str]]:
    """(kind, anchored pattern) of what is kept, without or with digits."""
    return [(k, f"^{compiled(p)}$") for k, p in (KEPT_LETTERS if letters else KEPT)]


_PATH = r"[A-Za-z0-9_.$()\-]+"
_PATH_END = r"(?![A-Za-z0-9_.$()\\/-])"
#: Structure that is never rewritten, before its end is trimmed: code, addresses, paths.
PROTECTED = "|".join(
    [
        r"(?<code>`++)(?:\\[^\n\r]|(?!\k<code>)[^\n\r])*+\k<code>",
        r"(?i:https?)://[^\s<>\[\]{}]+",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++(?![A-Za-z0-9_.-])",
        rf"(?<![A-Za-z0-9_])[A-Za-z]:(?:(?:\\{_PATH}(?: {_PATH})*+){{2,}}|\\[^\s<>\[\]{{}}()]+)",
        rf"(?<![A-Za-z0-9_\\])\\\\{_PATH}(?:\\{_PATH})++\\?{_PATH_END}",
        rf"(?<![\w.\\-])(?:\.\.?\\)+{_PATH}(?:\\{_PATH})*+\\?{_PATH_END}",
        rf"(?<![A-Za-z0-9_.$()\\-])(?:(?=[A-Za-z_()\\-]*[0-9.$]){_PATH}\\{_PATH}|{_PATH}(?:\\{_PATH}){{2}})(?:\\{_PATH})*+\\?{_PATH_END}",
        rf"(?<![\w./-])(?:\.\.?/)+{_PATH}(?:/{_PATH})*+/?{_PATH_END}",
        r"(?<![A-Za-z0-9_/.\x{3300}-\x{33FF}])/[^\s<>\[\]{}()]++(?![<>])",
    ]
)
#: What may stand in protected structure at all.
MAY_HOLD = r"[`@/\\]"
#: Not part of the structure at its end: punctuation, a particle behind ASCII, what no reader should miss.
END_STOPS = "[.,!?;:\"'”’]+$"
END_PARTICLE = rf"(?<=[A-Za-z0-9._/\\)-])(?:{'|'.join(t.longest_first(t.ADDRESS_PARTICLES))})$"
UNSAFE = r"(?s)[\p{Cc}\p{Cf}\p{Co}\p{Cn}&&[^\t\r\n]].*$"
