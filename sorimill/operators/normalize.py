"""Written text to spoken text: token stream, readings, rewrites and diagnostics.

All is one projection of Catalyst expressions: no shuffle, no Python worker. One
regular expression cuts the tokens out; each is then held as a whole against the
shapes of the grammar. Arrays of structs carry them through parsing, number facts
and reading.

Defined cases: null stays null; empty text stays empty; a text of syllables, blanks
and punctuation comes back as it is. Characters that the engine itself uses as marks
are set aside and come back unchanged.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grammar as g
from ..functions import render
from ..functions.composed import in_source, nfc, nfc_mapped
from ..functions.hangul import is_plain_korean
from ..functions.numbers import let, read_digitwise, read_native, read_sino
from . import classify

POLICIES = ("preserve", "warn", "error")
MAX_LENGTH = 10_000
#: Spoken text is at most so many times longer.
GROWTH = 16

# Marks: noncharacters, which no text should hold. If one does, ESCAPE and a code stand for it.
OPEN, CLOSE, SLOT, WALL, UNWALL = "\ufdd0\ufdd1\ufdd2\ufdd3\ufdd4"
ESCAPE = "\ufdd8"
_MARKS = [OPEN, CLOSE, SLOT, WALL, UNWALL, "\ufdd5", g.HIDDEN, "\ufdd7", ESCAPE]
_CODES = [chr(0xFDE0 + i) for i in range(len(_MARKS))]


def guarded(text: Column) -> Column:
    """The text without marks."""
    out = text
    for mark, code in reversed(list(zip(_MARKS, _CODES))):
        out = F.replace(out, F.lit(mark), F.lit(ESCAPE + code))
    return F.when(text.rlike(f"[{_MARKS[0]}-{_MARKS[-1]}]"), out).otherwise(text)


def unguarded(text: Column) -> Column:
    """The text as it was before ``guarded``."""
    out = text
    for mark, code in zip(_MARKS, _CODES):
        out = F.replace(out, F.lit(ESCAPE + code), F.lit(mark))
    return F.when(F.contains(text, F.lit(ESCAPE)), out).otherwise(text)


def _trimmed(found: Column) -> Column:
    """Protected structure without the punctuation, particle or bracket of the sentence around it."""
    inner = F.regexp_replace(F.regexp_replace(found, g.END_STOPS, ""), g.END_PARTICLE, "")

    def balanced(s: Column) -> Column:
        count = lambda sign: F.length(s) - F.length(F.replace(s, F.lit(sign), F.lit("")))
        closing = F.length(s) - F.length(F.regexp_replace(s, r"\)+$", ""))
        extra = F.greatest(F.lit(0), F.least(closing, count(")") - count("(")))
        return F.when(extra > 0, F.regexp_replace(F.substring(s, F.lit(1), F.length(s) - extra), g.END_STOPS, "")).otherwise(s)

    inner = F.when(found.rlike("^(?i:https?)://"), let(inner, balanced)).otherwise(inner)
    return F.regexp_replace(inner, g.UNSAFE, "")


def protected(text: Column) -> Column:
    """Pieces of a guarded text; those at odd places are protected structure.

    A piece behind a Latin letter, digit or underscore of such structure starts with g.HIDDEN.
    """

    def cut(parts: Column) -> Column:
        return let(F.transform(parts, lambda p, i: F.when(i % 2 == 1, _trimmed(p)).otherwise(p)), lambda kept: both(parts, kept))

    def both(parts: Column, kept: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            was, stays = F.get(parts, i - 1), F.get(kept, i - 1)
            hidden = F.when(stays.rlike("[A-Za-z0-9_]$"), g.HIDDEN).otherwise("")
            after = F.concat(hidden, F.substring(was, F.length(stays) + 1, F.length(was)), p)
            return F.when((i % 2 == 1) | (i == 0), p).otherwise(after)

        return F.transform(F.zip_with(parts, kept, lambda p, k: k), one)

    marked = F.split(F.regexp_replace(text, g.PROTECTED, f"{WALL}$0{UNWALL}"), f"[{WALL}{UNWALL}]")
    return F.when(text.rlike(g.MAY_HOLD), let(marked, cut)).otherwise(F.array(text))


def _record(piece: Column, has_lexicon: bool) -> Column:
    """(kind, token, p) of a piece of the scan; p has the parts of its shape."""

    def of(fields: Column) -> Column:
        call, item, word, odd, entry = (F.get(fields, F.lit(i)) for i in range(5))
        token = F.element_at(fields, -1)
        shaped = {k: (pattern, row) for k, pattern, row in g.shapes(SLOT)}
        lone = ("filename", "indefinite_unit", "unit_per", "standalone_unit_symbol", "acronym", "jamo")

        def chain(names, kept) -> Column:
            out = F.when(token.rlike("^[0-9]{11,}$"), "ambiguous_numeric")
            for k in names:
                pattern, row = shaped[k]
                out = out.when(token.rlike(pattern), F.regexp_replace(token, pattern, row))
            for k, pattern in kept:
                out = out.when(token.rlike(pattern), k)
            return out.otherwise("semantic_cluster")

        numbered = F.concat_ws(SLOT, F.lit("numbered_item"), F.regexp_replace(token, "[ \t]*번$", ""), F.lit("번"))
        fixed = F.when(odd != "", "attached")
        if has_lexicon:
            fixed = fixed.when(entry != "", "user_lexicon")
        emergency = F.concat_ws(SLOT, F.lit("emergency"), *[F.lit("")] * 4, F.substring(token, 1, 3), F.substring(token, 4, 99))
        fixed = fixed.when(call != "", emergency).when(item != "", numbered).when(word != "", "latin")
        digits = chain([k for k in shaped if k not in lone[1:]], g.kept(False))
        letters = chain(lone, g.kept(True))
        row = F.split(fixed.when(token.rlike("[0-9]"), digits).otherwise(letters), SLOT)
        return let(
            row,
            lambda r: F.struct(
                F.get(r, F.lit(0)).alias("kind"),
                token.alias("token"),
                F.struct(*[F.coalesce(F.get(r, F.lit(i)), F.lit("")).alias(f) for i, f in enumerate(g.FIELDS, 1)]).alias("p"),
            ),
        )

    return let(F.split(piece, SLOT), of)


def _plain(kind: str, token: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), token.alias("token"), F.struct(*[F.lit("").alias(f) for f in g.FIELDS]).alias("p"))


def _ranges(text: Column, lexicon: str = "") -> Column:
    """For each piece of ``protected`` the array of its (kind, token, p), gaps included."""
    slots = ["${call}", "${item}", "${word}", "${odd}", *(["${entry}"] if lexicon else []), "$0"]
    scan = g.scanner(lexicon)

    def piece(x: Column, i: Column) -> Column:
        marked = F.split(F.regexp_replace(x, scan, OPEN + SLOT.join(slots) + CLOSE), f"[{OPEN}{CLOSE}]")

        def one(q: Column, j: Column) -> Column:
            return F.when(j % 2 == 1, _record(q, bool(lexicon))).otherwise(_plain("gap", F.translate(q, g.HIDDEN, "")))

        found = F.when(i % 2 == 1, F.array(_plain("protected", x))).otherwise(F.transform(marked, one))
        return F.filter(found, lambda s: s["token"] != "")

    return F.transform(protected(guarded(text)), piece)


def tokens(text: Column) -> Column:
    """The token stream: array of (kind, token); gaps and protected structure included."""
    return F.transform(F.flatten(_ranges(text)), lambda x: F.struct(x["kind"].alias("kind"), unguarded(x["token"]).alias("token")))


def _code(kind: Column, token: Column) -> Column:
    code = F
    for name, value in g.CODES.items():
        code = code.when(kind == name, value)
    science = r"^[+\-−]?[0-9][0-9,]*(?:\.[0-9]+)?[eE][+\-]?[0-9]+[가-힣]*[.,]?$"
    loose = (
        F.when(~token.rlike("[0-9]") & ~token.rlike(r"[\p{N}&&[^²³⁴]]"), "unsupported_symbol")
        .when(token.rlike("[0-9]") & token.rlike("[A-Za-z]") & ~token.rlike(science), "ambiguous_identifier")
        .otherwise("ambiguous_numeric")
    )
    return code.when(kind.isin(*g.LOOSE_KINDS), loose).otherwise("ambiguous_numeric")


_GAP_CODES = {
    "unsupported_character": r"[\p{Cc}\p{Cf}\p{Co}\p{Cn}&&[^\t\r\n\x0b\x0c\x1c-\x1f\x{85}]]",
    "ambiguous_numeric": r"[\p{N}&&[^0-9]]",
    "unsupported_script": r"[ㄱ-ㆎ\x{1100}-\x{11FF}[\p{L}\p{M}&&[^가-힣A-Za-z]]]",
    "unsupported_symbol": r"[\p{S}=*<>\^~∼]",
}
_GAP_RUNS = "|".join(f"{c}+" for c in _GAP_CODES.values())


def _inspected(gap: Column) -> Column:
    """A gap in pieces (token, code): runs of characters that have no reading, and what stands between."""
    pieces = F.split(F.regexp_replace(gap, _GAP_RUNS, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]")

    def one(s: Column, i: Column) -> Column:
        code = F
        for name, pattern in _GAP_CODES.items():
            code = code.when(s.rlike(f"^{pattern}"), name)
        return F.struct(s.alias("token"), F.when(i % 2 == 1, code).alias("code"))

    return F.filter(F.transform(pieces, one), lambda s: s["token"] != "")


def _said(x: Column, values: Column | None, context: bool) -> Column:
    """(kind, token, spoken, rule, code, context) of (kind, token, p)."""

    def say(r: Column) -> Column:
        spoken, rule = render.reading(r)
        if values is not None:
            spoken = F.when(r["kind"] == "user_lexicon", F.element_at(values, r["token"])).otherwise(spoken)
            rule = F.when(r["kind"] == "user_lexicon", "normalizer.user_lexicon.v1").otherwise(rule)
        more = [render.in_context(r).alias("context")] if context else []
        return let(
            F.struct(r["kind"].alias("kind"), r["token"].alias("token"), spoken.alias("spoken"), rule.alias("rule"), *more),
            lambda s: F.struct(
                s["kind"].alias("kind"),
                s["token"].alias("token"),
                F.coalesce(s["spoken"], s["token"]).alias("spoken"),
                s["rule"].alias("rule"),
                F.when(s["spoken"].isNull(), _code(s["kind"], s["token"])).alias("code"),
                *([F.when(s["spoken"].isNotNull(), s["context"]).alias("context")] if context else []),
            ),
        )

    full = F.struct(x["kind"].alias("kind"), x["token"].alias("token"), x["p"].alias("p"), *render.facts_of(x["p"]))
    return let(full, say)


def _starts(stream: Column) -> Column:
    """Where each token of a stream begins, in code points of the text."""
    return F.aggregate(
        stream,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all")),
        lambda acc, s: F.struct((acc["at"] + F.length(unguarded(s["token"]))).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
        lambda acc: acc["all"],
    )


def _by_context(stream: Column, text: Column, analysis: Column, model: dict) -> Column:
    """The stream with numbers read as the model decides from an analyzer's tokens, if these fit the text."""

    def with_starts(at: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            c, start = s["context"], F.get(at, i)
            asked = F.struct(
                classify.features(analysis, text, start, start + F.length(c["number"]), start + c["length"], c["unit"]).alias("f"), c["site"].alias("site"), c["default"].alias("default")
            )

            def read(choice: Column) -> Column:
                number = F.when(choice == "native", read_native(c["number"])).when(choice == "digitwise", read_digitwise(c["number"])).otherwise(read_sino(c["number"]))
                spoken = F.when(choice.isNotNull(), F.concat(number, c["behind"])).otherwise(s["spoken"])
                rule = F.when(choice.isNotNull(), F.concat(F.lit("normalizer.number_context_"), choice, F.lit(".v1"))).otherwise(s["rule"])
                return s.withField("spoken", spoken).withField("rule", rule)

            return F.when(c.isNull(), s).otherwise(let(let(asked, lambda q: classify.choose(q["f"], q["site"], q["default"], model)), read))

        return F.transform(stream, one)

    asks = F.exists(stream, lambda s: s["context"].isNotNull()) & classify.fits(text, analysis)
    return F.when(asks, let(_starts(stream), with_starts)).otherwise(stream)


def spoken_tokens(text: Column, detail: bool = False, lexicon: tuple | None = None, context: tuple | None = None) -> Column:
    """Array of (kind, token, spoken, rule, code); spoken equals token where nothing changes.

    Tokens are guarded. With ``detail`` gaps are inspected; behind the first token or gap
    of a range that stays unread, later gaps of that range are not reported.
    ``lexicon`` is (pattern, map of readings), ``context`` (analyzer's tokens, model).
    """
    pattern, values = lexicon or ("", None)

    def of_range(items: Column) -> Column:
        said = F.transform(items, lambda x: _said(x, values, bool(context)))
        if not detail:
            return said

        def pieces(s: Column, i: Column) -> Column:
            base = F.struct(*[s[f].alias(f) for f in ("kind", "token", "spoken", "rule", "code")], *([s["context"].alias("context")] if context else []), i.alias("at"))
            own = lambda q: base.withField("token", q["token"]).withField("spoken", q["token"]).withField("code", q["code"])
            return F.when(s["kind"] == "gap", F.transform(_inspected(s["token"]), own)).otherwise(F.array(base))

        def suppressed(xs: Column) -> Column:
            first = F.array_min(F.transform(F.filter(xs, lambda x: x["code"].isNotNull()), lambda x: x["at"]))
            return let(first, lambda n: F.transform(xs, lambda x: F.when((x["kind"] == "gap") & (x["at"] > n), x.withField("code", F.lit(None).cast("string"))).otherwise(x)))

        return let(F.flatten(F.transform(said, pieces)), suppressed)

    stream = F.flatten(F.transform(_ranges(text, pattern), of_range))
    return let(stream, lambda s: _by_context(s, text, *context)) if context else stream


def read_tokens(text: Column) -> Column:
    """Array of (kind, token, spoken, rule, code) of composed text, gaps and protected structure included."""

    def shown(s: Column) -> Column:
        return F.struct(s["kind"].alias("kind"), unguarded(s["token"]).alias("token"), unguarded(s["spoken"]).alias("spoken"), s["rule"].alias("rule"), s["code"].alias("code"))

    return _once("read_tokens", nfc(text), lambda x: F.transform(spoken_tokens(x, detail=True), shown))


_BUILT: dict = {}


def _once(name, text: Column, build) -> Column:
    """The expression that ``build`` makes of a column, analysed once a session.

    It has thousands of nodes, each a call into the JVM, and lambdas in lambdas, each a
    round of the analyzer. So it is made of a column of its own; what the analyzer makes
    of it is kept, and other columns are put in that one's place.
    """
    context = SparkContext._active_spark_context
    if context is None or not hasattr(text, "_jc"):
        return build(text)
    if _BUILT.get("context") is not context:
        _BUILT.clear()
        _BUILT["context"] = context
    if name not in _BUILT:
        _BUILT[name] = _analysed(lambda x: let(x, build))
    return _in_place(_BUILT[name], text, context)


def _analysed(build):
    """The analysed expression of ``let(x, ..)`` over a string column x: an item of a transformed array."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()  # threads have no active one
    frame = spark.range(0).select(F.lit(None).cast("string").alias("x")).select(build(F.col("x")).alias("y"))
    return frame._jdf.queryExecution().analyzed().expressions().head().child()


def _in_place(item, text: Column, context: SparkContext) -> Column:
    jvm = context._jvm
    tools, seq = jvm.org.apache.spark.sql.classic.ExpressionUtils, jvm.PythonUtils.toSeq
    whole, at = item.children().head(), item.children().last()
    array, function = whole.children().head(), whole.children().last()
    whole = whole.withNewChildren(seq([array.withNewChildren(seq([tools.expression(text._jc)])), function]))
    return Column(tools.column(item.withNewChildren(seq([whole, at]))))


def _joined(stream: Column) -> Column:
    return unguarded(F.array_join(F.transform(stream, lambda s: s["spoken"]), ""))


def positive(name: str, value) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or value <= 0:
        raise ValueError(f"{name} must be a positive integer")
    return value


def checked(text: Column, max_length: int = MAX_LENGTH, what: str = "text") -> Column:
    """The text itself; a row longer than ``max_length`` code points raises."""
    positive("max_length", max_length)
    return F.when(F.length(text) > max_length, F.raise_error(F.lit(f"{what} is longer than {max_length} characters")).cast("string")).otherwise(text)


def _lexicon(entries: Mapping[str, str] | None) -> tuple | None:
    if not entries:
        return None
    from .lexicon import inline

    return inline(entries)


def _context(analysis: Column | None, model: dict | None) -> tuple | None:
    if (analysis is None) != (model is None):
        raise ValueError("reading by context takes both an analyzer's tokens and a model")
    return None if model is None else (analysis, model)


def _key(*parts):
    """What distinguishes two built expressions, or None if they can't be told apart by value."""
    return tuple(tuple(sorted(p.items())) if isinstance(p, Mapping) else p for p in parts)


def normalize(
    text: Column,
    max_length: int = MAX_LENGTH,
    *,
    max_output: int | None = None,
    lexicon: Mapping[str, str] | None = None,
    analysis: Column | None = None,
    model: dict | None = None,
) -> Column:
    """The spoken form of a text, in NFC; null stays null.

    ``lexicon``: readings of surface forms; ``analysis`` and ``model``: an analyzer's
    tokens (form, tag, start, end) of the composed text and the number-context model.
    """
    own, context = _lexicon(lexicon), _context(analysis, model)
    most = positive("max_output", max_output) if max_output is not None else GROWTH * positive("max_length", max_length)

    def spoken(x: Column) -> Column:
        read = checked(_joined(spoken_tokens(x, lexicon=own, context=context)), most, "spoken text")
        return (F.when(x.isNull(), None) if own else F.when(is_plain_korean(x), x)).when(x.isNotNull(), read)

    composed = nfc(checked(text, max_length))  # outside of what is analysed once, so that one may group by the result
    return let(composed, spoken) if context else _once(_key("normalize", most, lexicon), composed, spoken)


def convert(
    text: Column,
    on_ambiguous: str = "warn",
    max_length: int = MAX_LENGTH,
    *,
    lexicon: Mapping[str, str] | None = None,
    analysis: Column | None = None,
    model: dict | None = None,
) -> Column:
    """(source, normalized_text, rewrites, diagnostics, complete).

    Ranges are code points of the source. ``on_ambiguous``: "warn" lists what stays as
    written, "preserve" only marks the result incomplete, "error" raises at the first.
    """
    if on_ambiguous not in POLICIES:
        raise ValueError(f"on_ambiguous must be one of {', '.join(POLICIES)}")
    own, context = _lexicon(lexicon), _context(analysis, model)

    def build(source: Column) -> Column:
        both = F.struct(source.alias("source"), nfc_mapped(checked(source, max_length)).alias("m"))
        return let(both, lambda x: F.when(x["source"].isNotNull(), _converted(x["source"], x["m"], on_ambiguous, own, context)))

    return build(text) if context else _once(_key("convert", on_ambiguous, max_length, lexicon), text, build)


def _converted(source: Column, mapped: Column, on_ambiguous: str, own: tuple | None, context: tuple | None) -> Column:
    text = mapped["text"]

    def result(stream: Column) -> Column:
        def with_starts(at: Column) -> Column:
            placed = F.transform(stream, lambda s, i: F.struct(F.get(at, i).alias("start"), unguarded(s["token"]).alias("token"), unguarded(s["spoken"]).alias("spoken"), s["rule"].alias("rule"), s["code"].alias("code")))
            span = lambda x: [x["start"].alias("start"), (x["start"] + F.length(x["token"])).alias("end")]
            rewrites = F.transform(
                F.filter(placed, lambda x: x["token"] != x["spoken"]),
                lambda x: F.struct(*span(x), x["token"].alias("before"), x["spoken"].alias("after"), x["rule"].alias("rule_id"), F.lit("verbalization").alias("stage")),
            )
            composed = F.transform(
                mapped["rewrites"],
                lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["before"].alias("before"), r["after"].alias("after"), F.lit("unicode.nfc").alias("rule_id"), F.lit("unicode").alias("stage")),
            )
            report = lambda x, code, rule: F.struct(*span(x), code.alias("code"), rule.alias("rule_id"), F.lit("warning").alias("severity"), F.lit("verbalization").alias("stage"))
            reports = F.transform(
                F.filter(placed, lambda x: x["code"].isNotNull()), lambda x: report(x, x["code"], F.concat(F.lit("normalizer."), x["code"], F.lit(".v1")))
            )
            complete = F.size(reports) == 0
            if on_ambiguous == "error":
                complete = F.when(complete, True).otherwise(F.raise_error(F.concat(F.lit("no certain reading: "), F.get(reports, F.lit(0))["code"])).cast("boolean"))
            if context:  # rules stand in for a missing or unsound analysis, which is said once
                code = F.when(context[0].isNull(), "analyzer_unavailable").when(~classify.fits(text, context[0]), "analyzer_failed")
                asking = F.filter(F.zip_with(placed, stream, lambda x, s: F.when(s["context"].isNotNull(), x)), lambda x: x.isNotNull())
                failed = F.transform(F.when(code.isNotNull(), F.slice(asking, 1, 1)).otherwise(F.slice(asking, 1, 0)), lambda x: report(x, code, F.lit(None).cast("string")))
                reports = F.array_sort(F.concat(reports, failed), lambda a, b: a["start"] - b["start"])
            shown = F.slice(reports, 1, 0) if on_ambiguous == "preserve" else reports
            return F.struct(
                source.alias("source"), _joined(stream).alias("normalized_text"), F.concat(composed, in_source(rewrites, mapped)).alias("rewrites"), in_source(shown, mapped).alias("diagnostics"), complete.alias("complete")
            )

        return let(_starts(stream), with_starts)

    return let(spoken_tokens(text, detail=True, lexicon=own, context=context), result)


def rewrite_log(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """One row for each rewrite."""
    return df.select(*keys, F.explode(convert(F.col(text))["rewrites"]).alias("r")).select(*keys, "r.*")


def diagnostic_log(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """One row for each diagnostic."""
    return df.select(*keys, F.explode(convert(F.col(text))["diagnostics"]).alias("d")).select(*keys, "d.*")


def to_json(result: Column) -> Column:
    """A result as JSON text."""
    return F.to_json(result)


def write_json(df: DataFrame, text: str, path: str, *keys: str) -> None:
    """The results of a column, with its keys, as JSON lines."""
    df.select(*keys, convert(F.col(text)).alias("result")).write.json(path)
